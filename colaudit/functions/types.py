"""Type families of native type names and of Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

TEMPORAL = frozenset({"date", "timestamp", "timestamptz", "time", "timetz"})

#: Native names of each family.
NATIVE = {
    "string": "varchar char bpchar character name citext".split() + ["character varying"],
    "text": ["text"],
    "integer": "smallint int integer bigint serial bigserial smallserial int2 int4 int8".split(),
    "numeric": "numeric decimal money".split(),
    "float": "real float float4 float8 double".split() + ["double precision"],
    "boolean": "boolean bool".split(),
    "date": ["date"],
    "timestamp": ["timestamp", "timestamp without time zone"],
    "timestamptz": ["timestamptz", "timestamp with time zone"],
    "time": ["time", "time without time zone"],
    "timetz": ["timetz", "time with time zone"],
    "interval": ["interval"],
    "uuid": ["uuid"],
    "inet": "inet cidr macaddr".split(),
    "json": "json jsonb".split(),
    "bytes": "bytea blob".split(),
    "array": ["array"],
}
_FAMILY = {name: family for family, names in NATIVE.items() for name in names}


def family_of_native(raw: str) -> str:
    """varchar(20) -> string; unknown names by what they contain, else other."""
    name = raw.lower().strip()
    if name.endswith("[]"):
        return "array"
    name = name.split("(")[0].strip()
    if name in _FAMILY:
        return _FAMILY[name]
    if "char" in name or "text" in name:
        return "string"
    return "integer" if "int" in name else "other"


def family_of_spark(field: T.StructField) -> str:
    """A field's family; ``metadata={'family': ...}`` overrides it for types files do not have."""
    if "family" in (field.metadata or {}):
        return field.metadata["family"]
    t = field.dataType
    for kinds, family in (
        ((T.CharType, T.VarcharType), "string"),
        ((T.StringType,), "text"),
        ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "integer"),
        ((T.DecimalType,), "numeric"),
        ((T.FloatType, T.DoubleType), "float"),
        ((T.BooleanType,), "boolean"),
        ((T.DateType,), "date"),
        ((T.TimestampNTZType,), "timestamp"),
        ((T.TimestampType,), "timestamptz"),
        ((T.DayTimeIntervalType, T.YearMonthIntervalType), "interval"),
        ((T.StructType, T.MapType), "json"),
        ((T.BinaryType,), "bytes"),
        ((T.ArrayType,), "array"),
    ):
        if isinstance(t, kinds):
            return family
    return {"TimeType": "time", "VariantType": "json"}.get(type(t).__name__, "other")
