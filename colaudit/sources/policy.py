"""Retention policies: small driver-side records that become broadcast rows or literals."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions.text import glob_pattern


@dataclass
class RetentionPolicy:
    default_days: int = 365
    tables: dict[str, int] = field(default_factory=dict)
    columns: dict[str, int] = field(default_factory=dict)
    anchors: dict[str, str] = field(default_factory=dict)
    exclude: list[str] = field(default_factory=list)

    @classmethod
    def from_dict(cls, d: dict) -> RetentionPolicy:
        days = lambda m: {k: int(v) for k, v in (m or {}).items()}
        return cls(int(d.get("default_days", 365)), days(d.get("tables")), days(d.get("columns")), dict(d.get("anchors") or {}), list(d.get("exclude") or []))

    @classmethod
    def from_file(cls, spark: SparkSession, path: str) -> RetentionPolicy:
        """YAML by suffix, else JSON, from any path that Spark reads."""
        text = spark.read.text(path, wholetext=True).first()[0]
        if path.endswith((".yaml", ".yml")):
            import yaml

            return cls.from_dict(yaml.safe_load(text) or {})
        return cls.from_dict(json.loads(text))

    def to_dict(self) -> dict:
        return asdict(self)

    # a policy is read by people and has tens of rows: literals keep it out of any shuffle
    def _lookup(self, values: dict, key: Column, kind: str) -> Column:
        if not values:
            return F.lit(None).cast(kind)
        return F.create_map(*[F.lit(x).cast("string" if i % 2 == 0 else kind) for kv in values.items() for i, x in enumerate(kv)])[key]

    def days_for(self, table: Column, column: Column | None = None) -> Column:
        """struct<days, source>: the column's days, else its table's, else the default."""
        pair = lambda days, source: F.when(days.isNotNull(), F.struct(days.alias("days"), F.lit(source).alias("source")))
        options = [pair(self._lookup(self.columns, F.concat_ws(".", table, column), "int"), "column")] if column is not None else []
        return F.coalesce(*options, pair(self._lookup(self.tables, table, "int"), "table"), F.struct(F.lit(self.default_days).alias("days"), F.lit("default").alias("source")))

    def anchor_for(self, table: Column) -> Column:
        return self._lookup(self.anchors, table, "string")

    def is_excluded(self, table: Column, column: Column) -> Column:
        name, out = F.concat_ws(".", table, column), F.lit(False)
        for g in self.exclude:
            out = out | name.rlike(glob_pattern(g))
        return out
