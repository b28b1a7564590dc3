"""Schema introspection and profiling of tables: the column relation M."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import places
from ..functions.types import TEMPORAL, family_of_spark
from ..schemas import COLUMNS, CONSTRAINTS, TABLES
from ..scratch import keep


class MissingTables(LookupError):
    pass


def pick_tables(available: Mapping[str, DataFrame], wanted: list[str] | None) -> dict[str, DataFrame]:
    """The wanted tables by name, in order; an error names those that are missing."""
    if wanted is None:
        return dict(sorted(available.items()))
    if missing := sorted(set(wanted) - set(available)):
        raise MissingTables(f"no such tables: {', '.join(missing)}")
    return {t: available[t] for t in sorted(wanted)}


def catalog_tables(spark: SparkSession, database: str | None = None) -> dict[str, DataFrame]:
    return {t.name: spark.table(f"{database}.{t.name}" if database else t.name) for t in spark.catalog.listTables(database)}


def text_of(c: Column, kind: str) -> Column:
    """A value of a type as sample text: numbers and times as they print, bytes by length, collections as JSON."""
    if kind == "binary":
        return F.when(c.isNotNull(), F.format_string("<%d bytes>", F.length(c)))
    if kind.startswith(("array", "map", "struct", "variant")):
        return F.to_json(c)
    if kind.startswith("decimal"):
        return c.cast("double").cast("string")
    if kind in ("timestamp", "timestamp_ntz"):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return c.cast("string")


def as_text(df: DataFrame, name: str) -> Column:
    return text_of(df[name], dict(df.dtypes)[name])


def sample_rows(df: DataFrame, n: int = 30) -> DataFrame:
    """The n rows of least hash of their content: random, but the same each time.

    Each task keeps n rows, so n rows a task go through the shuffle.  Only maps, which have no hash, become JSON first.
    """
    hashed = [F.to_json(F.struct(df[c])) if "map<" in kind or "variant" in kind else df[c] for c, kind in df.dtypes]
    return df.orderBy(F.xxhash64(*hashed), *[df[c] for c, kind in df.dtypes if kind in ("bigint", "int", "string")]).limit(n)


def unpivot(df: DataFrame) -> DataFrame:
    """(column, ordinal, value) of all cells, values as text."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("ordinal"), as_text(df, c).alias("value")) for i, c in enumerate(df.columns, 1)])
    return df.select(F.explode(cells).alias("x")).select("x.*")


def profile_sample(df: DataFrame, n: int = 30, k: int = 12) -> DataFrame:
    """(column, sample_size, sample_null_fraction, distinct_in_sample, sample_values) of a bounded sample."""
    cells = unpivot(sample_rows(df, n))
    return cells.groupBy("column").agg(
        F.count("*").cast("int").alias("sample_size"),
        F.round(F.avg(F.col("value").isNull().cast("int")), 4).alias("sample_null_fraction"),
        F.count_distinct("value").cast("int").alias("distinct_in_sample"),
        F.slice(F.array_sort(F.collect_set("value")), 1, k).alias("sample_values"),
    )


def profile_full(df: DataFrame) -> DataFrame:
    """(column, ordinal, n_rows, n_null, n_distinct, min_text, max_text) of a whole table.

    Each row is expanded into its cells on the map side and counted by column: partial
    aggregates go through the shuffle, and distinct values are spread by value.
    """
    cells = unpivot(df)
    values = cells.groupBy("column", "ordinal", "value").agg(F.count("*").alias("n"))
    return values.groupBy("column", "ordinal").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).cast("long").alias("n_null"),
        F.count("value").alias("n_distinct"),
        F.min("value").alias("min_text"),
        F.max("value").alias("max_text"),
    )


def spans(df: DataFrame, cutoff: Callable[[str], Column] | None = None) -> DataFrame:
    """One aggregate over the temporal columns alone: (row_count, spans array<struct<column, min_value, max_value, late>>).

    Values are compared in their own type and become text afterwards.  cutoff: a column's name -> the time before which a
    row is late; late counts those rows.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields if family_of_spark(f) in TEMPORAL}
    late = lambda c: F.count_if(df[c] < cutoff(c).cast(kinds[c])) if cutoff else F.lit(None).cast("long")
    parts = [F.struct(F.lit(c).alias("column"), text_of(F.min(df[c]), k).alias("min_value"), text_of(F.max(df[c]), k).alias("max_value"), late(c).alias("late")) for c, k in kinds.items()]
    empty = F.array().cast("array<struct<column: string, min_value: string, max_value: string, late: bigint>>")
    return df.agg(F.count("*").alias("row_count"), (F.array(*parts) if parts else empty).alias("spans"))


def measure(tables: Mapping[str, DataFrame], cutoff: Callable[[str, str], Column] | None = None) -> DataFrame:
    """(table, row_count, spans): one scan of each table's temporal columns, written once as a row for each table."""
    one = lambda t, df: spans(df, (lambda c: cutoff(t, c)) if cutoff else None).select(F.lit(t).alias("table"), "row_count", "spans")
    return keep(reduce(DataFrame.unionAll, [one(t, df) for t, df in tables.items()]), "measured")


def sampled(tables: Mapping[str, DataFrame], n: int = 30, k: int = 12) -> DataFrame:
    """``profile_sample`` of all tables, written once: one more scan of each, which passes on n rows a task."""
    return keep(reduce(DataFrame.unionByName, [profile_sample(df, n, k).withColumn("table", F.lit(t)) for t, df in tables.items()]), "sampled")


def live(measured: DataFrame) -> DataFrame:
    """(qualified_name, rows_total, rows_overdue, fraction_overdue) of a measure with cut-offs, where a column has a value."""
    x = measured.select("table", F.col("row_count").alias("rows_total"), F.explode("spans").alias("s")).where("s.min_value is not null")
    share = F.when(F.col("rows_total") > 0, places(F.col("s.late") / F.nullif("rows_total", F.lit(0)))).otherwise(F.lit(0.0))
    return x.select(F.concat_ws(".", "table", "s.column").alias("qualified_name"), "rows_total", F.col("s.late").alias("rows_overdue"), share.alias("fraction_overdue"))


def extract(tables: Mapping[str, DataFrame], constraints: DataFrame | None = None, wanted: list[str] | None = None, sample: int = 30, max_samples: int = 12, measured: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(columns, tables) of the given tables; constraints add keys, uniqueness and families.

    measured: what ``measure`` found, where the caller has it already.
    """
    chosen = pick_tables(tables, wanted)
    if not chosen:
        raise MissingTables("no tables to profile")
    spark = next(iter(chosen.values())).sparkSession
    fields = [
        (t, f.name, i, family_of_spark(f), f.dataType.simpleString(), f.nullable, (f.metadata or {}).get("comment"), getattr(f.dataType, "length", None), getattr(f.dataType, "precision", None))
        for t, df in chosen.items()
        for i, f in enumerate(df.schema.fields, 1)
    ]
    schema = "`table` string, name string, ordinal int, family string, raw_type string, nullable boolean, comment string, char_max_length int, numeric_precision int"
    measured = measure(chosen) if measured is None else measured
    times = measured.select("table", F.explode("spans").alias("s")).select("table", F.col("s.column").alias("name"), "s.min_value", "s.max_value")
    rows = spark.createDataFrame(fields, schema).join(sampled(chosen, sample, max_samples).withColumnRenamed("column", "name"), ["table", "name"], "left").join(times, ["table", "name"], "left")
    counts = measured.select(F.col("table").alias("name"), "row_count")
    known = constraints if constraints is not None else spark.createDataFrame([], CONSTRAINTS)
    known = known.select("table", "name", *[F.col(c).alias(f"c_{c}") for c in ("is_primary_key", "is_foreign_key", "foreign_key_target", "is_unique", "is_indexed", "generic_type")])
    rows = rows.join(known, ["table", "name"], "left")
    flag = lambda c: F.coalesce(F.col(f"c_{c}"), F.lit(False)).alias(c)
    family = F.coalesce("c_generic_type", "family")
    columns = rows.select(
        F.concat_ws(".", "table", "name").alias("qualified_name"), "table", "name", "ordinal", family.alias("generic_type"), "raw_type", "nullable", F.lit(None).cast("string").alias("default"), "comment",
        flag("is_primary_key"), flag("is_foreign_key"), F.col("c_foreign_key_target").alias("foreign_key_target"),
        (F.coalesce(F.col("c_is_unique"), F.lit(False)) | F.coalesce(F.col("c_is_primary_key"), F.lit(False))).alias("is_unique"), flag("is_indexed"),
        "char_max_length", "numeric_precision", family.isin(*sorted(TEMPORAL)).alias("is_temporal"),
        F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"), F.coalesce("sample_size", F.lit(0)).alias("sample_size"), F.coalesce("sample_null_fraction", F.lit(0.0)).alias("sample_null_fraction"), F.coalesce("distinct_in_sample", F.lit(0)).alias("distinct_in_sample"), "min_value", "max_value",
    )
    keys = known.where("c_is_primary_key").groupBy(F.col("table").alias("name")).agg(F.array_sort(F.collect_set("name")).alias("primary_key"))
    tables_df = counts.join(keys, "name", "left").select("name", F.lit(None).cast("string").alias("schema"), "row_count", F.lit(None).cast("string").alias("comment"), F.coalesce("primary_key", F.array().cast("array<string>")).alias("primary_key"))
    return columns, tables_df


def save_document(columns: DataFrame, tables: DataFrame, path: str) -> None:
    """Writes the metadata as JSON documents, one per table with its columns nested."""
    nested = columns.groupBy(F.col("table").alias("name")).agg(F.array_sort(F.collect_list(F.struct("ordinal", *[c for c in columns.columns if c != "ordinal"]))).alias("columns"))
    tables.join(nested, "name", "left").write.mode("overwrite").json(path)


def load_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Reads what ``save_document`` wrote; unknown keys are dropped, missing ones are null."""
    docs = spark.read.schema(f"{TABLES}, columns array<struct<{_nested(COLUMNS)}>>").json(path)
    names = spark.createDataFrame([], COLUMNS).columns
    return docs.select(F.explode("columns").alias("c")).select(*[F.col(f"c.{n}") for n in names]), docs.drop("columns")


def _nested(ddl: str) -> str:
    return ", ".join(f"{a}: {b}" for a, b in (x.strip().split(" ", 1) for x in ddl.split(", ")))
