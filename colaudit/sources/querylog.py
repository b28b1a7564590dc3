"""Query-log readers; batch and streaming share the schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import split_names

_RAW = "ts string, query_id string, template string, service string, db_user string, operation string, columns_read {0}, columns_written {0}, rows string, sql string"


def _typed(raw: DataFrame, lists) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return raw.where("ts is not null").select(
        F.try_to_timestamp("ts").alias("ts"), text("query_id"), F.upper(F.coalesce("operation", F.lit(""))).alias("operation"), text("sql"), text("service"), text("db_user"), text("template"),
        lists("columns_read").alias("declared_reads"), lists("columns_written").alias("declared_writes"), F.col("rows").try_cast("int").alias("rows"),
    )


def _jsonl(reader) -> DataFrame:
    empty = F.array().cast("array<string>")
    return lambda path: _typed(reader.schema(_RAW.format("array<string>")).json(path), lambda c: F.coalesce(F.col(c), empty))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return _jsonl(spark.read)(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    # the header names the columns; a schema by name needs them read as text
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    for c in _RAW.format("string").split(", "):
        if (name := c.split()[0]) not in raw.columns:
            raw = raw.withColumn(name, F.lit(None).cast("string"))
    return _typed(raw, lambda c: split_names(F.col(c)))


def stream_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return _jsonl(spark.readStream)(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """By suffix; for other files the first character tells JSON lines from CSV."""
    if path.endswith((".jsonl", ".json", ".ndjson")):
        return read_jsonl(spark, path)
    if path.endswith(".csv"):
        return read_csv(spark, path)
    first = spark.read.text(path).where("trim(value) <> ''").first()
    return read_jsonl(spark, path) if first and first[0].lstrip("\ufeff ").startswith("{") else read_csv(spark, path)


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """The labelled catalogue: one row per column with tier, score, type and expected usage."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)  # the header names the columns
    kinds = {"table": "string", "column": "string", "sensitivity_tier": "string", "sensitivity_score": "double", "pii_type": "string", "expected_usage": "string", "seeded_stale_rows": "boolean", "rationale": "string"}
    rows = raw.select(*[(F.col(c).try_cast(k) if c in raw.columns else F.lit(None).cast(k)).alias(c) for c, k in kinds.items()])
    return rows.select(F.concat_ws(".", "table", "column").alias("qualified_name"), "*", F.col("sensitivity_tier").isin("high", "medium").alias("is_sensitive"))
