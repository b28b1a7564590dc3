"""Numeric features of columns, and name n-grams for the learned classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import SIGNATURES, TYPE_FAMILIES
from ..functions.text import char_ngrams, entropy, normalize_name

USAGE_FEATURES = ["use_score", "use_is_used", "use_log_reads", "use_log_writes"]


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return F.when(F.size(values) > 0, total / F.nullif(F.size(values), F.lit(0))).otherwise(F.lit(0.0))


def _matches(values: Column, pattern: str) -> Column:
    return F.transform(values, lambda x: x.rlike(pattern).cast("int"))


def _num(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def feature_columns(include_usage: bool = False) -> dict[str, Column]:
    """name -> expression over the column relation (joined with usage where included)."""
    c = F.col
    tokens = F.filter(F.split(normalize_name(c("name")), " "), lambda t: t != "")
    v = F.filter(F.coalesce("sample_values", F.array().cast("array<string>")), lambda x: x.isNotNull())
    lengths, words = F.transform(v, F.length), F.transform(v, lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != "")))
    digits = F.transform(F.filter(v, lambda x: x != ""), lambda x: (F.length(x) - F.length(F.regexp_replace(x, "[0-9]", ""))) / F.length(x))
    mean_len = _mean(lengths)
    spread = F.sqrt(F.greatest(F.lit(0.0), _mean(F.transform(lengths, lambda x: x * x)) - mean_len * mean_len))  # population form
    out = {
        "name_len": _num(F.length("name")), "name_tokens": _num(F.size(tokens)), "name_has_digit": _num(c("name").rlike("[0-9]")), "name_avg_token_len": _mean(F.transform(tokens, F.length)),
        **{f"type_{t}": _num(c("generic_type") == t) for t in TYPE_FAMILIES},
        "type_char_max_len": _num(c("char_max_length")), "type_numeric_precision": _num(c("numeric_precision")),
        "is_temporal": _num(c("is_temporal")), "is_nullable": _num(c("nullable")), "is_primary_key": _num(c("is_primary_key")), "is_foreign_key": _num(c("is_foreign_key")), "is_unique": _num(c("is_unique")), "is_indexed": _num(c("is_indexed")),
        "has_comment": _num(F.coalesce("comment", F.lit("")) != ""),
        "n_samples": _num(F.size(v)), "null_rate": _num(c("sample_null_fraction")), "distinct_ratio": F.when(F.size(v) > 0, _num(c("distinct_in_sample")) / F.nullif(F.size(v), F.lit(0))).otherwise(0.0),
        "val_len_mean": mean_len, "val_len_max": _num(F.array_max(lengths)), "val_len_std": spread, "val_entropy_mean": _mean(F.transform(v, entropy)), "val_words_mean": _mean(words), "val_is_freetext": _num(_mean(words) >= 3.0),
        "val_digit_ratio": _mean(digits), "val_space_frac": _mean(F.transform(v, lambda x: x.contains(" ").cast("int"))),
        **{f"sig_{s}": _mean(_matches(v, p)) for s, p in SIGNATURES.items()},
    }
    if include_usage:
        out |= {"use_score": _num(c("use_score")), "use_is_used": _num(c("use_is_used")), "use_log_reads": F.log1p(_num(c("use_reads"))), "use_log_writes": F.log1p(_num(c("use_writes")))}
    return out


def kinds_of(columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(qualified_name, kind) of all columns, and one column for each different description, with the kind as its name.

    A kind is the digest of all fields but the name; what is made of a kind holds for each of its columns.
    """
    fields = [c for c in columns.columns if c != "qualified_name"]
    keyed = columns.withColumn("kind", F.sha2(F.to_json(F.struct(*fields)), 256))
    return keyed.select("qualified_name", "kind"), keyed.select(F.col("kind").alias("qualified_name"), *fields).dropDuplicates(["qualified_name"])


def featurize(columns: DataFrame, usage: DataFrame | None = None) -> DataFrame:
    """columns (⟕ usage) -> (qualified_name, one column per feature, ngrams array<string>)."""
    c = columns
    if usage is not None:
        u = usage.select("qualified_name", F.col("score").alias("use_score"), F.col("is_used").alias("use_is_used"), F.col("read_count").alias("use_reads"), F.col("write_count").alias("use_writes"))
        c = c.join(u, "qualified_name", "left")
    return c.select("qualified_name", *[e.alias(n) for n, e in feature_columns(usage is not None).items()], char_ngrams(normalize_name(F.col("name"))).alias("ngrams"))
