"""The training-text pipeline: five operators over the documents table, each on what the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colaudit.llm import decontaminate, pii, resample, simhash
from colaudit.llm.common import shared_dir, table
from colaudit.llm.entries import bpe_round_trip, pii_key


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling rejects go.

    Null or empty texts have importance one; very long texts are scored by all their n-grams; repeated rows are kept
    or dropped together, ties at the last kept key all stay; an empty table stays empty; other columns pass.
    """
    return resample.sample(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id stays.

    Rows equal in id and text are one document.  Rows without an id get one from a hash of their text, above all
    others, for this stage only.  Null texts count as empty and texts without words link with each other; very long texts are
    hashed whole; an empty table stays empty; other columns pass.
    """
    name = "_key"
    while name in docs.columns:
        name += "_"
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = F.col("doc_id").cast("long")
    keyed = docs.withColumn(name, F.coalesce(own, F.xxhash64(text).bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)))
    groups = simhash.near_duplicates(keyed.select(F.col(name).alias("doc_id"), "text"))
    keep = groups.where("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    return keyed.join(keep, name, "left_semi").dropDuplicates([name, "text"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go.

    Null or empty texts have no overlap and stay; very long texts are searched whole; repeated rows go or stay together;
    an empty table stays empty; other columns pass.
    """
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced in the texts.

    Null texts stay null, empty ones empty; very long texts are read whole; of overlapping finds the earlier, then the kind
    listed first, wins; repeated rows give equal results; an empty table stays empty; other columns pass.
    """
    return pii.pseudonymise(docs, pii_key(spark), spans=None)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, text): token ids and the text they decode to.

    Null texts count as empty and have no ids; very long texts are encoded whole; repeated rows are encoded each; an empty
    table gives no rows; other columns go.
    """
    done = bpe_round_trip(docs)
    return done.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.decode("decoded", "UTF-8").alias("text"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", pseudonyms),
    ("byte-level BPE encoding and decoding", byte_bpe),
]

#: SQL expresses neither the hashed models nor XXH64, Feistel networks or BPE; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    top = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
    return docs
