"""Importance resampling with hashed n-gram models.

Two bags of words and word pairs, hashed to buckets, are modelled: the target (documents labelled
good) and the raw text (all documents).  A document's log importance is the log ratio of the two models
over its n-grams, the mean times their number, ``passage`` at most (None: times their number).  That is the ratio of
a passage of so many n-grams drawn from the text: n-grams of one text are not independent, and the small error of
each, times thousands of them, would outweigh any evidence.  Each key is the log importance plus Gumbel noise drawn from a hash of the id; the
documents with the k greatest keys are a sample without replacement in proportion to importance.

k is given, or is the number of documents at least as important as a share ``RATE`` of good documents is:
the labelled good documents are dealt into two halves by a hash of their ids, one is the target, and the
importances of the other half, which the model has not seen, tell which importance that share reaches.

The k-th greatest key is found by counting keys in ever finer intervals; nothing is sorted
as a whole and no key list leaves Spark.

The number of buckets grows with the corpus as its vocabulary does, with the root of its size: ``SPREAD`` times
the root of its bytes, from ``MIN_BUCKETS`` to ``MAX_BUCKETS`` (four million: 32 MB a worker, the bound of
what is broadcast).  The raw model counts every document; the target model and the held-out half have at most
``max_target`` labelled documents together, the first by hash of the id.  The target's counts are smoothed
towards the raw distribution by ``SMOOTH`` counts a bucket, so buckets that few target documents reach
say little.

Defined results: a null or empty text has no n-grams and importance one; a very long text is scored by all
its n-grams, scaled to a passage's number; null ids draw the same noise; rows with equal keys are kept
or dropped together, so ties at the k-th key may keep more than k rows; without two target labels all
importances are one and all rows are kept; an empty table gives no rows; other columns pass.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import chunks, powers
from .common import forget, mix, save

MIN_BUCKETS, MAX_BUCKETS, SPREAD = 1 << 12, 1 << 22, 2
MAX_TARGET, SMOOTH, RATE, PASSAGE, SEED = 20_000, 256.0, 0.995, 400, 1
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def ngrams(column: pa.Array, buckets: int):
    """(first row, last row + 1, rows, bucket numbers): the words and the pairs of neighbours of each text."""
    by_byte = powers()
    for low, high, words in chunks(column):
        h = words.hashes(by_byte)[0]
        row = np.repeat(np.arange(high - low), words.sizes)
        same = row[1:] == row[:-1]
        pairs = mix(h[:-1] * _PAIR + h[1:])[same]
        found = np.concatenate([h, pairs]) % np.uint64(buckets)
        yield low, high, np.concatenate([row, row[1:][same]]), found.astype(np.int64)


def gumbel(doc_id: int | None, seed: int = SEED) -> float:
    u = (xxhash.xxh64_intdigest(b"" if doc_id is None else str(doc_id).encode(), seed) + 0.5) / 2.0**64
    return float(-np.log(-np.log(u)))


class Model:
    """Log ratio of target and raw probability by bucket, and the good documents that it has not seen."""

    def __init__(self, target: np.ndarray, raw: np.ndarray, held: frozenset = frozenset(), smooth: float = SMOOTH, passage: int | None = PASSAGE):
        n = len(raw)
        p = (raw + 0.5) / (raw.sum() + 0.5 * n)
        q = (target + smooth * n * p) / (target.sum() + smooth * n) if target.sum() else p
        self.ratio, self.held, self.passage = np.log(q) - np.log(p), held, passage

    def importance(self, column: pa.Array) -> np.ndarray:
        """The log importance of each text of a column."""
        parts = [np.empty(0)]
        for low, high, row, bucket in ngrams(column, len(self.ratio)):
            n = np.bincount(row, minlength=high - low)
            whole = np.bincount(row, self.ratio[bucket], high - low)
            parts.append(whole if self.passage is None else whole * np.minimum(1, self.passage / np.maximum(1, n)))
        return np.concatenate(parts)


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def bucket_count(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return min(MAX_BUCKETS, max(MIN_BUCKETS, SPREAD * math.isqrt(size)))


def fit(docs: DataFrame, labels: DataFrame, max_target: int = MAX_TARGET, buckets: int | None = None, smooth: float = SMOOTH, passage: int | None = PASSAGE, split: int = 0) -> Model:
    """docs(doc_id, text), labels(doc_id, quality): one pass over the documents counts both bags.

    split: another number deals the good documents into other halves.
    """
    buckets = buckets or bucket_count(docs)
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("q")).where("doc_id is not null and q in (0, 1)")
    good = good.groupBy("doc_id").agg(F.min("q").alias("q")).where("q = 1").orderBy(F.xxhash64("doc_id", F.lit(split)) if split else F.xxhash64("doc_id"), "doc_id").limit(max_target)
    drawn = [r[0] for r in good.select("doc_id").collect()]
    target, held = frozenset(drawn[::2]), frozenset(drawn[1::2])  # they come in the order of their hashes
    if not held:
        target = held
    sent = docs.sparkSession.sparkContext.broadcast(target)

    def count(batches):
        chosen = np.array(sorted(sent.value), np.int64)
        bags = np.zeros((2, buckets), np.int64)
        for b in batches:
            ids = b.column(0)
            marked = np.isin(ids.fill_null(0).to_numpy(), chosen) & ids.is_valid().to_numpy(zero_copy_only=False)
            for low, high, row, bucket in ngrams(b.column(1), buckets):
                np.add.at(bags[0], bucket, 1)
                np.add.at(bags[1], bucket[marked[low:high][row]], 1)
        at = np.flatnonzero(bags[0])
        for k in range(0, len(at), 100_000):
            part = at[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(bags[0][part]), pa.array(bags[1][part])], ["bucket", "raw", "target"])

    counted = _source(docs).mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    bags = np.zeros((2, buckets))
    for k, name in enumerate(("raw", "target")):
        bags[k, counted["bucket"].to_numpy()] = counted[name].to_numpy()
    return Model(bags[1], bags[0], held, smooth, passage)


def _keys(column_of_ids: pa.Array, importance: np.ndarray, seed: int) -> np.ndarray:
    return importance + np.array([gumbel(i, seed) for i in column_of_ids.to_pylist()], float)


def importances(docs: DataFrame, model: Model, seed: int = SEED) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, log_importance, key, held): held marks the good documents that the model has not seen."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        held = np.array(sorted(model.held), np.int64)
        for b in batches:
            ids = b.column(0)
            w = model.importance(b.column(1))
            unseen = np.isin(ids.fill_null(0).to_numpy(), held) & ids.is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([ids, pa.array(w), pa.array(_keys(ids, w, seed)), pa.array(unseen)], ["doc_id", "log_importance", "key", "held"])

    return _source(docs).mapInArrow(run, "doc_id long, log_importance double, key double, held boolean")


def kth_greatest(values: DataFrame, column: str, k: int, parts: int = 4096) -> float:
    """The k-th greatest value of a column (minus infinity if there are fewer), by counts in intervals."""
    low, high, n = values.agg(F.min(column), F.max(column), F.count(column)).first()
    if n < k:
        return float("-inf")
    if k < 1:
        return float("inf")
    col, above = F.col(column), 0
    while low < high:
        width = (high - low) / parts
        inside = values.where((col >= low) & (col <= high))
        at = F.least(F.floor((col - F.lit(low)) / F.lit(width)), F.lit(parts - 1)) if width > 0 else F.lit(0)
        counts = {r[0]: r[1:] for r in inside.groupBy(at.alias("at")).agg(F.count("*"), F.min(column), F.max(column)).collect()}
        for i in sorted(counts, reverse=True):
            if above + counts[i][0] >= k:
                low, high = counts[i][1], counts[i][2]
                break
            above += counts[i][0]
        if width == 0:
            break
    return low


def sample_size(scored: DataFrame, rate: float = RATE) -> int:
    """How many documents are as important as a share ``rate`` of the held-out good ones is."""
    unseen = sorted(r[0] for r in scored.where("held").select("log_importance").collect())  # max_target at most
    if not unseen:
        return scored.count()
    least = unseen[math.floor((1 - rate) * len(unseen))]
    return scored.where(F.col("log_importance") >= F.lit(least)).count()


def _scored(docs: DataFrame, labels: DataFrame, k: int | None, max_target: int, smooth: float, rate: float, passage: int | None, split: int) -> tuple[Model, DataFrame, float]:
    model = fit(docs, labels, max_target, None, smooth, passage, split)
    scored = save(importances(docs, model), "importances")
    return model, scored, kth_greatest(scored, "key", sample_size(scored, rate) if k is None else k)


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, max_target: int = MAX_TARGET, smooth: float = SMOOTH, rate: float = RATE, passage: int | None = PASSAGE, split: int = 0) -> DataFrame:
    """(doc_id, log_importance, key, kept) of every document."""
    _, scored, least = _scored(docs, labels, k, max_target, smooth, rate, passage, split)
    return scored.select("doc_id", "log_importance", "key", (F.col("key") >= F.lit(least)).alias("kept"))


def sample(docs: DataFrame, labels: DataFrame, k: int | None = None, max_target: int = MAX_TARGET, smooth: float = SMOOTH, rate: float = RATE, passage: int | None = PASSAGE, split: int = 0) -> DataFrame:
    """The kept documents, all columns as they are; keys are computed again beside each row, without a join."""
    model, scored, least = _scored(docs, labels, k, max_target, smooth, rate, passage, split)
    forget(scored)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    i, t = docs.columns.index("doc_id"), docs.columns.index("text")

    def run(batches):
        model = sent.value
        for b in batches:
            keys = _keys(b.column(i), model.importance(b.column(t).cast(pa.string())), SEED)
            yield b.filter(pa.array(keys >= least))

    return docs.mapInArrow(run, docs.schema)
