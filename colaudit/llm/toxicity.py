"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Features are the words of a text and their prefixes of four to seven letters.  The vocabulary is every
feature that separates the labels significantly (chi-square at one in a hundred, three examples at least,
more often in toxic ones) among a bounded sample of labelled documents; it has no other bound.  Document
frequencies are counted over all documents.  The examples are ordered by their heaviest feature and cut into
blocks; for each feature the index keeps its postings and the greatest weight in each block.  A query adds
up these maxima to an upper bound of each block's cosines, scores the blocks of greatest bound, and then all
others whose bound reaches the k-th best cosine so far: the k neighbours are exact.  Votes weighted by cosine
are turned into a probability by a monotone fit on leave-one-out votes of the examples, equal votes
pooled first, weighted back to the classes' shares.

Bound (parameter): ``max_examples`` labelled rows per class, the first by hash of their id; index and
vocabulary are broadcast and their size follows from these rows' texts alone.

Defined results: a null or empty text, or one without a feature, gets the share of toxic
examples among those without features; a very long text is scored by all its words; labels that are null or
whose id is null are ignored, documents without an id are scored like others; a document with contradictory
labels counts as toxic; ties among neighbours go to the example that comes first in the index; repeated rows
score alike; without usable labels all scores are 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_EXAMPLES, NEIGHBOURS, BLOCK = 2_000, 25, 32
LEAST_CHI, LEAST_EXAMPLES = 6.635, 3  # one in a hundred by chance, with one degree of freedom
_PREFIXES = (4, 5, 6, 7)
_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    return [word, *[f"{word[:n]}*" for n in _PREFIXES if len(word) > n]]


class Features(dict):
    """word -> numbers of its features in the vocabulary, remembered for a bounded number of words."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> tuple:
        if len(self) >= 500_000:
            self.clear()
        found = self[word] = tuple(self.vocabulary[f] for f in word_features(word) if f in self.vocabulary)
        return found

    def counts(self, text: str | None) -> dict[int, int]:
        out: dict[int, int] = {}
        for ids in filter(None, map(self.__getitem__, _WORD.findall(text.lower()) if text else ())):
            for i in ids:
                out[i] = out.get(i, 0) + 1
        return out


def vector(counts: dict[int, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and unit-length TF-IDF weights."""
    ids = np.fromiter(counts, np.int64, len(counts))
    w = (1 + np.log(np.fromiter(counts.values(), float, len(counts)))) * idf[ids]
    norm = np.sqrt((w * w).sum())
    return (ids, w / norm) if norm > 0 else (ids[:0], w[:0])


class Index:
    """Postings of the examples by feature, with block maxima."""

    def __init__(self, examples: list[tuple[int, int, dict[int, int]]], idf: np.ndarray, shares: tuple[float, float], block: int = BLOCK):
        """examples: (doc_id, label, counts); shares: how many labelled rows an example stands for, by label."""
        self.idf, self.block = idf, block
        vectors = [(i, y, *vector(c, idf)) for i, y, c in examples]
        full = sorted((v for v in vectors if len(v[2])), key=lambda v: (int(v[2][np.argmax(v[3])]), v[0]))
        self.ids = np.array([v[0] for v in full], np.int64)
        self.labels = np.array([v[1] for v in full], float)
        weight = np.array(shares)
        bare = np.array([weight[v[1]] * np.array([1, v[1]]) for v in vectors if not len(v[2])]).reshape(-1, 2).sum(0)
        total = np.array([weight[v[1]] * np.array([1, v[1]]) for v in vectors]).reshape(-1, 2).sum(0)
        prior = total[1] / total[0] if total[0] else 0.0
        self.bare = (bare[1] + prior) / (bare[0] + 1) if total[0] else 0.0
        self.n_blocks = max(1, -(-len(full) // block))
        self.weights = [v[3] for v in full]
        self.terms = [v[2] for v in full]
        size = [len(t) for t in self.terms]
        example = np.repeat(np.arange(len(full)), size)
        feature = np.concatenate([*self.terms, np.empty(0, np.int64)]).astype(np.int64)
        weight_of = np.concatenate([*self.weights, np.empty(0)])
        # the postings of a feature within a block are one row of ``tiles``, row 0 is empty
        cell, at = np.unique(feature * self.n_blocks + example // block, return_inverse=True)
        self.tiles = np.zeros((len(cell) + 1, block))
        self.tiles[at + 1, example % block] = weight_of
        self.tile_of = np.zeros((len(idf), self.n_blocks), np.int32)
        self.tile_of.reshape(-1)[cell] = np.arange(1, len(cell) + 1)
        self.maxima = self.tiles.max(axis=1)[self.tile_of]
        self.calibrate(weight)

    def _cosines(self, ids: np.ndarray, w: np.ndarray, blocks: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """Examples of the blocks with a cosine above 0, and the cosines."""
        found = np.tensordot(w, self.tiles[self.tile_of[ids[:, None], blocks]], 1).ravel()
        at = np.flatnonzero(found > 0)
        number = blocks[at // self.block] * self.block + at % self.block
        keep = number != skip
        return number[keep], found[at][keep]

    def nearest(self, ids: np.ndarray, w: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of greatest cosine above 0, and the cosines, best first.

        The blocks of greatest bound are scored first; then all others whose bound reaches the k-th best cosine.
        """
        bound = w @ self.maxima[ids]
        order = np.argsort(-bound, kind="stable")
        order = order[: np.count_nonzero(bound > 0)]
        step = max(2, 2 * k // self.block)
        at, cos = self._cosines(ids, w, order[:step], skip)
        rest = order[step:]
        if len(rest) and len(cos) >= k:
            rest = rest[bound[rest] >= np.partition(cos, -k)[-k] - 1e-12]
        if len(rest):
            more = self._cosines(ids, w, rest, skip)
            at, cos = np.concatenate([at, more[0]]), np.concatenate([cos, more[1]])
        top = np.lexsort((at, -cos))[:k]
        return at[top], cos[top]

    def vote(self, at: np.ndarray, cos: np.ndarray) -> float:
        return float((cos * self.labels[at]).sum() / cos.sum()) if len(at) else -1.0

    def calibrate(self, weight: np.ndarray, k: int = NEIGHBOURS) -> None:
        """Pools adjacent violators of the leave-one-out votes."""
        votes = np.array([self.vote(*self.nearest(i, w, k, n)) for n, (i, w) in enumerate(zip(self.terms, self.weights))])
        keep = votes >= 0
        each = weight[self.labels[keep].astype(int)]
        level, at = np.unique(votes[keep], return_inverse=True)
        sums = np.column_stack([np.bincount(at, w, len(level)) for w in (each, each * self.labels[keep], each * votes[keep])])
        pools: list[list[float]] = []  # weight, weighted sum of labels, of votes
        for row in sums.tolist():
            pools.append(row)
            while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last)]
        self.x = np.array([p[2] / p[0] for p in pools])
        self.y = np.array([(p[1] + 0.02) / (p[0] + 1) for p in pools])

    def score(self, counts: dict[int, int], k: int = NEIGHBOURS) -> tuple[float, list]:
        """The probability, and (doc_id, label, cosine) of the neighbours."""
        ids, w = vector(counts, self.idf)
        at, cos = self.nearest(ids, w, k) if len(ids) else (ids, w)
        if not len(at) or not len(self.x):
            return float(self.bare), []
        vote = self.vote(at, cos)
        # a small share of the raw vote keeps documents apart that the fit puts on one level
        return float(0.98 * np.interp(vote, self.x, self.y) + 0.02 * vote), [(int(self.ids[a]), int(self.labels[a]), float(c)) for a, c in zip(at, cos)]


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> tuple[dict[str, int], Index]:
    """docs(doc_id, text), labels(doc_id, toxic) -> vocabulary and index."""
    source = _source(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    drawn = known.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples).collect()
    drawn += known.where("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples).collect()
    label = {r[0]: r[1] for r in drawn}
    spark = docs.sparkSession
    sample = F.broadcast(spark.createDataFrame(drawn, "doc_id long, toxic int"))
    examples = source.join(sample, "doc_id").select("toxic", "text")

    def features(batches):
        for b in batches:
            pos, neg = Counter(), Counter()
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = set(_WORD.findall(t.lower())) if t else ()
                (pos if y else neg).update({f for w in words for f in word_features(w)})
            keys = list(pos | neg)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([pos[k] for k in keys], pa.int64()), pa.array([neg[k] for k in keys], pa.int64())], ["feature", "a", "b"])

    n1, n0 = (max(1, sum(1 for y in label.values() if y == c)) for c in (1, 0))
    c, d = f"({n1} - a)", f"({n0} - b)"
    chi = F.expr(f"{n1 + n0} * power(double(a) * {d} - double(b) * {c}, 2) / (double({n1}) * {n0} * (a + b) * greatest(1, {c} + {d}))")
    seen = examples.mapInArrow(features, "feature string, a long, b long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    # features of toxic texts only: what marks the others would tie them to each other, not apart from these
    kept = seen.withColumn("chi", chi).where(f"a + b >= {LEAST_EXAMPLES} and chi >= {LEAST_CHI} and a * {n0} > 2 * b * {n1}").orderBy("feature").collect()
    vocabulary = {r["feature"]: i for i, r in enumerate(kept)}
    sent = spark.sparkContext.broadcast(vocabulary)

    def frequencies(batches):
        f = Features(sent.value)
        n = np.zeros(len(f.vocabulary) + 1, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                n[-1] += 1
                n[list(f.counts(t))] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], ["i", "n"])

    counted = source.select("text").mapInArrow(frequencies, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(len(vocabulary) + 1)
    for r in counted:
        df[r["i"]] = r["n"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    def vectors(batches):
        f = Features(sent.value)
        for b in batches:
            found = [sorted(f.counts(t).items()) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[k for k, _ in x] for x in found], pa.list_(pa.int32())), pa.array([[v for _, v in x] for x in found], pa.list_(pa.int32()))], ["doc_id", "ids", "n"])

    rows = source.join(sample, "doc_id").select("doc_id", "text").mapInArrow(vectors, "doc_id long, ids array<int>, n array<int>").dropDuplicates(["doc_id"]).collect()
    data = sorted((r["doc_id"], label[r["doc_id"]], dict(zip(r["ids"], r["n"]))) for r in rows)
    return vocabulary, Index(data, idf, (sizes.get(0, 0) / n0, sizes.get(1, 0) / n1))


def score(docs: DataFrame, model: tuple[dict[str, int], Index]) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, score, evidence array<struct<doc_id, label, cosine>>)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    near = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def run(batches):
        vocabulary, index = sent.value
        f = Features(vocabulary)
        for b in batches:
            done = [index.score(f.counts(t)) for t in b.column(1).to_pylist()]
            evidence = [[dict(zip(("doc_id", "label", "cosine"), x)) for x in e[:5]] for _, e in done]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for s, _ in done], pa.float64()), pa.array(evidence, near)], ["doc_id", "score", "evidence"])

    return _source(docs).mapInArrow(run, "doc_id long, score double, evidence array<struct<doc_id: bigint, label: int, cosine: double>>")


def held_out(doc_id: str = "doc_id") -> F.Column:
    """The fold that labels are never learnt from: crc32 of the id's text, modulo 4, is 2."""
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every document; the held-out fold's labels are not used."""
    model = fit(docs, labels.where(~held_out()))
    return score(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
