"""Incremental removal of repeated word windows with a log-structured fingerprint index.

A window is 20 consecutive words.  Its fingerprint is the least 64-bit hash among its
five-word parts, so equal windows have equal fingerprints while consecutive windows mostly
share one: a *stretch* is a run of windows with one fingerprint, and there are about an eighth
as many as words.  A stretch also has a hash of all its words, from a second, independent hash of
each word.  A run of the index holds one row for each distinct stretch of a batch (fingerprint,
hash, first document and place, number of windows), sorted by fingerprint, and is never changed.  A new batch

1. writes its stretches, and its own run by a pre-aggregated group-by;
2. is merge-joined with the historical runs by fingerprint;
3. stretches equal as a whole to an earlier one are settled there: all their windows start earlier;
4. where a fingerprint has different stretches, one of them new, or occurs twice in one stretch, the
   windows are verified: the texts that such a hit names, in the batch or in history, are read, their
   twenty words hashed in full by both word hashes, and the first place of each window found;
5. the words under windows that start earlier elsewhere are removed;
6. before the next batch, runs are merged into one sorted run if there are more than ``fanout``.

Later copies of a stretch are in no run, so the index grows with the distinct text.  Words are
compared by 64 + 64 bits, windows and stretches by 128 bits.  Counting is pre-aggregated and the joins
are sort-merge joins that Spark can split where a fingerprint is very frequent; no group of windows is
ever collected.

Defined results: a null text has no words; texts under 20 words are kept whole; a very long text is one
place among others, hashed in one piece; a document without an id stands before all others, under a hash of
its text (equal texts without an id are one document); rows with the same doc_id are not
compared with each other, and words go from each at the places where one of them has a repeat; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import Powers, chunks, powers
from .common import forget, save, windows

WIDTH, GRAM, FANOUT, BATCHES = 20, 5, 1, 3
FACTOR = 0xC2B2AE3D27D4EB4F  # of the polynomial over word hashes
_LOW = -(1 << 63)
_MARK = "fp long, h long, id long, start int, n int, times int"


def _least(h: np.ndarray, span: int) -> np.ndarray:
    """The minimum of each ``span`` neighbours, by doubling."""
    done = 1
    while done < span:
        step = min(done, span - done)
        h = np.minimum(h[: len(h) - step], h[step:])
        done += step
    return h


def stretches(tokens: np.ndarray, sizes: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Stretches of windows with one fingerprint, of texts that stand one after the other.

    (number of the text, fingerprint, first window among all tokens, number of windows, how many parts have that hash).
    """
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes)), np.maximum(0, sizes - width + 1))
    if not len(text):
        return text, np.empty(0, np.uint64), text, text, text
    # windows[i] is where the i-th window that lies in one text begins
    first = np.cumsum(np.concatenate(([0], np.maximum(0, sizes - width + 1))))[:-1]
    at = np.arange(len(text)) + (ends - sizes - first)[text]
    parts, span = windows(tokens, gram, 1), width - gram + 1
    fp = _least(parts, span)[at]
    edge = np.flatnonzero((fp[1:] != fp[:-1]) | (text[1:] != text[:-1])) + 1
    begin = np.concatenate(([0], edge))
    n = np.diff(np.concatenate((begin, [len(fp)])))
    fp, start = fp[begin], at[begin]
    # text that repeats itself within a stretch has its least part more than once there
    size = n + span - 1
    low = np.concatenate(([0], np.cumsum(size)[:-1]))
    every = np.arange(size.sum()) + np.repeat(start - low, size)
    times = np.add.reduceat((parts[every] == np.repeat(fp, size)).astype(np.int32), low)
    return text[begin], fp, start, n, times


def _later(text: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether a text has the same key before; rows of a text stand together and in order."""
    out = np.ones(len(key), bool)
    order = np.lexsort((key, text))
    t, k = text[order], key[order]
    new = np.concatenate(([True], (t[1:] != t[:-1]) | (k[1:] != k[:-1])))[: len(key)]
    out[order[new]] = False  # the sort is stable
    return out


def _source(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    without = F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 2) + F.lit(_LOW)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), without).alias("id"), text.alias("text"), F.col("doc_id").cast("long").alias("doc_id"))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)


def _sorted(rows: DataFrame) -> DataFrame:
    """A run's order; the hash beside the fingerprint deals a frequent fingerprint to several tasks."""
    return rows.repartition("fp", F.expr("pmod(h, 16)")).sortWithinPartitions("fp", "h")


class WindowIndex:
    """Runs of the stretches of all documents seen so far, and where to read their texts."""

    def __init__(self, spark: SparkSession, width: int = WIDTH, gram: int = GRAM, fanout: int = FANOUT):
        self.spark, self.width, self.gram, self.fanout = spark, width, gram, fanout
        self.runs: list[DataFrame] = []
        self.seen: list[DataFrame] = []

    def _marks(self, docs: DataFrame) -> DataFrame:
        """The stretches of all texts of a batch; again: the text has an equal one before."""
        width, gram = self.width, self.gram

        def run(batches):
            by_byte, by_word = powers(), Powers(FACTOR)
            for b in batches:
                ids = np.asarray(b.column(0))
                for low, high, words in chunks(b.column(1)):
                    (one, two), size = words.hashes(by_byte), words.sizes
                    text, fp, start, n, times = stretches(one, size, width, gram)
                    if not len(text):
                        continue
                    h = by_word.of(two, start, start + n + width - 1)
                    again = _later(text, h)
                    start = start - (np.cumsum(size) - size)[text]
                    cols = fp.view(np.int64), h.view(np.int64), ids[low:high][text], start.astype(np.int32), n.astype(np.int32), times.astype(np.int32), again
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["fp", "h", "id", "start", "n", "times", "again"])

        return _source(docs).select("id", "text").mapInArrow(run, f"{_MARK}, again boolean")

    def _merged(self, rows: DataFrame) -> DataFrame:
        """One row for each distinct stretch, where the first document has it; k: the number of documents."""
        found = rows.groupBy("fp", "h").agg(F.min("id").alias("first"), F.min_by("start", "id").alias("start"), F.min("n").alias("n"), F.max("times").alias("times"), F.sum("k").alias("k"))
        return found.withColumnRenamed("first", "id")

    def _windows(self, texts: DataFrame, places: DataFrame) -> DataFrame:
        """(w, c, id, pos, again) of the windows of the given stretches; again: the text has an equal one before."""
        width = self.width
        at = places.groupBy("id").agg(F.collect_list("start").alias("start"), F.collect_list("n").alias("n"))

        def run(batches):
            by_byte, by_word = powers(), Powers(FACTOR)
            for b in batches:
                ids = np.asarray(b.column(0))
                for low, high, words in chunks(b.column(1)):
                    both, size = words.hashes(by_byte), words.sizes
                    lists = [b.column(c).slice(low, high - low) for c in (2, 3)]
                    text = np.repeat(np.arange(high - low), lists[0].value_lengths().to_numpy())
                    start, n = (np.asarray(x.flatten()) for x in lists)
                    pos = np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)
                    text = np.repeat(text, n)
                    keep = pos <= size[text] - width  # another text with this id may be shorter
                    text, pos = text[keep], pos[keep]
                    if not len(text):
                        continue
                    order = np.lexsort((pos, text))
                    text, pos = text[order], pos[order]
                    new = np.concatenate(([True], (text[1:] != text[:-1]) | (pos[1:] != pos[:-1])))
                    text, pos = text[new], pos[new]
                    begin = (np.cumsum(size) - size)[text] + pos
                    w, c = (by_word.of(h, begin, begin + width) for h in both)
                    cols = w.view(np.int64), c.view(np.int64), ids[low:high][text], pos.astype(np.int32), _later(text, w)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["w", "c", "id", "pos", "again"])

        return texts.join(at, "id").select("id", "text", "start", "n").mapInArrow(run, "w long, c long, id long, pos int, again boolean")

    def _repeats(self, docs: DataFrame, marks: DataFrame, run: DataFrame) -> DataFrame:
        """(id, at array<struct<start, n>>): the batch's windows that also start earlier."""
        new, old = [run.withColumn("new", F.lit(1))], [r.withColumn("new", F.lit(0)) for r in self.runs]
        stretches = _union(new + old)
        shared = stretches.groupBy("fp").agg(F.count("*").alias("m"), F.max("times").alias("t"), F.max("new").alias("any"))
        hits = save(stretches.join(shared.where("any = 1 and (m > 1 or t > 1)").select("fp"), "fp"), "hits")
        # of equal stretches the first place stands for all
        kinds = hits.groupBy("fp", "h").agg(F.min("id").alias("first"), F.min_by("start", "id").alias("start"), F.min("n").alias("n"), F.max("times").alias("t"), F.min("new").alias("new"), F.max("new").alias("any"))
        kinds = save(kinds, "kinds")
        known = kinds.where("any = 1 and new = 0").select("fp", "h", "first")
        twice = run.where("k > 1").select("fp", "h", F.col("id").alias("first")).join(known.select("fp", "h"), ["fp", "h"], "left_anti")
        whole = marks.where("not again").join(known.unionAll(twice), ["fp", "h"]).where("id > first").select("id", "start", "n")
        whole = whole.unionAll(marks.where("again").select("id", "start", "n"))
        # an old stretch against old ones was compared before: only fingerprints with a new stretch count
        open_ = kinds.groupBy("fp").agg(F.count("*").alias("m"), F.max("t").alias("t"), F.max("new").alias("any")).where("any = 1 and (m > 1 or t > 1)")
        places = save(kinds.join(open_.select("fp"), "fp").select(F.col("first").alias("id"), "start", "n"), "places")
        full = save(self._windows(_union([_source(d).select("id", "text") for d in [docs, *self.seen]]), places), "windows")
        once = full.where("not again")
        earliest = once.groupBy("w", "c").agg(F.min("id").alias("first"), F.count("*").alias("m")).where("m > 1").select("w", "c", "first")
        single = once.join(earliest, ["w", "c"]).where("id > first").select("id", "pos").unionAll(full.where("again").select("id", "pos"))
        if old:  # ids of a batch are above those of history
            least = run.agg(F.min("id")).first()[0]
            single = single.where(F.col("id") >= F.lit(_LOW if least is None else least))
        both = whole.unionAll(single.select("id", F.col("pos").alias("start"), F.lit(1).alias("n")))
        out = save(both.groupBy("id").agg(F.collect_list(F.struct("start", "n")).alias("at")), "repeats")
        forget(hits, kinds, places, full)
        return out

    def ingest(self, docs: DataFrame) -> DataFrame:
        """Adds a batch whose ids are above all seen ones; returns what is left of its texts.

        (doc_id, n_words, n_removed, kept_text): the kept words joined by one space.
        """
        if len(self.runs) > self.fanout:
            self.compact()
        marks = save(self._marks(docs), "marks")
        run = save(_sorted(self._merged(marks.where("not again").withColumn("k", F.lit(1)))), "run")
        repeats = self._repeats(docs, marks, run)
        forget(marks)
        self.runs.append(run)
        self.seen.append(docs)
        width = self.width

        def keep(batches):
            for b in batches:
                for low, high, words in chunks(b.column(1)):
                    # each interval of windows covers words from its start to its end in one text
                    places = b.column(2).slice(low, high - low)
                    begin = np.cumsum(words.sizes) - words.sizes
                    text = np.repeat(np.arange(high - low), places.value_lengths().fill_null(0).to_numpy())
                    first, n = (np.asarray(places.flatten().field(i)).astype(np.int64) for i in (0, 1))
                    stop = np.minimum(first + n + width - 1, words.sizes[text])
                    first = np.minimum(first, stop)
                    edge = np.zeros(len(words.start) + 1, np.int64)
                    np.add.at(edge, begin[text] + first, 1)
                    np.add.at(edge, begin[text] + stop, -1)
                    left = np.cumsum(edge[:-1]) == 0
                    every = np.repeat(np.arange(high - low), words.sizes)
                    removed = np.bincount(every[~left], minlength=high - low)
                    cols = [b.column(0).slice(low, high - low), pa.array(words.sizes, pa.int64()), pa.array(removed, pa.int64()), words.joined(left)]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "kept_text"])

        left = _source(docs).join(repeats, "id", "left").select("doc_id", "text", "at")
        return left.mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept_text string")

    def compact(self) -> None:
        """Merges all runs into one sorted run; the old ones go when the new one is written."""
        merged = save(_sorted(self._merged(_union(self.runs))), "run")
        forget(*self.runs)
        self.runs = [merged]

    def close(self) -> None:
        """Deletes the runs; results that were returned stay readable."""
        forget(*self.runs)
        self.runs, self.seen = [], []


def drop_repeats(docs: DataFrame, n_batches: int = BATCHES, width: int = WIDTH, gram: int = GRAM, fanout: int = FANOUT) -> DataFrame:
    """Ingests a table in ``n_batches`` ranges of doc_id, in order, and returns all batches' results."""
    index = WindowIndex(docs.sparkSession, width, gram, fanout)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW))
    shares = [i / n_batches for i in range(1, n_batches)]
    cuts = docs.agg(F.percentile_approx(key, shares, 1_000)).first()[0] if shares else []
    edges = [_LOW, *sorted(set(cuts or ()) - {_LOW}), None]
    parts = [docs.where((key >= a) & (F.lit(True) if b is None else key < b)) for a, b in zip(edges, edges[1:])]
    out = _union([index.ingest(p) for p in parts])
    index.close()
    return out
