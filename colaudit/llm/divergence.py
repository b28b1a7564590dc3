"""How the words of each source differ from its language's and from every other source's.

1. Every partition folds whole documents into stripes held in a hash table: for a language, term -> (documents
   that hold it, occurrences by source).  When a task holds ``limit`` entries it writes its stripes out and goes
   on with an empty table, so memory is bounded at any size of partition.
2. The stripes are merged by (language, term).  A document has one source, so document frequencies add up over
   sources as occurrences do, and a hot term costs one entry for each task, spill and source, never one for each
   occurrence.
3. Merged stripes with at least ``min_docs`` documents are the vocabulary.  They go by once more and emit
   divergences directly: a task sums them for each pair of sources and keeps each group's best terms; what tasks
   found is added up and ranked.

All arithmetic is on 64-bit integers.  p = 1 + floor(SCALE * (count + 1) / (N + V)) is divided in three steps of
a thousand, which is exact up to 9e15 occurrences.  (p - q)**2 stays below 9.2e18, and so does a sum over the
vocabulary, as long as V is below two thousand millions.

A result has a row for each two sources of a language, so the table of sources and totals that a task holds (one
entry a source) is bounded by the square root of the result; above ``BROADCAST`` groups it is joined, not broadcast.

Defined results: null text, lang and source count as ''; a text without terms counts for its group, which then gives
all kept terms with count 0; a language without kept terms has value 0 for its pairs and no terms; a very long text is
one document, counted whole; repeated rows count as often as they stand there; equal values are ranked by item; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, save

MIN_DOCS, TOP = 3, 200
LIMIT = 300_000  # entries of the stripes that a task holds
BROADCAST = 100_000  # groups of (lang, source)
_BLOCK = 1 << 20  # cells of the arrays in a step
_PART = 1 << 20  # bytes of a text that are split at once

#: Letters and bytes beyond ASCII stay, A-Z become a-z, all others are spaces.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def pieces(text: bytes):
    """The terms of a text in UTF-8, a bounded piece at a time; no term is cut."""
    plain, low = text.translate(_TERM), 0
    while low < len(plain):
        stop = plain.find(b" ", low + _PART)
        high = len(plain) if stop < 0 else stop
        yield plain[low:high].split()
        low = high


class Stripes:
    """term -> document frequency and occurrences, by language and source."""

    def __init__(self) -> None:
        self.counts: dict[tuple[str, str], Counter] = {}
        self.docs: dict[tuple[str, str], Counter] = {}
        self.size = 0

    def fold(self, lang: str, source: str, text: bytes) -> None:
        key = lang, source
        if key not in self.counts:
            self.counts[key], self.docs[key] = Counter(), Counter()
            self.size += 1
        seen: set[bytes] = set()
        counts = self.counts[key]
        before = len(counts)
        for found in pieces(text):
            counts.update(found)
            seen.update(found)
        self.docs[key].update(seen)
        self.size += len(counts) - before

    def batches(self, rows: int = 100_000):
        """(lang, term, source, n, docs); a null term says that the group occurs."""
        for (lang, source), counts in self.counts.items():
            docs, names = self.docs[lang, source], list(counts)
            for low in range(0, max(1, len(names)), rows):
                part = names[low : low + rows]
                cols = [part, [counts[t] for t in part], [docs[t] for t in part]]
                if not low:
                    cols = [[None, *cols[0]], [0, *cols[1]], [0, *cols[2]]]
                k = len(cols[0])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * k), pa.array(cols[0], pa.binary()).cast(pa.string()), pa.array([source] * k), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["lang", "term", "source", "n", "docs"])


def stripes(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """docs(text, lang, source) -> (lang, term, source, n, docs): what each task has folded."""

    def run(batches):
        held = Stripes()
        for b in batches:
            lang, source = (b.column(i).to_pylist() for i in (0, 1))
            for k, text in enumerate(b.column(2).cast(pa.large_binary())):
                held.fold(lang[k], source[k], text.as_py())
                if held.size >= limit:
                    yield from held.batches()
                    held = Stripes()
        yield from held.batches()

    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*plain).mapInArrow(run, "lang string, term string, source string, n long, docs long")


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(1e9 * (count + 1) / total), exact: three digits of base 1000 at a time."""
    x = count + 1
    whole, rest = np.divmod(x, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return whole + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q) ** 2 / q)."""
    return (p - q) ** 2 // q


def _emitted(batches, top: int):
    """Merged stripes with their language's totals -> pair sums and each group's best terms of this task."""
    pairs: dict[str, np.ndarray] = {}
    best: dict[tuple[str, int], list] = {}
    names: dict[str, list[str]] = {}
    for b in batches:
        lang = np.array(b.column("lang").to_pylist(), object)
        term = b.column("term").to_pylist()
        of = {x: np.flatnonzero(lang == x) for x in dict.fromkeys(lang.tolist())}
        for x, rows in of.items():
            first = int(rows[0])
            if x not in names:
                names[x] = b.column("sources")[first].as_py()
            place = {s: i for i, s in enumerate(names[x])}
            totals = np.array(b.column("totals")[first].as_py(), np.int64)
            v = b.column("v")[first].as_py()
            s = len(totals)
            sums = pairs.setdefault(x, np.zeros((s, s), np.int64))
            step = max(1, _BLOCK // max(1, s))
            for low in range(0, len(rows), step):
                part = rows[low : low + step]
                stripe = b.take(pa.array(part))
                at, n = stripe.column("at"), stripe.column("n")
                sizes = at.value_lengths().to_numpy(zero_copy_only=False)
                counts = np.zeros((len(part), s), np.int64)
                which = np.array([place[y] for y in at.flatten().to_pylist()], np.int64)
                counts[np.repeat(np.arange(len(part)), sizes), which] = n.flatten().to_numpy(zero_copy_only=False)
                p = share(counts, totals + v)
                for g in range(s):
                    sums[g] += divergence(p[:, g : g + 1], p).sum(0)
                q = share(counts.sum(1), np.int64(totals.sum() + v))
                for g in range(s):
                    over = np.flatnonzero((counts[:, g] > 0) & (p[:, g] > q))
                    f = divergence(p[over, g], q[over])
                    heap = best.setdefault((x, g), [])
                    if len(over) > top:  # those below the top of this step cannot be in the top of all
                        least = np.partition(f, len(f) - top)[len(f) - top]
                        over, f = over[f >= least], f[f >= least]
                    heap += [(-value, term[part[i]].encode()) for i, value in zip(over.tolist(), f.tolist())]
                    if len(heap) > 4 * top:
                        best[x, g] = heapq.nsmallest(top, heap)
    out = [(x, names[x][g], "pair", names[x][o], int(sums[g, o])) for x, sums in pairs.items() for g in range(len(sums)) for o in range(len(sums)) if g != o]
    out += [(x, names[x][g], "term", item.decode(), -value) for (x, g), heap in best.items() for value, item in heapq.nsmallest(top, heap)]
    for low in range(0, len(out), 100_000):
        cols = list(zip(*out[low : low + 100_000]))
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:4]), pa.array(cols[4], pa.int64())], ["lang", "source", "part", "item", "value"])


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, limit: int = LIMIT) -> DataFrame:
    """docs(text, lang, source) -> (lang, source, part, item, value, rank).

    part ``pair``: the sum of divergences from each other source of the language; part ``term``: the ``top`` terms
    that are more frequent in the source than in its language, with their divergence.
    """
    # one shuffle merges the stripes: rows of a term stay together, whatever their source
    dealt = stripes(docs, limit).repartition("lang", "term")
    cells = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    merged = cells.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("by"), F.sum("docs").alias("docs"))
    merged = save(merged.where(F.col("term").isNull() | (F.col("docs") >= min_docs)), "stripes")
    vocabulary = merged.where("term is not null")
    groups = merged.where("term is null").select("lang", F.explode("by.source").alias("source"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("v"))
    found = vocabulary.select("lang", F.explode("by").alias("c")).select("lang", "c.source", "c.n", F.lit(0).alias("v"))
    by_source = save(groups.unionAll(found).groupBy("lang", "source").agg(F.sum("n").alias("n")), "totals")
    sizes = vocabulary.groupBy("lang").agg(F.count("*").alias("v"))
    totals = by_source.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("all")).join(sizes, "lang", "left")
    totals = totals.select("lang", F.col("all.source").alias("sources"), F.col("all.n").alias("totals"), F.coalesce("v", F.lit(0)).cast("long").alias("v"))
    if by_source.count() <= BROADCAST:
        totals = F.broadcast(totals)
    read = vocabulary.select("lang", "term", F.col("by.source").alias("at"), F.col("by.n").alias("n")).join(totals, "lang")
    emitted = read.mapInArrow(lambda batches: _emitted(batches, top), "lang string, source string, part string, item string, value long")
    # a language without kept terms emits nothing: each pair starts from zero
    other = by_source.select("lang", F.col("source").alias("item"))
    zero = by_source.join(other, "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    summed = emitted.unionAll(zero).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = save(summed.withColumn("rank", F.row_number().over(order)).where(f"part = 'pair' or rank <= {int(top)}"), "divergences")
    forget(merged, by_source)
    return ranked
