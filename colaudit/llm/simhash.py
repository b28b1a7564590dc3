"""Near-duplicate documents by SimHash fingerprints and tiled exact comparison.

A fingerprint has bit b where more than half of the text's word shingles have bit b in
their XXH64.  Equal fingerprints are one class (a pre-aggregated group-by).  The distinct
fingerprints are sorted by population counts, first of all 64 bits, then of halves and of
quarters, and packed into tiles.  A tile keeps the range of each count.  The Hamming distance is at
least the sum of the differences of the parts' counts, so tile pairs whose ranges lie
further apart than the radius are skipped; all others are compared exactly with numpy
exclusive-or and bit counts.  Of the links found a task keeps a spanning forest (no
component is lost, no group is written out as all its pairs), and the forests are joined by
large-star and small-star steps on Spark.  Fingerprints are the nodes; each component is then named
by its smallest doc_id.

Defined results: a null text counts as empty; a text without words has fingerprint zero, linked like any
other; a very long text is hashed whole, in pieces; rows with a repeated doc_id are kept as they are; rows
without a doc_id link and are linked like others, and a component of such rows alone has no id; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, save
from .components import connected_components

SHINGLE, RADIUS, SEED = 4, 4, 42
TILE_ROWS = 16_384  # fingerprints in a stored tile (8 bytes each)
_INNER = 1_024  # rows of a compared block: 8 MB of exclusive-ors at a time
_CHUNK = 65_536


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words, repeats included; A-Z are lower-cased first."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist())), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """The signed 64-bit SimHash of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[i : i + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    packed = np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()
    return int.from_bytes(packed, "little", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fp)."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(shingle_hashes(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


_HALVES = ("shiftrightunsigned(fp, 32)", "fp & 4294967295L")
_QUARTERS = ("shiftrightunsigned(fp, 48)", "shiftrightunsigned(fp, 32) & 65535", "shiftrightunsigned(fp, 16) & 65535", "fp & 65535")
#: Parts of a fingerprint at each level, with their columns in the ranges kept of a tile.
_LEVELS = ((0,), (1, 2), (3, 4, 5, 6))


def _counts(fps: np.ndarray) -> np.ndarray:
    """The population counts of the whole, the halves and the quarters, high parts first."""
    q = np.bitwise_count(fps.astype(">u8").view(">u2").reshape(-1, 4)).astype(np.int16)
    return np.column_stack([q.sum(1), q[:, :2].sum(1), q[:, 2:].sum(1), q]).astype(np.int16)


def tiles(classes: DataFrame, n_rows: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """classes(fp) -> (tile, lo, hi, fps), sorted by counts and packed."""
    keys = [F.expr(f"bit_count({x})") for x in ("fp", _HALVES[0], _QUARTERS[0], _QUARTERS[2])]
    names = ["k0", "k1", "k2", "k3", "fp"]
    keyed = classes.select("fp", *[k.alias(n) for k, n in zip(keys, names)])
    dealt = keyed.repartitionByRange(max(1, -(-n_rows // tile_rows)), *names).sortWithinPartitions(*names).select("fp")

    def pack(batches):
        part = TaskContext.get().partitionId()
        held, n, k = [], 0, 0

        def out(held, k):
            fps = np.concatenate([np.asarray(b.column(0)) for b in held])
            c = _counts(fps.view(np.uint64))
            cols = [[part * 1_000_000 + k], [c.min(0).tolist()], [c.max(0).tolist()], [fps.tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()))], ["tile", "lo", "hi", "fps"])

        for b in batches:
            while b.num_rows:
                take = min(b.num_rows, tile_rows - n)
                held.append(b.slice(0, take))
                b, n = b.slice(take), n + take
                if n == tile_rows:
                    yield out(held, k)
                    held, n, k = [], 0, k + 1
        if n:
            yield out(held, k)

    return dealt.mapInArrow(pack, "tile long, lo array<int>, hi array<int>, fps binary")


def _near(lo_a, hi_a, lo_b, hi_b, radius):
    """Which of the boxes b may hold a value within the radius of box a (one row against many)."""
    gap = np.maximum(0, np.maximum(lo_b - hi_a, lo_a - hi_b))
    return np.logical_and.reduce([gap[:, list(level)].sum(1) <= radius for level in _LEVELS])


class Forest:
    """Union-find over positions of two tiles; remembers only links that join two sets."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.label[i], self.label[j]
            keep = a != b
            if not keep.any():
                return
            i, j, a, b = i[keep], j[keep], a[keep], b[keep]
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            order = np.lexsort((lo, hi))
            hi, lo = hi[order], lo[order]
            first = np.concatenate(([True], hi[1:] != hi[:-1]))
            to = np.arange(len(self.label))
            to[hi[first]] = lo[first]  # each set joins its smallest neighbour
            while not np.array_equal(up := to[to], to):
                to = up
            self.label = to[self.label]


def compare(fps_a: np.ndarray, fps_b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) between fingerprints: a spanning forest of all pairs within the radius."""
    fps = fps_a if same else np.concatenate([fps_a, fps_b])
    forest, shift = Forest(len(fps)), 0 if same else len(fps_a)
    cuts_a, cuts_b = range(0, len(fps_a), _INNER), range(0, len(fps_b), _INNER)
    boxes = [(c.min(0), c.max(0)) for c in (_counts(fps_b[j : j + _INNER]) for j in cuts_b)]
    lo_b, hi_b = np.array([x[0] for x in boxes]), np.array([x[1] for x in boxes])
    for i in cuts_a:
        a = fps_a[i : i + _INNER]
        c = _counts(a)
        for k in np.flatnonzero(_near(c.min(0), c.max(0), lo_b, hi_b, radius)):
            j = cuts_b[int(k)]
            if same and j < i:
                continue
            x, y = np.nonzero(np.bitwise_count(a[:, None] ^ fps_b[None, j : j + _INNER]) <= radius)
            if len(x):
                forest.join(x + i, y + j + shift)
    moved = np.flatnonzero(forest.label != np.arange(len(fps)))
    return fps[moved].view(np.int64), fps[forest.label[moved]].view(np.int64)


def links(classes: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """classes(fp), fp distinct -> links (u, v) between fps that differ in <= radius bits."""
    packed = save(tiles(classes, classes.count(), tile_rows), "tiles")
    side = lambda s: packed.select(*[F.col(c).alias(f"{c}_{s}") for c in ("tile", "lo", "hi")])
    a = side("a").withColumn("k", F.explode(F.expr("sequence(lo_a[0], hi_a[0])")))
    b = side("b").withColumn("k", F.explode(F.expr(f"sequence(greatest(0, lo_b[0] - {radius}), hi_b[0] + {radius})")))
    gap = "greatest(0, lo_a[{0}] - hi_b[{0}], lo_b[{0}] - hi_a[{0}])"
    fits = " and ".join(f"{' + '.join(gap.format(i) for i in level)} <= {radius}" for level in _LEVELS)
    first = f"k = greatest(lo_a[0], greatest(0, lo_b[0] - {radius}))"  # each pair at one k only
    pairs = a.join(b, "k").where(f"tile_a <= tile_b and {first} and {fits}").select("tile_a", "tile_b")
    data = lambda s: packed.select(F.col("tile").alias(f"tile_{s}"), F.col("fps").alias(f"fps_{s}"))
    loaded = pairs.join(data("a"), "tile_a").join(data("b"), "tile_b").select("tile_a", "tile_b", "fps_a", "fps_b")

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                u, v = compare(*(np.frombuffer(r[c], np.uint64) for c in ("fps_a", "fps_b")), r["tile_a"] == r["tile_b"], radius)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    conf = {"spark.sql.execution.arrow.maxRecordsPerBatch": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    found = save(loaded.mapInArrow(run, "u long, v long"), "links", conf)
    forget(packed)
    return found


def near_duplicates(docs: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fp, component_id): one row per row of docs."""
    fps = save(fingerprints(docs), "fingerprints")
    classes = save(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    found = links(classes, radius, tile_rows)
    parts = connected_components(found)
    named = classes.join(parts, classes.fp == parts.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    # a component may have very many fingerprints: its name is joined back, no list of them is built
    names = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    of = save(named.join(names, "component").select("fp", "component_id"), "names")
    forget(classes, found, parts)
    return fps.join(of, "fp", "left").select("doc_id", "fp", "component_id")
