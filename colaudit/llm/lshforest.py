"""Near-duplicate documents by an LSH forest over MinHash signatures, links confirmed on the full shingle sets.

A document's set holds the hashes of its distinct five-word shingles.  Equal sets are one class (a pre-aggregated
group-by), and only classes go on.  A class has a signature of ``TREES * LEAST`` MinHash values, a byte each.
A tree of the forest is one sorted order of all signatures by an eight-byte label: the tree's own five values, then
those of its next tree.  Classes that share the first ``LEAST`` values of a label form a region of that tree.

1. Each order is dealt by ranges and sorted, and rows that share no such prefix with the row before or behind go.
2. A task walks along its slice.  A region of few rows is compared as a whole; in a crowded one each row meets
   its ``NEAR`` neighbours to either side, which are those with the longest common prefix, so the depth adapts to the
   region, and the row that agrees most with all others of the region (its centre).  Each row keeps its best neighbour
   and its best centre by the estimate of all values: at most two links a class are confirmed from the texts.
3. Regions whose rows are then all in one component are done.  In the others every row that is not in the region's
   largest component is compared with all rows of other components, in tiles, by the estimate; pairs of tiles with
   candidates are joined with their tiles' full sets and confirmed where they meet, and the components are made again.
   So no pair that shares a region is lost, however crowded it is, and no candidate pair is written as a row.

Two sets with a Jaccard similarity of 0.85 share no region of 28 trees with probability (1 - 0.85**5)**28 = 7e-8, and
are put aside by the estimate (five standard deviations) with 2e-7 at most.  Step 3 is quadratic only in rows that are
in one region and in no large component.

Sets are compared by 64-bit hashes of shingles.  Classes are named by a 64-bit hash of their set: among 10**9 distinct
sets two share a name with a probability of 3 %.

Defined results: a null text counts as empty; a text without words has an empty set, is linked with nothing and is
its own component; a text of one to four words has one shingle; a very long text is hashed as a whole; rows with a
repeated doc_id are kept as they are; rows without a doc_id link and are linked like others, and a component of such
rows alone has no id and keeps them; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import Powers, chunks, powers
from .common import forget, mix, multipliers, save
from .components import connected_components

SHINGLE, PERCENT = 5, 85
TREES, LEAST, DEPTH = 28, 5, 8
NEAR = 32  # neighbours to either side in a crowded region
SPREAD = 5.0  # standard deviations that an estimate may lie below the threshold
TILE, TILE_HASHES = 256, 1 << 20  # rows of a tile in step 3, and shingle hashes that it may have (8 MB) beyond one row's
BROADCAST = 500_000  # rows of (row id, class) that may be broadcast: 8 MB
_FACTOR = 0xC2B2AE3D27D4EB4F
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    drawn = multipliers(n, 77)
    return (drawn >> np.uint64(32)).astype(np.uint32) | np.uint32(1), drawn.astype(np.uint32)


class Shingler:
    """The sorted distinct shingle hashes of texts."""

    def __init__(self, shingle: int = SHINGLE):
        self.shingle, self.by_byte, self.by_word = shingle, powers(), Powers(_FACTOR)

    def sets(self, column: pa.Array):
        """(first row, last row + 1, text of each hash, hashes), sorted by text and hash, for stretches of a column."""
        k = self.shingle
        for low, high, words in chunks(column):
            words.data = _LOWER[words.data]
            tokens, size = words.hashes(self.by_byte)[0], words.sizes
            n = np.where(size < k, np.minimum(size, 1), size - k + 1)
            text = np.repeat(np.arange(high - low), n)
            first = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = (np.cumsum(size) - size)[text] + first
            h = self.by_word.of(tokens, start, start + np.minimum(size, k)[text])
            order = np.lexsort((h, text))
            text, h = text[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
            yield low, high, text[new], h[new]


def _starts(text: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts with a set, where each begins, its size)."""
    size = np.bincount(text, minlength=n_texts)
    full = np.flatnonzero(size)
    return full, (np.cumsum(size) - size)[full], size


def names(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, the same for equal sets."""
    return mix(np.add.reduceat(mix(h ^ np.uint64(0xA0761D6478BD642F)), starts)) if len(starts) else np.empty(0, np.uint64)


def signatures(h: np.ndarray, starts: np.ndarray, values: int) -> np.ndarray:
    """A byte of each MinHash value, a row for each set."""
    out = np.empty((len(starts), values), np.uint8)
    if len(starts):
        short = (h >> np.uint64(32)).astype(np.uint32)
        for i, (a, b) in enumerate(zip(*_permutations(values))):
            least = np.minimum.reduceat((short ^ b) * a, starts)
            out[:, i] = (least * np.uint32(0x9E3779B1)) >> np.uint32(24)
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary value for each row of bytes."""
    rows = np.ascontiguousarray(rows)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def _matrix(column: pa.Array, values: int) -> np.ndarray:
    """The inverse of ``_binary``."""
    if not len(column):
        return np.empty((0, values), np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset :]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[0] + len(column) * values].reshape(-1, values)


def _source(docs: DataFrame) -> DataFrame:
    text, own = F.col("text").cast("string"), F.col("doc_id").cast("long")
    return docs.select(own.alias("doc_id"), F.coalesce(own, F.xxhash64(F.coalesce(text, F.lit("")))).alias("row"), text.alias("text"))


def marks(docs: DataFrame, values: int, shingle: int = SHINGLE) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, row, n, node, sig); node and sig are null where the set is empty."""

    def run(batches):
        shingler = Shingler(shingle)
        for b in batches:
            for low, high, text, h in shingler.sets(b.column(2)):
                full, starts, size = _starts(text, high - low)
                at = np.full(high - low, -1)
                at[full] = np.arange(len(full))
                none = at < 0
                take = pa.array(np.maximum(at, 0), mask=none)
                node, sig = pa.array(names(h, starts).view(np.int64)), _binary(signatures(h, starts, values))
                cols = [b.column(0).slice(low, high - low), b.column(1).slice(low, high - low), pa.array(size, pa.int64()), node.take(take), sig.take(take)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "row", "n", "node", "sig"])

    return _source(docs).mapInArrow(run, "doc_id long, row long, n long, node long, sig binary")


def labels(sig: np.ndarray, trees: int = TREES, least: int = LEAST, depth: int = DEPTH) -> np.ndarray:
    """A label for each row and tree: ``depth`` bytes, big end first, as a signed number of the same order."""
    at = (np.arange(trees)[:, None] * least + np.arange(depth)) % sig.shape[1]
    out = np.zeros((len(sig), trees, 8), np.uint8)
    out[:, :, :depth] = sig[:, at]
    return (out.view(">u8")[:, :, 0].astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def crowd(classes: DataFrame, trees: int = TREES, least: int = LEAST, depth: int = DEPTH) -> DataFrame:
    """classes(node, sig) -> (tree, label, node): the rows of each sorted order that may share a region."""
    values = trees * least

    def grow(batches):
        for b in batches:
            lab = labels(_matrix(b.column(1), values), trees, least, depth)
            node = np.asarray(b.column(0))
            cols = np.tile(np.arange(trees, dtype=np.int32), len(node)), lab.ravel(), np.repeat(node, trees)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["tree", "label", "node"])

    shift = np.int64(8 * (8 - least))

    def thin(batches):
        """Drops rows that share no prefix with a neighbour; at the ends of a slice the neighbour is not known."""
        held, like_last = None, True
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks().to_batches()[0]
            tree, pre = np.asarray(t.column(0)), np.asarray(t.column(1)) >> shift
            same = (tree[1:] == tree[:-1]) & (pre[1:] == pre[:-1])
            before = np.concatenate(([like_last], same))
            yield t.slice(0, len(tree) - 1).filter(pa.array(before[:-1] | same))
            held, like_last = t.slice(len(tree) - 1), bool(before[-1])
        if held is not None:
            yield held

    order = ["tree", "label", "node"]
    rows = classes.select("node", "sig").mapInArrow(grow, "tree int, label long, node long")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(thin, "tree int, label long, node long")


def _fits(n: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can be similar enough."""
    return 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])


def _best(i: np.ndarray, j: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Places of the best partner j of each i."""
    order = np.lexsort((j, e, i))
    return order[np.concatenate((i[order][1:] != i[order][:-1], [True]))] if len(order) else order


def walk(rows: DataFrame, floor: int, percent: int = PERCENT, least: int = LEAST, near: int = NEAR, values: int = TREES * LEAST) -> DataFrame:
    """Sorted rows (tree, label, node, n, sig) -> (x, y, est, centre): of each row its best neighbour and centre."""
    shift = np.int64(8 * (8 - least))

    def run(batches):
        tree = label = node = n = sig = None
        for b in batches:
            if not b.num_rows:
                continue
            new = [np.asarray(b.column(c)) for c in range(4)] + [_matrix(b.column(4), values)]
            old = 0 if tree is None else len(tree)
            tree, label, node, n, sig = new if tree is None else [np.concatenate(p) for p in zip((tree, label, node, n, sig), new)]
            pre, total = label >> shift, len(tree)
            found = []
            for k in range(1, near + 1):
                i = np.arange(max(0, old - k), total - k)
                i = i[(tree[i] == tree[i + k]) & (pre[i] == pre[i + k])]
                if not len(i):
                    break
                i = i[_fits(n, i, i + k, percent)]
                est = np.count_nonzero(sig[i] == sig[i + k], axis=1)
                ok = est >= floor
                found.append((i[ok], i[ok] + k, est[ok]))
            if found:
                i, j, e = (np.concatenate(p) for p in zip(*found))
                i, j, e = np.concatenate((i, j)), np.concatenate((j, i)), np.concatenate((e, e))
                at = _best(i, j, e)
                yield links(node[i[at]], node[j[at]], e[at], False)
            # crowded regions: the row that shares most values with all rows of the region
            edge = np.flatnonzero((tree[1:] != tree[:-1]) | (pre[1:] != pre[:-1])) + 1
            for low, high in zip(np.concatenate(([0], edge)), np.concatenate((edge, [total]))):
                if high - low > near and high > old:
                    cell = sig[low:high] + np.arange(values) * 256
                    counts = np.bincount(cell.ravel(), minlength=values * 256)
                    c = low + int(np.argmax(counts[cell].sum(1)))
                    i = np.arange(low, high)
                    i = i[(i != c) & _fits(n, i, np.full(len(i), c), percent)]
                    est = np.count_nonzero(sig[i] == sig[c], axis=1)
                    i, est = i[est >= floor], est[est >= floor]
                    yield links(node[i], np.full(len(i), node[c]), est, True)
            tree, label, node, n, sig = (x[-near:] for x in (tree, label, node, n, sig))

    def links(x, y, e, centre):
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(e.astype(np.int32)), pa.array(np.full(len(x), centre))], ["x", "y", "est", "centre"])

    return rows.mapInArrow(run, "x long, y long, est int, centre boolean")


def _pairs(found: DataFrame) -> DataFrame:
    return found.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).where("u <> v").distinct()


def _texts(nodes: DataFrame, classes: DataFrame, repeated: DataFrame, docs: DataFrame) -> DataFrame:
    """nodes(node), distinct -> (node, text): a text of each class.

    repeated(row): row ids that stand at more than one row.  Such an id may bring texts of other classes too.
    """
    needed = save(nodes.join(classes.select("node", "row"), "node").join(repeated.withColumn("again", F.lit(True)), "row", "left").select("row", "node", "again"), "needed")
    small, source = needed.count() <= BROADCAST, _source(docs).select("row", "text")
    read = lambda rows: source.join(F.broadcast(rows) if small else rows, "row").select("node", "text")
    texts = read(needed.where("again is null"))
    if needed.where("again").limit(1).count():
        texts = texts.unionAll(read(needed.where("again")).distinct())
    texts = save(texts, "texts")
    forget(needed)
    return texts


def confirm(pairs: DataFrame, classes: DataFrame, repeated: DataFrame, docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """The pairs (u, v) of classes whose full sets have the given percentage of their union in common."""
    uses = save(pairs.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("c")), "uses")
    texts = _texts(uses.select("node"), classes, repeated, docs)
    # the text that more pairs name is on the right, in one copy for 256 pairs
    of = lambda x: uses.select(F.col("node").alias(x), F.col("c").alias(f"c{x}"))
    copies = F.floor(F.greatest("cu", "cv") / 256).cast("int")
    turned = pairs.join(of("u"), "u").join(of("v"), "v").select(F.when(F.col("cu") > F.col("cv"), F.col("v")).otherwise(F.col("u")).alias("x"), F.when(F.col("cu") > F.col("cv"), F.col("u")).otherwise(F.col("v")).alias("y"), copies.alias("m"))
    turned = turned.select("x", "y", F.pmod(F.xxhash64("x"), F.col("m") + 1).cast("int").alias("salt"))
    right = texts.join(uses, "node").select(F.col("node").alias("y"), F.explode(F.sequence(F.lit(0), F.floor(F.col("c") / 256).cast("int"))).alias("salt"), F.col("text").alias("text_y"))
    left = texts.select(F.col("node").alias("x"), F.col("text").alias("text_x"))
    both = turned.join(right, ["y", "salt"]).join(left, "x").select("x", "y", "text_x", "text_y")

    def run(batches):
        shingler = Shingler(shingle)

        def sets(column, name):
            out = []
            for low, high, text, h in shingler.sets(column):
                cut = np.searchsorted(text, np.arange(high - low + 1))
                out += [h[a:b] for a, b in zip(cut[:-1], cut[1:])]
            same = [len(h) and int(names(h, np.zeros(1, int)).view(np.int64)[0]) == i for h, i in zip(out, name.to_pylist())]
            return out, same

        for b in batches:
            (a, is_u), (c, is_v) = sets(b.column(2), b.column(0)), sets(b.column(3), b.column(1))
            keep = []
            for x, y, ok in zip(a, c, (p and q for p, q in zip(is_u, is_v))):
                common = 0
                if ok:
                    all_ = np.sort(np.concatenate((x, y)), kind="stable")
                    common = int(np.count_nonzero(all_[1:] == all_[:-1]))
                keep.append(bool(ok) and 100 * common >= percent * (len(x) + len(y) - common))
            yield b.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    done = save(_pairs(both.mapInArrow(run, "x long, y long")), "confirmed", {"spark.sql.execution.arrow.maxRecordsPerBatch": "128"})
    forget(uses, texts)
    return done


def similar(sets: dict[int, np.ndarray], us: np.ndarray, vs: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs of sets have the given percentage of their union in common."""
    out = np.zeros(len(us), bool)
    order = np.argsort(us, kind="stable")
    cuts = np.flatnonzero(np.diff(us[order])) + 1
    for at in np.split(order, cuts):
        own = sets[int(us[at[0]])]
        for low in range(0, len(at), 1024):
            part = at[low : low + 1024]
            others = [sets[int(v)] for v in vs[part]]
            size = np.array([len(x) for x in others])
            flat = np.concatenate(others)
            place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            common = np.add.reduceat((own[place] == flat).astype(np.int64), np.cumsum(size) - size)
            out[part] = 100 * common >= percent * (len(own) + size - common)
    return out


def remaining(rows: DataFrame, parts: DataFrame, classes: DataFrame, repeated: DataFrame, docs: DataFrame, floor: int, percent: int = PERCENT, shingle: int = SHINGLE, trees: int = TREES, least: int = LEAST, tile: int = TILE) -> DataFrame:
    """Links (u, v) between classes that share a region and lie in different components, confirmed on full sets."""
    values, shift = trees * least, 8 * (8 - least)
    part = parts.withColumnRenamed("component", "c")
    placed = save(rows.join(part, "node", "left").select("tree", F.shiftright("label", shift).alias("pre"), "node", F.coalesce("c", "node").alias("c")), "placed")
    region = ["tree", "pre"]
    sizes = placed.groupBy(*region, "c").agg(F.count("*").alias("k"))
    # regions of more than one component, with their largest
    open_ = sizes.groupBy(*region).agg(F.max_by("c", "k").alias("main"), F.count("*").alias("m")).where("m > 1").select(*region, "main")
    sigs = classes.select("node", "n", "sig")
    left = placed.join(open_, region).withColumn("is_main", F.col("c") == F.col("main")).join(sigs, "node").select(*region, "is_main", "node", "c", "n", "sig")
    order = [*region, "is_main", "node"]

    def pack(batches):
        begin, k = TaskContext.get().partitionId() << 40, 0
        for b in batches:
            tree, pre, main, node, comp, n = (b.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            sig = _matrix(b.column(6), values)
            edge = np.flatnonzero((tree[1:] != tree[:-1]) | (pre[1:] != pre[:-1]) | (main[1:] != main[:-1])) + 1
            at = []
            for low, high in zip([0, *edge.tolist()], [*edge.tolist(), b.num_rows]):
                while low < high:
                    at.append(low)
                    fit = int(np.searchsorted(np.cumsum(n[low : low + tile]), TILE_HASHES, "right"))
                    low = min(high, low + max(1, min(tile, fit)))
            data = [[c[x:y].tobytes() for x, y in zip(at, [*at[1:], b.num_rows])] for c in (node, comp, n, sig)]
            ids = np.arange(k, k + len(at)) + begin
            k += len(at)
            yield pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (tree, pre, main)] + [pa.array(ids)] + [pa.array(d, pa.binary()) for d in data], ["tree", "pre", "is_main", "tile", "nodes", "comps", "ns", "sigs"])

    dealt = left.repartitionByRange(*order).sortWithinPartitions(*order)
    tiles = save(dealt.mapInArrow(pack, "tree int, pre long, is_main boolean, tile long, nodes binary, comps binary, ns binary, sigs binary"), "tiles")
    data = ("tile", "nodes", "comps", "ns", "sigs")
    a = tiles.where("not is_main").select(*region, *[F.col(c).alias(f"{c}_a") for c in data])
    b = tiles.select(*region, "is_main", *[F.col(c).alias(f"{c}_b") for c in data])
    both = a.join(b, region).where("is_main or tile_a <= tile_b").select("tree", *[f"{c}_{s}" for s in "ab" for c in data])

    def estimate(batches):
        """Candidates of each pair of tiles, in one row; a pair of rows counts in the first tree whose region they share."""
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                u, ca, na = (np.frombuffer(r[f"{c}_a"], np.int64) for c in data[1:4])
                v, cb, nb = (np.frombuffer(r[f"{c}_b"], np.int64) for c in data[1:4])
                sa, sb = (np.frombuffer(r[f"sigs_{s}"], np.uint8).reshape(-1, values) for s in "ab")
                fit = (ca[:, None] != cb[None]) & (100 * np.minimum(na[:, None], nb[None]) >= percent * np.maximum(na[:, None], nb[None]))
                if r["tile_a"] == r["tile_b"]:
                    fit = np.triu(fit, 1)
                i, j = np.nonzero(fit)
                found = []
                for low in range(0, len(i), 1 << 14):
                    x, y = i[low : low + (1 << 14)], j[low : low + (1 << 14)]
                    same = sa[x] == sb[y]
                    ok = np.flatnonzero(np.count_nonzero(same, axis=1) >= floor)
                    first = same[ok].reshape(-1, trees, least).all(2).argmax(1) == r["tree"]
                    found.append((x[ok[first]], y[ok[first]]))
                if found:
                    x, y = (np.concatenate(z) for z in zip(*found))
                    if len(x):
                        out.append((r["tile_a"], r["tile_b"], u[x].tobytes(), v[y].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["tile_a", "tile_b", "us", "vs"])

    few = {"spark.sql.execution.arrow.maxRecordsPerBatch": "64"}
    hits = save(both.mapInArrow(estimate, "tile_a long, tile_b long, us binary, vs binary"), "candidates", few)

    def unpack(batches):
        for b in batches:
            nodes = [np.frombuffer(x, np.int64) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(b.column(0)), [len(x) for x in nodes])), pa.array(np.concatenate(nodes))], ["tile", "node"])

    named = hits.select(F.explode(F.array("tile_a", "tile_b")).alias("tile")).distinct()
    members = save(tiles.join(named, "tile").select("tile", "nodes").mapInArrow(unpack, "tile long, node long"), "members")
    texts = _texts(members.select("node").distinct(), classes, repeated, docs)

    def hashed(batches):
        shingler = Shingler(shingle)
        for b in batches:
            for low, high, text, h in shingler.sets(b.column(1)):
                full, starts, _ = _starts(text, high - low)
                own = np.zeros(high - low, np.uint64)
                own[full] = names(h, starts)
                node = np.asarray(b.column(0))[low:high]
                cut = np.searchsorted(text, np.arange(high - low + 1))
                keep = np.flatnonzero(own.view(np.int64) == node)
                yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array([h[cut[k] : cut[k + 1]].tobytes() for k in keep], pa.binary())], ["node", "hashes"])

    sets = texts.mapInArrow(hashed, "node long, hashes binary")
    full = save(members.join(sets, "node").groupBy("tile").agg(F.collect_list(F.struct("node", "hashes")).alias("sets")), "sets")  # a tile is bounded
    of = lambda x: full.select(F.col("tile").alias(f"tile_{x}"), F.col("sets").alias(f"sets_{x}"))
    met = hits.join(of("a"), "tile_a").join(of("b"), "tile_b").select("us", "vs", "sets_a", "sets_b")

    def verify(batches):
        for b in batches:
            for r in b.to_pylist():
                known = {x["node"]: np.frombuffer(x["hashes"], np.uint64) for s in "ab" for x in r[f"sets_{s}"]}
                us, vs = (np.frombuffer(r[c], np.int64) for c in ("us", "vs"))
                ok = similar(known, us, vs, percent)
                yield pa.RecordBatch.from_arrays([pa.array(us[ok]), pa.array(vs[ok])], ["x", "y"])

    out = save(_pairs(met.mapInArrow(verify, "x long, y long")), "remaining", {"spark.sql.execution.arrow.maxRecordsPerBatch": "4"})
    forget(placed, tiles, hits, members, texts, full)
    return out


def near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, trees: int = TREES, least: int = LEAST, depth: int = DEPTH, near: int = NEAR, tile: int = TILE) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_shingles, component_id, kept): one row per row of docs."""
    values = trees * least
    floor = int(np.floor(values * percent / 100 - SPREAD * np.sqrt(values * percent / 100 * (1 - percent / 100))))
    rows = save(marks(docs, values, shingle), "marks")
    classes = save(rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("row").alias("row"), F.min("n").alias("n"), F.first("sig").alias("sig")), "classes")
    crowded = save(crowd(classes, trees, least, depth), "crowd")
    order = ["tree", "label", "node"]
    with_sig = crowded.join(classes.select("node", "n", "sig"), "node").select(*order, "n", "sig").repartitionByRange(*order).sortWithinPartitions(*order)
    found = save(walk(with_sig, floor, percent, least, near, values), "neighbours")
    best = found.groupBy("x", "centre").agg(F.max_by("y", "est").alias("y"))
    first = save(_pairs(best), "pairs")
    repeated = save(rows.groupBy("row").agg(F.count("*").alias("k")).where("k > 1").select("row"), "repeated")
    links = confirm(first, classes, repeated, docs, percent, shingle)
    parts = connected_components(links)
    more = remaining(crowded, parts, classes, repeated, docs, floor, percent, shingle, trees, least, tile)
    forget(parts)
    parts = connected_components(links.unionAll(more))
    named = classes.join(parts, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    # a component may have very many classes: its name is joined back, no list of them is built
    ids = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    of = save(named.join(ids, "component").select("node", "component_id"), "names")
    forget(classes, crowded, found, first, repeated, links, more, parts)
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = rows.select("doc_id", "n", "node").join(of, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
