"""Byte-level BPE with a segment tree over byte positions.

A text is cut into matches of the pattern, each match merged on its own.  The tree's
leaves are the byte positions; a leaf holds the rank of the pair that starts there (with the
position in the low bits, so that the least leaf is the leftmost pair of the least rank).  A
merge changes the pair at the position, that of its left neighbour, and clears that of the right
one: three point updates of logarithmic cost (a node has 16 children, so a match of up to 16 bytes
is a tree of one node), and a match of n bytes takes n log n steps.

Encoding and decoding are one pass (``round_trip``) or one each.  Words recur, so a Python worker
remembers the ids of short matches, as packed integers, up to a bounded number of bytes
(``MEMO_BYTES``); what it remembers holds for all tasks it runs.

Defined results: a null text counts as empty and has no ids; special tokens are ordinary text; a very long
text is encoded whole (a long match by the same tree, and is not remembered); repeated rows and
null or repeated ids are encoded each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FAN = 16  # children of a node of the segment tree
_NONE = 1 << 62
LONG = 64  # characters from which on a match is not remembered
MEMO_BYTES = 128 << 20  # what a worker remembers, with what its dict and objects take
_ENTRY = 190  # bytes of an entry besides its characters and ids
_SLICE = 4 << 20  # characters encoded at a time


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one match."""
    get = ranks.get
    if (whole := get(piece)) is not None:
        return [whole]
    n = len(piece)
    shift = n.bit_length()
    low = (1 << shift) - 1
    end = list(range(1, n + 1))  # where the token that starts here ends
    prev = list(range(-1, n))
    found = [get(piece[i : i + 2]) for i in range(n - 1)]
    leaves = [_NONE if r is None else r << shift | i for i, r in enumerate(found)]
    leaves.append(_NONE)
    tree = [leaves]  # each level holds the minima of _FAN nodes of the one below
    while len(tree[-1]) > _FAN:
        below = tree[-1]
        tree.append([min(below[k : k + _FAN]) for k in range(0, len(below), _FAN)])
    top, upper = tree[-1], range(1, len(tree))
    while (least := min(top)) != _NONE:
        i = least & low
        j = end[i]
        e = end[i] = end[j]
        leaves[j] = leaves[i] = _NONE
        if e < n:
            prev[e] = i
            if (r := get(piece[i : end[e]])) is not None:
                leaves[i] = r << shift | i
        if (p := prev[i]) >= 0:
            r = get(piece[p:e])
            leaves[p] = _NONE if r is None else r << shift | p
        for at in (j, i, p) if upper else ():
            for level in upper:  # up to the first node that stays as it is
                at //= _FAN
                if at < 0 or tree[level][at] == (new := min(tree[level - 1][at * _FAN : at * _FAN + _FAN])):
                    break
                tree[level][at] = new
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder(dict):
    """match -> its ids as packed 32-bit integers, remembered up to ``limit`` bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, limit: int = MEMO_BYTES):
        import regex

        super().__init__()
        self.ranks, self.find, self.limit, self.held = ranks, regex.compile(pattern).findall, limit, 0

    def __missing__(self, match: str) -> bytes:
        ids = merge(match.encode("utf-8", "surrogatepass"), self.ranks)
        packed = struct.pack(f"={len(ids)}i", *ids)
        if len(match) < LONG:
            size = _ENTRY + len(match) + len(packed)
            if self.held + size > self.limit:
                self.clear()
                self.held = 0
            self.held += size
            self[match] = packed
        return packed

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin and the last's end."""
        packed = [b"".join(map(self.__getitem__, self.find(t))) if t else b"" for t in texts]
        return np.frombuffer(b"".join(packed), np.int32), np.cumsum([0, *map(len, packed)]) // 4


class Decoder:
    """Bytes of ids, by a look-up of whole arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        of: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            of[rank] = token
        self.tokens = pa.array(of, pa.large_binary())

    def of(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """One binary for each stretch of ids between two ends."""
        found = self.tokens.take(pa.array(ids))
        if found.null_count:
            raise ValueError("an id is not in the vocabulary")
        if not len(ids):
            return pa.array([b""] * (len(ends) - 1), pa.binary())
        _, offsets, data = found.buffers()
        at = np.frombuffer(offsets, np.int64)[found.offset :][ends]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(at)), data]).cast(pa.binary())


_kept: dict[tuple, object] = {}


def _once(key: tuple, make):
    """What this Python worker has made before under the key; one of a kind is kept."""
    if key not in _kept:
        for old in [k for k in _kept if k[0] == key[0]]:
            del _kept[old]
        _kept[key] = make()
    return _kept[key]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``_SLICE`` bytes each."""
    if not len(texts):
        return
    size = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    low = 0
    while low < len(texts):
        before = size[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(size, before + _SLICE, "right")))
        yield low, high
        low = high


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _encoded(docs: DataFrame, path: str, pattern: str, back: bool) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches):
        encoder = _once(("encoder", path, pattern), lambda: Encoder(sent.value, pattern))
        decoder = _once(("decoder", path), lambda: Decoder(sent.value)) if back else None
        for b in batches:
            texts = b.column(1)
            for low, high in _slices(texts):
                flat, ends = encoder.of(texts.slice(low, high - low).to_pylist())
                cols = [b.column(0).slice(low, high - low), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))]
                yield pa.RecordBatch.from_arrays([*cols, decoder.of(flat, ends)] if back else cols, ["doc_id", "ids", "decoded"][: 2 + back])

    return _source(docs).mapInArrow(run, "doc_id long, ids array<int>" + ", decoded binary" * back)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, ids array<int>).

    path: the vocabulary, read on the driver and broadcast (a fixed size); pattern: what one match is.
    """
    return _encoded(docs, path, pattern, False)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, ids array<int>, decoded binary): encodes, then decodes the ids, in one pass."""
    return _encoded(docs, path, pattern, True)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded(doc_id, ids) -> (doc_id, ids, decoded binary); null ids give no bytes."""
    sent = encoded.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches):
        decoder = _once(("decoder", path), lambda: Decoder(sent.value))
        for b in batches:
            ids = b.column(1)
            ends = np.cumsum([0, *pa.compute.fill_null(pa.compute.list_value_length(ids), 0).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), ids, decoder.of(ids.flatten().to_numpy(zero_copy_only=False), ends)], ["doc_id", "ids", "decoded"])

    source = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return source.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
