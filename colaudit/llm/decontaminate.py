"""Benchmark leaks by spaced-seed hashing.

A spaced seed looks at six of the tokens under it and ignores the others, so a changed
word under a gap does not hide a copied passage.  The seeds of all benchmark items are joined by
hash with the seeds at every token of every document.  Each hit fixes an item, a document and
their alignment, along which the longest stretch with at least ``min_equal`` equal tokens is
found; it counts from ``min_words`` words on, or the whole item if that is shorter.
Items of fewer than eleven tokens (``SHORT``) are also cut into one piece more than words may differ, and
each piece is looked up at its place, so no overlap with a whole item is missed.  An item of fewer than five tokens
(``WHOLE``), such as "Yes", stands in any text; it counts only where it is the whole text.

The test set is small beside the corpus but has no fixed size: it is taken in blocks of
at most ``block_tokens`` tokens, each a bounded broadcast and a pass over the documents.

Tokens are the words between ASCII white space, lower-cased, without characters that are neither
letters nor digits; a word of other characters only is passed over.

Defined results: of equally long overlaps the first found stands; a very long text is read whole; null or empty texts and items have no hits; items or documents with
repeated ids count each row; a null id is returned as null; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TokenHash, mix, multipliers

MASKS = ("111111", "11011011", "1100110011", "10101010101", "111000111")
MIN_WORDS, MIN_EQUAL = 12, 0.8
SHORT = 11  # the five masks can miss items of fewer tokens
WHOLE = 5  # items of fewer tokens must be the whole text
BLOCK_TOKENS = 200_000
_BITS = 22
NAMES = ("doc_id", "item_id", "doc_start", "item_start", "n_span", "n_equal")


class _Words(TokenHash):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        core = "".join(filter(str.isalnum, word.decode("utf-8", "replace").lower()))
        h = (xxhash.xxh64_intdigest(core, 5) | 1) if core else 0
        self[word] = h = h - (1 << 64) if h >= 1 << 63 else h
        return h


def tokens(text: str | None, memo: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes and the numbers of their words."""
    h = memo.of((text or "").encode("utf-8", "surrogatepass").split())
    at = np.flatnonzero(h)
    return h[at], at


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i, m in zip([i for i, c in enumerate(mask) if c == "1"], multipliers(mask.count("1"), 7)):
        total += h[i : i + n] * m
    return mix(total)


def longest(equal: np.ndarray, share: float) -> tuple[int, int]:
    """The longest stretch [a, b) of which at least ``share`` is true (the first of several)."""
    gain = np.concatenate(([0.0], np.cumsum(np.where(equal, 1.0 - share, -share))))
    lows = np.flatnonzero(np.concatenate(([True], gain[1:] < np.minimum.accumulate(gain)[:-1])))
    best, b = (0, 0), len(gain) - 1
    # from the right, the lowest start not yet used that is not above the end
    high = np.maximum.accumulate(gain[::-1])[::-1]
    for a in lows.tolist():
        end = int(np.searchsorted(-high, -(gain[a] - 1e-9), side="right")) - 1
        if end - a > best[1] - best[0]:
            best = (a, end)
        if b - a <= best[1] - best[0]:
            break
    return best


class Block:
    """A bounded part of the test set, ready to be looked up; travels by broadcast."""

    def __init__(self, items: list[tuple[int, str]], min_equal: float = MIN_EQUAL):
        memo = _Words()
        self.ids = [i for i, _ in items]
        self.items = [tokens(t, memo)[0] for _, t in items]
        self.tables = []
        for mask in MASKS:
            found = [(h, np.full(len(h), k), np.arange(len(h))) for k, x in enumerate(self.items) for h in [seeds(x, mask)] if len(h)]
            if not found:
                continue
            h, k, p = (np.concatenate(c) for c in zip(*found))
            order = np.argsort(h, kind="stable")
            self.tables.append((mask, h[order], k[order], p[order]))
        pieces: dict[int, list] = {}
        for k, x in enumerate(self.items):
            if 0 < len(x) < SHORT:  # one piece more than words may differ, so one is whole
                n = min(len(x), int(len(x) * (1 - min_equal) + 1e-9) + 1)
                cuts = [len(x) * i // n for i in range(n + 1)]
                for a, b in zip(cuts, cuts[1:]):
                    pieces.setdefault(b - a, []).append((seeds(x[a:b], "1" * (b - a))[0], k, a))
        for n, found in sorted(pieces.items()):
            h, k, p = (np.array(c) for c in zip(*found))
            order = np.argsort(h, kind="stable")
            self.tables.append(("1" * n, h[order], k[order], p[order]))

    def bitmap(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << _BITS, bool)
        out[h >> np.uint64(64 - _BITS)] = True
        return out


def _hits(block: Block, bitmaps: list[np.ndarray], h: np.ndarray, ends: np.ndarray):
    """(document, item, shift) of each alignment with a hit, once; ends: where each document ends in h."""
    found = []
    for (mask, keys, items, places), bits in zip(block.tables, bitmaps):
        s = seeds(h, mask)
        at = np.flatnonzero(bits[s >> np.uint64(64 - _BITS)])
        lo, hi = np.searchsorted(keys, s[at]), np.searchsorted(keys, s[at], side="right")
        at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        doc = np.searchsorted(ends, at, side="right")
        inside = at + len(mask) <= ends[doc]
        at, lo, n, doc = at[inside], lo[inside], n[inside], doc[inside]
        j = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else lo, n) + np.arange(n.sum())
        begin = np.concatenate(([0], ends))[doc]
        found.append(np.column_stack([np.repeat(doc, n), items[j], np.repeat(at - begin, n) - places[j]]))
    return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 3), np.int64)


def _overlaps(texts: list, block: Block, bitmaps: list, memo: _Words, min_words: int, min_equal: float) -> dict:
    """(row, item) -> (doc_start, item_start, n_span, n_equal) of the longest overlap, for a list of texts."""
    best: dict = {}
    for low in range(0, len(texts), 2_000):
        parts = [tokens(t, memo) for t in texts[low : low + 2_000]]
        ends = np.cumsum([len(h) for h, _ in parts])
        for d, k, shift in _hits(block, bitmaps, np.concatenate([h for h, _ in parts]), ends).tolist():
            h, at = parts[d]
            item = block.items[k]
            begin, end = max(0, -shift), min(len(item), len(h) - shift)
            equal = item[begin:end] == h[begin + shift : end + shift]
            s, e = longest(equal, min_equal)
            if len(item) < WHOLE and not (len(h) == len(item) == e - s):
                continue
            if e - s >= min(min_words, len(item)) and e - s > best.get((low + d, k), (0,) * 4)[2]:
                best[low + d, k] = (int(at[begin + shift + s]), begin + s, e - s, int(equal[s:e].sum()))
    return best


def _scan(docs: DataFrame, block: Block, min_words: int, min_equal: float) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        block, memo = sent.value, _Words()
        bitmaps = [block.bitmap(keys) for _, keys, _, _ in block.tables]
        for b in batches:
            best = _overlaps(b.column(1).to_pylist(), block, bitmaps, memo, min_words, min_equal)
            ids = b.column(0).to_pylist()
            rows = [(ids[d], block.ids[k], *v) for (d, k), v in sorted(best.items())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], list(NAMES))

    return docs.mapInArrow(run, ", ".join(f"{n} long" for n in NAMES))


def _blocks(benchmark: DataFrame, block_tokens: int):
    """The test set in blocks of bounded size, streamed to the driver one item at a time."""
    held, n = [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    for i, text in rows.toLocalIterator():
        size = len(text.split()) + 1
        if held and n + size > block_tokens:
            yield held
            held, n = [], 0
        held.append((i, text))
        n += size
    if held:
        yield held


def leaks(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, min_equal: float = MIN_EQUAL, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> one row for each document and item that overlap.

    (doc_id, item_id, doc_start, item_start, n_span, n_equal): the longest overlap, from word
    doc_start of the text and token item_start of the item, n_span tokens, n_equal of them equal.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = [_scan(source, Block(items, min_equal), min_words, min_equal) for items in _blocks(benchmark, block_tokens)]
    if not parts:
        return docs.sparkSession.createDataFrame([], ", ".join(f"{n} long" for n in NAMES))
    return reduce(DataFrame.unionAll, parts)


def without_leaks(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, min_equal: float = MIN_EQUAL, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The documents without an overlap, all columns as they are; a text that leaks goes as a whole."""
    at = docs.columns.index("text")

    def keeps(sent):
        def run(batches):
            block, memo = sent.value, _Words()
            bitmaps = [block.bitmap(keys) for _, keys, _, _ in block.tables]
            for b in batches:
                bad = {d for d, _ in _overlaps(b.column(at).to_pylist(), block, bitmaps, memo, min_words, min_equal)}
                yield b.filter(pa.array([i not in bad for i in range(b.num_rows)], pa.bool_()))

        return run

    for items in _blocks(benchmark, block_tokens):
        docs = docs.mapInArrow(keeps(docs.sparkSession.sparkContext.broadcast(Block(items, min_equal))), docs.schema)
    return docs
