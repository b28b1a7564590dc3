"""Words of whole Arrow columns as arrays: where they stand in the bytes, and two independent hashes of each.

Nothing is done word by word in Python: a word's hash is a polynomial modulo 2**64 over its bytes (each
byte stands for a drawn 64-bit number), taken from prefix sums over the column's bytes.  Words longer
than ``LONG`` bytes, where such polynomials can be made to collide, are hashed by XXH64 and XXH3.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from .common import mix

LONG = 64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_DRAWN = np.array([[xxhash.xxh64_intdigest(bytes([b]), seed) for b in range(256)] for seed in (101, 102)], np.uint64)
_FACTORS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)  # odd, so that their powers can be inverted


class Powers:
    """Powers of an odd factor and their inverses, as many as were needed so far."""

    def __init__(self, factor: int):
        self.factor, self.up, self.down = factor, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> Powers:
        if n > len(self.up):
            size = 1 << n.bit_length()
            for name, f in (("up", self.factor), ("down", pow(self.factor, -1, 1 << 64))):
                steps = np.full(size, f, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self

    def of(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of values[start:end] for each start and end."""
        self.to(len(values) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * self.up[: len(values)], dtype=np.uint64)))
        return mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))


class Words:
    """The words of one stretch of texts: ``start`` and ``end`` in ``data``, ``sizes`` by text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        """data: bytes of the texts, one after the other; offsets: where each begins, and the last's end."""
        self.data = data
        char = ~_SPACE[data]
        inner = offsets[(offsets > 0) & (offsets < len(data))]  # texts touch each other there
        before = np.concatenate((np.zeros(1, bool), char[:-1]))[: len(data)]
        before[inner] = False
        after = np.concatenate((char[1:], np.zeros(1, bool)))[: len(data)]
        after[inner - 1] = False
        self.start, self.end = np.flatnonzero(char & ~before), np.flatnonzero(char & ~after) + 1
        self.sizes = np.diff(np.searchsorted(self.start, offsets))

    def hashes(self, powers: tuple[Powers, Powers]) -> np.ndarray:
        out = np.stack([p.of(drawn[self.data], self.start, self.end) for p, drawn in zip(powers, _DRAWN)])
        for k in np.flatnonzero(self.end - self.start > LONG).tolist():
            word = self.data[self.start[k] : self.end[k]].tobytes()
            out[:, k] = xxhash.xxh64_intdigest(word, 11), xxhash.xxh3_64_intdigest(word, 12)
        return out

    def joined(self, keep: np.ndarray) -> pa.Array:
        """Each text's kept words joined by one space."""
        text = np.repeat(np.arange(len(self.sizes)), self.sizes)[keep]
        start, end = self.start[keep], self.end[keep]
        inside = np.zeros(len(self.data) + 1, np.int8)
        inside[start] = 1
        inside[end] -= 1  # a text may begin where another ends
        mask = np.cumsum(inside[:-1], dtype=np.int8) > 0
        data = self.data.copy()
        space = end[:-1][text[:-1] == text[1:]]  # a space or the like stands behind each word but the last
        mask[space] = True
        data[space] = 32
        size = np.bincount(text, end - start, len(self.sizes)).astype(np.int64) + np.maximum(np.bincount(text, minlength=len(self.sizes)) - 1, 0)
        offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data[mask])])
        return found.cast(pa.binary()).cast(pa.string())


def powers() -> tuple[Powers, Powers]:
    return tuple(map(Powers, _FACTORS))


def chunks(column: pa.Array, size: int = 1 << 18) -> Iterator[tuple[int, int, Words]]:
    """(first row, last row + 1, words) of a column of texts, about ``size`` bytes at a time, whole texts always.

    Nulls have no words.
    """
    texts = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.empty(0, np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size)))
        high = min(high, len(texts))
        yield low, high, Words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        low = high
