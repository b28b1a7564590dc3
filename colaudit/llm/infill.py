"""Fill-in-the-middle: cuts a text at two of its unit boundaries and moves the middle to the end.

The byte offsets where units begin, and the end of the text, are held in a ``Boundaries`` set: the offset's
high part names a chunk of 65,536 bytes, and each chunk that holds a boundary has one container, whichever is
smallest: a sorted array of 16-bit offsets, a bitmap of 8 KB, or runs (start, length).  Cumulative
cardinalities stand beside the containers, so the k-th boundary is found by a binary search for the container
and a select inside it: by index in an array, by a search in the runs' sums, by bit counts in a bitmap.  Plain ASCII
is one run a chunk, text that mixes scripts an array or a bitmap, so the set of a long text takes at most an
eighth of its bytes, and the two cut offsets are found without decoding the text.

A document's choices come from the SHA-256 of ``seed:doc_id``, so they do not depend on order, partitions or
attempts, and a lost task repeats them.

Defined results: a null text counts as empty, an empty text stays plain; a text that holds a marker stays plain, so
that every output can be turned back; a missing doc_id is an empty string in the hash; repeated rows give equal
rows; a very long text is cut as a whole, like any other; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 1, 90, 20  # percent of the texts that are cut, and of those in the order suffix, prefix, middle
CHUNK = 1 << 16
_BITMAP_BYTES = CHUNK // 8
_YIELD = 1 << 22  # bytes of output in a batch

ARRAY, BITMAP, RUNS = "array", "bitmap", "runs"


class Array:
    """Sorted 16-bit offsets."""

    kind = ARRAY

    def __init__(self, offsets: np.ndarray):
        self.offsets = offsets.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.offsets[k])


class Bitmap:
    """One bit for each of 65,536 offsets."""

    kind = BITMAP

    def __init__(self, bits: np.ndarray):
        """bits: 65,536 booleans."""
        self.words = np.packbits(bits, bitorder="little").view("<u8")

    def select(self, k: int) -> int:
        upto = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)
        w = int(np.searchsorted(upto, k, "right"))
        before = int(upto[w - 1]) if w else 0
        ones = np.flatnonzero(np.unpackbits(self.words[w : w + 1].view(np.uint8), bitorder="little"))
        return w * 64 + int(ones[k - before])


class Runs:
    """Runs of consecutive offsets, with the number of offsets before each."""

    kind = RUNS

    def __init__(self, starts: np.ndarray, sizes: np.ndarray):
        self.starts, self.upto = starts.astype(np.uint16), np.cumsum(sizes, dtype=np.int64)

    def select(self, k: int) -> int:
        r = int(np.searchsorted(self.upto, k, "right"))
        return int(self.starts[r]) + k - (int(self.upto[r - 1]) if r else 0)


def container(bits: np.ndarray) -> Array | Bitmap | Runs:
    """The smallest container of a chunk's boundaries (booleans by offset, 65,536 at most)."""
    edge = np.diff(np.concatenate(([0], bits.view(np.int8), [0])))
    starts = np.flatnonzero(edge == 1)
    n = int(np.count_nonzero(bits))
    if 4 * len(starts) < min(2 * n, _BITMAP_BYTES):
        return Runs(starts, np.flatnonzero(edge == -1) - starts)
    if 2 * n <= _BITMAP_BYTES:
        return Array(np.flatnonzero(bits))
    full = np.zeros(CHUNK, bool)
    full[: len(bits)] = bits
    return Bitmap(full)


class Boundaries:
    """An ordered set of byte offsets with select; built chunk by chunk."""

    def __init__(self) -> None:
        self.keys: list[int] = []
        self.containers: list[Array | Bitmap | Runs] = []
        self.upto: list[int] = []

    def add(self, key: int, bits: np.ndarray) -> None:
        """The boundaries of chunk ``key``; chunks come in order, those without a boundary are left out."""
        n = int(np.count_nonzero(bits))
        if n:
            self.keys.append(key)
            self.containers.append(container(bits))
            self.upto.append((self.upto[-1] if self.upto else 0) + n)

    def __len__(self) -> int:
        return self.upto[-1] if self.upto else 0

    def select(self, k: int) -> int:
        """The k-th smallest offset, from 0."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        c = int(np.searchsorted(self.upto, k, "right"))
        return self.keys[c] * CHUNK + self.containers[c].select(k - (self.upto[c - 1] if c else 0))


def code_points(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 begin a code point."""
    return (data & 0xC0) != 0x80


def lines(data: np.ndarray, before: int | None = None) -> np.ndarray:
    """Which bytes begin a line: the first, and each behind a line feed.  before: the byte before the data."""
    out = np.empty(len(data), bool)
    out[1:] = data[:-1] == 10
    out[:1] = before is None or before == 10
    return out


#: name -> (bytes, byte before them or None) -> where units begin
UNITS = {"code points": lambda data, before: code_points(data), "lines": lines}


def boundaries(data: bytes, unit: str = "code points") -> Boundaries:
    """Where the units of a text begin, and its end."""
    found, bytes_ = Boundaries(), np.frombuffer(data, np.uint8)
    for low in range(0, len(data) + 1, CHUNK):
        part = bytes_[low : low + CHUNK]
        bits = UNITS[unit](part, data[low - 1] if low else None)
        if low + CHUNK > len(data):
            bits = np.append(bits, True)
        found.add(low // CHUNK, bits)
    return found


def choices(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four 32-bit numbers from the hash of seed and doc_id."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(h[i : i + 8], 16) for i in range(0, 32, 8))


def cut(data: bytes, doc_id: int | None, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED, unit: str = "code points", markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> tuple[int, str, int | None, int | None, bytes]:
    """(number of units, form, units in the prefix, units in the middle, output) of one text in UTF-8."""
    p, s, m = (x.encode() for x in markers)
    at = boundaries(data, unit)
    n = len(at) - 1
    h1, h2, h3, h4 = choices(doc_id, seed)
    if not data or h3 % 100 >= rate or p in data or s in data or m in data:
        return n, "plain", None, None, data
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = at.select(low), at.select(high)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if h4 % 100 < spm_rate:
        return n, "spm", low, high - low, b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", low, high - low, b"".join((p, prefix, s, suffix, m, middle))


def transform(docs: DataFrame, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED, unit: str = "code points", markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n, form, prefix_units, middle_units, output), a row for each row."""

    def run(batches):
        for b in batches:
            rows, held = [], 0
            for i, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary())):
                row = cut(text.as_py() or b"", i, rate, spm_rate, seed, unit, markers)
                rows.append((i, *row))
                held += len(row[-1])
                if held >= _YIELD:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)

    def batch(rows):
        doc_id, n, form, prefix, middle, output = zip(*rows)
        cols = [pa.array(doc_id, pa.int64()), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "form", "prefix_units", "middle_units", "output"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n long, form string, prefix_units long, middle_units long, output string")


def restore(output: Column, form: Column, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that ``transform`` was given, from its output and form."""
    quoted = "|".join("\\Q" + m + "\\E" for m in markers)
    part = F.split(output, quoted, 4)  # '', then three parts; none of them holds a marker
    psm = F.concat(F.get(part, 1), F.get(part, 3), F.get(part, 2))
    spm = F.concat(F.get(part, 2), F.get(part, 3), F.get(part, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
