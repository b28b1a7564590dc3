"""Shared helpers: table access, lineage cuts, word splitting, hashing."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: The ASCII white space that separates words everywhere in this subpackage
#: (``bytes.split()`` splits on exactly these six characters).
WORD_SQL = "[^\\x20\\x09-\\x0D]+"
SPACE_SQL = "[\\x20\\x09-\\x0D]+"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # workers that see this folder find the package there, wherever the driver was started
    root = str(Path(__file__).resolve().parents[2])
    if root not in (found := spark.sparkContext.environment.get("PYTHONPATH", "")).split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{found}".strip(":")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none (tests on one machine) a temporary folder is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="colaudit-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextlib.contextmanager
def session_conf(spark: SparkSession, values: dict[str, str]):
    """Sets runtime options for one action and puts the old values back."""
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def save(df: DataFrame, name: str, conf: dict[str, str] | None = None) -> DataFrame:
    """Cuts the lineage: writes ``df`` to the shared folder and reads it back.

    Its shuffle files are dropped as soon as the write is done, so the disk holds
    one step's shuffle at a time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with session_conf(spark, {_CLEANUP: "true"} | (conf or {})):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._colaudit_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Deletes what ``save`` wrote for these frames; nothing may read them later."""
    for df in frames:
        path = getattr(df, "_colaudit_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


class TokenHash(dict):
    """word (bytes) -> signed 64-bit hash, remembered up to a bounded number of words."""

    def __init__(self, seed: int = 0, limit: int = 400_000):
        super().__init__()
        self.seed, self.limit = seed, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = xxhash.xxh64_intdigest(word, self.seed)
        h = h - (1 << 64) if h >= 1 << 63 else h
        self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words)).view(np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of 64-bit MurmurHash3, so that sums of products become even in all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def multipliers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit factors drawn by a fixed rule from the seed."""
    return np.array([xxhash.xxh64_intdigest(f"{seed}:{i}") | 1 for i in range(n)], np.uint64)


def windows(tokens: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` token hashes (empty if there are fewer)."""
    n = len(tokens) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i, m in enumerate(multipliers(width, seed)):
        total += tokens[i : i + n] * m
    return mix(total)
