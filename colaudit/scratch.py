"""What driver and executors share: a folder for tables written between steps, and this package."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def reach_workers(spark: SparkSession) -> None:
    """Python workers that see this folder find the package there, wherever the driver was started."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in (found := env.get("PYTHONPATH", "")).split(":"):
        env["PYTHONPATH"] = f"{root}:{found}".strip(":")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where the session has none and all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="colaudit-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once and reads it back, so that a lost executor costs no more than the step after."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
