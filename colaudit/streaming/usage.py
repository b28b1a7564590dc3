"""Usage counts from a streaming log, ranked in batch.

The usage score ranks each column among all, which no stream can do row by row; what is kept
per column and day, or per column and block of days, can be added up over any window.

``daily_partials`` closes a day when the watermark has passed it.  ``block_states`` keeps state for whole blocks of 63 days:
counts, first and last access, and a mask with a bit for each day, so distinct days of blocks, batches and windows add up by
bit operations.  Its state is a built-in aggregate, so it stays in the JVM and in the state store; a row that is late by less
than the watermark's delay is merged into its block, whatever has arrived meanwhile.  With a delay as long as the longest
window that is scored, rows that come later than that can change no score; without one no row is too late, and the state
has a row for each column and block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTIALS = ("read_count", "write_count", "first_at", "last_at")
BLOCK = 63  # days: the bits of a long without its sign
STATES = (*PARTIALS, "days")


def _counts(is_write: str = "is_write") -> list[Column]:
    return [F.count_if(~F.col(is_write)).alias("read_count"), F.count_if(is_write).alias("write_count"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at")]


def _bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))


def daily_partials(touches: DataFrame, key: str = "qualified_name", watermark: str | None = "1 day") -> DataFrame:
    """touches(key, ts, is_write) -> one row per key and day; with a watermark late days are closed on a stream."""
    t = touches.withWatermark("ts", watermark) if watermark and touches.isStreaming else touches
    return t.groupBy(key, F.window("ts", "1 day").alias("w")).agg(*_counts()).select(key, F.to_date("w.start").alias("day"), *PARTIALS)


def block_states(touches: DataFrame, key: str = "qualified_name", watermark: str | None = None) -> DataFrame:
    """touches(key, ts, is_write) -> (key, block, read_count, write_count, first_at, last_at, days), in batch or as state.

    block is the number of 63 days since 1970; bit i of days is set if its day i has an access.
    """
    t = touches
    if watermark and touches.isStreaming:  # the state of a block goes when the watermark has passed its end
        t = t.withWatermark("ts", watermark)
        block = F.window("ts", f"{BLOCK} days")
        number = F.floor(F.unix_date(F.to_date("_b.start")) / BLOCK)
    else:
        block = F.floor(F.unix_date(F.to_date("ts")) / BLOCK)
        number = F.col("_b")
    bit = _bit(F.pmod(F.unix_date(F.to_date("ts")), F.lit(BLOCK)))
    found = t.withColumn("_bit", bit).groupBy(key, block.alias("_b")).agg(*_counts(), F.bit_or("_bit").alias("days"))
    return found.select(key, number.cast("long").alias("block"), *STATES)


def merge_states(states: DataFrame, key: str = "qualified_name", window_days: int | None = None, until=None) -> DataFrame:
    """States of any blocks -> (key, read_count, write_count, first_access_at, last_access_at, distinct_days).

    Of a window, the last ``window_days`` days up to ``until``, only the distinct days and the last access are exact: counts
    and the first access are those of the blocks that it meets.
    """
    days = F.col("days")
    if window_days is not None:
        # the bits of the block's days in the window: those from its first to its last day here
        last = F.unix_date(F.lit(until).cast("date")) - F.col("block") * BLOCK
        low, high = F.greatest(last - window_days + 1, F.lit(0)), F.least(last, F.lit(BLOCK - 1))
        upto = lambda n: F.when(n >= BLOCK - 1, F.lit((1 << BLOCK) - 1)).otherwise(_bit(n + 1) - 1)
        mask = upto(high).bitwiseAND(F.bitwise_not(_bit(low) - 1))
        days = days.bitwiseAND(F.when((low > BLOCK - 1) | (high < 0), F.lit(0).cast("long")).otherwise(mask))
    met = states.withColumn("_days", days).where("_days <> 0")
    return met.groupBy(key).agg(
        F.sum("read_count").alias("read_count"), F.sum("write_count").alias("write_count"), F.min("first_at").alias("first_access_at"), F.max("last_at").alias("last_access_at"),
        F.sum(F.bit_count("_days")).alias("distinct_days"),
    )


def merge(partials: DataFrame, key: str = "qualified_name", window_days: int | None = None, until=None) -> DataFrame:
    """Partials of any days -> counts per key, for scoring."""
    p = partials
    if window_days is not None:
        p = p.where((F.col("day") <= F.lit(until)) & (F.col("day") > F.date_sub(F.lit(until).cast("date"), window_days)))
    return p.groupBy(key).agg(F.sum("read_count").alias("read_count"), F.sum("write_count").alias("write_count"), F.min("first_at").alias("first_access_at"), F.max("last_at").alias("last_access_at"), F.count_distinct("day").alias("distinct_days"))


def _sink(path: str):
    """Each batch overwrites its own folder, so a batch that is repeated after a failure changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def _run(states: DataFrame, path: str, checkpoint: str) -> None:
    states.writeStream.outputMode("update").foreachBatch(_sink(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_available(stream: DataFrame, path: str, checkpoint: str, key: str = "qualified_name") -> None:
    """Processes what is there into daily partials and stops."""
    _run(daily_partials(stream, key), path, checkpoint)


def run_states(stream: DataFrame, path: str, checkpoint: str, key: str = "qualified_name", watermark: str | None = None) -> None:
    """Processes what is there into states of blocks and stops; the next run goes on from the state."""
    _run(block_states(stream, key, watermark), path, checkpoint)


def _latest(spark: SparkSession, path: str, keys: list[str], values: tuple[str, ...]) -> DataFrame:
    rows = spark.read.option("basePath", path).parquet(path)
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("x"))
    return latest.select(*keys, "x.*")


def read_partials(spark: SparkSession, path: str, key: str = "qualified_name") -> DataFrame:
    """The latest state of each key and day among the batches written."""
    return _latest(spark, path, [key, "day"], PARTIALS)


def read_states(spark: SparkSession, path: str, key: str = "qualified_name") -> DataFrame:
    """The latest state of each key and block among the batches written."""
    return _latest(spark, path, [key, "block"], STATES)
