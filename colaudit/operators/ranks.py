"""Exact ranks of relations of any size: no window ever runs over all rows in one task.

``running`` takes totals over values: slices are cut at approximate quantiles, each slice is summed by itself, and the
sums of the slices before are added.  Cuts and sums are two small scalar sub-queries, so the plan stays lazy and gives the
same result however often a part of it is repeated.

``positions`` numbers whole rows: they are dealt by ranges and sorted, written once with their slice and place in it, and
the sizes of the slices before are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import keep


def _slices(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def running(counts: DataFrame, value: str, weight: str, before: str = "_before", total: str = "_total") -> DataFrame:
    """counts, one row for each value, with the sum of ``weight`` over smaller values and over all.

    A null value is smaller than all others.
    """
    n = _slices(counts)
    cuts = counts.agg(F.percentile_approx(value, [i / n for i in range(1, n)], 10_000)).scalar()
    at = F.when(F.col(value).isNull() | F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col(value))))
    placed = counts.withColumn("_cuts", cuts).withColumn("_slice", at).drop("_cuts")
    sums = placed.groupBy("_slice").agg(F.sum(weight).alias("w")).agg(F.collect_list(F.struct("_slice", "w"))).scalar()
    add = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x["w"].cast("long"))
    inside = Window.partitionBy("_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    smaller = F.coalesce(F.sum(weight).over(inside), F.lit(0)) + add(F.filter("_sums", lambda x: x["_slice"] < F.col("_slice")))
    return placed.withColumn("_sums", sums).select(*counts.columns, smaller.alias(before), add(F.col("_sums")).alias(total))


def positions(rows: DataFrame, *order: Column, out: str = "rank", within: str | None = None) -> DataFrame:
    """rows with their place in the order, from 1; ``within`` a column that the order begins with, in each of its values."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = keep(dealt.select("*", F.spark_partition_id().alias("_slice"), place.alias("_place")), "ordered")
    keys = ["_slice"] if within is None else ["_slice", within]
    sizes = placed.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_place").alias("low"))
    # a row for each slice (and value in it): as few as there are tasks
    all_ = sizes.agg(F.collect_list(F.struct(*keys, "n"))).scalar()
    same = (lambda x: x["_slice"] < F.col("_slice")) if within is None else (lambda x: (x["_slice"] < F.col("_slice")) & x[within].eqNullSafe(F.col(within)))
    offset = F.aggregate(F.filter("_all", same), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    starts = sizes.withColumn("_all", all_).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], (offset - F.col("low") + 1).alias("_add"))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = placed.join(F.broadcast(starts), on[0] if len(on) == 1 else on[0] & on[1])
    return joined.select((F.col("_place") + F.col("_add")).alias(out), *rows.columns)
