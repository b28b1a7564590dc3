"""Connected components by alternating large-star and small-star steps.

Each step is an aggregate of minima and a join, so a node with very many links is
pre-aggregated before its shuffle and split by the skew join; no list of neighbours is built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, save


def _stamp(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum((F.xxhash64("b", "a") % 1_000_003))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(u, v) of longs -> (node, component), component the smallest node reachable.

    Nulls and loops are ignored, repeated edges count once; nodes without an edge to
    another node are not returned.  No edges give no rows.
    """
    links = edges.where("u is not null and v is not null and u <> v")
    now = save(links.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), "edges")
    stamp = _stamp(now)
    for _ in range(max_rounds):
        both = now.select(F.col("a").alias("n"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("n"), F.col("a").alias("v")))
        least = both.groupBy("n").agg(F.min("v").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.where("v > n").join(least, "n").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = save(large, "large")
        roots = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(roots, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = save(small.unionAll(roots.select("a", F.col("m").alias("b"))).distinct(), "edges")
        forget(large, now)
        now, old = new, stamp
        stamp = _stamp(now)
        if stamp == old:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    out = save(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots), "components")
    forget(now)
    return out
