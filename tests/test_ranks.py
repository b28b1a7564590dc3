"""Exact ranks in slices against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from colaudit import registry
from colaudit.operators import evaluation, ranks, usage


@pytest.mark.parametrize("n", [0, 1, 3, 5000])
def test_running_totals(spark, n):
    r = random.Random(n)
    rows = {(None if n > 1 and i == 0 else r.randrange(-(10**6), 10**6)): r.randrange(1, 50) for i in range(n)}
    got = ranks.running(spark.createDataFrame(list(rows.items()), "v long, c long").repartition(3), "v", "c").collect()
    want, before = {}, 0
    for v in sorted(rows, key=lambda x: (x is not None, x)):
        want[v], before = before, before + rows[v]
    assert {x["v"]: x["_before"] for x in got} == want and all(x["_total"] == before for x in got)


def test_mid_rank_and_average_rank(spark):
    r = random.Random(4)
    values = [r.choice((0.0, r.random(), 7.5)) for _ in range(900)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k long, v double").repartition(5)
    mid = {x["k"]: x["rank_fraction"] for x in usage.rank_fraction(df, "v").collect()}
    avg = {x["k"]: x["a"] for x in evaluation.average_rank(df, "v", "a").collect()}
    for i, v in enumerate(values):
        low, same = sum(x < v for x in values), sum(x == v for x in values)
        assert mid[i] == pytest.approx((low + same / 2) / (len(values) - 1)) and avg[i] == low + (same + 1) / 2


@pytest.mark.parametrize("within", [None, "g"])
def test_positions(spark, within):
    r = random.Random(8)
    rows = [(r.choice("abc") if r.random() < 0.95 else None, r.randrange(4), f"n{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, s long, name string").repartition(7)
    got = ranks.positions(df, F.col("g"), F.desc("s"), F.col("name"), within=within).collect()
    order, want, seen = sorted(rows, key=lambda x: (x[0] is not None, x[0] or "", -x[1], x[2])), {}, {}
    for k, x in enumerate(order, 1):
        seen[x[0]] = seen.get(x[0], 0) + 1
        want[x[2]] = seen[x[0]] if within else k
    assert {x["name"]: x["rank"] for x in got} == want and set(got[0].asDict()) == {"rank", "g", "s", "name"}
    assert ranks.positions(df.limit(0), F.col("g")).count() == 0


@pytest.mark.parametrize("name", ["score_all_report", "score_verdict_rank", "usage_midrank", "usage_spearman", "usage_log_bands", "usage_score_tier"])
def test_no_window_over_all_rows(spark, data, name):
    plan = registry.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if " Window [" in line:
            assert "_slice#" in line.rpartition("], [")[0].rpartition("windowspecdefinition(")[2], line
