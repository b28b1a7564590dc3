from __future__ import annotations

import bisect
import json
import random
from datetime import datetime, timedelta

import pytest

from colaudit.operators import evaluation, usage
from colaudit.schemas import LOG
from colaudit.sources import querylog
from colaudit.streaming import usage as stream

NOW = datetime(2026, 9, 8)


def entry(days_ago, reads=(), writes=(), sql="", service="web", template="q", op="SELECT"):
    return (NOW - timedelta(days=days_ago), "q", op, sql, service, "app", template, list(reads), list(writes), 1)


@pytest.fixture
def log(spark):
    return lambda *rows: spark.createDataFrame(list(rows), LOG)


def by_name(df):
    return {r["qualified_name"]: r for r in df.collect()}


def test_window_is_inclusive(log):
    rows = usage.in_window(log(entry(0, ["t.a"]), entry(90, ["t.a"]), entry(90.01, ["t.a"])), 90)
    assert rows.count() == 2


def test_scores_rank_by_use(log):
    r = by_name(usage.analyze(log(*[entry(1, ["t.hot"]) for _ in range(50)], *[entry(1, ["t.warm"]) for _ in range(5)], entry(80, ["t.old"]), entry(1, [], ["t.written"])), window_days=90, now=NOW, mode="declared"))
    assert r["t.hot"]["score"] > r["t.warm"]["score"] > r["t.old"]["score"] > 0
    assert r["t.written"]["write_count"] == 1 and r["t.written"]["read_count"] == 0
    assert r["t.hot"]["access_by_service"] == {"web": 50} and r["t.hot"]["tier"] in ("frequent", "heavy", "occasional")


def test_unseen_columns_get_zero(spark, log):
    columns = spark.createDataFrame([("t.a", "t", "a"), ("t.b", "t", "b")], "qualified_name string, `table` string, name string")
    r = by_name(usage.analyze(log(entry(1, ["t.a"]), entry(1, ["x.c"])), columns, now=NOW, mode="declared"))
    assert r["t.b"]["score"] == 0 and r["t.b"]["tier"] == "unused" and not r["t.b"]["is_used"] and r["x.c"]["is_used"]


def test_modes(spark, log):
    columns = spark.createDataFrame([("t.a", "t", "a"), ("t.b", "t", "b")], "qualified_name string, `table` string, name string")
    rows = log(entry(1, ["t.b"], sql="SELECT a FROM t"))
    used = lambda mode: {k for k, v in by_name(usage.analyze(rows, columns, now=NOW, mode=mode)).items() if v["is_used"]}
    assert (used("sql"), used("declared"), used("hybrid")) == ({"t.a"}, {"t.b"}, {"t.a", "t.b"})
    with pytest.raises(ValueError, match="mode"):
        usage.attribute(rows, columns, "guess")


def test_falls_back_to_declared(log):
    r = by_name(usage.analyze(log(entry(1, ["t.b"], sql="not sql at all")), now=NOW, mode="sql"))
    assert r["t.b"]["attribution"] == "declared"


def test_mid_rank_equals_bisect(spark):
    values = [random.Random(3).choice([0.0, 1.0, 1.0, 2.5, 7.0]) for _ in range(40)]
    got = usage.rank_fraction(spark.createDataFrame([(v,) for v in values], "v double"), "v").collect()
    s = sorted(values)
    for r in got:
        mid = (bisect.bisect_left(s, r["v"]) + bisect.bisect_right(s, r["v"])) / 2 / (len(s) - 1)
        assert abs(r["rank_fraction"] - mid) < 1e-12
    one = usage.rank_fraction(spark.createDataFrame([(3.0,)], "v double"), "v").first()
    assert one["rank_fraction"] == 1.0


def test_spearman(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 9.0), (4.0, 16.0)], "x double, y double")
    assert abs(evaluation.spearman(rows, "x", "y").first()["spearman"] - 1) < 1e-9
    assert evaluation.spearman(rows.limit(2), "x", "y").first()["spearman"] == 0.0


def test_usage_follows_the_log(log):
    rng = random.Random(1)
    rows = [entry(rng.random() * 5, [f"t.c{min(int(rng.expovariate(0.3)), 15)}"]) for _ in range(600)]
    u = usage.analyze(log(*rows), now=NOW, mode="declared")
    truth = evaluation.log_derived(log(*rows)).selectExpr("qualified_name", "band as expected_usage")
    e = evaluation.evaluate_usage(u, truth).first()
    assert e["precision"] == e["recall"] == 1.0 and e["spearman"] >= 0.9


def test_log_readers(spark, tmp_path):
    rows = [dict(ts="2026-09-01T10:00:00Z", query_id="q1", operation="select", sql="SELECT 1", service="s", columns_read=["t.a"], columns_written=None, rows=3), dict(ts="2026-09-02T10:00:00+02:00", operation="update", columns_read=[], columns_written=["t.b"])]  # noqa: C408
    (tmp_path / "l.jsonl").write_text("﻿".join(["", ""]) + "\n\n".join(json.dumps(r) for r in rows))
    (tmp_path / "l.csv").write_text('ts,query_id,operation,sql,service,columns_read,columns_written,rows\n2026-09-01T10:00:00Z,q1,select,"SELECT a, b",s,t.a|t.b; t.c,,3\n')
    j = querylog.read(spark, f"file://{tmp_path}/l.jsonl").orderBy("ts").collect()
    assert [r["operation"] for r in j] == ["SELECT", "UPDATE"] and j[0]["declared_reads"] == ["t.a"] and j[1]["service"] == "" and j[1]["ts"].hour == 8
    c = querylog.read(spark, f"file://{tmp_path}/l.csv").first()
    assert c["declared_reads"] == ["t.a", "t.b", "t.c"] and c["sql"] == "SELECT a, b" and c["rows"] == 3
    (tmp_path / "plain.log").write_text((tmp_path / "l.csv").read_text())
    assert querylog.read(spark, f"file://{tmp_path}/plain.log").count() == 1


def test_stream_equals_batch(spark, tmp_path, log):
    rows = [entry(d / 3, [f"t.c{d % 4}"]) for d in range(40)]
    batch = usage.touches(usage.attribute(log(*rows), None, "declared"))
    batch.write.parquet(f"file://{tmp_path}/in")
    source = spark.readStream.schema(batch.schema).parquet(f"file://{tmp_path}/in")
    stream.run_available(source, f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    got = stream.merge(stream.read_partials(spark, f"file://{tmp_path}/out"))
    want = batch.groupBy("qualified_name").count()
    assert {r[0]: r["read_count"] for r in got.collect()} == {r[0]: r[1] for r in want.collect()}
