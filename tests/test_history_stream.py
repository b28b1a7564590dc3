"""Run history under failures and concurrent writers; stream state over restarts and late rows."""

from __future__ import annotations

import datetime
import random
import threading
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from colaudit.operators import history
from colaudit.streaming import usage as stream

T0 = datetime.datetime(2024, 1, 1)
FINDING = "qualified_name string, rank long, score double, is_flagged boolean, verdict string, sensitivity double, usage double, retention double"


def findings(spark, n, verdict="keep"):
    return spark.createDataFrame([(f"t.c{i}", i, i / 10, verdict == "flag_for_deletion", verdict, 0.5, 0.5, 0.5) for i in range(n)], FINDING)


def record(h, rows, hours=0, note=""):
    return h.record(rows, started_at=T0, finished_at=T0 + datetime.timedelta(hours=hours), note=note)


def test_a_writer_that_dies_leaves_no_run(spark, tmp_path, monkeypatch):
    h = history.History(spark, f"file://{tmp_path}/h")
    assert h.count() == 0
    a = record(h, findings(spark, 3))

    def die(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:  # after the findings, before the manifest
        m.setattr(history.History, "_commit", die)
        with pytest.raises(RuntimeError):
            record(h, findings(spark, 5), 1)
    with monkeypatch.context() as m:  # after the manifest was written aside, before the rename
        own = history.History._hadoop

        def no_rename(self, path):
            if "/runs/run-" in path:
                raise RuntimeError("killed")
            return own(self, path)

        m.setattr(history.History, "_hadoop", no_rename)
        with pytest.raises(RuntimeError):
            record(h, findings(spark, 7), 2)
    assert h.count() == 1 and h.resolve("latest") == a
    assert h.findings().count() == 3 and h.all_findings().count() == 3 and h.trend("t.c2").count() == 1
    b = record(h, findings(spark, 3, "flag_for_deletion"), 3)
    assert {(r["change"], r["qualified_name"]) for r in h.diff(a, b).collect()} == {(c, f"t.c{i}") for c in ("newly_flagged", "verdict_changed") for i in range(3)}
    assert len(h.sweep()) == 2 and h.sweep() == [] and h.count() == 2 and h.all_findings().count() == 6


def test_writers_at_the_same_time(spark, tmp_path):
    h, failed = history.History(spark, f"file://{tmp_path}/h"), []

    def work(k):
        try:
            record(h, findings(spark, k + 1), k, str(k))
        except Exception as e:  # told below
            failed.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and h.count() == 4
    got = h.all_findings().groupBy("run_id").count().join(h.runs().withColumnRenamed("id", "run_id"), "run_id").collect()
    assert sorted((r["note"], r["count"], r["n_columns"]) for r in got) == [(str(k), k + 1, k + 1) for k in range(4)]


def test_changes_equal_a_join(spark):
    r = random.Random(3)
    rows = [(f"c{i}", run, r.random(), r.random() < 0.5, r.choice(("keep", "review"))) for i in range(200) for run in (0, 1, 2) if r.random() < 0.8]
    df = spark.createDataFrame(rows, "qualified_name string, run_id long, score double, is_flagged boolean, verdict string")
    want = history.diff(df.where("run_id = 0"), df.where("run_id = 2"))
    assert sorted(history.changes(df, 0, 2).collect(), key=str) == sorted(want.collect(), key=str)


@pytest.mark.parametrize("watermark", [None, "400 days"])
def test_state_goes_on_after_a_restart_and_takes_late_rows(spark, tmp_path, watermark):
    r, rows = random.Random(6), []
    for _ in range(600):
        rows.append((f"c{r.randrange(5)}", T0 + datetime.timedelta(days=r.randrange(200), seconds=r.randrange(86_400)), r.random() < 0.3))
    schema, source = "qualified_name string, ts timestamp, is_write boolean", f"file://{tmp_path}/in"
    for part in range(4):  # files in no order of time; the second run begins with the state of the first
        spark.createDataFrame(rows[part::4], schema).coalesce(1).write.mode("append").parquet(source)
        if part in (1, 3):
            s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
            stream.run_states(s, f"file://{tmp_path}/out", f"file://{tmp_path}/state", watermark=watermark)
    states = stream.read_states(spark, f"file://{tmp_path}/out")
    got = {x["qualified_name"]: tuple(x)[1:] for x in stream.merge_states(states).collect()}
    by = defaultdict(list)
    for c, ts, w in rows:
        by[c].append((ts, w))
    want = {c: (sum(not w for _, w in x), sum(w for _, w in x), min(x)[0], max(t for t, _ in x), len({t.date() for t, _ in x})) for c, x in by.items()}
    assert got == want
    assert sorted(stream.block_states(spark.createDataFrame(rows, schema)).collect()) == sorted(states.collect())
    for days in (1, 30, 63, 64, 150):
        until = datetime.date(2024, 6, 1)
        got = {x["qualified_name"]: x["distinct_days"] for x in stream.merge_states(states, window_days=days, until=until).collect()}
        inside = {c: len({t.date() for t, _ in x if until - datetime.timedelta(days=days) < t.date() <= until}) for c, x in by.items()}
        assert got == {c: n for c, n in inside.items() if n}
