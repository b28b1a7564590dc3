"""Faster forms against the plain ones: paragraphs, searches, name rules, measured tables, the guard."""

from __future__ import annotations

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from colaudit.functions import rules, text
from colaudit.operators import guard, policy_text, retention, sensitivity
from colaudit.sources import catalog
from colaudit.sources.policy import RetentionPolicy


def brute_paragraphs(t):
    out, heading, held = [], "", []

    def flush():
        if held and (p := " ".join(held)):
            out.append((heading, p))
        held.clear()

    for line in t.split("\n"):
        line = line.strip(" \t\r")
        bullet = re.match(r"[-*]\s+", line)
        if line == "" or line.startswith("#") or bullet:
            flush()
        if line.startswith("#"):
            heading = re.sub(r"^[\d.\s]+", "", line.lstrip("#").strip(" "))
        elif line:
            held.append(re.sub("[*_`]", "", re.sub(r"^[-*]\s+", "", line)))
    flush()
    return out


def test_paragraphs_equal_a_loop(spark):
    r = random.Random(5)
    parts = ["# 1.2 Head", "## Other *x*", "text **bold** here", "more", "", "\t", " ", "- item one", "* item", "-", "*word*", "  indented", "a # b", "#", "end.\r", "-no bullet"]
    texts = ["\n".join(r.choice(parts) for _ in range(r.randrange(1, 14))) for _ in range(400)] + ["", "\n", "# only"]
    rows = policy_text.paragraphs(spark.createDataFrame(list(enumerate(texts)), "doc long, text string")).orderBy("doc", "pos").collect()
    got = {}
    for x in rows:
        got.setdefault(x["doc"], []).append((x["heading"], x["paragraph"]))
    for i, t in enumerate(texts):
        assert got.get(i, []) == brute_paragraphs(t), repr(t)


def test_paragraphs_do_not_shuffle(spark):
    plan = policy_text.extract_rules(spark.createDataFrame([(1, "a")], "doc long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_quick_searches_find_the_same(spark):
    r = random.Random(9)
    pieces = ["a@b.de", "@", "x@y", ".com", "q@w.c", "A@B.COM", "123-45-6789", "1123-45-67890", "+49 30 1234567", "(030) 123 45 67", "12345678", "5+123456789012", " ", ".", "-", "1 2 3 4 5 6 7 8 9 0 .", "é", "٣٤٥", None]
    rows = [("".join(r.choice(pieces[:-1]) + r.choice(("", " ")) for _ in range(r.randrange(6))),) for _ in range(1500)] + [(None,), ("",)]
    df = spark.createDataFrame(rows, "v string")
    for name, p, _, _ in rules.EMBEDDED_RULES:
        odd = df.where(~text.found_in(F.col("v"), p).eqNullSafe(F.col("v").rlike(f"(?i){p}")))
        assert p in text._QUICK and odd.count() == 0, name


def test_name_rules(spark):
    names = ["email address", "ip address", "home address", "user name", "date of birth", "card last4", "zz9", "", None, "customer ssn number", "phone email password"]
    n = F.col("n")
    df = spark.createDataFrame([(x,) for x in names], "n string").withColumn("hits", sensitivity.name_hits(n))
    for x in df.select("n", sensitivity.name_score(F.col("hits")).alias("s"), sensitivity.name_type(F.col("hits")).alias("t"), sensitivity.name_matches(F.col("hits")).alias("m"), sensitivity.matched(n, rules.NAME_RULES, "name").alias("want")).collect():
        found = [k for k in rules.NAME_RULES if f"name:{k[0]}" in (x["want"] or [])]
        best = max(found, key=lambda k: k[3], default=None)
        assert (x["m"], x["s"], x["t"]) == (x["want"], best[3] if best else 0.0, best[2] if best else None)


def test_measured_equals_live_stats(spark):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(i, t0 - datetime.timedelta(days=10 * i), (t0 - datetime.timedelta(days=i)).date(), "x") for i in range(50)]
    df = spark.createDataFrame(rows, "id long, created_at timestamp_ntz, start_date date, s string")
    none = spark.createDataFrame([], "at timestamp_ntz")
    policy = RetentionPolicy(100, columns={"t.start_date": 20})
    cutoff = lambda t, c: F.lit(t0).cast("timestamp_ntz") - F.make_dt_interval(policy.days_for(F.lit(t), F.lit(c))["days"])
    measured = catalog.measure({"t": df, "empty": none}, cutoff)
    columns, tables = catalog.extract({"t": df, "empty": none}, measured=measured)
    want = retention.live_stats({"t": df, "empty": none}, columns, policy, t0)
    got = set(map(tuple, catalog.live(measured).collect()))
    assert ("t.start_date", 50, 29, 0.58) in got  # no lifecycle column: retention does not ask for it
    assert {(r["qualified_name"], r["rows_total"], r["rows_overdue"], r["fraction_overdue"]) for r in want.collect()} == got - {("t.start_date", 50, 29, 0.58)}
    assert {r["name"]: r["row_count"] for r in tables.collect()} == {"t": 50, "empty": 0}
    assert {r["name"]: r["max_value"] for r in columns.collect()} == {"id": None, "s": None, "created_at": "2024-01-01T00:00:00", "start_date": "2024-01-01", "at": None}


def test_a_sample_does_not_depend_on_partitions(spark):
    df = spark.range(500).select("id", F.create_map(F.lit("k"), "id").alias("m"), F.array("id").alias("a"))
    one, two = (sorted(r["id"] for r in catalog.sample_rows(x, 20).collect()) for x in (df.repartition(7), df.coalesce(1)))
    assert one == two and len(one) == 20


@pytest.mark.parametrize(
    ("sql", "ok"),
    [
        ("select 1; drop table t", False), ("select 1;  ;", True), ("select ';drop' -- ; drop\n", True), ("with x as (delete from t returning a) select * from x", False), ("with x as (select 1) insert into t select * from x", False),
        ("with x as (select 'insert into' a) select * from x for update", True), ("with x as (update t set a = 1 returning a) select 1", False), ("explain /* analyze */ select 1", True), ("select 'it''s; fine'", True), ("show tables;", True),
    ],
)
def test_guard_of_hidden_changes(spark, sql, ok):
    assert spark.createDataFrame([(sql,)], "q string").select(guard.is_read(F.col("q"))).first()[0] is ok
    if ok:
        guard.assert_read(sql)
    else:
        with pytest.raises(guard.WriteAttemptBlocked):
            guard.assert_read(sql)
