from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from test_sensitivity import FIELDS

from colaudit.operators import history, remediation, retention, scoring
from colaudit.schemas import COLUMNS, RETENTION, SENSITIVITY, TABLES, USAGE
from colaudit.sources.policy import RetentionPolicy

NOW = datetime(2026, 9, 8, tzinfo=timezone.utc)


def column(name, kind="timestamptz", oldest=None, newest=None, table="t", temporal=True):
    ago = lambda d: (NOW - timedelta(days=d)).strftime("%Y-%m-%dT%H:%M:%S") if d is not None else None
    row = dict.fromkeys(FIELDS) | dict(qualified_name=f"{table}.{name}", table=table, name=name, ordinal=1, generic_type=kind, raw_type=kind, nullable=True, is_primary_key=False, is_foreign_key=False, is_temporal=temporal, min_value=ago(oldest), max_value=ago(newest), sample_values=[])  # noqa: C408
    return tuple(row[f] for f in FIELDS)


@pytest.fixture
def check(spark):
    def run(*rows, policy=None, live=None):
        return {r["qualified_name"]: r for r in retention.check(spark.createDataFrame(list(rows), COLUMNS), policy or RetentionPolicy(365), NOW, live).collect()}

    return run


def test_staleness_curve(check):
    score = lambda age: check(column("created_at", oldest=age))["t.created_at"]["score"]
    assert score(300) == 0.0 and abs(score(365 + 182) - 0.5) < 0.01 and score(730) == score(2000) == 1.0


def test_columns_inherit_from_the_anchor(check):
    r = check(column("created_at", oldest=900, newest=1), column("email", "string", temporal=False), column("date_of_birth", "date", oldest=20000), column("updated_at", oldest=100))
    assert r["t.email"]["basis"] == "table:created_at" and r["t.email"]["score"] == r["t.created_at"]["score"] == 1.0
    assert r["t.date_of_birth"]["basis"] == "table:created_at"  # an attribute, not a lifecycle time
    assert r["t.updated_at"]["basis"] == "self" and r["t.updated_at"]["score"] == 0.0
    assert r["t.created_at"]["days_overdue"] == 535 and r["t.created_at"]["oldest_row_age_days"] == 900


def test_policy_chain(check):
    p = RetentionPolicy(365, {"t": 2555}, {"t.created_at": 90, "t.gender": 1}, exclude=["*.updated_at"])
    r = check(column("created_at", oldest=200), column("gender", "string", temporal=False), column("updated_at", oldest=9000), policy=p)
    assert (r["t.created_at"]["policy_days"], r["t.created_at"]["policy_source"]) == (90, "column")
    assert r["t.gender"]["policy_days"] == 2555 and r["t.gender"]["score"] == 0.0  # an override of such a column has no effect
    assert r["t.updated_at"]["basis"] == "excluded"


def test_without_times(check):
    assert check(column("a", "string", temporal=False))["t.a"]["basis"] == "no-temporal-data"


def test_named_anchor(check):
    r = check(column("created_at", oldest=10), column("closed_at", oldest=900), column("x", "string", temporal=False), policy=RetentionPolicy(365, anchors={"t": "closed_at"}))
    assert r["t.x"]["basis"] == "table:closed_at" and r["t.x"]["score"] == 1.0


def test_live_rows_weigh_the_score(spark, check):
    df = spark.createDataFrame([((NOW - timedelta(days=800)).replace(tzinfo=None),)] + [((NOW - timedelta(days=2)).replace(tzinfo=None),)] * 99, "created_at timestamp_ntz")
    rows = spark.createDataFrame([column("created_at", oldest=800)], COLUMNS)
    live = retention.live_stats({"t": df}, rows, RetentionPolicy(365), NOW)
    r = check(column("created_at", oldest=800), live=live)["t.created_at"]
    assert (r["rows_total"], r["rows_overdue"], r["fraction_overdue"]) == (100, 1, 0.01)
    assert abs(r["score"] - (0.4 + 0.6 * 0.1)) < 1e-3


def test_policy_files(spark, tmp_path):
    (tmp_path / "p.yaml").write_text("default_days: 100\ntables:\n  t: 5\nexclude: ['*.x']\n")
    (tmp_path / "p.json").write_text('{"default_days": 100, "tables": {"t": 5}, "exclude": ["*.x"]}')
    a, b = (RetentionPolicy.from_file(spark, f"file://{tmp_path}/p.{x}") for x in ("yaml", "json"))
    assert a == b == RetentionPolicy.from_dict(a.to_dict())


def signals(spark, s, u, r):
    name = "t.c"
    return (
        spark.createDataFrame([(name, s, s >= 0.5, "high", "contact", 0.9, ["name:x"])], SENSITIVITY), spark.createDataFrame([(name, u, "rare", 5, 0, None)], USAGE),
        spark.createDataFrame([(name, r, r > 0, 100, 365, "created_at", 465, "self", 0.5)], RETENTION),
    )


@pytest.mark.parametrize(
    "s,u,r,verdict,flag,score",
    [(0.90, 0.95, 1.0, "keep", False, 0.045), (0.90, 0.0, 0.0, "review", False, 0.0), (0.90, 0.0, 1.0, "flag_for_deletion", True, 0.90), (0.05, 0.0, 1.0, "not_a_risk", False, 0.05), (0.90, 0.30, 1.0, "keep", False, 0.63), (0.50, 0.20, 0.50, "flag_for_deletion", True, 0.2)],
)
def test_verdicts(spark, s, u, r, verdict, flag, score):
    n = scoring.score_all(*signals(spark, s, u, r)).first()
    assert (n["verdict"], n["is_flagged"], n["score"]) == (verdict, flag, score)
    assert len(n["reasons"]) == 2 and n["breakdown"]["product"] == score


def test_missing_signals_are_neutral(spark):
    s, u, r = signals(spark, 0.9, 0.5, 1.0)
    n = scoring.score_all(s, u.where("false"), r.where("false")).first()
    assert (n["usage"], n["retention"], n["verdict"]) == (0.0, 0.0, "review")
    assert {x["verdict"]: x["n"] for x in scoring.histogram(scoring.score_all(s, u, r)).collect()} == {"flag_for_deletion": 0, "review": 0, "keep": 1, "not_a_risk": 0}


def run(spark, scores):
    rows = [(f"t.c{i}", float(s), float(u), float(r)) for i, (s, u, r) in enumerate(scores)]
    df = spark.createDataFrame(rows, "qualified_name string, sensitivity double, `usage` double, retention double")
    g = scoring.gate(df)
    return g.withColumn("rank", F.lit(1)).withColumn("remediation", F.when(F.col("is_flagged"), F.struct(F.lit("x").alias("sql"))))


def test_history(spark, tmp_path):
    h = history.History(spark, f"file://{tmp_path}/h")
    assert h.count() == 0
    t0 = datetime(2026, 1, 1)
    a = h.record(run(spark, [(0.9, 0, 1), (0.9, 0, 1), (0.1, 0, 0)]), started_at=t0, finished_at=t0, note="a")
    b = h.record(run(spark, [(0.9, 0, 1), (0.9, 0, 0), (0.1, 0, 0)]), started_at=t0, finished_at=t0 + timedelta(days=1), note="b")
    assert h.count() == 2 and h.resolve("latest") == b and [r["note"] for r in h.list_runs().collect()] == ["b", "a"]
    assert h.findings(a, flagged_only=True).count() == 2 and h.runs().where(F.col("id") == a).first()["n_flagged"] == 2
    d = h.diff(a, b).collect()
    assert {(r["qualified_name"], r["change"]) for r in d} == {("t.c1", "no_longer_flagged"), ("t.c1", "verdict_changed"), ("t.c1", "score_moved")}
    assert h.diff(a, a).count() == 0
    assert [r["score_delta"] for r in h.trend("t.c1").collect()] == [-0.9, None]
    assert h.remediation(a, "t.c0")["sql"] == "x"
    for bad in (lambda: h.resolve("nope"), lambda: h.finding(a, "t.zz"), lambda: h.remediation(a, "t.c2")):
        with pytest.raises(history.RunNotFound):
            bad()
    with pytest.raises(ValueError):
        h.list_runs(0)


def test_added_and_removed_columns(spark):
    a, b = run(spark, [(0.9, 0, 1)]), run(spark, [(0.1, 0, 0), (0.9, 0, 1)])
    changes = {(r["qualified_name"], r["change"]) for r in history.diff(a, b).collect()}
    assert ("t.c1", "newly_flagged") in changes and ("t.c0", "no_longer_flagged") in changes


def draft(spark, dialect="postgresql", **flags):
    n = scoring.score_all(*signals(spark, 0.9, 0.0, 1.0))
    row = dict.fromkeys(FIELDS) | dict(qualified_name="t.c", table="t", name="c", raw_type="text", nullable=True, is_primary_key=False, is_foreign_key=False) | flags  # noqa: C408
    columns = spark.createDataFrame([tuple(row[f] for f in FIELDS)], COLUMNS)
    tables = spark.createDataFrame([("t", "public", 1, None, ["id"])], TABLES)
    return remediation.draft(n, columns, tables, dialect, datetime(2026, 9, 9)).first()


def test_drafts(spark, tmp_path):
    d = draft(spark)
    assert d["strategy"] == "archive_then_drop" and d["reversible"]
    for part in ("BEGIN;", 'SELECT "id", "c" FROM "public"."t" WHERE "c" IS NOT NULL;', 'ALTER TABLE "public"."t" DROP COLUMN "c";', "t__c__20260909", "interval '365 days'"):
        assert part in d["sql"]
    k = draft(spark, is_foreign_key=True, nullable=False, foreign_key_target="u.id")
    assert k["strategy"] == "anonymize_in_place" and not k["reversible"] and "SET \"c\" = ''" in k["sql"] and any("u.id" in c for c in k["cautions"])
    assert "-- UPDATE" in draft(spark, is_primary_key=True)["sql"]
    assert "`c`" in draft(spark, "mysql")["sql"] and "BEGIN" not in draft(spark, "mysql")["sql"]
    assert draft(spark)["sql"] == d["sql"]
    n = scoring.score_all(*signals(spark, 0.9, 0.9, 1.0))
    none = remediation.draft(n, spark.createDataFrame([], COLUMNS), spark.createDataFrame([], TABLES))
    assert none.first()["strategy"] == "none" and remediation.write_drafts(none, str(tmp_path)) == 0
