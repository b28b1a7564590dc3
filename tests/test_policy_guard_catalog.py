from __future__ import annotations

import datetime
import math
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from colaudit import cli
from colaudit.functions.text import char_ngrams, entropy, glob_pattern, split_names
from colaudit.functions.types import family_of_native
from colaudit.operators import guard, policy_text
from colaudit.plans.audit import AuditConfig, run_audit
from colaudit.schemas import LOG
from colaudit.sources import catalog
from colaudit.sources.jdbc import ReadOnlyReader, ReadOnlyReport, TargetConfig
from colaudit.sources.policy import RetentionPolicy

POLICY = """# Data retention

_Reviewed every 12 months._

## 2.1 Orders
Order and transaction records **must
be retained for 7 years** from the date of purchase.
## 2.2 Support
Support tickets **should be deleted after
1 year** from closing. Ticket satisfaction survey answers are kept for 6 months only.

## 2.3 Users
User account profiles are retained for
**3 years**.

## 2.4 Logs
Login history, including source IP addresses, is retained for **90 days**.

- Access requests are answered within 30 days of receipt.
- Breaches are reported within **72 hours**.
- Backups are rotated on a 35 day cycle; this does not extend the periods above.

## 2.7 Other
Any category not listed above is retained for no longer than **two years** by default.
"""
TARGETS = list(policy_text.SYNONYMS)


def test_rules_of_a_document(spark):
    r = policy_text.extract_rules(policy_text.read_document(spark, POLICY)).orderBy("pos", "part").collect()
    assert [x["retention_days"] for x in r] == [2555, 365, 180, 1095, 90, 730]
    assert [x["is_default"] for x in r] == [False] * 5 + [True]
    assert r[0]["confidence"] == 0.9 and r[0]["heading"] == "Orders" and r[0]["category"] == "Order and transaction records"


def test_mapping_and_policy(spark):
    rules = policy_text.extract_rules(policy_text.read_document(spark, POLICY))
    p = policy_text.propose_mappings(rules, TARGETS)
    got = {r["retention_days"]: r for r in p.collect()}
    assert got[2555]["target"] == "orders" and got[2555]["suggested"] and got[730]["target_kind"] == "default"
    assert got[1095]["target"] == "users" and got[90]["target_kind"] == "column"
    policy = policy_text.to_policy(p)
    assert policy.default_days == 730 and policy.tables["orders"] == 2555
    assert policy_text.to_policy(p, set()).tables == {}
    text = policy_text.review_yaml(p, "doc")
    assert "orders: 2555" in text and "default_days: 730" in text
    import yaml

    assert RetentionPolicy.from_dict(yaml.safe_load(text)).tables["orders"] == 2555


def test_conflicts_keep_the_longer(spark):
    text = "# Orders\n\nOrder invoices must be retained for 2 years.\n\nOrder payment records must be retained for 5 years.\n"
    p = policy_text.propose_mappings(policy_text.extract_rules(policy_text.read_document(spark, text)), TARGETS)
    c = policy_text.conflicts(p).first()
    assert c["target"] == "orders" and [o["days"] for o in c["options"]] == [1825, 730]
    assert policy_text.to_policy(p, {"orders"}).tables == {"orders": 1825}


def _by_hand(cat: str, words: list[str], targets: list[str], synonyms: dict[str, list[str]], tokens: dict[str, list[str]]):
    """All targets by score, each compared with each."""
    import difflib

    out = []
    for i, t in enumerate(sorted((t for t in synonyms if t in targets), key=lambda t: "." in t)):
        hits = sum(term in cat or any(term in k or k in term for k in words) for term in synonyms[t])
        same = len(set(words) & set(tokens[t])) / len(tokens[t]) if tokens[t] else 0.0
        fuzzy = max((difflib.SequenceMatcher(None, k, n).ratio() for k in words for n in tokens[t]), default=0.0)
        total = 0.6 * min(1.0, hits / 2) + 0.25 * same + 0.15 * fuzzy
        out.append((-float(Decimal(repr(total)).quantize(Decimal("0.001"), ROUND_HALF_UP)), i, t))
    return [(t, -s) for s, _, t in sorted(out) if s < 0]


def test_mapping_equals_comparing_all(spark):
    import random

    draw = random.Random(5)
    stems = ["order", "ip", "age", "agenda", "shipment", "logins", "login", "birth", "bodies", "rate", "useful", "sexton", "optin", "subscriber", "zzz", "case", "showcase", "qqx", "demographics", "invoices"]
    lexicon = policy_text.SYNONYMS | {"wide": ["ab", "x", "order"], "wide.agenda_items": ["agenda item", "showcase"], "zz.qq_ww": ["never spoken of"]}
    rows = []
    for i in range(150):
        said = [draw.choice(stems) for _ in range(draw.randint(0, 4))]
        rows.append((f"d{i % 7}", i, 0, " ".join(said).title(), 30 * i, "", "s", "", [w for w in dict.fromkeys(said) if len(w) > 2], 0.6, i % 19 == 0))
    names = "doc string, pos int, part int, category string, retention_days int, raw_period string, sentence string, heading string, keywords array<string>, confidence double, is_default boolean"
    rules = spark.createDataFrame(rows + rows[:5], names)
    for targets in (list(lexicon), ["orders", "users.gender"], []):
        tokens = {t: spark.range(1).select(policy_text.keywords(F.lit(t.replace(".", " ").replace("_", " ")))).first()[0] for t in targets}
        got = policy_text.propose_mappings(rules, targets, lexicon).collect()
        assert len(got) == 155
        for r in got:
            want = _by_hand(r["category"].lower(), r["keywords"], targets, lexicon, tokens)
            if r["is_default"]:
                assert (r["target_kind"], r["target"], r["match_score"], r["suggested"], r["alternatives"]) == ("default", None, 1.0, True, [])
                continue
            top = want[0] if want else (None, 0.0)
            assert r["match_score"] == pytest.approx(top[1])
            hit = top[1] >= 0.3
            assert r["target"] == (top[0] if hit else None)
            rest = [x for x in want[1:4] if x[1] > 0.1] if hit else want[:3]
            assert [(a["target"], a["score"]) for a in r["alternatives"]] == rest
            assert r["suggested"] == (hit and top[1] >= 0.5 and top[1] - (want[1][1] if len(want) > 1 else 0.0) >= 0.12 - 1e-9)


def test_subjects_of_the_queries_without_spark():
    import re

    from colaudit.queries import _SUBJECTS

    def words(text):
        found = [re.sub("s+$", "", w) if len(w) > 4 else w for w in re.findall(r"[a-z][a-z-]+", text.lower())]
        return list(dict.fromkeys(w for w in found if w not in policy_text.STOP and len(w) > 2))

    tokens = {t: words(t.replace(".", " ").replace("_", " ")) for t in TARGETS}
    for subject, kind, target, score, suggested, others in _SUBJECTS:
        ranked = _by_hand(subject.lower(), list(dict.fromkeys(words(subject) + ["record"])), TARGETS, policy_text.SYNONYMS, tokens)
        hit = ranked[0][1] >= 0.3
        rest = [x for x in ranked[1:4] if x[1] > 0.1] if hit else ranked[:3]
        assert (target, score) == (ranked[0][0] if hit else None, ranked[0][1]), subject
        assert kind == ("unmapped" if not hit else "column" if "." in target else "table")
        assert others == "; ".join(f"{n} {x:.3f}" for n, x in rest), subject
        assert suggested == (hit and score >= 0.5 and score - ranked[1][1] >= 0.12 - 1e-9)


def test_drafted_by_document(spark):
    rows = [("a", 0, 0, "orders", 10, "table", True), ("a", 1, 0, "orders", 30, "table", True), ("a", 2, 0, "users.gender", 5, "column", False), ("a", 3, 0, None, 7, "default", True), ("a", 4, 0, None, 9, "default", True), ("b", 0, 0, "orders", 20, "table", True), ("b", 1, 0, None, 4, "unmapped", False)]
    p = spark.createDataFrame(rows, "doc string, pos int, part int, target string, retention_days int, target_kind string, suggested boolean")
    got = {(r["doc"], r["target"]): r["retention_days"] for r in policy_text.drafted(p).collect()}
    assert got == {("a", "orders"): 30, ("a", None): 9, ("b", "orders"): 20}
    assert {r["target"] for r in policy_text.drafted(p, {"users.gender"}).collect()} == {"users.gender", None}
    q = p.withColumn("category", F.lit("c")).withColumn("sentence", F.lit("s"))
    assert policy_text.conflict_evidence(q).count() == 3 and policy_text.conflicts(q).first()["options"][0]["days"] == 30


def test_no_rules(spark):
    rules = policy_text.extract_rules(policy_text.read_document(spark, "Nothing here.\nAt all.\n"))
    assert rules.count() == 0 and policy_text.propose_mappings(rules, TARGETS).count() == 0


READS = ["SELECT 1", "  with x as (select 1) select * from x", "/* c */ SELECT 1", "-- c\nSHOW tables", "EXPLAIN SELECT 1", "rollback"]
WRITES = ["INSERT INTO t VALUES (1)", "update t set a = 1", "DELETE FROM t", "DROP TABLE t", "/* select */ truncate t", "-- select\nALTER TABLE t ADD c int", "EXPLAIN ANALYZE DELETE FROM t", "CREATE TABLE t (a int)", "GRANT ALL ON t TO u", "COPY t FROM 'x'", ""]


def test_guard(spark):
    rows = spark.createDataFrame([(s,) for s in READS + WRITES], "sql string").withColumn("ok", guard.is_read(F.col("sql")))
    assert {r["sql"] for r in rows.where("ok").collect()} == set(READS)
    for s in READS:
        guard.assert_read(s)
    for s in WRITES:
        with pytest.raises(guard.WriteAttemptBlocked):
            guard.assert_read(s)


def test_profile(spark):
    df = spark.createDataFrame([(1, "a", datetime.datetime(2020, 1, 1), Decimal("1.50"), b"xy", [1]), (2, None, datetime.datetime(2021, 1, 1), None, None, None)], "id long, s string, at timestamp_ntz, d decimal(5,2), b binary, l array<int>")
    keys = spark.createDataFrame([("t", "id", True, False, None, False, False, None), ("t", "s", False, True, "u.id", False, False, "inet")], "`table` string, name string, is_primary_key boolean, is_foreign_key boolean, foreign_key_target string, is_unique boolean, is_indexed boolean, generic_type string")
    columns, tables = catalog.extract({"t": df}, keys)
    c = {r["name"]: r for r in columns.collect()}
    assert [c[n]["generic_type"] for n in ("id", "s", "at", "d", "b", "l")] == ["integer", "inet", "timestamp", "numeric", "bytes", "array"]
    assert c["id"]["is_primary_key"] and c["id"]["is_unique"] and c["s"]["is_foreign_key"] and c["s"]["sample_null_fraction"] == 0.5
    assert (c["at"]["min_value"], c["at"]["max_value"]) == ("2020-01-01T00:00:00", "2021-01-01T00:00:00") and c["at"]["is_temporal"]
    assert c["b"]["sample_values"] == ["<2 bytes>"] and c["d"]["sample_values"] == ["1.5"] and c["l"]["sample_values"] == ["[1]"]
    t = tables.first()
    assert (t["row_count"], t["primary_key"]) == (2, ["id"])
    with pytest.raises(catalog.MissingTables, match="zz"):
        catalog.extract({"t": df}, wanted=["zz"])


def test_document_round_trip(spark, tmp_path):
    df = spark.range(5).withColumn("n", F.lit("x"))
    columns, tables = catalog.extract({"t": df})
    catalog.save_document(columns, tables, f"file://{tmp_path}/m")
    c, t = catalog.load_document(spark, f"file://{tmp_path}/m")
    assert sorted(map(str, c.collect())) == sorted(map(str, columns.collect())) and t.first()["row_count"] == 5


def test_native_types():
    got = [family_of_native(x) for x in ("VARCHAR(20)", "text", "bigint", "numeric(10,2)", "double precision", "timestamp with time zone", "jsonb", "int[]", "point", "datetime", "citext")]
    assert got == ["string", "text", "integer", "numeric", "float", "timestamptz", "json", "array", "integer", "other", "string"]


def test_text_functions(spark):
    r = spark.createDataFrame([("aabb", "ab c", "a|b; c")], "a string, b string, c string").select(entropy(F.col("a")).alias("e"), char_ngrams(F.col("b")).alias("g"), split_names(F.col("c")).alias("s"), F.col("c").rlike(glob_pattern("a?b*")).alias("m")).first()
    assert math.isclose(r["e"], 1.0) and r["s"] == ["a", "b", "c"] and r["m"] and set(r["g"]) == {" a", "ab", "b ", " ab", "ab ", " ab ", " c", "c ", " c "}


def test_target_config(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("AUDIT_DB_HOST='h'\nAUDIT_DB_PASSWORD=pw\n# x\n")
    monkeypatch.setenv("AUDIT_DB_USER", "u")
    c = TargetConfig.from_env(str(tmp_path / ".env"), database="d")
    assert c.url == "jdbc:postgresql://h:5432/d" and "pw" not in repr(c) and "READ ONLY" in c.options()["sessionInitStatement"]
    assert ReadOnlyReport().ok and not ReadOnlyReport(writable_tables=("t",)).ok
    init = c.options(timeout_s=7, lock_s=3, idle_s=11)["sessionInitStatement"]
    assert all(x in init for x in ("statement_timeout = '7s'", "lock_timeout = '3s'", "idle_in_transaction_session_timeout = '11s'"))
    my = TargetConfig(dialect="mysql", database="d").options(timeout_s=7)["sessionInitStatement"]
    assert "transaction_read_only = 1" in my and "max_execution_time = 7000" in my and "lock_wait_timeout = 5" in my and ";" not in my


@pytest.mark.parametrize(
    ("held", "ro", "ok", "tables"),
    [
        ([("*.*", "USAGE"), ("shop.*", "SELECT")], 1, True, ()),
        ([("shop.orders", "UPDATE"), ("shop.orders", "INSERT"), ("shop.a", "SELECT")], 1, False, ("shop.orders",)),
        ([("*.*", "SUPER")], 1, False, ()),
        ([("shop.*", "CREATE VIEW")], 1, False, ()),
        ([("shop.*", "SELECT")], 0, False, ()),
        ([], 1, True, ()),
    ],
)
def test_mysql_accounts_are_verified(spark, monkeypatch, held, ro, ok, tables):
    asked = []

    def answer(self, sql):
        guard.assert_read(sql)
        asked.append(sql)
        return spark.createDataFrame([(ro,)], "ro int") if "@@session" in sql else spark.createDataFrame(held, "place string, privilege string")

    monkeypatch.setattr(ReadOnlyReader, "query", answer)
    reader = ReadOnlyReader(spark, TargetConfig(dialect="mysql"), strict=False)
    assert reader.report.ok is ok and reader.report.writable_tables == tables
    assert all(f"information_schema.{k}_privileges" in asked[0] for k in ("user", "schema", "table", "column"))
    if not ok:
        with pytest.raises(guard.ReadOnlyViolation):
            ReadOnlyReader(spark, TargetConfig(dialect="mysql"))


@pytest.fixture(scope="module")
def estate(spark):
    old = datetime.datetime(2020, 1, 1)
    users = spark.createDataFrame([(i, f"u{i}@example.com", f"{100 + i}-22-3333", old) for i in range(20)], "id long, email string, ssn string, created_at timestamp_ntz")
    log = spark.createDataFrame([(datetime.datetime(2026, 9, 1), "q", "SELECT", f"SELECT email FROM users WHERE id = {i}", "web", "app", "t", [], [], 1) for i in range(30)], LOG)
    return {"users": users}, log


def test_whole_audit(spark, estate, tmp_path):
    from colaudit.operators.history import History

    tables, log = estate
    a = run_audit(tables, log, AuditConfig(now=datetime.datetime(2026, 9, 8, tzinfo=datetime.timezone.utc)))
    f = {r["qualified_name"]: r for r in a.findings.collect()}
    assert f["users.ssn"]["verdict"] == "flag_for_deletion" and f["users.email"]["verdict"] == "keep" and f["users.ssn"]["rank"] == 1
    h = History(spark, f"file://{tmp_path}/h")
    run = a.record(h, "first")
    assert h.findings(run).count() == 4 and "DROP COLUMN" in h.remediation(run, "users.ssn")["sql"]


def test_config_is_checked():
    for bad in ({"window_days": 0}, {"mode": "x"}, {"policy_days": 0}):
        with pytest.raises(ValueError):
            AuditConfig(**bad)
    assert AuditConfig(policy_days=10).policy.default_days == 10


def test_command_line(spark, estate, tmp_path, capsys):
    tables, log = estate
    tables["users"].write.parquet(f"file://{tmp_path}/t/users.parquet")
    log.select("ts", "sql", "service", "template", "operation").withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX")).coalesce(1).write.json(f"file://{tmp_path}/log.jsonl")
    args = ["--tables", f"file://{tmp_path}/t", "--log", f"file://{tmp_path}/log.jsonl"]
    assert cli.main(["audit", *args, "--history", f"file://{tmp_path}/h", "--policy-days", "30"], spark) == 0
    assert "users.ssn" in capsys.readouterr().out
    for c in (["runs"], ["findings", "--flagged-only"], ["finding", "--column", "users.ssn"], ["remediation", "--column", "users.ssn"], ["trend", "--column", "users.ssn"], ["health"]):
        assert cli.main([*c, "--history", f"file://{tmp_path}/h"], spark) == 0
    assert '"runs": 1' in capsys.readouterr().out
    assert cli.main(["drafts", *args, "--out", str(tmp_path / "drafts")], spark) == 0 and (tmp_path / "drafts/users__ssn.sql").exists()


def test_a_probe_that_has_not_run_is_not_reported_as_blocked():
    assert ReadOnlyReport().probe_blocked is None and "probe blocked not run" in ReadOnlyReport().summary()
    assert not ReadOnlyReport(probe_blocked=False).ok and "probe blocked False" in ReadOnlyReport(probe_blocked=False).summary()


def test_reports_and_evaluation(spark, estate, tmp_path, capsys):
    tables, log = estate
    tables["users"].write.parquet(f"file://{tmp_path}/t/users.parquet")
    log.write.json(f"file://{tmp_path}/log.json")
    (tmp_path / "truth.csv").write_text("table,column,sensitivity_tier,sensitivity_score,pii_type\nusers,email,high,0.8,contact\nusers,ssn,high,0.95,government_id\nusers,id,none,0.0,\nusers,created_at,none,0.0,\n")
    where = ["--tables", f"file://{tmp_path}/t"]
    assert cli.main(["evaluate", *where, "--truth", f"file://{tmp_path}/truth.csv"], spark) == 0
    out = capsys.readouterr().out.splitlines()
    assert out[0] == "sensitivity against labels" and out[2].split()[:6] == ["rules", "4", "2", "0", "2", "0"]
    assert cli.main(["report", "profile", *where], spark) == 0
    out = capsys.readouterr().out.splitlines()
    assert out[0] == "catalogue: 4 columns" and [x.split()[0] for x in out[2:]] == ["users.id", "users.email", "users.ssn", "users.created_at"]
    assert cli.main(["report", "usage", *where, "--log", f"file://{tmp_path}/log.json", "--top", "2"], spark) == 0
    out = capsys.readouterr().out.splitlines()
    assert out[0] == "usage over 90 days: 2 of 4 columns used" and [x.split()[0] for x in out[2:]] == ["users.email", "users.id"] and out[2].split()[3] == "30"
    assert cli.main(["report", "retention", *where, "--policy-days", "30"], spark) == 0
    assert "overdue" in capsys.readouterr().out
