from __future__ import annotations

import pytest

from colaudit.operators import lineage as ln

CATALOG = {
    "users": "id email password_hash is_active full_name phone last_login_at last_login_ip updated_at created_at gender date_of_birth ssn".split(),
    "orders": "id user_id status total_amount currency ip_address card_last4 created_at updated_at shipping_address".split(),
    "support_tickets": "id user_id subject body category status priority created_at assigned_agent".split(),
}
CASES = [
    ("SELECT id, email FROM users WHERE is_active", {"users.id", "users.email", "users.is_active"}, set()),
    ("SELECT count(*) FROM users WHERE gender = 'f'", {"users.gender"}, set()),
    ("SELECT u.email, o.status FROM users u JOIN orders o ON o.user_id = u.id", {"users.email", "orders.status", "orders.user_id", "users.id"}, set()),
    ("SELECT email FROM users WHERE id IN (SELECT user_id FROM orders WHERE status = 'x')", {"users.email", "users.id", "orders.user_id", "orders.status"}, set()),
    ("SELECT gender, count(*) FROM users GROUP BY 1 HAVING max(created_at) > now() - interval '7 days' ORDER BY gender", {"users.gender", "users.created_at"}, set()),
    ("SELECT subject, total_amount FROM support_tickets s JOIN orders o ON s.user_id = o.user_id", {"support_tickets.subject", "orders.total_amount", "support_tickets.user_id", "orders.user_id"}, set()),
    ("UPDATE users SET last_login_at = now(), last_login_ip = $1 WHERE id = $2", {"users.id"}, {"users.last_login_at", "users.last_login_ip"}),
    ("UPDATE users SET full_name = email WHERE id = 1", {"users.email", "users.id"}, {"users.full_name"}),
    ("INSERT INTO orders (id, user_id) VALUES ($1, $2)", set(), {"orders.id", "orders.user_id"}),
    ("INSERT INTO orders (id, user_id) SELECT id, id FROM users WHERE email = 'a'", {"users.id", "users.email"}, {"orders.id", "orders.user_id"}),
    ("DELETE FROM users WHERE email = 'a'", {"users.email"}, set()),
    ("SELECT date_part('year', age(date_of_birth)) FROM users", {"users.date_of_birth"}, set()),
    ("SELECT * FROM orders", {f"orders.{c}" for c in CATALOG["orders"]}, set()),
    ("SELECT u.* FROM users u JOIN orders o ON u.id = o.user_id", {f"users.{c}" for c in CATALOG["users"]} | {"orders.user_id"}, set()),
]


#: Forms of PostgreSQL and MySQL; the columns are written by hand.
DIALECTS = [
    ("SELECT id::text, (created_at AT TIME ZONE 'utc')::date d FROM users", "users.id users.created_at", ""),
    ("SELECT body->>'x', subject #>> '{a,b}' FROM support_tickets WHERE body @> '{}' AND body ? 'k'", "support_tickets.body support_tickets.subject", ""),
    ('SELECT "u"."email" FROM "users" AS "u" WHERE "u"."is_active"', "users.email users.is_active", ""),
    ("SELECT `email` FROM `users` WHERE `id` = 3", "users.email users.id", ""),
    ("SELECT id FROM orders WHERE status = 'x' ORDER BY created_at LIMIT 5 FOR UPDATE OF orders SKIP LOCKED", "orders.id orders.status orders.created_at", ""),
    ("UPDATE orders SET status = 'y', currency = u.gender FROM users u WHERE u.id = orders.user_id AND u.email = $1", "users.gender users.id orders.user_id users.email", "orders.status orders.currency"),
    ("UPDATE users AS u SET (full_name, phone) = (email, 'x') WHERE u.id = 1 RETURNING u.updated_at", "users.email users.id users.updated_at", "users.full_name users.phone"),
    ("UPDATE orders o JOIN users u ON u.id = o.user_id SET o.status = u.gender WHERE u.ssn = 'x'", "users.id orders.user_id users.gender users.ssn", "orders.status"),
    ("DELETE FROM orders USING users u WHERE u.id = orders.user_id AND u.is_active = false", "users.id orders.user_id users.is_active", ""),
    ("WITH gone AS (DELETE FROM orders WHERE status = 'x' RETURNING user_id) SELECT count(*) FROM gone", "orders.status orders.user_id", ""),
    ("INSERT INTO orders (id, status) VALUES (1, 'a') ON CONFLICT (id) DO UPDATE SET status = excluded.status, updated_at = now() RETURNING created_at", "orders.id orders.created_at", "orders.id orders.status orders.updated_at"),
    ("INSERT INTO users (id, email) VALUES (1, 'a') ON DUPLICATE KEY UPDATE email = 'b'", "", "users.id users.email"),
    ("SELECT DISTINCT ON (user_id) user_id, total_amount FROM orders ORDER BY user_id, created_at DESC NULLS LAST", "orders.user_id orders.total_amount orders.created_at", ""),
    ("SELECT extract(year FROM date_of_birth), cast(phone AS character varying(9)), count(*) FILTER (WHERE is_active) FROM users GROUP BY 1, 2", "users.date_of_birth users.phone users.is_active", ""),
    ("SELECT sum(total_amount) OVER (PARTITION BY currency ORDER BY created_at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM orders ORDER BY s", "orders.total_amount orders.currency orders.created_at", ""),
    ("SELECT u.email FROM users u WHERE EXISTS (SELECT 1 FROM orders o WHERE o.user_id = u.id AND total_amount > 5 AND ssn IS NOT NULL)", "users.email orders.user_id users.id orders.total_amount users.ssn", ""),
    ("SELECT email FROM users u LEFT JOIN LATERAL (SELECT status FROM orders o WHERE o.user_id = u.id LIMIT 1) l ON true", "users.email orders.status orders.user_id users.id", ""),
    ("SELECT subject, currency FROM orders JOIN support_tickets USING (user_id)", "support_tickets.subject orders.currency orders.user_id support_tickets.user_id", ""),
    ("(SELECT email FROM users) UNION ALL (SELECT subject FROM support_tickets WHERE priority IS DISTINCT FROM category)", "users.email support_tickets.subject support_tickets.priority support_tickets.category", ""),
    ("SELECT CASE WHEN is_active THEN phone ELSE ssn END k, $q$it's id$q$ FROM users -- don't, full_name\n WHERE /* gender */ id = ANY($1)", "users.is_active users.phone users.ssn users.id", ""),
    ("SELECT Email FROM USERS WHERE Id = 1", "users.email users.id", ""),
    ("SELECT id FROM (SELECT id, email FROM users) x, generate_series(1, 3) g WHERE x.email = 'a'", "users.id users.email", ""),
    ("INSERT INTO support_tickets (subject) WITH a AS (SELECT full_name FROM users) SELECT full_name FROM a", "users.full_name", "support_tickets.subject"),
]


def test_statements(spark):
    """All cases as one table, raw and as templates."""
    cases = CASES + [(q, set(r.split()), set(w.split())) for q, r, w in DIALECTS]
    for n, (q, reads, writes) in enumerate(cases):
        assert "FROM orders JOIN" in q or ln.references(q)[0] in ("select", "insert", "update", "delete"), q
    raw = {r["sql"]: r for r in ln.resolve(ln.parsed(spark.createDataFrame([(q,) for q, _, _ in cases], "sql string")), CATALOG).collect()}
    for q, reads, writes in cases:
        assert (set(raw[q]["reads"]), set(raw[q]["writes"]), raw[q]["parsed_ok"]) == (reads, writes, True), q
    named = spark.createDataFrame([(q,) for q, _, _ in cases], "sql string").select("sql", ln.template_of("sql").alias("t")).collect()
    done = {r["sql"]: r for r in ln.lineage_table(spark.createDataFrame([(q,) for q, _, _ in cases], "sql string"), CATALOG).collect()}
    for r in named:
        assert [done[r["t"]][c] for c in ("reads", "writes", "wildcards")] == [raw[r["sql"]][c] for c in ("reads", "writes", "wildcards")], r["sql"]


def test_machine_never_raises():
    """Statements cut short or with tokens dropped are read or put aside, never an error."""
    for q, *_ in CASES + DIALECTS:
        parts = q.split(" ")
        for k in range(len(parts)):
            ln.references(" ".join(parts[:k]))
            ln.references(" ".join(parts[:k] + parts[k + 1 :]))
            ln.references(q[: 3 * k])
    for q in (None, "", "(((", ")", "select", "select (", "with", "with a as (", "update", "insert into", "select a from t; drop table t", "'", '"', "$$", "select " + "(" * 5000):
        assert ln.references(q)[0] == "none"


def test_without_a_catalogue(spark):
    r = ln.lineage(spark, "SELECT u.a, b FROM users u WHERE EXISTS (SELECT c FROM orders)")
    assert (r["reads"], r["unresolved"]) == (["orders.c", "users.a", "users.b"], [])
    r = ln.lineage(spark, "SELECT u.a, b FROM users u JOIN orders o ON o.x = u.y")
    assert (r["reads"], r["unresolved"]) == (["orders.x", "users.a", "users.y"], ["b"])


def test_unknown_tables(spark):
    r = ln.lineage(spark, "SELECT mystery FROM elsewhere WHERE x = 1", CATALOG)
    assert (r["reads"], r["unresolved"], r["parsed_ok"]) == ([], ["mystery", "x"], False)


def test_never_raises(spark):
    assert ln.lineage(spark, "this is no sql")["method"] == "none"
    r = ln.lineage(spark, "INSERT INTO t (a, b) VALUES (...)")
    assert (r["method"], r["writes"]) == ("insert-regex", ["t.a", "t.b"])


def test_ambiguous_names_stay_unresolved(spark):
    r = ln.lineage(spark, "SELECT status FROM orders o JOIN support_tickets s ON o.user_id = s.user_id", CATALOG)
    assert r["unresolved"] == ["status"]


def test_ctes_are_no_tables(spark):
    r = ln.lineage(spark, "WITH c AS (SELECT id FROM users) SELECT c.id FROM c", CATALOG)
    assert "c.id" in r["unresolved"] and not any(x.startswith("c.") for x in r["reads"])


def test_wildcards(spark):
    assert ln.lineage(spark, "SELECT * FROM nowhere", CATALOG)["wildcards"] == ["nowhere.*"]
    assert ln.lineage(spark, "INSERT INTO orders SELECT 1, 2 FROM users", CATALOG)["wildcards"] == ["orders.*"]


def test_templates_are_parsed_once(spark):
    rows = spark.createDataFrame([(f"SELECT email FROM users WHERE id = {i} AND ssn = 'x{i}'",) for i in range(50)], "sql string")
    found = ln.lineage_table(rows, CATALOG).collect()
    assert len(found) == 1 and found[0]["reads"] == ["users.email", "users.id", "users.ssn"]


def test_wildcards_expand_by_columns(spark):
    columns = spark.createDataFrame([("t", "a", "t.a"), ("t", "b", "t.b")], "`table` string, name string, qualified_name string")
    table = ln.lineage_table(spark.createDataFrame([("SELECT * FROM t",), ("SELECT * FROM z",)], "sql string"))
    got = {r["sql"]: r for r in ln.expand_wildcards(table, columns).collect()}
    assert got["SELECT * FROM t"]["reads"] == ["t.a", "t.b"] and got["SELECT * FROM t"]["wildcards"] == []
    assert got["SELECT * FROM z"]["wildcards"] == ["z.*"]
