"""A synthetic estate at any size: three tables, their labelled columns and a query log, generated by Spark.

All values follow from a hash of the row number and a seed, so a table is the same on any cluster.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: the labelled columns ---------------------------------------------------------
#: table, column, family, nullable, key, tier, score, type, expected usage
CATALOGUE = [
    ("users", "id", "integer", False, "PK", "none", 0.0, None, "high"),
    ("users", "created_at", "timestamptz", False, "", "none", 0.0, None, "high"),
    ("users", "updated_at", "timestamptz", False, "", "none", 0.0, None, "medium"),
    ("users", "last_login_at", "timestamptz", True, "", "low", 0.15, "activity", "medium"),
    ("users", "email", "string", False, "UQ", "high", 0.9, "contact", "high"),
    ("users", "password_hash", "string", False, "", "high", 0.85, "credential", "high"),
    ("users", "full_name", "string", False, "", "medium", 0.55, "identity", "high"),
    ("users", "phone", "string", True, "", "high", 0.8, "contact", "low"),
    ("users", "ssn", "string", True, "", "high", 0.95, "government_id", "rare"),
    ("users", "mothers_maiden_name", "string", True, "", "high", 0.9, "knowledge_based", "never"),
    ("users", "date_of_birth", "date", True, "", "high", 0.75, "identity", "rare"),
    ("users", "gender", "string", True, "", "medium", 0.5, "demographic", "rare"),
    ("users", "last_login_ip", "inet", True, "", "medium", 0.6, "network_id", "medium"),
    ("users", "marketing_consent", "boolean", False, "", "low", 0.2, "preference", "low"),
    ("users", "favorite_color", "string", True, "", "none", 0.05, "preference", "never"),
    ("users", "theme_preference", "string", False, "", "none", 0.05, "preference", "high"),
    ("users", "locale", "string", False, "", "none", 0.05, "preference", "high"),
    ("users", "is_active", "boolean", False, "", "none", 0.0, None, "high"),
    ("users", "account_status", "string", False, "", "low", 0.1, None, "low"),
    ("orders", "id", "integer", False, "PK", "none", 0.0, None, "high"),
    ("orders", "user_id", "integer", False, "FK users.id", "low", 0.1, "linkage", "high"),
    ("orders", "created_at", "timestamptz", False, "", "none", 0.0, None, "high"),
    ("orders", "updated_at", "timestamptz", False, "", "none", 0.0, None, "medium"),
    ("orders", "status", "string", False, "", "none", 0.0, None, "high"),
    ("orders", "total_amount", "numeric", False, "", "low", 0.15, "financial", "high"),
    ("orders", "currency", "string", False, "", "none", 0.0, None, "high"),
    ("orders", "shipping_address", "string", True, "", "high", 0.8, "address", "medium"),
    ("orders", "billing_address", "string", True, "", "high", 0.8, "address", "rare"),
    ("orders", "card_last4", "string", True, "", "medium", 0.65, "financial", "medium"),
    ("orders", "card_brand", "string", True, "", "low", 0.25, "financial", "medium"),
    ("orders", "ip_address", "inet", True, "", "medium", 0.6, "network_id", "low"),
    ("orders", "promo_code", "string", True, "", "none", 0.05, None, "low"),
    ("orders", "notes", "string", True, "", "low", 0.2, "freetext", "never"),
    ("support_tickets", "id", "integer", False, "PK", "none", 0.0, None, "high"),
    ("support_tickets", "user_id", "integer", False, "FK users.id", "low", 0.1, "linkage", "high"),
    ("support_tickets", "created_at", "timestamptz", False, "", "none", 0.0, None, "high"),
    ("support_tickets", "updated_at", "timestamptz", False, "", "none", 0.0, None, "medium"),
    ("support_tickets", "resolved_at", "timestamptz", True, "", "none", 0.0, None, "low"),
    ("support_tickets", "subject", "string", False, "", "low", 0.25, "freetext", "high"),
    ("support_tickets", "body", "string", False, "", "medium", 0.55, "freetext", "medium"),
    ("support_tickets", "category", "string", False, "", "none", 0.0, None, "medium"),
    ("support_tickets", "priority", "string", False, "", "none", 0.0, None, "high"),
    ("support_tickets", "status", "string", False, "", "none", 0.0, None, "high"),
    ("support_tickets", "assigned_agent", "string", True, "", "low", 0.15, "employee", "medium"),
    ("support_tickets", "customer_sentiment", "string", True, "", "none", 0.05, None, "never"),
    ("support_tickets", "satisfaction_rating", "integer", True, "", "none", 0.05, None, "never"),
]
# --- end of fixed values ------------------------------------------------------------------------

#: Entries per read of a table's columns of one usage label, and how they lie in time.
BANDS = {"high": (4_000, "growing"), "medium": (400, "uniform"), "low": (40, "weekly"), "rare": (4, "late")}


def statements() -> list[tuple]:
    """(template, operation, weight, shape, service, statement, columns read, columns written), made from the labels.

    For each table and label one read by key and one write of that label's columns, inserts for the most used; for each
    foreign key one join.  A table has half the traffic of the one before it; columns labelled never are in no statement.
    """
    out = []
    tables = list(dict.fromkeys(t for t, *_ in CATALOGUE))
    for i, t in enumerate(tables):
        of = lambda band: [c for x, c, *_, use in CATALOGUE if x == t and use == band]  # noqa: B023, E731
        full = lambda cs: [f"{t}.{c}" for c in cs]  # noqa: B023, E731
        key = next(c for x, c, _, _, k, *_ in CATALOGUE if x == t and k == "PK")
        for band, (weight, shape) in BANDS.items():
            cols, weight = of(band), max(1, weight >> i)
            if not cols:
                continue
            seen = list(dict.fromkeys([*cols, key]))
            out.append((f"{t}_{band}_read", "SELECT", weight, shape, t, f"SELECT {', '.join(cols)} FROM {t} WHERE {key} = $1", full(seen), []))
            if band == "high":
                out.append((f"{t}_insert", "INSERT", weight // 4, shape, t, f"INSERT INTO {t} ({', '.join(cols)}) VALUES ({', '.join(f'${n + 1}' for n in range(len(cols)))})", [], full(cols)))
            elif band == "medium":
                out.append((f"{t}_{band}_write", "UPDATE", weight // 4, shape, t, f"UPDATE {t} SET {', '.join(f'{c} = ${n + 2}' for n, c in enumerate(cols))} WHERE {key} = $1", full([key]), full(cols)))
        for c, k in [(c, k) for x, c, _, _, k, *_ in CATALOGUE if x == t and k.startswith("FK")]:
            far, far_key = k[3:].split(".")
            shown = of("high")[-1]
            out.append((f"{t}_with_{far}", "SELECT", 200 >> i, "uniform", "desk", f"SELECT a.{shown}, b.email FROM {t} a JOIN {far} b ON b.{far_key} = a.{c} WHERE a.{key} = $1", [f"{t}.{x}" for x in dict.fromkeys((shown, c, key))] + [f"{far}.{far_key}", f"{far}.email"], []))
    return out


def _h(seed: int, what: str, n: int) -> Column:
    """A number below n from the row's id."""
    return F.pmod(F.xxhash64(F.col("id"), F.lit(f"{seed}:{what}")), F.lit(n))


def _pick(seed: int, what: str, values: list[str]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), _h(seed, what, len(values)).cast("int"))


def _ago(now: datetime, seed: int, what: str) -> Column:
    """Ages of rows: about a sixth are 400 to 900 days old, the rest up to 700."""
    days = F.when(_h(seed, f"{what}?", 100) < 18, 400 + _h(seed, what, 500)).otherwise(1 + _h(seed, what, 700))
    return F.lit(now).cast("timestamp") - F.make_dt_interval(days.cast("int"), _h(seed, f"{what}h", 24).cast("int"))


def _maybe(seed: int, what: str, c: Column, percent: int = 85) -> Column:
    return F.when(_h(seed, f"{what} null", 100) < percent, c)


def _family(df: DataFrame, table: str) -> DataFrame:
    """Puts the columns in catalogue order; families that Spark's types do not tell go into the metadata."""
    fields = [(c, f) for t, c, f, *_ in CATALOGUE if t == table]
    return df.select(*[df[c].alias(c, metadata={"family": f}) if f in ("inet", "string") else df[c] for c, f in fields])


def users(spark: SparkSession, n: int = 600, seed: int = 42, now: datetime = datetime(2026, 9, 8)) -> DataFrame:
    d = spark.range(n)
    name = F.concat_ws(" ", _pick(seed, "first", ["Ada", "Ben", "Cleo", "Dan", "Eve", "Finn"]), _pick(seed, "last", ["Adler", "Brook", "Cole", "Dietz", "Ekman"]))
    d = d.select(
        "id", _ago(now, seed, "created").alias("created_at"), F.lit(now).cast("timestamp").alias("updated_at"), _maybe(seed, "login", F.lit(now).cast("timestamp") - F.make_dt_interval(_h(seed, "login", 90).cast("int"))).alias("last_login_at"),
        F.concat(F.lit("user"), F.col("id").cast("string"), F.lit("@example.com")).alias("email"), F.sha2(F.col("id").cast("string"), 256).alias("password_hash"), name.alias("full_name"),
        _maybe(seed, "phone", F.format_string("+1%010d", _h(seed, "phone", 9_999_999_999))).alias("phone"), _maybe(seed, "ssn", F.format_string("%03d-%02d-%04d", 100 + _h(seed, "s1", 800), 10 + _h(seed, "s2", 89), 1000 + _h(seed, "s3", 8999))).alias("ssn"),
        _maybe(seed, "maiden", _pick(seed, "maiden", ["Adler", "Brook", "Cole", "Dietz"])).alias("mothers_maiden_name"), _maybe(seed, "dob", F.date_add(F.lit("1950-01-01").cast("date"), _h(seed, "dob", 20_000).cast("int"))).alias("date_of_birth"),
        _maybe(seed, "gender", _pick(seed, "gender", ["f", "m", "x"])).alias("gender"), _maybe(seed, "ip", F.concat_ws(".", *[(1 + _h(seed, f"ip{i}", 254)).cast("string") for i in range(4)])).alias("last_login_ip"),
        (_h(seed, "consent", 2) == 0).alias("marketing_consent"), _maybe(seed, "color", _pick(seed, "color", ["red", "blue", "green"])).alias("favorite_color"), _pick(seed, "theme", ["dark", "light"]).alias("theme_preference"),
        _pick(seed, "locale", ["en-US", "de-DE", "fr-FR"]).alias("locale"), (_h(seed, "active", 10) > 0).alias("is_active"), _pick(seed, "status", ["active", "active", "suspended"]).alias("account_status"),
    )
    return _family(d, "users")


def orders(spark: SparkSession, n: int = 2_400, n_users: int = 600, seed: int = 42, now: datetime = datetime(2026, 9, 8)) -> DataFrame:
    d = spark.range(n)
    address = lambda w: F.concat((1 + _h(seed, w, 999)).cast("string"), F.lit(" "), _pick(seed, f"{w} street", ["Oak", "Elm", "Lake"]), F.lit(" Street"))
    d = d.select(
        "id", _h(seed, "user", n_users).alias("user_id"), _ago(now, seed, "ordered").alias("created_at"), F.lit(now).cast("timestamp").alias("updated_at"), _pick(seed, "status", ["paid", "shipped", "returned"]).alias("status"),
        (_h(seed, "total", 99_999) / 100).cast("decimal(10,2)").alias("total_amount"), _pick(seed, "cur", ["EUR", "USD"]).alias("currency"), _maybe(seed, "ship", address("ship")).alias("shipping_address"), _maybe(seed, "bill", address("bill")).alias("billing_address"),
        _maybe(seed, "card", F.format_string("%04d", _h(seed, "card", 10_000))).alias("card_last4"), _maybe(seed, "brand", _pick(seed, "brand", ["visa", "amex"])).alias("card_brand"), _maybe(seed, "ip", F.concat_ws(".", *[(1 + _h(seed, f"oip{i}", 254)).cast("string") for i in range(4)])).alias("ip_address"),
        _maybe(seed, "promo", _pick(seed, "promo", ["SAVE10", "SPRING"]), 20).alias("promo_code"), _maybe(seed, "note", F.lit("leave at the door"), 10).alias("notes"),
    )
    return _family(d, "orders")


def support_tickets(spark: SparkSession, n: int = 900, n_users: int = 600, seed: int = 42, now: datetime = datetime(2026, 9, 8)) -> DataFrame:
    d = spark.range(n)
    made = _ago(now, seed, "ticket")
    d = d.select(
        "id", _h(seed, "tuser", n_users).alias("user_id"), made.alias("created_at"), F.lit(now).cast("timestamp").alias("updated_at"), _maybe(seed, "resolved", made + F.make_dt_interval(F.lit(2)), 70).alias("resolved_at"),
        _pick(seed, "subject", ["parcel is late", "wrong size sent", "refund please"]).alias("subject"), _pick(seed, "body", ["my parcel has not come yet and I would like to know why", "the size I got is not the one that I ordered last week"]).alias("body"),
        _pick(seed, "cat", ["delivery", "returns"]).alias("category"), _pick(seed, "prio", ["low", "high"]).alias("priority"), _pick(seed, "tstatus", ["open", "closed"]).alias("status"), _maybe(seed, "agent", _pick(seed, "agent", ["agent-1", "agent-2"])).alias("assigned_agent"),
        _maybe(seed, "mood", _pick(seed, "mood", ["calm", "angry"])).alias("customer_sentiment"), _maybe(seed, "stars", (1 + _h(seed, "stars", 5)).cast("int")).alias("satisfaction_rating"),
    )
    return _family(d, "support_tickets")


def estate(spark: SparkSession, n_users: int = 600, seed: int = 42, now: datetime = datetime(2026, 9, 8)) -> dict[str, DataFrame]:
    return {"users": users(spark, n_users, seed, now), "orders": orders(spark, 4 * n_users, n_users, seed, now), "support_tickets": support_tickets(spark, 3 * n_users // 2, n_users, seed, now)}


def constraints(spark: SparkSession) -> DataFrame:
    rows = [(t, c, k == "PK", k.startswith("FK"), k[3:] if k.startswith("FK") else None, k in ("PK", "UQ"), k != "", None) for t, c, _, _, k, *_ in CATALOGUE if k]
    return spark.createDataFrame(rows, "`table` string, name string, is_primary_key boolean, is_foreign_key boolean, foreign_key_target string, is_unique boolean, is_indexed boolean, generic_type string")


def catalogue(spark: SparkSession) -> DataFrame:
    """The labels, in the form that ``querylog.read_ground_truth`` returns."""
    rows = [(f"{t}.{c}", t, c, tier, score, kind, use, tier in ("high", "medium")) for t, c, _, _, _, tier, score, kind, use in CATALOGUE]
    return spark.createDataFrame(rows, "qualified_name string, `table` string, `column` string, sensitivity_tier string, sensitivity_score double, pii_type string, expected_usage string, is_sensitive boolean")


def query_log(spark: SparkSession, n: int = 30_000, days: int = 90, seed: int = 42, now: datetime = datetime(2026, 9, 8)) -> DataFrame:
    """n entries of the statements by weight, in the schema of the log readers."""
    names = ["template", "operation", "low", "high", "shape", "service", "sql", "declared_reads", "declared_writes"]
    rows, low = [], 0
    for t, op, w, shape, service, sql, reads, writes in statements():
        rows.append((t, op, low, low + w, shape, service, sql, reads, writes))
        low += w
    known = F.array(*[F.struct(*[(F.array(*[F.lit(x) for x in v]).cast("array<string>") if isinstance(v, list) else F.lit(v)).alias(k) for k, v in zip(names, r)]) for r in rows])
    e = spark.range(n).withColumn("_w", _h(seed, "template", low))
    e = e.withColumn("t", F.filter(known, lambda t: (t["low"] <= F.col("_w")) & (F.col("_w") < t["high"]))[0])
    u = _h(seed, "time", 1_000_000) / 1_000_000
    age = (
        F.when(F.col("t.shape") == "growing", days * u * u)
        .when(F.col("t.shape") == "weekly", F.floor(u * days / 7) * 7 + 0.5)
        .when(F.col("t.shape") == "late", days * (0.5 + 0.5 * u))
        .otherwise(days * u)
    )
    ts = F.timestamp_micros(F.unix_micros(F.lit(now).cast("timestamp")) - (age * 86_400e6).cast("long"))
    return e.select(
        ts.alias("ts"), F.format_string("q_%07d", "id").alias("query_id"), F.col("t.operation").alias("operation"), F.col("t.sql").alias("sql"), F.col("t.service").alias("service"), F.concat(F.lit("svc_"), "t.service").alias("db_user"),
        F.col("t.template").alias("template"), F.col("t.declared_reads").alias("declared_reads"), F.col("t.declared_writes").alias("declared_writes"), (1 + _h(seed, "rows", 50)).cast("int").alias("rows"),
    )


def write_log(log: DataFrame, path: str, fmt: str = "jsonl") -> None:
    """In the form that the readers take: JSON lines, or CSV with pipe-joined lists."""
    out = log.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("ts"), *[c for c in log.columns if c not in ("ts", "declared_reads", "declared_writes")], F.col("declared_reads").alias("columns_read"), F.col("declared_writes").alias("columns_written"))
    if fmt == "csv":
        out.withColumns({c: F.array_join(c, "|") for c in ("columns_read", "columns_written")}).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    else:
        out.write.mode("overwrite").json(path)
