"""Staleness of columns against a retention policy."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import places
from ..sources.policy import RetentionPolicy

#: Names of lifecycle times, of dates that describe something else, preferred anchors; the share of
#: overdue rows that counts in full.
LIFECYCLE = (
    r"(?i)(^|_)(created|inserted|added|registered|signed_?up|onboarded|updated|modified|changed|touched|deleted|removed|archived|purged|"
    r"resolved|closed|completed|finished|cancelled|last_?login|last_?seen|last_?active|last_?access|accessed|synced|processed|imported|exported|refreshed)(_|$)"
    r"|_(at|ts|time|on|datetime|timestamp)$|^(ts|timestamp|event_time)$"
)
ATTRIBUTE = r"(?i)(birth|dob|expir|valid_from|valid_to|valid_until|effective|start_date|end_date|due_?date|scheduled|renew|anniversary|maturity|as_of|period_)"
PREFERRED = ["created_at", "created", "inserted_at", "registered_at", "signed_up_at", "added_at", "onboarded_at"]
VOLUME_TARGET = 0.10


def is_relevant(name: Column, family: Column, temporal: Column) -> Column:
    """A lifecycle timestamp, scored by its own values."""
    return temporal & ~name.rlike(ATTRIBUTE) & (name.rlike(LIFECYCLE) | family.isin("timestamp", "timestamptz"))


def age_days(ts: Column, now: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / F.lit(86_400e6))


def age_score(age: Column, days: Column) -> Column:
    """0 until the policy's age, 1 from twice that age on."""
    over = age - days
    return F.when(age.isNull() | (days <= 0) | (over <= 0), F.lit(0.0)).otherwise(places(F.least(F.lit(1.0), over / F.when(days > 0, days))))


def blend(age: Column, fraction: Column) -> Column:
    """The age score, less where few rows are overdue."""
    volume = F.least(F.lit(1.0), fraction / VOLUME_TARGET)
    return F.when(age <= 0, F.lit(0.0)).when(fraction.isNull(), places(age)).otherwise(places(age * (0.4 + 0.6 * volume)))


def live_stats(tables: Mapping[str, DataFrame], columns: DataFrame, policy: RetentionPolicy, now) -> DataFrame | None:
    """(qualified_name, rows_total, rows_overdue, fraction_overdue): one scan per table with a relevant column."""
    relevant = columns.where(is_relevant(F.col("name"), F.col("generic_type"), F.col("is_temporal")) & F.col("min_value").isNotNull())
    wanted: dict[str, list] = {}
    for r in relevant.select("table", "name", "qualified_name", policy.days_for(F.col("table"), F.col("name"))["days"].alias("days")).collect():
        wanted.setdefault(r["table"], []).append(r)
    parts = []
    for t, cols in wanted.items():
        if t not in tables:
            continue
        df = tables[t]
        late = [F.count_if(df[r["name"]] < (F.lit(now) - F.make_dt_interval(F.lit(r["days"]))).cast(dict(df.dtypes)[r["name"]])).alias(f"n{i}") for i, r in enumerate(cols)]
        one = df.agg(F.count("*").alias("rows_total"), *late)
        rows = F.explode(F.array(*[F.struct(F.lit(r["qualified_name"]).alias("qualified_name"), F.col(f"n{i}").alias("rows_overdue")) for i, r in enumerate(cols)]))
        parts.append(one.select("rows_total", rows.alias("x")).select("x.qualified_name", "rows_total", "x.rows_overdue"))
    if not parts:
        return None
    share = F.when(F.col("rows_total") > 0, places(F.col("rows_overdue") / F.nullif("rows_total", F.lit(0)))).otherwise(F.lit(0.0))
    return reduce(DataFrame.unionAll, parts).withColumn("fraction_overdue", share)


def pick_anchors(columns: DataFrame, policy: RetentionPolicy) -> DataFrame:
    """(table, anchor, anchor_min, anchor_max): the policy's, else a preferred name, else the oldest relevant column."""
    named = F.coalesce(policy.anchor_for(F.col("table")) == F.col("name"), F.lit(False))
    usable = is_relevant(F.col("name"), F.col("generic_type"), F.col("is_temporal")) & F.coalesce("min_value", F.lit("")).__ne__("")
    place = F.array_position(F.array(*[F.lit(p) for p in PREFERRED]), F.lower("name"))
    place = F.when(place > 0, place).otherwise(F.lit(len(PREFERRED) + 1))
    parsed = F.try_to_timestamp("min_value")
    rows = columns.where(named | usable & ((place <= len(PREFERRED)) | parsed.isNotNull()))
    order = Window.partitionBy("table").orderBy(F.desc(named), place, parsed, "ordinal")
    return rows.withColumn("_k", F.row_number().over(order)).where("_k = 1").select("table", F.col("name").alias("anchor"), F.col("min_value").alias("anchor_min"), F.col("max_value").alias("anchor_max"))


def check_tables(columns: DataFrame, policy: RetentionPolicy, now, live: DataFrame | None = None) -> DataFrame:
    """The retention of each table through its anchor; without one its score is 0."""
    t = columns.select("table").distinct().join(pick_anchors(columns, policy), "table", "left")
    t = t.withColumn("_p", policy.days_for(F.col("table")))
    if live is not None:
        t = t.join(live.select(F.col("qualified_name").alias("_qn"), "rows_total", "rows_overdue", "fraction_overdue"), F.concat_ws(".", "table", "anchor") == F.col("_qn"), "left").drop("_qn")
    else:
        t = t.select("*", *[F.lit(None).cast(k).alias(n) for n, k in (("rows_total", "long"), ("rows_overdue", "long"), ("fraction_overdue", "double"))])
    oldest, newest = (age_days(F.try_to_timestamp(c), F.lit(now)) for c in ("anchor_min", "anchor_max"))
    t = t.select("*", oldest.alias("_old"), newest.alias("_new")).withColumn("_days", F.col("_p.days"))
    t = t.withColumn("score", F.when(F.col("anchor").isNull(), 0.0).otherwise(blend(age_score(F.col("_old"), F.col("_days")), F.col("fraction_overdue"))))
    over = F.bround(F.col("_old") - F.col("_days")).cast("int")
    return t.select(
        "table", "anchor", F.col("_days").alias("policy_days"), F.col("_p.source").alias("policy_source"), "score", (F.coalesce(over > 0, F.lit(False)) | (F.col("score") > 0)).alias("is_overdue"),
        F.when(over > 0, over).alias("days_overdue"), F.col("_old").cast("int").alias("oldest_row_age_days"), F.col("_new").cast("int").alias("newest_row_age_days"), "rows_total", "rows_overdue", "fraction_overdue",
    )


def check(columns: DataFrame, policy: RetentionPolicy, now, live: DataFrame | None = None) -> DataFrame:
    """The retention relation R: excluded columns, lifecycle times by their own values, all others by their table."""
    tables = check_tables(columns, policy, now, live)
    t = tables.select("table", *[F.col(c).alias(f"t_{c}") for c in tables.columns if c != "table"])
    c = columns.join(t, "table", "left")
    if live is not None:
        c = c.join(live.select("qualified_name", *[F.col(x).alias(f"l_{x}") for x in ("rows_total", "rows_overdue", "fraction_overdue")]), "qualified_name", "left")
    else:
        c = c.select("*", F.lit(None).cast("long").alias("l_rows_total"), F.lit(None).cast("long").alias("l_rows_overdue"), F.lit(None).cast("double").alias("l_fraction_overdue"))
    own = is_relevant(F.col("name"), F.col("generic_type"), F.col("is_temporal")) & (F.coalesce("min_value", F.lit("")) != "")
    c = c.withColumn("_basis", F.when(policy.is_excluded(F.col("table"), F.col("name")), "excluded").when(own, "self").when(F.col("t_anchor").isNull(), "no-temporal-data").otherwise(F.concat(F.lit("table:"), "t_anchor")))
    c = c.withColumn("_p", policy.days_for(F.col("table"), F.col("name"))).withColumn("_old", age_days(F.try_to_timestamp("min_value"), F.lit(now))).withColumn("_new", age_days(F.try_to_timestamp("max_value"), F.lit(now)))
    over = F.bround(F.col("_old") - F.col("_p.days")).cast("int")
    is_self, out, no_anchor = F.col("_basis") == "self", F.col("_basis") == "excluded", F.col("_basis") == "no-temporal-data"
    pick = lambda self_value, table_value: F.when(out | no_anchor, F.lit(None)).when(is_self, self_value).otherwise(table_value)
    score = F.when(out | no_anchor, 0.0).when(is_self, blend(age_score(F.col("_old"), F.col("_p.days")), F.col("l_fraction_overdue"))).otherwise(F.col("t_score"))
    return c.select(
        "qualified_name", "table", F.col("name").alias("column"), F.coalesce(score, F.lit(0.0)).alias("score"), F.coalesce(pick(over > 0, F.col("t_is_overdue")), F.lit(False)).alias("is_overdue"),
        pick(F.when(over > 0, over), F.col("t_days_overdue")).alias("days_overdue"),
        F.when(~out, F.when(is_self, F.col("_p.days")).otherwise(F.col("t_policy_days"))).alias("policy_days"),
        F.when(out, "excluded").when(is_self, F.col("_p.source")).otherwise(F.col("t_policy_source")).alias("policy_source"),
        pick(F.col("name"), F.col("t_anchor")).alias("anchor"), pick(F.col("_old").cast("int"), F.col("t_oldest_row_age_days")).alias("oldest_row_age_days"), pick(F.col("_new").cast("int"), F.col("t_newest_row_age_days")).alias("newest_row_age_days"),
        F.col("_basis").alias("basis"), pick(F.col("l_rows_total"), F.col("t_rows_total")).alias("rows_total"), pick(F.col("l_rows_overdue"), F.col("t_rows_overdue")).alias("rows_overdue"),
        pick(F.col("l_fraction_overdue"), F.col("t_fraction_overdue")).alias("fraction_overdue"),
    ).orderBy(F.desc("score"), "qualified_name")
