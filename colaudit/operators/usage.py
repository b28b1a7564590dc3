"""Column usage from a query log: attribution, aggregation, rank and score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import places
from ..scratch import keep
from . import lineage as ln
from .ranks import running

#: Fixed values of the score.
WRITE_WEIGHT, RANK_WEIGHT, ABS_REFERENCE, RECENCY_FLOOR = 0.25, 0.55, 400.0, 0.50


def tier(score: Column) -> Column:
    return F.when(score < 1e-9, "unused").when(score < 0.20, "rare").when(score < 0.45, "occasional").when(score < 0.75, "frequent").otherwise("heavy")


def weighted(reads: Column, writes: Column) -> Column:
    return reads + F.lit(WRITE_WEIGHT) * writes


def in_window(log: DataFrame, window_days: int, now=None) -> DataFrame:
    """The entries of the last days, both ends included; ``now`` is the last entry's time unless given.

    Adds the column ``_now``.  The default clock is a scalar sub-query, run once.
    """
    clock = log.agg(F.max("ts")).scalar() if now is None else F.lit(now)
    span = F.make_dt_interval(F.lit(window_days))
    return log.where((F.col("ts") >= clock - span) & (F.col("ts") <= clock)).withColumn("_now", clock)


def compact(log: DataFrame) -> DataFrame:
    """Entries of one day that differ in parameters and time only as one row: n of them, from ``ts_first`` to ``ts``.

    ``sql`` becomes the statement's template.  All aggregates of ``accumulate`` stay the same, over far fewer rows.
    """
    keys = ["sql", "service", "template", "declared_reads", "declared_writes", "_now"]
    t = log.withColumn("sql", ln.template_of(F.coalesce("sql", F.lit(""))))
    grouped = t.groupBy(*[k for k in keys if k in t.columns], F.to_date("ts").alias("_day"))
    return grouped.agg(F.count("*").alias("n"), F.min("ts").alias("ts_first"), F.max("ts").alias("ts")).drop("_day")


def attribute(log: DataFrame, columns: DataFrame | None, mode: str = "hybrid") -> DataFrame:
    """log -> log with (reads, writes, attribution): from the statement, the declared lists, or both."""
    if mode not in ("sql", "declared", "hybrid"):
        raise ValueError(f"mode must be sql, declared or hybrid, not {mode!r}")
    none = F.array().cast("array<string>")
    r, w = F.coalesce("declared_reads", none), F.coalesce("declared_writes", none)
    declared = (F.size(r) + F.size(w)) > 0
    if mode == "declared":
        return log.select("*", F.array_distinct(r).alias("reads"), F.array_distinct(w).alias("writes"), F.when(declared, "declared").otherwise("none").alias("attribution"))
    if "ts_first" in log.columns:  # few rows, from which templates and counts are taken: the log is read once
        log = keep(log, "compacted")
        templates = log.select("sql")
    else:
        templates = log.select(ln.template_of("sql").alias("sql"))
    found = ln.lineage_table(templates, columns, templated=True, expand=True)
    found = found.select(F.col("sql").alias("_template"), F.col("reads").alias("_r"), F.col("writes").alias("_w"), F.col("parsed_ok").alias("_ok"))
    template = F.col("sql") if "ts_first" in log.columns else ln.template_of(F.coalesce("sql", F.lit("")))
    joined = log.withColumn("_template", template).join(found, "_template", "left")
    ok = F.coalesce("_ok", F.lit(False))
    pick = lambda parsed, given: F.when(ok, F.array_union(parsed, given) if mode == "hybrid" else parsed).otherwise(F.array_distinct(given))
    how = F.when(ok, "parsed").when(declared, "declared").otherwise("none")
    return joined.select(*log.columns, pick(F.col("_r"), r).alias("reads"), pick(F.col("_w"), w).alias("writes"), how.alias("attribution"))


def touches(attributed: DataFrame) -> DataFrame:
    """One row per column that an entry reads or writes."""
    touch = lambda names, write: F.transform(names, lambda c: F.struct(c.alias("qualified_name"), F.lit(write).alias("is_write")))
    return attributed.select(*attributed.columns, F.explode(F.concat(touch(F.col("reads"), False), touch(F.col("writes"), True))).alias("_t")).select("_t.*", *[c for c in attributed.columns if c not in ("reads", "writes", "declared_reads", "declared_writes", "sql")])


def accumulate(t: DataFrame, keys: tuple[str, ...] = ("qualified_name",)) -> DataFrame:
    """Counts, times, days, services and templates per column; each is a mergeable aggregate.

    Rows of ``compact`` count ``n`` times, from ``ts_first`` to ``ts``.
    """
    n, first = (F.col("n"), F.col("ts_first")) if "ts_first" in t.columns else (F.lit(1), F.col("ts"))
    times = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    # one pass: by service first, then over the services; days add up as a set
    by_service = t.groupBy(*keys, "service").agg(
        times(~F.col("is_write")).alias("read_count"), times(F.col("is_write")).alias("write_count"),
        F.max(F.when(~F.col("is_write"), F.col("ts"))).alias("last_read_at"), F.max(F.when(F.col("is_write"), F.col("ts"))).alias("last_write_at"),
        F.min(first).alias("first_access_at"), F.max("ts").alias("last_access_at"), F.collect_set(F.to_date("ts")).alias("days"),
        F.collect_set(F.when(F.col("template") != "", F.col("template"))).alias("templates"),
        times(F.col("attribution") == "parsed").alias("from_sql"), times(F.col("attribution") == "declared").alias("from_declared"),
    )
    total, latest = lambda c: F.sum(c).alias(c), lambda c: F.max(c).alias(c)
    found = by_service.groupBy(*keys).agg(
        total("read_count"), total("write_count"), latest("last_read_at"), latest("last_write_at"), F.min("first_access_at").alias("first_access_at"), latest("last_access_at"),
        F.size(F.array_distinct(F.flatten(F.collect_list("days")))).cast("long").alias("distinct_days"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("templates")))).alias("query_templates"), total("from_sql"), total("from_declared"),
        F.array_sort(F.collect_list(F.when(F.col("service") != "", F.struct((-F.col("read_count") - F.col("write_count")).alias("n"), "service")))).alias("s"),
    )
    services = F.map_from_entries(F.transform("s", lambda x: F.struct(x["service"], -x["n"])))
    return found.withColumn("access_by_service", F.when(F.size("s") > 0, services)).drop("s")


def rank_fraction(rows: DataFrame, value: str, out: str = "rank_fraction") -> DataFrame:
    """Mid-rank of ``value`` over (n - 1) among all rows; of a single row 1 if positive, else 0.

    Equal values are counted first and totals run over the distinct values, slice by slice.
    """
    counts = rows.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    ranked = running(counts, "_v", "_c", "_lo", "_n")
    mid = (F.col("_lo") * 2 + F.col("_c")) / 2 / F.nullif(F.col("_n") - 1, F.lit(0))
    ranked = ranked.select("_v", F.coalesce(mid, F.when(F.col("_v") > 0, 1.0).otherwise(0.0)).alias(out))
    return rows.join(ranked, rows[value].eqNullSafe(ranked["_v"]), "left").drop("_v")


def score(counts: DataFrame, half_life_days: float, now: Column) -> DataFrame:
    """counts(read_count, write_count, last_access_at, ...) -> the same with score parts, ``score`` and ``tier``.

    Every row takes part in the rank, those without an access too.
    """
    c = counts.withColumn("weighted", weighted(F.coalesce("read_count", F.lit(0)), F.coalesce("write_count", F.lit(0))))
    c = rank_fraction(c, "weighted")
    c = c.withColumn("absolute", F.least(F.lit(1.0), F.log1p("weighted") / F.log1p(F.lit(ABS_REFERENCE))))
    c = c.withColumn("frequency", F.lit(RANK_WEIGHT) * F.col("rank_fraction") + F.lit(1 - RANK_WEIGHT) * F.col("absolute"))
    age = F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_access_at").cast("timestamp"))) / F.lit(86_400e6))
    c = c.withColumn("recency", F.pow(F.lit(0.5), age / F.lit(half_life_days)))
    raw = F.col("frequency") * (RECENCY_FLOOR + (1 - RECENCY_FLOOR) * F.col("recency"))
    used = F.col("weighted") > 0
    c = c.withColumn("score", F.when(used, places(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)))).otherwise(F.lit(0.0)))
    return c.withColumn("is_used", used).withColumn("tier", tier(F.col("score")))


def analyze(log: DataFrame, columns: DataFrame | None = None, window_days: int = 90, now=None, mode: str = "hybrid", half_life_days: float | None = None) -> DataFrame:
    """The usage relation U: every known column and every column the log names."""
    recent = attribute(compact(in_window(log, window_days, now)), columns, mode)
    acc = accumulate(touches(recent))
    clock = log.agg(F.max("ts")).scalar() if now is None else F.lit(now)
    if columns is not None:
        acc = columns.select("qualified_name").join(acc, "qualified_name", "full_outer")
    zero = ["read_count", "write_count", "distinct_days", "from_sql", "from_declared"]
    acc = acc.fillna(0, zero)
    out = score(acc, half_life_days or window_days / 3, clock)
    how = F.when((F.col("from_sql") > 0) & (F.col("from_declared") > 0), "hybrid").when(F.col("from_sql") > 0, "parsed").when(F.col("from_declared") > 0, "declared").otherwise("none")
    return out.select(
        "qualified_name", F.regexp_extract("qualified_name", r"\A(.*)\.", 1).alias("table"), F.substring_index("qualified_name", ".", -1).alias("column"), "score", "is_used", "tier", "read_count", "write_count",
        (F.col("read_count") + F.col("write_count")).alias("total_count"), "last_read_at", "last_write_at", "last_access_at", "first_access_at", "distinct_days",
        F.coalesce(F.size("access_by_service"), F.lit(0)).alias("distinct_services"), "access_by_service", "query_templates", F.lit(window_days).alias("window_days"), how.alias("attribution"),
        F.struct("weighted", "rank_fraction", "absolute", "frequency", "recency").alias("signals"),
    ).orderBy(F.desc("score"), "qualified_name")


def run_counters(recent: DataFrame) -> DataFrame:
    """How many entries were in the window and how they were attributed."""
    n = F.col("n") if "ts_first" in recent.columns else F.lit(1)
    total = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    return recent.agg(total(F.lit(True)).alias("n_in_window"), *[total(F.col("attribution") == a).alias(f"n_{a}") for a in ("parsed", "declared", "none")])
