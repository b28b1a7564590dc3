"""Necessity of columns: sensitivity, disuse and staleness joined into a score and a verdict."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import places
from .ranks import positions

#: Fixed order of the report.
VERDICTS = ["flag_for_deletion", "review", "keep", "not_a_risk"]


@dataclass(frozen=True)
class Thresholds:
    sensitive: float = 0.50
    unused: float = 0.20
    stale: float = 0.50


def verdict_of(sensitive: Column, unused: Column, stale: Column) -> Column:
    return F.when(~sensitive, "not_a_risk").when(~unused, "keep").when(~stale, "review").otherwise("flag_for_deletion")


def verdict_order(verdict: Column) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in VERDICTS]), verdict)


def gate(rows: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """(sensitivity, usage, retention) -> three inclusive tests, the product, the flag and the verdict."""
    rows = rows.select(
        "*", places(F.col("sensitivity") * (1 - F.col("usage")) * F.col("retention")).alias("score"),
        (F.col("sensitivity") >= t.sensitive).alias("is_sensitive"), (F.col("usage") <= t.unused).alias("is_unused"), (F.col("retention") >= t.stale).alias("is_stale"),
    )
    return rows.withColumn("is_flagged", F.col("is_sensitive") & F.col("is_unused") & F.col("is_stale")).withColumn("verdict", verdict_of(F.col("is_sensitive"), F.col("is_unused"), F.col("is_stale")))


def join_signals(s: DataFrame, u: DataFrame, r: DataFrame, key: str = "qualified_name") -> DataFrame:
    """Full outer join of the three; a missing side scores 0."""
    tag = lambda df, p: df.select(key, F.struct(*[c for c in df.columns if c != key]).alias(p))
    j = tag(s, "s").join(tag(u, "u"), key, "full_outer").join(tag(r, "r"), key, "full_outer")
    zero = lambda p: F.coalesce(F.col(f"{p}.score"), F.lit(0.0))
    return j.select(key, "s", "u", "r", zero("s").alias("sensitivity"), zero("u").alias("usage"), zero("r").alias("retention"))


def _reasons(t: Thresholds) -> Column:
    f = lambda c: F.format_string("%.2f", F.coalesce(F.col(c), F.lit(0.0)))
    pii = F.coalesce(F.concat(F.lit(" ("), "s.pii_type", F.lit(")")), F.lit(""))
    late = F.when(F.col("r.days_overdue").isNotNull() & F.col("r.policy_days").isNotNull(), F.concat("r.days_overdue", F.lit(" days past the "), "r.policy_days", F.lit("-day retention policy"))).otherwise(F.concat(F.lit("past retention policy (staleness "), f("retention"), F.lit(")")))
    first = (
        F.when(F.col("verdict") == "flag_for_deletion", F.concat(F.lit("sensitive"), pii, F.lit(" (score "), f("sensitivity"), F.lit("), not queried in the window (usage "), f("usage"), F.lit("), and "), late, F.lit(" - minimization violation")))
        .when(F.col("verdict") == "keep", F.concat(F.lit("sensitive"), pii, F.lit(" but actively used ("), F.format_number(F.coalesce("u.read_count", F.lit(0)), 0), F.lit(" reads, usage "), f("usage"), F.lit(f" > {t.unused}) - keep")))
        .when(F.col("verdict") == "review", F.concat(F.lit("sensitive"), pii, F.lit(" and unused (usage "), f("usage"), F.lit(") but data not yet overdue (staleness "), f("retention"), F.lit(f" < {t.stale}) - review, don't delete yet")))
        .otherwise(F.concat(F.lit("not sensitive (score "), f("sensitivity"), F.lit(f" < {t.sensitive}) - unused/stale but not a compliance risk")))
    )
    flag = lambda c: F.initcap(F.col(c).cast("string"))
    second = F.concat(F.lit("sensitive="), flag("is_sensitive"), F.lit(" (s="), f("sensitivity"), F.lit("), unused="), flag("is_unused"), F.lit(" (u="), f("usage"), F.lit("), stale="), flag("is_stale"), F.lit(" (r="), f("retention"), F.lit(")"))
    return F.array(first, second)


def score_all(s: DataFrame, u: DataFrame, r: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """The necessity relation N, ranked: verdict order, score, name; rows without a name come after the named ones.

    s, u and r follow SENSITIVITY, USAGE and RETENTION; further columns stay in the evidence.
    """
    g = gate(join_signals(s, u, r), t)
    part = lambda c, limit, test, factor: F.struct(F.round(c, 4).alias("score"), F.lit(limit).alias("threshold"), F.col(test).alias("met"), F.round(factor, 4).alias("factor"))
    breakdown = F.struct(
        F.lit("sensitivity * (1 - usage) * staleness").alias("formula"), part("sensitivity", t.sensitive, "is_sensitive", F.col("sensitivity")).alias("sensitivity"),
        part("usage", t.unused, "is_unused", 1 - F.col("usage")).alias("usage"), part("retention", t.stale, "is_stale", F.col("retention")).alias("staleness"), F.col("score").alias("product"),
    )
    g = g.select("*", breakdown.alias("breakdown"), _reasons(t).alias("reasons"), F.struct(F.col("s").alias("sensitivity"), F.col("u").alias("usage"), F.col("r").alias("retention")).alias("evidence"))
    g = positions(g, verdict_order(F.col("verdict")), F.desc("score"), F.asc_nulls_last("qualified_name"))
    return g.select(
        "rank", "qualified_name", F.regexp_extract("qualified_name", r"\A(.*)\.", 1).alias("table"), F.substring_index("qualified_name", ".", -1).alias("column"), "score", "is_flagged", "verdict",
        "sensitivity", "usage", "retention", "is_sensitive", "is_unused", "is_stale", "breakdown", "reasons", "evidence",
    ).orderBy("rank")


def histogram(rows: DataFrame) -> DataFrame:
    """(verdict, n) for all four verdicts, zeros too."""
    counted = rows.agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(v).alias("verdict"), F.col(v).alias("n")) for v in VERDICTS])).alias("x")).select("x.*")


def report(rows: DataFrame, top: int | None = None) -> str:
    """Fixed-width text of the ranked findings."""
    found = (rows.orderBy("rank").limit(top) if top else rows.orderBy("rank")).toLocalIterator()
    lines = [f"{'#':>4}  {'column':<40} {'score':>6} {'S':>5} {'U':>5} {'R':>5}  verdict"]
    return "\n".join(lines + [f"{r['rank']:>4}  {r['qualified_name']:<40} {r['score']:>6.3f} {r['sensitivity']:>5.2f} {r['usage']:>5.2f} {r['retention']:>5.2f}  {r['verdict']}" for r in found])
