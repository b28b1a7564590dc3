"""Text reports: each line is one expression over a row, so that Spark formats and orders them; the driver joins what it prints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _none(c: str, text: str = "-") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(text))


def _text(title: str, heading: str, rows: DataFrame, line: Column, order: list[Column], top: int | None) -> str:
    """Title, heading and one line for each row, in order; ``top`` bounds what is printed, None prints all."""
    named = rows.orderBy(*order).select(line.alias("line"))
    found = named.limit(top) if top else named
    return "\n".join([title, heading, *(r["line"] for r in found.toLocalIterator())])


def usage_line() -> Column:
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("read_count", "write_count", "distinct_days")]
    return F.format_string("%-40s %6.4f %-10s %10d %10d %6d  %s", F.col("qualified_name"), F.col("score"), F.col("tier"), *counts, F.col("attribution"))


def usage(u: DataFrame, top: int | None = 40) -> str:
    """The usage relation, most used first."""
    n = u.agg(F.count("*").alias("n"), F.count_if("is_used").alias("used"), F.max("window_days").alias("days")).first()
    heading = f"{'column':<40} {'score':>6} {'tier':<10} {'reads':>10} {'writes':>10} {'days':>6}  attribution"
    return _text(f"usage over {n['days']} days: {n['used']} of {n['n']} columns used", heading, u, usage_line(), [F.desc("score"), F.col("qualified_name")], top)


def retention(r: DataFrame, top: int | None = 40) -> str:
    """The retention relation, most overdue first."""
    n = r.agg(F.count("*").alias("n"), F.count_if("is_overdue").alias("late")).first()
    line = F.format_string("%-40s %6.4f %-7s %9s %9s  %s", F.col("qualified_name"), F.coalesce("score", F.lit(0.0)), F.when(F.col("is_overdue"), "overdue").otherwise(""), _none("policy_days"), _none("days_overdue"), _none("basis"))
    heading = f"{'column':<40} {'score':>6} {'':<7} {'policy':>9} {'overdue':>9}  basis"
    return _text(f"retention: {n['late']} of {n['n']} columns overdue", heading, r, line, [F.desc("score"), F.col("qualified_name")], top)


def profile(columns: DataFrame, top: int | None = None) -> str:
    """The catalogue, by table and place of the column."""
    n = columns.agg(F.count("*").alias("n"), F.approx_count_distinct("table").alias("tables")).first()
    span = F.when(F.col("min_value").isNotNull(), F.concat_ws(" .. ", "min_value", "max_value")).otherwise("")
    keys = F.concat_ws(",", F.when(F.col("is_primary_key"), "primary"), F.when(F.col("is_foreign_key"), "foreign"), F.when(F.col("is_indexed"), "indexed"))
    line = F.format_string("%-40s %-12s %6.3f %8d %-16s %s", F.col("qualified_name"), F.col("generic_type"), F.coalesce(F.col("sample_null_fraction"), F.lit(0.0)).cast("double"), F.coalesce(F.col("distinct_in_sample"), F.lit(0)).cast("long"), keys, span)
    heading = f"{'column':<40} {'type':<12} {'nulls':>6} {'distinct':>8} {'keys':<16} span"
    return _text(f"catalogue: {n['n']} columns", heading, columns, line, [F.col("table"), F.col("ordinal")], top)


def evaluation(ways: DataFrame) -> str:
    """(method, n, tp, fp, tn, fn, precision, recall, f1, accuracy, tier_accuracy, score_mae) as text, a line for each method."""
    figures = ("precision", "recall", "f1", "accuracy", "tier_accuracy", "score_mae")
    line = F.format_string("%-10s %7d %6d %6d %6d %6d" + " %9.3f" * len(figures), F.col("method"), *[F.col(c) for c in ("n", "tp", "fp", "tn", "fn")], *[F.coalesce(F.col(c), F.lit(0.0)) for c in figures])
    heading = f"{'method':<10} {'n':>7} {'tp':>6} {'fp':>6} {'tn':>6} {'fn':>6}" + "".join(f" {c[:9]:>9}" for c in figures)
    return _text("sensitivity against labels", heading, ways, line, [F.col("method")], None)
