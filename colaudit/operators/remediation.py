"""Draft SQL for findings; text only, nothing is executed."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import quote

#: Types whose data the law often wants kept, and where archives go.
STATUTORY = ["government_id", "financial", "health", "special_category"]
ARCHIVE_SCHEMA = "minimization_archive"


def strategy(verdict: Column, is_primary_key: Column, is_foreign_key: Column) -> Column:
    return F.when(~verdict.isin("flag_for_deletion", "review"), "none").when(is_primary_key | is_foreign_key, "anonymize_in_place").otherwise("archive_then_drop")


def cautions(pii_type: Column, plan: Column, column: Column, nullable: Column, fraction_overdue: Column, foreign_key_target: Column) -> Column:
    drop = plan == "archive_then_drop"
    late = F.format_string("%.0f%%", (1 - fraction_overdue) * 100)
    return F.when(plan == "none", F.array().cast("array<string>")).otherwise(F.array_compact(F.array(
        F.lit("Not executed: review this draft and run it by hand."),
        F.when(pii_type.isin(*STATUTORY), F.concat(pii_type, F.lit(" data often must be kept by law: make sure that no duty to keep it applies."))).otherwise(F.lit("Make sure that no legal or contractual duty to keep this data applies.")),
        F.lit("Back up first and use a maintenance window."),
        F.when(drop & ~nullable, F.concat(column, F.lit(" is NOT NULL: the constraint goes with the column."))),
        F.when(drop & (fraction_overdue < 0.999), F.concat(late, F.lit(" of the rows are within the retention period and lose the column too; to keep it for them, delete the overdue rows instead."))),
        F.when(~drop, F.concat(column, F.lit(" is part of a key"), F.coalesce(F.concat(F.lit(" (references "), foreign_key_target, F.lit(")")), F.lit("")), F.lit(": its values are replaced, not dropped."))),
    )))


def _lines(*lines) -> Column:
    return F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines])


def draft(findings: DataFrame, columns: DataFrame, tables: DataFrame, dialect: str = "postgresql", now: datetime | None = None, archive_schema: str = ARCHIVE_SCHEMA) -> DataFrame:
    """findings ⋈ columns ⋈ tables -> (qualified_name, strategy, summary, sql, cautions, reversible, dialect)."""
    day = (now or datetime.now(timezone.utc)).strftime("%Y%m%d")
    q = lambda c: quote(F.col(c) if isinstance(c, str) else c, dialect)
    m = columns.select("qualified_name", "raw_type", "nullable", "is_primary_key", "is_foreign_key", "foreign_key_target")
    t = tables.select(F.col("name").alias("table"), F.coalesce("schema", F.lit("public")).alias("schema"), "primary_key")
    r = findings.select("qualified_name", "table", "column", "verdict", "score", "sensitivity", "usage", "retention", F.col("reasons")[0].alias("reason"), "evidence").join(m, "qualified_name", "left").join(t, "table", "left")
    r = r.fillna({"raw_type": "text", "nullable": True, "is_primary_key": False, "is_foreign_key": False, "schema": "public"})
    r = r.withColumn("strategy", strategy(F.col("verdict"), F.col("is_primary_key"), F.col("is_foreign_key")))
    r = r.withColumn("cautions", cautions(F.col("evidence.sensitivity.pii_type"), F.col("strategy"), F.col("column"), F.col("nullable"), F.col("evidence.retention.fraction_overdue"), F.col("foreign_key_target")))
    source = F.concat(q("schema"), F.lit("."), q("table")) if dialect == "postgresql" else q("table")
    arc = F.concat("table", F.lit("__"), "column", F.lit(f"__{day}"))
    archive = F.concat(q(F.lit(archive_schema)), F.lit("."), q(arc)) if dialect == "postgresql" else q(F.concat(F.lit(f"{archive_schema}_"), arc))
    keys = F.array_join(F.transform(F.coalesce("primary_key", F.array().cast("array<string>")), lambda k: q(k)), ", ")
    picked = F.when(keys != "", F.concat(keys, F.lit(", "), q("column"))).otherwise(F.lit("*") if dialect == "postgresql" else q("column"))
    copy = F.concat(F.lit("CREATE TABLE "), archive, F.lit(" AS\n  SELECT "), picked, F.lit(" FROM "), source)
    f2 = lambda c: F.format_string("%.2f", F.col(c))
    head = _lines(
        F.concat(F.lit("-- DRAFT, not executed: "), "schema", F.lit("."), "qualified_name"), F.concat(F.lit("-- necessity "), F.format_string("%.3f", F.col("score")), F.lit(", verdict "), "verdict"),
        F.concat(F.lit("-- sensitivity "), f2("sensitivity"), F.lit(", usage "), f2("usage"), F.lit(", staleness "), f2("retention")), F.concat(F.lit("-- "), F.coalesce("reason", F.lit("no reason recorded"))),
        F.array_join(F.transform("cautions", lambda c: F.concat(F.lit("-- CAUTION: "), c)), "\n"), "",
    )
    days, anchor = F.col("evidence.retention.policy_days"), F.col("evidence.retention.anchor")
    late = F.concat(F.lit(" FROM "), source, F.lit(" WHERE "), q(anchor), F.lit(" < now() - interval '"), days.cast("string"), F.lit(" days';"))
    drop = F.concat(F.lit("ALTER TABLE "), source, F.lit(" DROP COLUMN "), q("column"), F.lit(";"))
    restore = F.concat(F.lit("-- to restore: ALTER TABLE "), source, F.lit(" ADD COLUMN "), q("column"), F.lit(" "), "raw_type", F.lit("; then copy the values back by key from "), archive)
    if dialect == "postgresql":
        archived = _lines(
            "BEGIN;", F.lit(f'CREATE SCHEMA IF NOT EXISTS "{archive_schema}";'), F.concat(copy, F.lit(" WHERE "), q("column"), F.lit(" IS NOT NULL;")), drop, "COMMIT;", restore,
            F.coalesce(F.concat(F.lit("-- or drop only the overdue rows: DELETE"), late), F.lit("-- the table has no lifecycle column by which to drop overdue rows only")),
        )
    else:
        archived = _lines("-- this engine does not roll back DDL: back up first", F.concat(copy, F.lit(" WHERE "), q("column"), F.lit(" IS NOT NULL;")), drop)
    blank = F.when(F.col("nullable"), "NULL").when(F.col("raw_type").rlike("(?i)char|text|json|string"), "''").otherwise("0")
    update = F.concat(F.lit("UPDATE "), source, F.lit(" SET "), q("column"), F.lit(" = "))
    masked = _lines(
        *([F.lit(f'CREATE SCHEMA IF NOT EXISTS "{archive_schema}";')] if dialect == "postgresql" else []), F.concat(copy, F.lit(";")),
        F.when(F.col("is_primary_key"), F.concat(F.lit("-- a primary key: replace it in all tables that refer to it in one migration\n-- "), update, F.lit("/* pseudonym */;"))).otherwise(F.concat(update, blank, F.lit(";"))),
    )
    sql = F.when(F.col("strategy") == "none", F.concat(F.lit("-- "), "qualified_name", F.lit(": verdict "), "verdict", F.lit(", nothing to do\n"))).when(F.col("strategy") == "archive_then_drop", F.concat(head, archived, F.lit("\n"))).otherwise(F.concat(head, masked, F.lit("\n")))
    summary = (
        F.when(F.col("strategy") == "none", "In use or not sensitive: no action.")
        .when(F.col("strategy") == "archive_then_drop", F.concat(F.lit("Archive "), "column", F.lit(f" to {archive_schema}, then drop it.")))
        .otherwise(F.concat("column", F.lit(" is a "), F.when(F.col("is_primary_key"), "primary").otherwise("foreign"), F.lit(" key: anonymize in place.")))
    )
    return r.select("qualified_name", "strategy", summary.alias("summary"), sql.alias("sql"), "cautions", (F.col("strategy") != "anonymize_in_place").alias("reversible"), F.lit(dialect).alias("dialect"))


def write_drafts(drafts: DataFrame, path: str) -> int:
    """One .sql file per column in a local folder, streamed from the executors; returns how many."""
    import os

    os.makedirs(path, exist_ok=True)
    n = 0
    for r in drafts.where("strategy <> 'none'").toLocalIterator():
        with open(os.path.join(path, r["qualified_name"].replace(".", "__") + ".sql"), "w", encoding="utf-8") as f:
            f.write(r["sql"])
        n += 1
    return n
