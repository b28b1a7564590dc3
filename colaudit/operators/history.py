"""Recorded audit runs: two Parquet tables, findings partitioned by run."""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scoring import VERDICTS

MOVED = 0.05  # a score that moved by this much is reported


class RunNotFound(LookupError):
    pass


class History:
    """Runs under one path that all executors share.

    A run's findings are written to a folder of their own; then its manifest, one row with its counts, is written aside and
    moved to its place by a rename.  What has no manifest is no run: a writer that dies before the rename leaves nothing
    that a reader sees, and writers that record at the same time do not meet.  ``sweep`` deletes what they left.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def record(self, findings: DataFrame, *, started_at: datetime, finished_at: datetime, target: str = "", window_days: int = 90, mode: str = "hybrid", policy: dict | None = None, thresholds: dict | None = None, note: str = "") -> str:
        """Appends one run and its findings; returns the run's id."""
        run_id = str(uuid.uuid4())
        folder = f"{self.path}/findings/run_id={run_id}"
        findings.write.parquet(folder)
        stored = self.spark.read.schema(findings.schema).parquet(folder)
        counts = F.create_map(*[x for v in VERDICTS for x in (F.lit(v), F.count_if(F.col("verdict") == v))])
        run = stored.agg(F.count("*").alias("n_columns"), F.count_if("is_flagged").alias("n_flagged"), counts.alias("verdict_counts"))
        text = lambda d: F.lit(json.dumps(d or {}, sort_keys=True))
        manifest = run.select(
            F.lit(run_id).alias("id"), F.lit(started_at).alias("started_at"), F.lit(finished_at).alias("finished_at"), F.lit(target).alias("target"), F.lit(window_days).alias("window_days"), F.lit(mode).alias("mode"),
            text(policy).alias("policy"), text(thresholds).alias("thresholds"), "n_columns", "n_flagged", "verdict_counts",
            F.lit((finished_at - started_at).total_seconds()).alias("duration_seconds"), F.lit(note).alias("note"),
        )
        self._commit(manifest.coalesce(1), run_id)
        return run_id

    def _hadoop(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _commit(self, manifest: DataFrame, run_id: str) -> None:
        aside = f"{self.path}/_manifests/{run_id}"
        manifest.write.parquet(aside)
        to, fs = self._hadoop(f"{self.path}/runs/run-{run_id}")
        fs.mkdirs(to.getParent())
        if not fs.rename(self._hadoop(aside)[0], to):
            raise OSError(f"the manifest of run {run_id} could not be moved to {to}")

    def sweep(self) -> list[str]:
        """Deletes findings and manifests of runs that were never committed; no run may be recorded meanwhile."""
        known, gone = {r[0] for r in self.runs().select("id").collect()} if self.count() else set(), []
        for folder, prefix in (("findings", "run_id="), ("_manifests", "")):
            top, fs = self._hadoop(f"{self.path}/{folder}")
            for s in fs.listStatus(top) if fs.exists(top) else []:
                name = s.getPath().getName()
                if name.startswith(prefix) and (run_id := name.removeprefix(prefix)) not in known:
                    fs.delete(s.getPath(), True)
                    gone.append(run_id)
        return sorted(set(gone))

    def runs(self) -> DataFrame:
        return self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.path}/runs")

    def all_findings(self) -> DataFrame:
        """The findings of all runs that are committed, with ``run_id``."""
        rows = self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/findings")
        return rows.join(F.broadcast(self.runs().select(F.col("id").alias("run_id"))), "run_id", "left_semi")

    def count(self) -> int:
        try:
            return self.runs().count()
        except Exception as e:  # no run has been recorded yet
            if "PATH_NOT_FOUND" in str(e):
                return 0
            raise

    def list_runs(self, limit: int = 50) -> DataFrame:
        if not 1 <= limit <= 500:
            raise ValueError("limit must be from 1 to 500")
        return self.runs().orderBy(F.desc("finished_at"), "id").limit(limit)

    def resolve(self, run_id: str) -> str:
        rows = self.runs() if run_id == "latest" else self.runs().where(F.col("id") == run_id)
        found = rows.orderBy(F.desc("finished_at"), "id").first()
        if found is None:
            raise RunNotFound(run_id)
        return found["id"]

    def findings(self, run_id: str = "latest", flagged_only: bool = False) -> DataFrame:
        """The findings of one run: its partition only, filtered in the scan."""
        rows = self.spark.read.parquet(f"{self.path}/findings/run_id={(found := self.resolve(run_id))}").withColumn("run_id", F.lit(found))
        return (rows.where("is_flagged") if flagged_only else rows).orderBy("rank")

    def finding(self, run_id: str, qualified_name: str):
        found = self.findings(run_id).where(F.col("qualified_name") == qualified_name).first()
        if found is None:
            raise RunNotFound(f"{qualified_name} in run {run_id}")
        return found

    def remediation(self, run_id: str, qualified_name: str):
        found = self.finding(run_id, qualified_name)
        if "remediation" not in found or found["remediation"] is None:
            raise RunNotFound(f"no remediation for {qualified_name} (verdict {found['verdict']!r})")
        return found["remediation"]

    def trend(self, qualified_name: str, limit: int = 50) -> DataFrame:
        """One column through all runs, newest first, with the change since the run before."""
        rows = self.all_findings().where(F.col("qualified_name") == qualified_name)
        runs = self.runs().select(F.col("id").alias("run_id"), "finished_at")
        return trend(rows.join(runs, "run_id")).orderBy(F.desc("finished_at")).limit(limit)

    def diff(self, base: str, head: str) -> DataFrame:
        return changes(self.all_findings(), self.resolve(base), self.resolve(head))


def trend(rows: DataFrame) -> DataFrame:
    """Findings with finished_at -> the same with ``score_delta`` to the column's run before."""
    order = Window.partitionBy("qualified_name").orderBy("finished_at")
    return rows.select("qualified_name", "run_id", "finished_at", "score", "is_flagged", "verdict", "sensitivity", "usage", "retention", F.round(F.col("score") - F.lag("score").over(order), 4).alias("score_delta"))


def _compared(j: DataFrame, moved: float) -> DataFrame:
    """Rows (qualified_name, b_…, h_…) of two runs, nulls where one lacks the column -> the kinds of change."""
    both = F.col("b_verdict").isNotNull() & F.col("h_verdict").isNotNull()
    was, now = F.coalesce("b_is_flagged", F.lit(False)), F.coalesce("h_is_flagged", F.lit(False))
    # scores carry four decimals: half a unit below the limit tells 0.05 from rounding
    changes = F.array_compact(F.array(
        F.when(now & ~was, "newly_flagged"), F.when(was & ~now, "no_longer_flagged"), F.when(both & (F.col("b_verdict") != F.col("h_verdict")), "verdict_changed"),
        F.when(both & (F.abs(F.col("h_score") - F.col("b_score")) >= moved - 5e-5), "score_moved"),
    ))
    return j.select("qualified_name", F.explode(changes).alias("change"), F.col("h_verdict").alias("verdict"), F.col("b_verdict").alias("verdict_was"), F.col("h_score").alias("score"), F.round(F.col("h_score") - F.col("b_score"), 4).alias("score_delta"))


_COMPARED = ("score", "is_flagged", "verdict")


def diff(base: DataFrame, head: DataFrame, moved: float = MOVED) -> DataFrame:
    """(qualified_name, change, verdict, verdict_was, score, score_delta): one row per kind of change.

    change: newly_flagged, no_longer_flagged, verdict_changed, score_moved; a column may have several.
    """
    pick = lambda df, p: df.select("qualified_name", *[F.col(c).alias(f"{p}_{c}") for c in _COMPARED])
    return _compared(pick(base, "b").join(pick(head, "h"), "qualified_name", "full_outer"), moved)


def changes(rows: DataFrame, base, head, moved: float = MOVED) -> DataFrame:
    """The same as ``diff`` for rows of many runs in one relation (run_id, qualified_name, …): one pass, no join."""
    side = lambda run, p: [F.max(F.when(F.col("run_id") == run, F.col(c))).alias(f"{p}_{c}") for c in _COMPARED]
    both = rows.where(F.col("run_id").isin(base, head)).groupBy("qualified_name").agg(*side(base, "b"), *side(head, "h"))
    return _compared(both, moved)


def most_moved(changes: DataFrame) -> DataFrame:
    """The moved scores of a diff, the largest change first."""
    return changes.where("change = 'score_moved'").orderBy(F.desc(F.abs("score_delta")), "qualified_name")
