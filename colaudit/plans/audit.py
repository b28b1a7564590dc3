"""A whole audit: profile, sensitivity, usage, retention, score."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import history, remediation, retention, scoring, sensitivity, usage
from ..sources import catalog
from ..sources.policy import RetentionPolicy


@dataclass
class AuditConfig:
    window_days: int = 90
    mode: str = "hybrid"
    policy: RetentionPolicy = field(default_factory=RetentionPolicy)
    policy_days: int | None = None
    live: bool = True
    now: datetime | None = None
    thresholds: scoring.Thresholds = field(default_factory=scoring.Thresholds)

    def __post_init__(self):
        if not 1 <= self.window_days <= 3650:
            raise ValueError("window_days must be from 1 to 3650")
        if self.mode not in ("sql", "declared", "hybrid"):
            raise ValueError("mode must be sql, declared or hybrid")
        if self.policy_days is not None:
            if not 1 <= self.policy_days <= 36500:
                raise ValueError("policy_days must be from 1 to 36500")
            self.policy = RetentionPolicy(self.policy_days, self.policy.tables, self.policy.columns, self.policy.anchors, self.policy.exclude)


@dataclass
class Audit:
    columns: DataFrame
    tables: DataFrame
    sensitivity: DataFrame
    usage: DataFrame
    retention: DataFrame
    findings: DataFrame
    started_at: datetime
    config: AuditConfig

    def with_drafts(self) -> DataFrame:
        """Findings with a remediation struct where the verdict asks for one."""
        d = remediation.draft(self.findings, self.columns, self.tables, now=self.config.now)
        keep = F.when(F.col("strategy") != "none", F.struct(*[c for c in d.columns if c != "qualified_name"]))
        return self.findings.join(d.select("qualified_name", keep.alias("remediation")), "qualified_name", "left")

    def record(self, to: history.History, note: str = "", target: str = "") -> str:
        from dataclasses import asdict

        return to.record(
            self.with_drafts(), started_at=self.started_at, finished_at=datetime.now(timezone.utc), target=target, window_days=self.config.window_days,
            mode=self.config.mode, policy=self.config.policy.to_dict(), thresholds=asdict(self.config.thresholds), note=note,
        )


def run_audit(tables: Mapping[str, DataFrame], log: DataFrame, config: AuditConfig | None = None, constraints: DataFrame | None = None, columns: DataFrame | None = None, tables_df: DataFrame | None = None) -> Audit:
    """The three signals are independent lazy plans that meet in one join.

    Each table is scanned once for counts, spans and late rows, with the policy's cut-offs, and once for its sample; both
    are written as small tables, from which the column relation and the retention signal are read.
    """
    config = config or AuditConfig()
    started = datetime.now(timezone.utc)
    now = config.now or started
    live = None
    if columns is None or config.live:
        cutoff = lambda t, c: F.lit(now).cast("timestamp") - F.make_dt_interval(config.policy.days_for(F.lit(t), F.lit(c))["days"])
        measured = catalog.measure(tables, cutoff)
        live = catalog.live(measured) if config.live else None
    if columns is None:
        columns, tables_df = catalog.extract(tables, constraints, measured=measured)
    s = sensitivity.classify(columns).drop("table", "name")
    u = usage.analyze(log, columns, config.window_days, mode=config.mode)
    r = retention.check(columns, config.policy, now, live)
    u_in = u.select("qualified_name", "score", "tier", "read_count", "write_count", "last_access_at", "window_days", "access_by_service", "query_templates")
    r_in = r.drop("table", "column")
    return Audit(columns, tables_df, s, u, r, scoring.score_all(s, u_in, r_in, config.thresholds), started, config)
