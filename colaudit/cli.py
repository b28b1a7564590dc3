"""Command line: profile, audit, history, drafts, policy drafts, reports and evaluation against labels.

    python -m colaudit.cli audit --tables DIR --log FILE --history DIR
"""

from __future__ import annotations

import argparse
import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import reports
from .operators import history, policy_text, remediation, retention, scoring, sensitivity, usage
from .plans.audit import AuditConfig, run_audit
from .scratch import keep
from .session import session
from .sources import catalog, querylog
from .sources.policy import RetentionPolicy


def load_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Every Parquet file or folder under a path, by name; listed by Spark's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = sorted(s.getPath().getName() for s in fs.listStatus(p))
    return {n.removesuffix(".parquet"): spark.read.parquet(f"{path}/{n}") for n in names if n.endswith(".parquet")}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="colaudit")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *options: tuple, **kw):
        s = sub.add_parser(name, **kw)
        for flags, more in options:
            s.add_argument(*flags, **more)

    tables = (["--tables"], {"required": True})
    log = (["--log"], {"required": True})
    hist = (["--history"], {"required": True})
    policy = (["--policy"], {})
    days = (["--policy-days"], {"type": int})
    window = (["--window-days"], {"type": int, "default": 90})
    run = (["--run"], {"default": "latest"})
    column = (["--column"], {"required": True})
    add("profile", tables, (["--out"], {}))
    add("sensitivity", tables)
    add("usage", tables, log, window, (["--mode"], {"default": "hybrid"}))
    add("retention", tables, policy, days)
    add("audit", tables, log, window, policy, days, (["--history"], {}), (["--note"], {"default": ""}), (["--top"], {"type": int, "default": 20}), (["--mode"], {"default": "hybrid"}))
    add("runs", hist, (["--limit"], {"type": int, "default": 50}))
    add("findings", hist, run, (["--flagged-only"], {"action": "store_true"}))
    add("finding", hist, run, column)
    add("remediation", hist, run, column)
    add("trend", hist, column)
    add("diff", hist, (["--base"], {"required": True}), (["--head"], {"required": True}))
    add("drafts", tables, log, (["--out"], {"required": True}), policy, days, window)
    add("policy", (["document"], {}), tables)
    add("train", (["--out"], {"required": True}), (["--model"], {"default": "logreg"}))
    add("evaluate", tables, (["--truth"], {"required": True}), (["--model"], {"help": "a stored model; without it the rules alone"}))
    add("report", (["what"], {"choices": ["profile", "usage", "retention"]}), tables, (["--log"], {}), window, policy, days, (["--top"], {"type": int, "default": 40}), (["--mode"], {"default": "hybrid"}))
    add("health", hist)
    return p


def _config(a: argparse.Namespace, spark: SparkSession) -> AuditConfig:
    found = RetentionPolicy.from_file(spark, a.policy) if getattr(a, "policy", None) else RetentionPolicy()
    return AuditConfig(window_days=getattr(a, "window_days", 90), mode=getattr(a, "mode", "hybrid"), policy=found, policy_days=getattr(a, "policy_days", None))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or session()
    show = lambda df, n=200: df.show(n, truncate=60)
    past = history.History(spark, a.history) if getattr(a, "history", None) else None
    tables = load_tables(spark, a.tables) if getattr(a, "tables", None) else {}
    if a.command == "profile":
        columns, found = catalog.extract(tables)
        show(columns.select("qualified_name", "generic_type", "sample_null_fraction", "distinct_in_sample", "min_value", "max_value"))
        if a.out:
            catalog.save_document(columns, found, a.out)
    elif a.command == "sensitivity":
        show(sensitivity.classify(catalog.extract(tables)[0]).orderBy("score", ascending=False))
    elif a.command == "usage":
        show(usage.analyze(querylog.read(spark, a.log), catalog.extract(tables)[0], a.window_days, mode=a.mode))
    elif a.command == "retention":
        config, columns, now = _config(a, spark), catalog.extract(tables)[0], datetime.now(timezone.utc)
        show(retention.check(columns, config.policy, now, retention.live_stats(tables, columns, config.policy, now)))
    elif a.command in ("audit", "drafts"):
        done = run_audit(tables, querylog.read(spark, a.log), _config(a, spark))
        if a.command == "drafts":
            print(remediation.write_drafts(remediation.draft(done.findings, done.columns, done.tables), a.out), "drafts")
        else:
            print(scoring.report(done.findings, a.top))
            if past:
                print("run", done.record(past, a.note, a.tables))
    elif a.command == "runs":
        show(past.list_runs(a.limit))
    elif a.command == "findings":
        show(past.findings(a.run, a.flagged_only))
    elif a.command == "finding":
        print(json.dumps(past.finding(a.run, a.column).asDict(recursive=True), default=str, indent=1))
    elif a.command == "remediation":
        print(past.remediation(a.run, a.column)["sql"])
    elif a.command == "trend":
        show(past.trend(a.column))
    elif a.command == "diff":
        show(past.diff(a.base, a.head))
    elif a.command == "policy":
        columns = catalog.extract(tables)[0]
        names = [r[0] for r in columns.select("qualified_name").collect()] + list(tables)
        rules = policy_text.extract_rules(policy_text.read_document(spark, a.document))
        print(policy_text.review_yaml(policy_text.propose_mappings(rules, names), a.document))
    elif a.command == "train":
        from .operators import ml

        ml.save(ml.train(spark, a.model)[0], a.out)
    elif a.command == "evaluate":
        from .operators import evaluation, ml

        truth = querylog.read_ground_truth(spark, a.truth)
        columns = keep(catalog.extract(tables)[0], "columns")
        rules = keep(sensitivity.classify(columns), "rules")
        if a.model:
            ways = ml.compare(rules, keep(ml.predict(ml.load(a.model), columns), "learned"), truth)
        else:
            ways = evaluation.evaluate_sensitivity(rules, truth).withColumn("method", F.lit("rules"))
        print(reports.evaluation(ways))
    elif a.command == "report":
        columns = catalog.extract(tables)[0]
        if a.what == "profile":
            print(reports.profile(columns, a.top))
        elif a.what == "usage":
            print(reports.usage(usage.analyze(querylog.read(spark, a.log), columns, a.window_days, mode=a.mode), a.top))
        else:
            config, now = _config(a, spark), datetime.now(timezone.utc)
            print(reports.retention(retention.check(columns, config.policy, now, retention.live_stats(tables, columns, config.policy, now)), a.top))
    elif a.command == "health":
        print(json.dumps({"status": "ok", "runs": past.count()}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
