"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 4) choose tables and cores.  Each query
runs once to warm up and then three times; the median counts.  The result is written by Spark's noop sink.
"""

from __future__ import annotations

import json
import os
import statistics
import time

HEADLINE = [
    "usage_window_counts", "usage_score_tier", "usage_spearman", "retention_spans", "retention_overdue_filter", "retention_age_score", "sens_name_rules", "sens_value_hits", "sens_embedded_pii", "feat_entropy",
    "score_full_outer", "score_verdict_histogram", "history_diff", "catalog_profile", "lineage_statements", "policy_rules_extract",
]


def main() -> None:
    from colaudit import registry
    from colaudit.session import session

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "4"))
    spark = session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": str(cpus), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = registry.queries(), {}
    for name in HEADLINE:
        times = []
        for k in range(4):
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if k:
                times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times), 4)
    entries = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    spark.stop()
    print(json.dumps({"metric": "sum of median seconds of the headline queries", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "log_entries_per_sec": round(entries / took["lineage_statements"])}))


if __name__ == "__main__":
    main()
