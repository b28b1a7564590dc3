"""How well scores agree with labels: one aggregate each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import running

#: Fixed order of usage labels.
USAGE_ORDINAL = {"never": 0, "rare": 1, "low": 2, "medium": 3, "high": 4}


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / F.nullif(b, F.lit(0))).otherwise(F.lit(0.0))


def confusion(rows: DataFrame, predicted: str, actual: str, *more: Column) -> DataFrame:
    """(n, tp, fp, tn, fn, *more, precision, recall, f1, accuracy); empty denominators give 0; one aggregate for all."""
    p, a = F.col(predicted), F.col(actual)
    c = rows.agg(F.count("*").alias("n"), F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & ~a).alias("tn"), F.count_if(~p & a).alias("fn"), *more)
    c = c.select("*", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))
    return c.select("*", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), ratio(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"))


def evaluate_sensitivity(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Confusion of is_sensitive, accuracy of tiers and mean absolute error of scores."""
    j = predictions.select("qualified_name", "score", "tier", F.col("is_sensitive").alias("predicted")).join(truth.select("qualified_name", "sensitivity_score", "sensitivity_tier", F.col("is_sensitive").alias("actual")), "qualified_name")
    more = F.avg((F.col("tier") == F.col("sensitivity_tier")).cast("int")).alias("tier_accuracy"), F.avg(F.abs(F.col("score") - F.col("sensitivity_score"))).alias("score_mae")
    return confusion(j, "predicted", "actual", *more)


def average_rank(rows: DataFrame, value: str, out: str) -> DataFrame:
    """1-based rank of ``value``, ties averaged; totals run over the distinct values."""
    counts = running(rows.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_c")), "_v", "_c")
    ranked = counts.select("_v", (F.col("_before") + (F.col("_c") + 1) / 2).alias(out))
    return rows.join(ranked, rows[value].eqNullSafe(ranked["_v"])).drop("_v")


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """(n, spearman): Pearson correlation of average ranks; 0 below three rows or without variance."""
    r = average_rank(average_rank(rows, x, "_rx"), y, "_ry")
    c = r.agg(F.count("*").alias("n"), F.covar_pop("_rx", "_ry").alias("c"), F.stddev_pop("_rx").alias("sx"), F.stddev_pop("_ry").alias("sy"))
    return c.select("n", F.when((F.col("n") < 3) | (F.col("sx") * F.col("sy") == 0), F.lit(0.0)).otherwise(F.col("c") / F.nullif(F.col("sx") * F.col("sy"), F.lit(0.0))).alias("spearman"))


def log_bands(counts: DataFrame) -> DataFrame:
    """counts(reads, writes) -> (weighted, band): never, else the quartile of reads + 0.2 writes among those in use."""
    c = counts.withColumn("weighted", F.col("reads") + 0.2 * F.col("writes"))
    totals = c.where("weighted > 0").groupBy("weighted").agg(F.count("*").alias("_c"))
    share = running(totals, "weighted", "_c").select("weighted", ((F.col("_before") + F.col("_c")) / F.col("_total")).alias("_share"))
    band = F.when(F.col("_share").isNull(), "never").when(F.col("_share") <= 0.25, "rare").when(F.col("_share") <= 0.50, "low").when(F.col("_share") <= 0.75, "medium").otherwise("high")
    return c.join(share, "weighted", "left").withColumn("band", band).drop("_share")


def log_derived(log: DataFrame) -> DataFrame:
    """Bands of all columns by how often the log's declared lists name them, repeats counted."""
    one = lambda c, r, w: log.select(F.explode(c).alias("qualified_name"), F.lit(r).alias("r"), F.lit(w).alias("w"))
    counts = one("declared_reads", 1, 0).unionAll(one("declared_writes", 0, 1)).groupBy("qualified_name").agg(F.sum("r").alias("reads"), F.sum("w").alias("writes"))
    return log_bands(counts)


def evaluate_usage(usage: DataFrame, truth: DataFrame) -> DataFrame:
    """Confusion of used against labels other than never, with Spearman of score and label."""
    order = F.create_map(*[F.lit(x) for kv in USAGE_ORDINAL.items() for x in kv])
    j = usage.select("qualified_name", "score", F.col("is_used").alias("predicted")).join(truth.select("qualified_name", F.col("expected_usage").alias("label")), "qualified_name")
    j = j.select("*", (F.col("label") != "never").alias("actual"), order[F.col("label")].cast("double").alias("ordinal"))
    return confusion(j, "predicted", "actual").withColumn("spearman", spearman(j.where("ordinal is not null"), "score", "ordinal").select("spearman").scalar())


def band_means(usage: DataFrame, truth: DataFrame) -> DataFrame:
    j = usage.select("qualified_name", "score").join(truth.select("qualified_name", F.col("expected_usage").alias("label")), "qualified_name")
    return j.groupBy("label").agg(F.avg("score").alias("mean_score"), F.count("*").alias("n"))


def evaluate_lineage(found: DataFrame, declared: DataFrame) -> DataFrame:
    """found(sql, reads, writes), declared(sql, reads, writes) -> micro precision, recall and F1 over statements."""
    got = found.select("sql", F.array_union("reads", "writes").alias("got"))
    want = declared.dropDuplicates(["sql"]).select("sql", F.array_union("reads", "writes").alias("want"))
    j = got.join(want, "sql").select(F.size(F.array_intersect("got", "want")).alias("tp"), F.size(F.array_except("got", "want")).alias("fp"), F.size(F.array_except("want", "got")).alias("fn"))
    c = j.agg(F.count("*").alias("n_statements"), *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("tp", "fp", "fn")])
    c = c.select("*", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))
    return c.select("*", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"))
