"""Rule-based sensitivity of columns: one projection over the column relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import EMBEDDED_RULES, HARMLESS_RULES, NAME_RULES, TYPE_RULES, VALUE_RULES
from ..functions.text import found_in, full_match, normalize_name


def tier(score: Column) -> Column:
    """none < .15 <= low < .40 <= medium < .70 <= high."""
    return F.when(score < 0.15, "none").when(score < 0.40, "low").when(score < 0.70, "medium").otherwise("high")


_BY_WEIGHT = sorted(range(len(NAME_RULES)), key=lambda i: -NAME_RULES[i][3])  # the first listed of equal weight comes first


def name_hits(norm: Column) -> Column:
    """The name rules that a name matches, by their place in the order of weight; each pattern is tried once."""
    return F.array_compact(F.array(*[F.when(norm.rlike(NAME_RULES[i][1]), F.lit(k)) for k, i in enumerate(_BY_WEIGHT)]))


def _pick(values: list, hits: Column) -> Column:
    """The value of the heaviest rule."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.array_min(hits))


def name_score(hits: Column) -> Column:
    return F.coalesce(_pick([NAME_RULES[i][3] for i in _BY_WEIGHT], hits), F.lit(0.0))


def name_type(hits: Column) -> Column:
    return _pick([NAME_RULES[i][2] for i in _BY_WEIGHT], hits)


def name_matches(hits: Column) -> Column:
    """The rules' names in the order in which they are listed."""
    listed = F.array_sort(F.transform(hits, lambda k: F.get(F.array(*[F.lit(i) for i in _BY_WEIGHT]), k)))
    return F.transform(listed, lambda i: F.concat(F.lit("name:"), F.get(F.array(*[F.lit(r[0]) for r in NAME_RULES]), i)))


def matched(norm: Column, rules: list, prefix: str) -> Column:
    return F.array_compact(F.array(*[F.when(norm.rlike(r[1]), F.lit(f"{prefix}:{r[0]}")) for r in rules]))


def first_value_rule(value: Column) -> Column:
    """The id of the first whole-value rule that a value matches."""
    out = None
    for i, p, _, _ in VALUE_RULES:
        out = F.when(full_match(value, p), i) if out is None else out.when(full_match(value, p), i)
    return out


def value_rule(samples: Column, ratio: float = 0.6, embedded_ratio: float = 0.3) -> Column:
    """struct<id, kind, weight> of the rule that most samples match, else of one found inside enough of them."""
    n, first = F.size(samples), F.transform(samples, first_value_rule)
    share = lambda hits: F.size(hits) / F.nullif(n, F.lit(0))
    rule = lambda r: F.struct(F.lit(r[0]).alias("id"), F.lit(r[2]).cast("string").alias("kind"), F.lit(r[3]).alias("weight"))
    out = F.when(n == 0, F.lit(None))
    whole = lambda name: F.filter(first, lambda x: x == name)
    inside = lambda pattern: F.filter(samples, lambda x: found_in(x, pattern))
    for r in VALUE_RULES:
        out = out.when(share(whole(r[0])) >= ratio, rule(r))
    for r in EMBEDDED_RULES:
        out = out.when(share(inside(r[1])) >= embedded_ratio, rule(r))
    return out


def classify(columns: DataFrame, threshold: float = 0.5, strong_threshold: float = 0.5, value_hit_ratio: float = 0.6, harmless_cap: float = 0.08) -> DataFrame:
    """columns -> (qualified_name, table, name, score, is_sensitive, tier, pii_type, confidence, matched_rules)."""
    c = columns.withColumn("norm", normalize_name(F.col("name")))
    c = c.withColumn("hits", name_hits(F.col("norm")))
    c = c.withColumn("samples", F.filter(F.coalesce("sample_values", F.array().cast("array<string>")), lambda v: v.isNotNull()))
    kind = F.create_map(*[F.lit(x) for t, (k, _) in TYPE_RULES.items() for x in (t, k)])
    weight = F.create_map(*[F.lit(x) for t, (_, w) in TYPE_RULES.items() for x in (t, w)])
    c = c.select(
        "*", name_score(F.col("hits")).alias("s_name"), name_type(F.col("hits")).alias("t_name"), value_rule(F.col("samples"), value_hit_ratio).alias("v"),
        kind[F.col("generic_type")].alias("t_type"), F.coalesce(weight[F.col("generic_type")], F.lit(0.0)).alias("s_type"), matched(F.col("norm"), HARMLESS_RULES, "harmless").alias("harmless"),
    )
    c = c.withColumn("s_value", F.coalesce("v.weight", F.lit(0.0)))
    c = c.withColumn("agree", F.coalesce(F.col("t_name") == F.col("v.kind"), F.lit(False)))
    top = F.greatest("s_name", "s_value", "s_type")
    c = c.withColumn("positive", F.when(F.col("agree") & (top < 0.98), F.least(F.lit(1.0), top + 0.05)).otherwise(top))
    strong = F.col("positive") >= strong_threshold
    c = c.withColumn("capped", (F.size("harmless") > 0) & ~strong)
    c = c.withColumn("score1", F.when(F.col("capped"), F.least("positive", F.lit(harmless_cap))).otherwise(F.col("positive")))
    c = c.withColumn("type1", F.when(~(F.col("capped") & (F.col("positive") < 0.05)), F.coalesce("t_name", "v.kind", "t_type")))
    c = c.withColumn("pk", F.col("is_primary_key") & (F.col("score1") < strong_threshold)).withColumn("fk", ~F.col("pk") & F.col("is_foreign_key") & (F.col("score1") < 0.2))
    c = c.withColumn("time", F.col("is_temporal") & ~strong)
    score2 = F.when(F.col("pk"), F.lit(0.0)).when(F.col("fk"), F.greatest("score1", F.lit(0.1))).otherwise(F.col("score1"))
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.col("time"), F.least(score2, F.lit(0.03))).otherwise(score2))), 3)
    kind = F.when(F.col("pk") | F.col("time"), F.lit(None)).when(F.col("fk"), F.coalesce("type1", F.lit("linkage"))).otherwise(F.col("type1"))
    c = c.withColumn("score", score).withColumn("pii_type", kind)
    none = F.array().cast("array<string>")
    one = lambda test, text: F.when(test, F.array(text)).otherwise(none)
    rules = F.concat(
        name_matches(F.col("hits")), one(F.col("v").isNotNull(), F.concat(F.lit("value:"), "v.id")), one(F.col("s_type") > 0, F.concat(F.lit("type:"), "generic_type")),
        F.when(F.col("capped"), F.col("harmless")).otherwise(none), one(F.col("pk"), F.lit("struct:primary_key")), one(F.col("fk"), F.lit("struct:foreign_key")), one(F.col("time"), F.lit("struct:temporal")),
    )
    confidence = (
        F.when(F.col("agree"), 0.95)
        .when((F.col("s_name") >= 0.6) | (F.col("s_value") >= 0.7), 0.85)
        .when((F.col("score") == 0) & ((F.size("harmless") > 0) | (F.col("s_name") == 0)), 0.8)
        .when((F.col("s_name") > 0) | (F.col("s_value") > 0), 0.65)
        .otherwise(0.55)
    )
    return c.select("qualified_name", "table", "name", "score", (F.col("score") >= threshold).alias("is_sensitive"), tier(F.col("score")).alias("tier"), "pii_type", confidence.alias("confidence"), rules.alias("matched_rules"))
