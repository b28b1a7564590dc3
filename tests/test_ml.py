from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from colaudit.operators import evaluation, features, ml, sensitivity


@pytest.fixture(scope="module")
def trained(spark):
    return ml.train(spark, n_synth=360)


def test_held_out_gates(trained):
    side = lambda c: F.col(c).isin("medium", "high")
    e = evaluation.confusion(trained[1].select(side("tier_predicted").alias("p"), side("label").alias("a")), "p", "a").first()
    assert e["precision"] >= 0.95 and e["recall"] >= 0.90


def test_features(spark):
    corpus = ml.synthetic_columns(spark, 40)
    assert len(features.feature_columns()) == 51 and len(features.feature_columns(True)) == 55
    r = features.featurize(corpus).where("qualified_name like '%email%'").first()
    assert r["sig_email"] == 1.0 and r["val_len_max"] >= r["val_len_mean"] > 0 and r["type_string"] == 1.0


def test_prediction_blend_and_store(spark, trained, tmp_path):
    corpus = ml.synthetic_columns(spark, 60, seed=7)
    rules, learned = sensitivity.classify(corpus), ml.predict(trained[0], corpus)
    both = ml.hybrid(rules, learned)
    assert both.count() == 60 and both.where("score < 0 or score > 1").count() == 0
    assert both.where("abs(score - round(0.6 * rule_score + 0.4 * ml_score, 3)) > 1e-9").count() == 0
    j = both.select("qualified_name", F.col("is_sensitive").alias("p")).join(rules.select("qualified_name", F.col("is_sensitive").alias("a")), "qualified_name")
    assert evaluation.confusion(j, "p", "a").first()["recall"] >= 0.95
    ml.save(trained[0], f"file://{tmp_path}/m")
    again = ml.predict(ml.load(f"file://{tmp_path}/m"), corpus)
    assert sorted(map(str, again.collect())) == sorted(map(str, learned.collect()))
    with pytest.raises(ValueError):
        ml.hybrid(rules, learned, mode="x")


def test_comparison_and_usage_variants(spark, trained, tmp_path, monkeypatch):
    corpus = ml.synthetic_columns(spark, 54, seed=9).cache()
    rules, learned = sensitivity.classify(corpus).cache(), ml.predict(trained[0], corpus).cache()
    truth = rules.select("qualified_name", F.col("score").alias("sensitivity_score"), F.col("tier").alias("sensitivity_tier"), "is_sensitive")
    c = {r["method"]: r for r in ml.compare(rules, learned, truth).collect()}
    assert set(c) == {"rules", "model", "hybrid"} and c["rules"]["f1"] == 1.0 and c["rules"]["score_mae"] == 0.0 and c["model"]["n"] == 54
    wrong = learned.join(truth.select("qualified_name", F.col("is_sensitive").alias("a")), "qualified_name").where("is_sensitive <> a")
    found = ml.disagreements(rules, learned, truth)
    assert sorted(r[0] for r in found.select("qualified_name").collect()) == sorted(r[0] for r in wrong.select("qualified_name").collect())
    path = f"file://{tmp_path}/kept"
    monkeypatch.setattr(ml, "train", lambda spark, *a, include_usage=False, **k: trained)
    v = {r["include_usage"]: r for r in ml.compare_usage_variants(spark).collect()}
    assert set(v) == {False, True} and v[True]["n"] > 50 and v[True]["recall"] >= 0.9
    assert [len(ml.load_or_train(spark, path).stages) for _ in range(2)] == [len(trained[0].stages)] * 2
    for df in (corpus, rules, learned):
        df.unpersist()


def test_training_with_usage(spark):
    r = ml.held_out(ml.train(spark, n_synth=135, include_usage=True)[1]).first()
    assert r["n"] > 25 and r["recall"] >= 0.8


def test_gates_of_a_model_taught_on_a_table(spark):
    from colaudit import registry

    rows = registry.queries()["ml_trained"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 8 and all(r["reached"] for r in rows)


def test_split_is_stratified_whatever_the_ties(spark):
    rows = spark.createDataFrame([(f"c{i % 90}", "a" if i % 9 else "b") for i in range(180)], "k string, label string")
    got = {(r["label"], r["is_test"]): r["count"] for r in ml.stratified_split(rows, "label", "k").groupBy("label", "is_test").count().collect()}
    assert got == {("a", True): 40, ("a", False): 120, ("b", True): 5, ("b", False): 15}
    assert ml.stratified_split(rows.limit(0), "label", "k").count() == 0


def test_equal_columns_are_one_weighted_row_of_the_fit(spark, monkeypatch):
    """The regression reads each different column once and comes out as if taught on every column."""
    once = ml.synthetic_columns(spark, 54, seed=5)
    columns = once.select(F.explode(F.sequence(F.lit(1), F.lit(12))).alias("i"), "*").withColumn("qualified_name", F.concat("qualified_name", F.lit("_"), F.col("i").cast("string"))).drop("i").localCheckpoint()
    read, fit = [], ml.Pipeline.fit
    monkeypatch.setattr(ml.Pipeline, "fit", lambda self, rows, *a: read.append(rows.count()) or fit(self, rows, *a))
    model, held_out = ml.learn(columns)
    held_out = held_out.localCheckpoint()
    assert 0 < read[0] <= 54 and held_out.count() == held_out.select("qualified_name").distinct().count() > 150
    rows = features.featurize(columns).join(sensitivity.classify(columns).select("qualified_name", F.col("tier").alias("label")), "qualified_name")
    assert held_out.select("qualified_name", "label").exceptAll(rows.select("qualified_name", "label")).count() == 0
    rows = rows.join(held_out.select("qualified_name"), "qualified_name", "left_anti").localCheckpoint()
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n = sum(sizes.values())
    weights = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, n / (len(sizes) * v))])
    rows = rows.withColumn("weight", weights[F.col("label")])
    for s in model.stages[:4]:
        rows = s.transform(rows)
    plain = ml.LogisticRegression(family="multinomial", regParam=1.0 / n, maxIter=500, labelCol="target", weightCol="weight").fit(rows)
    assert model.stages[4].summary.objectiveHistory[-1] == pytest.approx(plain.summary.objectiveHistory[-1], rel=2e-3)
    p = lambda df: {r[0]: r[1] for r in df.select("qualified_name", "probability").collect()}
    one, other = p(held_out), p(plain.transform(held_out.drop("rawPrediction", "probability", "prediction")))
    assert max(abs(a - b) for k in one for a, b in zip(one[k], other[k])) < 0.02


def test_kinds_stand_for_all_their_columns(spark):
    once = ml.synthetic_columns(spark, 30, seed=3)
    nulls = once.limit(2).withColumns({"sample_values": F.lit(None).cast("array<string>"), "comment": F.lit(""), "name": F.lit("Ünïcode \"x\"")})
    both = once.unionAll(nulls)
    columns = both.unionAll(both).withColumn("qualified_name", F.concat("qualified_name", F.lit("_"), F.monotonically_increasing_id().cast("string"))).localCheckpoint()
    keyed, kinds = features.kinds_of(columns)
    assert columns.count() == keyed.count() == 64 and kinds.count() == 32
    for work in (features.featurize, sensitivity.classify):
        named = keyed.join(work(kinds).withColumnRenamed("qualified_name", "kind"), "kind").drop("kind")
        assert sorted(map(str, named.collect())) == sorted(map(str, work(columns).collect()))
