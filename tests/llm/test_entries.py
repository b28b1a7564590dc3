"""The registered queries against SQL, and the pipeline against a brute-force version."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F
from test_operators import awkward, brute_components, brute_fingerprint

import corpus_pipeline
from colaudit.llm import decontaminate, entries, pii, resample


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in ("documents", "conversations", "pages", "labels", "benchmark"):
        p = f"{data}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


@pytest.mark.parametrize("name", sorted(entries.ORACLES))
def test_query_equals_sql(spark, duck, data, name):
    df, rel = entries.QUERIES[name](spark, data), duck.sql(entries.ORACLES[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    want = sorted(tuple(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall())
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == want


def test_all_queries_have_integer_ids(spark, data):
    assert [int(k[2:].split("_")[0]) for k in entries.QUERIES] == list(range(1, 14))
    for name, f in entries.QUERIES.items():
        if name == "op12_source_divergence":  # its rows are groups and terms
            continue
        df = f(spark, data)
        assert df.dtypes[0][1] == "bigint"


def test_pipeline(spark, data):
    out = corpus_pipeline.run(spark, data).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    d, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    left = {r["doc_id"] for r in resample.resample(d, labels).where("kept").collect()}
    fps = {i: brute_fingerprint(docs[i]) for i in left}
    order = sorted(left)
    parts = brute_components([(a, b) for k, a in enumerate(order) for b in order[:k] if (fps[a] ^ fps[b]).bit_count() <= 4])
    left = {i for i in left if parts.get(i, i) == i}
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    left -= {r["doc_id"] for r in decontaminate.leaks(d, bench).collect()}
    p = pii.Pseudonyms(entries.pii_key(spark))
    assert {r["doc_id"]: r["text"] for r in out} == {i: p.apply(docs[i])[0] for i in left}
    assert all(r["n_tokens"] == len(r["ids"]) for r in out) and 0 < len(out) < len(docs)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_awkward_rows(spark, data, name, stage):
    d = awkward(spark)
    for rows in (d, d.limit(0)):
        out = stage(spark, rows, data)
        assert out.count() <= d.count()
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == d.columns
    if name == "SimHash near-dedup":
        kept = stage(spark, d, data)
        assert kept.where(F.col("doc_id").isin(2, 3, 9)).count() == 0 and kept.where("doc_id = 4").count() == 1
