"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from colaudit import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{data}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def test_all_have_sql():
    assert set(registry.oracle_sql()) == set(registry.queries())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, duck, data, name):
    df = registry.queries()[name](spark, data)
    rel = duck.sql(registry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    key = lambda r: tuple((v is None, str(v)) for v in r)
    want = sorted((tuple(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall()), key=key)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["score_all_report", "score_verdict_rank", "score_full_outer", "ml_hybrid_blend"])
def test_scores_on_the_edge_of_a_place(spark, tmp_path, data, name):
    """Balances whose ten-thousandth ends in 5 are ranked by the rounding of SQL on doubles."""
    balances = [6113.50, 6113.45, 6456.50, 6093.50, 2885.50, 5135.50, 246.50, 5125.50, 1.50, -12.5, 0.5, 4999.5]
    c = duckdb.connect()
    for t in ("events", "orders"):
        c.execute(f"copy (select * from '{data}/{t}.parquet') to '{tmp_path}/{t}.parquet' (format parquet)")
    given = ", ".join(str(b) for b in balances)
    c.execute(f"copy (select * replace (([{given}]::DOUBLE[])[1 + c_custkey % {len(balances)}] as c_acctbal) from '{data}/customer.parquet') to '{tmp_path}/customer.parquet' (format parquet)")
    for t in ("events", "orders", "customer"):
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    df = registry.queries()[name](spark, str(tmp_path))
    rel = c.sql(registry.oracle_sql()[name])
    got = {tuple(r[k] for k in rel.columns) for r in df.collect()}
    assert got == set(rel.fetchall())


@pytest.mark.parametrize("name", ["score_all_report", "score_verdict_rank", "score_topk"])
def test_rows_without_a_key_are_ranked_last(spark, tmp_path, data, name):
    """Among equal scores SQL puts a null key after the others."""
    c = duckdb.connect()
    given = {
        "customer": "select * replace (nullif(c_custkey, (select min(c_custkey) from t where c_acctbal >= 5000)) as c_custkey) from t",
        "orders": "select * from t limit 0", "events": "select * replace (case when event_id % 9 <> 1 then user_id end as user_id) from t",
    }
    for t, sql in given.items():
        c.execute(f"copy (with t as (select * from '{data}/{t}.parquet') {sql}) to '{tmp_path}/{t}.parquet' (format parquet)")
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    rel = c.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, str(tmp_path)).collect()
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted((tuple(r[k] for k in rel.columns) for r in got), key=key) == sorted(rel.fetchall(), key=key)


@pytest.mark.parametrize("name", ["score_all_report", "score_verdict_rank", "retention_age_score", "history_trend"])
def test_orders_without_a_date(spark, tmp_path, data, name):
    """Customers whose orders all lack their date have the staleness that SQL gives them."""
    c = duckdb.connect()
    given = {"customer": "select * from t", "events": "select * from t", "orders": "select * replace (case when o_custkey % 3 <> 1 and o_orderkey % 5 <> 1 then o_orderdate end as o_orderdate) from t"}
    for t, sql in given.items():
        c.execute(f"copy (with t as (select * from '{data}/{t}.parquet') {sql}) to '{tmp_path}/{t}.parquet' (format parquet)")
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    rel = c.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, str(tmp_path)).collect()
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted((tuple(r[k] for k in rel.columns) for r in got), key=key) == sorted(rel.fetchall(), key=key)
