"""The driver contract: entry() smoke run, and every SQL-checked query equals its DuckDB oracle at sf0.001."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from tools.compare import difference

SF = "/root/testdata/sf0.001"
SLOW = {"clu_01_k_scan", "clu_09_model_comparison", "for_02_forest_forecast", "sup_07_train_target"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
              "embeddings", "pages", "benchmark", "labels", "conversations"]:
        p = os.path.join(SF, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["topic", "posts", "avg_misinformation", "avg_credibility", "avg_toxicity"]


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries()) and all(isinstance(v, str) for v in E.oracle_sql().values())


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    s_rows, s_cols = [tuple(r) for r in df.collect()], df.columns
    res = duck.execute(E.oracle_sql()[name])
    d_cols = [d[0] for d in res.description]
    assert difference(s_rows, s_cols, res.fetchall(), d_cols) is None


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(E.oracle_sql()) - SLOW))
def test_rows_only_queries_run(spark, name):
    df = E.queries()[name](spark, SF)
    assert df.columns and df.count() > 0
