"""Every query against its SQL in DuckDB, on the smallest tables."""

import numbers

import duckdb
import numpy as np
import pandas as pd
import pytest

from quartier.plans import catalog

PATH = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{PATH}/{name}.parquet')")
    return con


def plain(df: pd.DataFrame) -> list:
    def cell(x):
        if pd.isna(x):
            return "null"
        if isinstance(x, numbers.Number) and not isinstance(x, bool | np.bool_):  # columns with nulls are floats on one side
            return f"{float(x):.5f}"
        return pd.Timestamp(x).isoformat() if hasattr(x, "year") else str(x)  # a date is its midnight

    df = df[sorted(df.columns)]
    return sorted([cell(x) for x in row] for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, db, name):
    got, want = catalog.QUERIES[name](spark, PATH).toPandas(), db.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, PATH).count() > 0


def test_spatial_joins_have_no_nested_loops(spark):
    for name in ("j1_within_join", "j3_queen_adjacency", "j4_spatial_lag"):
        plan = catalog.QUERIES[name](spark, PATH)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan
        assert "BroadcastNestedLoopJoin" not in plan


def test_entry_names_are_complete():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_queries_take_whole_texts(spark, monkeypatch):
    from quartier.plans import tables, text_queries
    from quartier.sources import store

    rows = [(1, 1, "user", "and §151.99 with Article 77")]
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    real, written = tables.table, []
    monkeypatch.setattr(tables, "table", lambda s, d, name: made if name == "conversations" else real(s, d, name))
    assert text_queries.f16(spark, PATH).first().refs == "§151.01(a)|Article 1|§151.99|Article 77"
    assert {r.ref for r in text_queries.j17(spark, PATH).collect()} == {"§151.01(a)", "Article 1", "§151.99", "Article 77"}
    write = store.write_oof
    monkeypatch.setattr(store, "write_oof", lambda df, path: (written.append(path), write(df, path)))
    assert catalog.QUERIES["s17_out_of_fold"](spark, PATH).count() == store.read_oof(spark, written[0]).count() > 0
