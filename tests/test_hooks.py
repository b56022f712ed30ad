"""Batch scorers from the registry."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartier.operators import hooks, retrieval


def lengths(arrays, queries, texts):
    assert len(queries) <= 3  # the batch that was asked for
    out = [np.nan if x is None else arrays["w"][0] * len(x) - (0 if q is None else len(q)) for q, x in zip(queries, texts, strict=True)]
    return np.array(out)


@pytest.fixture
def rows(spark):
    hits = [(1, 1, "a", "xx", "four"), (1, 2, "b", "xx", "sixsix"), (1, 3, "c", "xx", None), (1, 4, "d", "xx", ""), (2, 1, "a", None, "four"), (2, 2, "e", None, "four")]
    return spark.createDataFrame(hits, "query_id long, rank int, chunk_id string, text string, content string")


def ranked(df):
    return [(r.query_id, r.rank, r.chunk_id) for r in df.orderBy("query_id", "rank").collect()]


def test_scorer_ranks_like_its_column_form(spark, tmp_path, rows):
    hooks.save_arrays(spark, {"w": np.array([2.0])}, str(tmp_path), "len", "v9")
    got = ranked(retrieval.rerank(rows, hooks.batch_scorer(str(tmp_path), "len", lengths, batch=3)))
    column = lambda q, x: F.coalesce(2.0 * F.length(x) - F.coalesce(F.length(q), F.lit(0)), F.lit(float("-inf")))
    assert got == ranked(retrieval.rerank(rows, column))
    assert got == [(1, 1, "b"), (1, 2, "a"), (1, 3, "d"), (1, 4, "c"), (2, 1, "a"), (2, 2, "e")]
    assert retrieval.rerank(rows.limit(0), hooks.batch_scorer(str(tmp_path), "len", lengths, batch=3)).isEmpty()


def test_the_version_saved_last_unless_one_is_named(spark, tmp_path, rows):
    at = str(tmp_path)
    for version, w in (("v9", 1.0), ("v10", -1.0)):
        hooks.save_arrays(spark, {"w": np.array([w])}, at, "len", version)
    first = lambda version: ranked(retrieval.rerank(rows, hooks.batch_scorer(at, "len", lengths, version, batch=3)))[0][2]
    assert (first(None), first("v9")) == ("d", "b")
    with pytest.raises(KeyError):
        hooks.batch_scorer(at, "len", lengths, "v11")
    with pytest.raises(KeyError):
        hooks.batch_scorer(at, "other", lengths)
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        hooks.save_arrays(spark, {"w": np.array([0.0])}, at, "len", "v10")


def test_arrays_come_back_and_workers_need_no_session(spark, tmp_path):
    arrays = {"w": np.arange(6.0).reshape(2, 3), "names": np.array(["a", "bb"]), "none": np.zeros((0, 4), np.int32)}
    hooks.save_arrays(spark, arrays, f"file://{tmp_path}", "m", "v1", {"note": "x"})
    got = hooks.load_arrays(f"file://{tmp_path}/arrays/m/v1")
    assert set(got) == set(arrays) and all(np.array_equal(got[k], v) and got[k].dtype == v.dtype for k, v in arrays.items())
    assert glob.glob(f"{tmp_path}/arrays/m/v1/_SUCCESS")


def test_a_wrong_shape_stops_the_job(spark, tmp_path, rows):
    hooks.save_arrays(spark, {"w": np.array([2.0])}, str(tmp_path), "len", "v1")
    with pytest.raises(Exception, match="one number a row"):
        retrieval.rerank(rows, hooks.batch_scorer(str(tmp_path), "len", lambda a, q, x: np.zeros((len(q), 2)))).collect()
