import numpy as np
import pytest
from pyspark.sql import functions as F

from quartier.operators import retrieval, vector_index

PATH = "/root/testdata/sf0.1"


def frame(spark, rows, key="chunk_id"):
    return spark.createDataFrame(rows, f"{key} long, embedding array<float>")


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 24))
    return [(i, (centres[i % 20] + rng.normal(scale=0.4, size=24)).tolist()) for i in range(1500)]


def test_all_cells_give_the_exact_answer(spark, tmp_path, clustered):
    odd = [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] * 24), (5003, [1.0] * 3), (5004, clustered[0][1])]
    df = frame(spark, clustered + odd)
    index = vector_index.build(df.where("chunk_id % 3 <> 0"), str(tmp_path / "i"), 12, most=50)
    vector_index.extend(df.where("chunk_id % 3 = 0"), vector_index.load(spark, str(tmp_path / "i")), most=50)
    queries = df.where("chunk_id % 50 = 0 OR chunk_id > 4999").withColumnRenamed("chunk_id", "query_id")
    want = retrieval.dense_top_k(queries.where("query_id NOT IN (5000, 5001, 5002, 5003)"), df.where("chunk_id NOT IN (5000, 5001, 5002, 5003)"), 10)
    for block in (1024, 7):
        got = vector_index.search(queries, index, 10, 12, block)
        key = lambda r: (r.query_id, r.rank)
        a, b = sorted(got.collect(), key=key), sorted(want.collect(), key=key)
        assert [(r.query_id, r.rank, r.chunk_id, round(r.score, 7)) for r in a] == [(r.query_id, r.rank, r.chunk_id, round(r.score, 7)) for r in b]


def test_few_probes_find_most_and_read_few_cells(spark, tmp_path, clustered):
    df = frame(spark, clustered)
    index = vector_index.build(df, str(tmp_path / "i"), 40)
    queries = df.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    got = vector_index.search(queries, index, 10, 8)
    assert vector_index.recall(got, retrieval.dense_top_k(queries, df, 10)) >= 0.9
    one = vector_index.search(queries.limit(1), index, 10, 2)
    assert one.count() == 10
    files = {f.split("/cell=")[1].split("/")[0] for f in spark.read.parquet(f"{index.path}/vectors").where(F.col("cell").isin(0, 1)).inputFiles()}
    assert len(files) >= 2


def test_recall_over_the_whole_table(spark, tmp_path):
    """Vectors of the given table hardly form clusters, so most of the cells is what 0.9 takes."""
    df = spark.read.parquet(f"{PATH}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    index = vector_index.build(df, str(tmp_path / "i"))
    queries = df.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    exact = retrieval.dense_top_k(queries, df, 10)
    probes = vector_index.probes_for(queries, index)
    found = vector_index.recall(vector_index.search(queries, index, 10, probes), exact)
    print(index.cells, probes, found)
    assert probes < index.cells and found >= 0.9
    assert vector_index.recall(vector_index.search(queries, index, 10, index.cells), exact) > 0.999


def test_a_batch_without_its_list_does_not_count(spark, tmp_path, clustered):
    df = frame(spark, clustered[:200])
    index = vector_index.build(df, str(tmp_path / "i"), 4)
    df.limit(0).write.mode("ignore").parquet(f"{index.path}/vectors/batch=9/cell=0/part=0")
    frame(spark, [(1, clustered[0][1])]).select(F.col("chunk_id").alias("id"), F.col("embedding").alias("raw")).write.mode("overwrite").parquet(f"{index.path}/vectors/batch=9/cell=0/part=0")
    got = vector_index.search(df.limit(3).withColumnRenamed("chunk_id", "query_id"), index, 5, 4)
    assert got.count() == 15
    with pytest.raises(ValueError):
        vector_index.build(df.limit(0), str(tmp_path / "none"))
