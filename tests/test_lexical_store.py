import random

import pytest
from pyspark.sql import functions as F

from quartier.operators import lexical_store, retrieval
from quartier.plans import text_queries as tq

PATH = "/root/testdata/sf0.001"


def rows(df):
    return sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 6)) for r in df.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    words = [f"w{int(rng.paretovariate(0.6)) % 3000}" for _ in range(60_000)]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 3, 40, 200]))) for _ in range(900)]
    return spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, "", "é W1 w1"])], "chunk_id long, content string")


@pytest.fixture(scope="module")
def questions(spark):
    rng = random.Random(3)
    asks = [" ".join(rng.choices([f"w{i}" for i in range(1, 60)], k=rng.choice([1, 2, 5]))) for _ in range(40)]
    return spark.createDataFrame([(i, t) for i, t in enumerate([*asks, "", None, "nowhere", "w1 W1 É"])], "query_id int, text string")


@pytest.mark.parametrize("match", ["any", "all"])
def test_equal_to_a_full_count_after_extensions(spark, tmp_path, corpus, questions, match):
    path = str(tmp_path / "index")
    assert lexical_store.search(questions, path).count() == 0
    parts = [corpus.where(F.col("chunk_id") % 3 == i) for i in range(3)]
    assert [lexical_store.extend(p, path, per_range=16) for p in parts] == [p.count() for p in parts]
    assert lexical_store.extend(corpus, path) == 0  # all are known
    index = retrieval.lexical_index(corpus)
    for k, first in ((1, 1), (10, 2), (2000, 8)):
        assert rows(lexical_store.search(questions, path, k, match, first=first)) == rows(retrieval.bm25_top_k(questions, index, k, match))
    assert sorted(map(tuple, lexical_store.terms(spark, path).collect())) == sorted(map(tuple, index.terms.collect()))


def test_a_search_stops_early_and_reads_asked_folders(spark, tmp_path):
    rng = random.Random(5)
    texts = [" ".join(rng.choices("abcdefgh", k=60)) + (" rare" * rng.randint(1, 9) if i % 97 == 0 else "") for i in range(2000)]
    corpus = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "chunk_id long, content string")
    path = str(tmp_path / "index")
    lexical_store.extend(corpus, path, per_range=8)
    asks = spark.createDataFrame([(1, "rare a")], "query_id int, text string")
    steps = lexical_store.Search(asks, path, 3, "any", 1.2, 0.75, "query_id", "text", 8)
    assert steps.rest.count() < 0.1 * steps.bounds.count()
    assert rows(steps.result()) == rows(retrieval.bm25_top_k(asks, retrieval.lexical_index(corpus), 3))
    plan = steps.postings._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]


def test_terms_are_counted_within_the_row(spark):
    rows = [(0, ["b", "a", "b"]), (1, []), (2, None), (3, ["x"]), (4, ["z"] * 5 + ["y"])]
    df = spark.createDataFrame(rows, "i int, t array<string>").select("i", lexical_store.counted(F.col("t")).alias("c"))
    got = {r.i: r.c and [tuple(x) for x in r.c] for r in df.collect()}
    assert got == {0: [("a", 1), ("b", 2)], 1: [], 2: None, 3: [("x", 1)], 4: [("y", 1), ("z", 5)]}


def test_a_batch_without_totals_does_not_count(spark, tmp_path, corpus, questions):
    path = str(tmp_path / "index")
    lexical_store.extend(corpus.limit(100), path)
    before = rows(lexical_store.search(questions, path, 5))
    for kind in ("postings", "bounds"):  # a load that broke off
        spark.read.parquet(f"{path}/{kind}/batch=0").write.partitionBy("bucket").parquet(f"{path}/{kind}/batch=1")
    assert rows(lexical_store.search(questions, path, 5)) == before
    assert lexical_store.extend(corpus, path) == corpus.count() - 100
    assert rows(lexical_store.search(questions, path, 5)) == rows(retrieval.bm25_top_k(questions, retrieval.lexical_index(corpus), 5))


def test_retrieve_with_a_stored_index(spark, tmp_path):
    chunks, asked = tq._chunks(spark, PATH), tq._asked_whole(spark, PATH)
    path = str(tmp_path / "index")
    lexical_store.extend(chunks, path)
    got = retrieval.retrieve(asked, chunks, lexical_only=True, lexical=path)
    want = retrieval.retrieve(asked, chunks, lexical_only=True)
    assert rows(got) == rows(want)
