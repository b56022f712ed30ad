import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quartier.operators import retrieval
from quartier.plans import catalog


def tokens(text):
    return "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()


def plain(queries, chunks, k, match="any"):
    """BM25 as the SQL of r9 counts it: a row for each chunk, length and term."""
    n = len(chunks)
    mean = sum(len(tokens(x)) for _, x in chunks) / max(1, sum(x is not None for _, x in chunks))
    tf = Counter((c, len(tokens(x)), t) for c, x in chunks for t in tokens(x))
    df = Counter(t for _, _, t in tf)
    out = []
    for q, asked in queries:
        need, scores, held = set(tokens(asked)), Counter(), Counter()
        for (c, length, t), f in tf.items():
            if t in need:
                scores[c] += math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / mean))
                held[c] += 1
        best = sorted((-round(s, 9), c) for c, s in scores.items() if match == "any" or held[c] == len(need))[:k]
        out += [(q, i + 1, c, round(-s, 6)) for i, (s, c) in enumerate(best)]
    return sorted(out)


def rows(df):
    return sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 6)) for r in df.collect())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    words = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(5000)]
    made = [" ".join(rng.choices(words, k=rng.choice([0, 2, 20, 90]))) for _ in range(250)]
    return [*made, *made[:40], *[made[9]] * 30, None, "", "W1 é É"]  # copies tie


ASKED = [(i, " ".join(random.Random(i).choices([f"w{j}" for j in range(1, 50)], k=i % 6 + 1))) for i in range(25)] + [(97, ""), (98, None), (99, "nowhere w1 É")]


@pytest.mark.parametrize("match", ["any", "all"])
def test_scan_equals_brute_force_over_blocks_runs_and_copies(spark, texts, match, monkeypatch):
    monkeypatch.setattr(retrieval, "CELLS", 1 << 9)  # some chunks at a time; tasks take the value with them
    chunks = [(f"c{i:03}", x) for i, x in enumerate(texts)]
    index = retrieval.lexical_index(spark.createDataFrame(chunks, "chunk_id string, content string").repartition(3))
    asked = spark.createDataFrame(ASKED, "query_id long, text string")
    for k in (1, 7):
        assert rows(retrieval.bm25_top_k(asked, index, k, match, block=6)) == plain(ASKED, chunks, k, match)


@pytest.mark.parametrize("match", ["any", "all"])
def test_rows_that_repeat_an_id_are_scored_together(spark, texts, match):
    chunks = [(i % 200, x) for i, x in enumerate(texts)]
    index = retrieval.lexical_index(spark.createDataFrame(chunks, "chunk_id long, content string"))
    got = retrieval.bm25_top_k(spark.createDataFrame(ASKED, "query_id long, text string"), index, 5, match)
    assert rows(got) == plain(ASKED, chunks, 5, match)


def test_an_empty_corpus_has_no_hits(spark):
    none = spark.createDataFrame([], "chunk_id long, content string")
    assert retrieval.bm25_top_k(spark.createDataFrame(ASKED, "query_id long, text string"), retrieval.lexical_index(none)).count() == 0


def shuffled(spark):
    """Bytes of the shuffle files that are there."""
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    tops = [d.getPath() for d in env.blockManager().diskBlockManager().localDirs()]
    return {f"{d}/{x}": os.path.getsize(f"{d}/{x}") for top in tops for d, _, names in os.walk(top) for x in names if x.startswith("shuffle_")}


def test_neither_pairs_nor_texts_of_others_are_shuffled(spark):
    rng = random.Random(4)
    texts = [" ".join(["the", "of", *(f"{rng.getrandbits(40):x}" for _ in range(150))]) for _ in range(3000)]
    chunks = spark.createDataFrame([(i, x, "From: " + x, i // 2 if i % 2 else None) for i, x in enumerate(texts)], "chunk_id long, content string, content_with_prefix string, parent_chunk_id long")
    asked = spark.createDataFrame([(i, "the of " + texts[37 * i][7:60]) for i in range(60)], "query_id long, text string")
    before = shuffled(spark)
    hits = retrieval.retrieve(asked, chunks, lexical_only=True, top_k=1).collect()
    new = sum(size for name, size in shuffled(spark).items() if name not in before)
    assert {(r.query_id, r.chunk_id) for r in hits} == {(i, 37 * i) for i in range(60)}
    assert new < 0.25 * sum(map(len, texts))  # pairs alone were more than their half, and the texts were shuffled twice


@pytest.mark.parametrize("name", ["r13_retrieve", "r11_rerank_whole", "r13_retrieve_lexical", "r11_rerank_batch"])
def test_queries_shuffle_a_small_part_of_the_texts(spark, name):
    path = "/root/testdata/sf0.01"
    before = shuffled(spark)
    catalog.QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
    new = sum(size for file, size in shuffled(spark).items() if file not in before)
    assert new < 0.1 * spark.read.parquet(f"{path}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]


@pytest.mark.parametrize("most", [200_000, 1])
def test_hits_get_their_chunks(spark, most, monkeypatch):
    monkeypatch.setattr(retrieval, "LOOKED_UP", most)
    chunks = spark.createDataFrame([(i, f"text {i}") for i in range(50)] + [(None, "none")], "chunk_id long, content string")
    hits = spark.createDataFrame([(1, 1, 7), (1, 2, 9), (2, 1, 7), (2, 2, 99), (3, 1, None)], "query_id int, rank int, chunk_id long")
    got = retrieval.with_chunks(hits, chunks).select("query_id", "rank", "chunk_id", F.col("content")).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 7, "text 7"), (1, 2, 9, "text 9"), (2, 1, 7, "text 7")]
