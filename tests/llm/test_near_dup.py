import random

import numpy as np

from quartier.llm import graph, near_dup


def brute(rows, n, percent):
    """component_id of each row by comparing all pairs of word shingle sets."""
    import re

    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        k = min(n, len(words))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set())
    find = graph.UnionFind(len(rows))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                find.join(i, j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find.find(i)] = min(doc, least.get(find.find(i), doc))
    return [(doc, len(sets[i]), least[find.find(i)]) for i, (doc, _) in enumerate(rows)]


def corpus(rng, families=12, copies=12):
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    texts = [None, "", " \n", "one", "One", "one two", "ONE two", "one two three"]
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 8, 30, 80, 300]))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 15))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(rng.choice([" ", "\n", "  "]).join(words))
    texts += texts[10:14]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_components_equal_brute_force(spark):
    for seed, n, percent in ((1, 3, 85), (2, 5, 80)):
        rows = corpus(random.Random(seed))
        docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string")
        got = near_dup.near_duplicates(docs, n, percent).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, n, percent))
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
        assert {r.doc_id for r in near_dup.stage(spark, docs, "").collect()} >= {r.doc_id for r in got if r.kept} if n == 5 else True


def test_representatives_lose_nothing(spark, monkeypatch):
    """Lists and families beyond these bounds go through rounds of representatives."""
    for seed, block, group_bytes, tiles in ((5, 4, 1 << 24, 64), (6, 2, 1 << 24, 0), (7, 256, 4096, 64), (8, 256, 4096, 1)):
        monkeypatch.setattr(near_dup, "MOST_TILES", tiles)
        monkeypatch.setattr(near_dup, "BLOCK", block)
        monkeypatch.setattr(near_dup, "GROUP_BYTES", group_bytes)
        rows = corpus(random.Random(seed), 3, 30)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = near_dup.near_duplicates(docs, 3, 85).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, 3, 85))


def test_null_ids_link_others(spark):
    """The middle one of three texts has no id, and the outer two are linked through it alone."""
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(words[i : i + 90]) for i in (0, 4, 8)]
    for big in (2, 2**60 + 1):  # ids are not rounded
        docs = spark.createDataFrame([(big, texts[0]), (None, texts[1]), (big + 2, texts[2])], "doc_id long, text string")
        got = sorted(near_dup.near_duplicates(docs, 3, 85).collect(), key=lambda r: r.doc_id or 0)
        assert [(r.doc_id, r.component_id, r.kept) for r in got] == [(None, big, False), (big, big, True), (big + 2, big, False)]
        assert [r.doc_id for r in near_dup.stage(spark, docs, "").collect()] == [big]


def test_stage_keeps_one_row_of_each_group(spark):
    text = "one two three four five six seven"
    rows = [(None, text), (None, text), (3, "a b c d e f"), (3, "a b c d e f"), (None, None), (None, None), (4, "z"), (5, "y y y y y y"), (6, "y y y y y y")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, node int")
    got = near_dup.stage(spark, docs, "").collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted([("None", text), ("3", "a b c d e f"), ("None", "None"), ("None", "None"), ("4", "z"), ("5", "y y y y y y")])
    assert got[0].__fields__ == docs.columns


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in graph.components(df).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 140)}}
    assert graph.components(df.limit(0)).count() == 0


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (4, "x y z w"), (2, "x y z w"), (9, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 4, False), (4, 4, True), (4, 4, True), (4, 2, False), (2, 2, True), (9, 9, True)], key=str)
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_intersections():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 50, n)).astype(np.uint64) for n in (1, 5, 30, 60)]
    assert near_dup.intersections(sets).tolist() == [[len(set(a) & set(b)) for b in sets] for a in sets]
    assert near_dup.intersections(sets[:1], sets[1:]).tolist() == [[len(set(a) & set(b)) for b in sets[1:]] for a in sets[:1]]


def test_small_documents_table(spark):
    path = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    got = near_dup.op1_near_dedup(spark, path).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, 3, 85))
