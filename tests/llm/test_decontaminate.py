import random

import numpy as np

from quartier.llm import decontaminate as d


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def distance(unit, text):
    """Least edits between the unit and any substring, by plain dynamic programming."""
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(unit):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (t != c), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def edited(rng, text, n):
    s = list(text)
    for _ in range(n):
        i = rng.randrange(len(s))
        kind = rng.randrange(3)
        s[i : i + (kind != 0)] = [rng.choice("klmnop")] if kind < 2 else []
    return "".join(s)


def test_against_brute_force():
    rng = random.Random(3)
    items = [(i, words(rng, n)) for i, n in enumerate([6, 12, 20, 20, 60])]
    texts = []
    for n in (0, 1, 3, 5, 7, 9, 12, 30):
        for _, text in items:
            texts.append(words(rng, 30) + " " + edited(rng, text, n) + " " + words(rng, 30))
    texts += [words(rng, 100), "", items[1][1].upper().replace(" ", ",\n"), items[4][1][100:320], items[2][1] * 3]
    got = {(a, b): (e, n) for a, b, e, n in d.Finder(items).find(texts)}
    want = {}
    for a, text in enumerate(texts):
        points = d.reduced(text)
        for b, item in items:
            found = [distance(u, points) for _, u in d.units_of(b, item)]
            found = [e for e, (_, u) in zip(found, d.units_of(b, item), strict=True) if e <= int(d.RATE * len(u))]
            if found:
                want[a, b] = (min(found), len(found))
    assert got == want and len(want) > 15


def test_frames(spark):
    item = "the quick brown fox jumps over the lazy dog and runs into the deep dark forest"
    rows = [(1, f"start. {item.title()}! end", "x"), (2, None, "x"), (3, "", "x"), (4, "nothing of the kind " * 50, "x"), (1, item, "y"), (5, "pad " * 20000 + item, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(9, item), (8, None), (7, "of the"), (6, "?!"), (6, "othing of")], "item_id long, text string")
    got = sorted(tuple(r) for r in d.contaminated(docs, bench).collect())
    assert got == [(1, 9, 0, 1), (1, 9, 0, 1), (4, 7, 0, 1), (5, 9, 0, 1)]
    assert sorted(r.doc_id for r in d.clean(docs, bench, short=True).collect()) == [2, 3]
    kept = d.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    assert d.contaminated(docs, bench.limit(0)).count() == 0 and d.clean(docs, bench.limit(0)).count() == 6
    assert d.contaminated(docs.limit(0), bench).count() == 0


def test_null_ids_repeated_items_and_blocks(spark, monkeypatch):
    item = "the quick brown fox jumps over the lazy dog and runs into the deep dark forest"
    docs = spark.createDataFrame([(None, item), (2**60 + 1, item), (3, "nothing")], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(None, item), (2**60 + 3, item), (4, "nothing")], "item_id long, text string")
    want = {(doc, i, 0, 1) for doc in (None, 2**60 + 1) for i in (None, 2**60 + 3)} | {(3, 4, 0, 1)}
    for size in (4_000_000, 30):
        monkeypatch.setattr(d, "BLOCK_CHARS", size)
        assert {tuple(r) for r in d.contaminated(docs, bench).collect()} == want
        assert [r.doc_id for r in d.clean(docs, bench).collect()] == [3]


def test_planted_passages(spark):
    path = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "benchmark"))
    items = bench.collect()
    want = {r.doc_id for r in docs.collect() if any(i.text in r.text for i in items)}
    got = {r.doc_id for r in d.op6_decontamination(spark, path).collect()}
    assert want and want <= got and len(got) <= len(want) + 10, (len(want), len(got))


def test_excerpts_are_caught_wherever_they_begin():
    rng = random.Random(8)
    items = [(i, words(rng, n)) for i, n in enumerate([15, 40, 47, 90])]
    finder = d.Finder(items)
    least = d.EXCERPT + d.STRIDE - 1
    assert least == 67
    pieces = []
    for i, text in items:
        points = "".join(map(chr, d.reduced(text)[:-1]))
        for length in (least, 90, 120, 130, 160):
            last = len(points) - length
            pieces += [(i, points[at : at + length]) for at in {0, last, *(rng.randrange(last + 1) for _ in range(12))} if last >= 0] if last >= 0 else []
    found = {(doc, item): edits for doc, item, edits, _ in finder.find(["mnop " * 9 + piece + " mnop" * 9 for _, piece in pieces])}
    assert len(pieces) > 150 and found == {(doc, i): 0 for doc, (i, _) in enumerate(pieces)}
