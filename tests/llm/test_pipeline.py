import corpus_pipeline
from quartier.llm import bpe, decontaminate, io

from . import test_near_dup, test_suffix_dedup
from .test_decontaminate import distance


def test_pipeline_equals_plain_version(spark):
    from tokenizers import Tokenizer

    path = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    rows = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
    kept = {c for _, _, c in test_near_dup.brute(rows, 5, 80)}
    rows = [(i, t) for i, t in rows if i in kept]
    cut = []
    raw = [(t or "").encode() for _, t in rows]
    seen = test_suffix_dedup.Counter(r[i : i + 200] for r in raw for i in range(len(r) - 199))
    for (doc, _), r in zip(rows, raw, strict=True):
        gone = bytearray(len(r))
        for i in range(len(r) - 199):
            if seen[r[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        cut.append((doc, bytes(b for b, g in zip(r, gone, strict=True) if not g).decode("utf-8", "ignore")))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    units = [u for i, t in items for _, u in decontaminate.units_of(i, t)]
    # a text within the budget shares a tenth of the unit word for word, which spares most comparisons
    holds = lambda p: any(
        any(u[k : k + 9].tobytes() in p.tobytes() for k in range(0, len(u) - 9)) and distance(u, p) <= int(decontaminate.RATE * len(u)) for u in units if u[:9].size
    )
    suspects = {d for d, *_ in decontaminate.Finder(items).find([t for _, t in cut])}
    for k, (_, text) in enumerate(cut):
        if len(text) < 1200 and k % 5 == 0:
            assert holds(decontaminate.reduced(text)) == (k in suspects)
    t = Tokenizer.from_file(bpe.default_path())
    want = {doc: t.encode(text, add_special_tokens=False).ids for k, (doc, text) in enumerate(cut) if k not in suspects}
    out = corpus_pipeline.run(spark, path)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "n_tokens"]
    got = {r.doc_id: r.ids for r in out.collect()}
    assert got == want and suspects


def test_stages_take_an_empty_table(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
    assert docs.count() == 0


def test_stages_take_odd_rows(spark):
    """Null and large ids, repeated rows, null, empty and long texts, and columns named like the stages' own."""
    path, big = "/root/testdata/sf0.001", 2**60 + 1
    base = [r.text for r in spark.read.parquet(f"{path}/documents.parquet").orderBy("doc_id").limit(12).collect()]
    copy = "a text that two rows without an id and one row with an id have in common, word for word, and nothing else has " * 2
    rows = [(i, t, "en", None) for i, t in enumerate(base)] + [(None, copy, None, 1), (None, copy, None, 1), (big, copy, "en", 2), (big, copy, "en", 2), (None, "the only one of its kind", None, 3)]
    rows += [(77, None, None, None), (78, "", "en", 0), (79, "1 2 3", "en", 0), (80, "lange " + "wörter sind selten " * 9000, "de", 0)]
    docs = spark.createDataFrame([(*r, "own", 5) for r in rows], "doc_id long, text string, lang string, n_chars long, node string, batch int").coalesce(2)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = io.written(stage(spark, docs, path), "odd")
        assert docs.columns == ["doc_id", "text", "lang", "n_chars", "node", "batch"]
        assert {(r.node, r.batch) for r in docs.collect()} == {("own", 5)}
    got = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    ids = [r.doc_id for r in got]
    assert ids.count(big) == 1 and ids.count(None) == 1 and not {77, 78, 79} & set(ids) and 80 in ids
    assert [r.text for r in got if r.doc_id is None] == ["the only one of its kind"] and all(len(r.ids) == r.n_tokens for r in got)


def test_columns_named_like_the_stages_own_keep_their_values(spark):
    path = "/root/testdata/sf0.001"
    names = {"lang_pred": "a", "score": 2.5, "_p": "b", "_key": 3, "_batch": "c", "batch": 4, "key": "d", "ranges": 5}
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(40)
    from pyspark.sql import functions as F

    docs = docs.select("*", *[F.lit(v).alias(k) for k, v in names.items()]).coalesce(2)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = io.written(stage(spark, docs, path), "clash")
        rows = docs.collect()
        assert rows and all(r[k] == v for r in rows for k, v in names.items())
