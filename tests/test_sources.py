"""Spans, the model registry, and words between all kinds of spaces."""

import datetime as dt
import json

from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from quartier.functions import text
from quartier.operators import corpus, joins
from quartier.sources import store


def test_spans_keep_every_microsecond(spark, tmp_path):
    starts = [1_732_803_123_456_789_012, 1_732_803_123_456_789_999, 1_732_803_123_000_001_000, 0, -1, -1_000_001]
    lines = [json.dumps({"span_id": str(i), "start_time_ns": s, "end_time_ns": s + 1_500_000}) for i, s in enumerate(starts)]
    (tmp_path / "spans.jsonl").write_text("\n".join([*lines, "no span", "{}"]))
    rows = store.read_spans(spark, str(tmp_path / "spans.jsonl")).select("span_id", F.unix_micros("ts").alias("us"), "duration_ms").collect()
    assert {int(r.span_id): r.us for r in rows} == {i: s // 1000 for i, s in enumerate(starts)}
    assert {r.duration_ms for r in rows} == {1.5}


def test_registry_loads_what_was_saved_last(spark, tmp_path):
    rows = spark.createDataFrame([("a",), ("b",)], "x string")
    model = Pipeline(stages=[StringIndexer(inputCol="x", outputCol="i")]).fit(rows)
    for version in ("v9", "v10", "2026-06-05", "alpha"):
        store.registry_save(model, str(tmp_path), "m", version, {"version": version})
        store.registry_save(model, str(tmp_path), "other", version)
        numbers = {r.version: r.number for r in store.registry_list(spark, str(tmp_path)).where("name = 'm'").collect()}
        assert max(numbers, key=numbers.get) == version
        assert store.registry_load(spark, str(tmp_path), "m").uid == model.uid
    assert sorted(numbers.values()) == [1, 2, 3, 4]


def test_words_stand_between_all_spaces(spark):
    texts = ["a b　c d", "  ", "", " one\ttwo three ", "x\x1cy\x85z", "no-break space", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.n for r in df.select("i", text.word_count(F.col("t")).alias("n")).collect()}
    assert got == {i: None if t is None else len(t.split()) for i, t in enumerate(texts)}
    docs = spark.createDataFrame([("d", "w " * 1000)], "doc_id string, text string")
    pieces = [r.content for r in corpus.chunk_sections(corpus.split_sections(docs)).collect()]
    assert len(pieces) == 3 and max(len(p.split()) for p in pieces) == 450
    hits = spark.createDataFrame([(1, 1, "c", "p", "a", "a")], "query_id int, rank int, chunk_id string, parent_chunk_id string, content string, content_with_prefix string")
    parents = spark.createDataFrame([("p", "　".join("uvw"))], "chunk_id string, content_with_prefix string")
    assert [joins.expand_parents(hits, parents, n).first().expanded for n in (3, 4)] == [False, True]


def test_dates_of_spans(spark, tmp_path):
    at = dt.datetime(2024, 11, 28, 12, 0, 0, 123457, tzinfo=dt.UTC)
    ns = int(at.timestamp()) * 10**9 + 123_457_999
    (tmp_path / "s.jsonl").write_text(json.dumps({"span_id": "1", "start_time_ns": ns, "end_time_ns": ns}))
    assert store.read_spans(spark, str(tmp_path)).first().ts == at.replace(tzinfo=None)
