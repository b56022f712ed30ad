"""Queries of texts, retrieval, evaluation and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import text
from ..operators import corpus, evaluation, hooks, joins, lexical_store, retrieval, vector_index
from . import tables as t

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


@query("f13_token_count", r"SELECT doc_id, CAST(floor(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) * 1.3) AS INTEGER) AS n FROM documents")
def f13(spark, d):
    return t.table(spark, d, "documents").select("doc_id", text.token_count(F.col("text")).alias("n"))


@query("f14_contextual_prefix", "SELECT item_id, 'From bench set ' || item_id || ': ' || text AS content FROM benchmark")
def f14(spark, d):
    b = t.table(spark, d, "benchmark")
    return b.select("item_id", text.contextual_prefix(F.lit("bench"), F.lit("set"), F.col("item_id").cast("string"), F.col("text")).alias("content"))


#: Each line of a conversation with references, as the corpus' texts have none.
CITED = "'See §151.0' || (turn % 4) || '(a) and Article ' || conv_id % 9 || ', §151.0' || (turn % 4) || '(a). ' || text"


def _cited(spark, d):
    c = t.table(spark, d, "conversations")
    ref = F.concat(F.lit("§151.0"), (F.col("turn") % 4).cast("string"), F.lit("(a)"))
    return c.withColumn("body", F.concat(F.lit("See "), ref, F.lit(" and Article "), (F.col("conv_id") % 9).cast("string"), F.lit(", "), ref, F.lit(". "), "text"))


@query("f16_cross_refs", "SELECT conv_id, turn, '§151.0' || (turn % 4) || '(a)|Article ' || conv_id % 9 AS refs FROM conversations")
def f16(spark, d):
    return _cited(spark, d).select("conv_id", "turn", F.array_join(text.cross_refs(F.col("body")), "|").alias("refs"))


@query("f17_answer_citations", "SELECT conv_id, turn, '§151.0' || (turn % 4) || '(a)' AS refs FROM conversations")
def f17(spark, d):
    return _cited(spark, d).select("conv_id", "turn", F.array_join(text.answer_citations(F.col("body")), "|").alias("refs"))


@query("f15_defined_terms", "SELECT item_id, lower(left(regexp_replace(text, '[^A-Za-z]', '', 'g'), 12)) AS term FROM benchmark WHERE length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 12")
def f15(spark, d):
    letters = F.substring(F.regexp_replace("text", "[^A-Za-z]", ""), 1, 12)
    body = F.concat(F.lit('A "'), letters, F.lit('" means the thing itself. "'), letters, F.lit('" shall mean the last one.'))
    b = t.table(spark, d, "benchmark").where(F.length(letters) >= 12).select("item_id", text.defined_terms(body).alias("m"))
    return b.select("item_id", F.explode("m").alias("term", "meaning")).select("item_id", "term")


@query("f19_describe_factor", "SELECT event_id, round(value - 50, 6) AS contribution, CASE WHEN value - 50 > 0 THEN 'up' ELSE 'down' END AS direction, event_type AS readable FROM events")
def f19(spark, d):
    e = t.table(spark, d, "events").select("event_id", text.describe_factor(F.col("event_type"), F.col("value") - 50).alias("f"))
    return e.select("event_id", "f.contribution", "f.direction", "f.readable")


def _chunks(spark, d):
    docs = t.table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.concat(F.lit("From docs: "), "text").alias("content_with_prefix"))


def _asked(spark, d):
    """Queries: the first eight words of each benchmark item."""
    return t.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, 8), " ").alias("text"))


def _asked_whole(spark, d):
    """Queries: the whole text of each benchmark item."""
    return t.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


TOKENS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}0-9]+'), lambda t: t <> '')"
CHUNKS = f"c AS (SELECT doc_id AS chunk_id, {TOKENS.format('text')} AS t FROM documents)"
ASKED = f"q AS (SELECT item_id AS query_id, list_distinct({TOKENS.format(chr(39).join(['array_to_string(string_split(text, ', ' ', ')[:8], ', ' ', ')']))}) AS t FROM benchmark)"
ASKED_WHOLE = f"q AS (SELECT item_id AS query_id, list_distinct({TOKENS.format('text')}) AS t FROM benchmark)"
BM25 = f"""{CHUNKS}, {ASKED}, p AS (SELECT chunk_id, len(t) AS length, unnest(t) AS term FROM c), post AS (SELECT chunk_id, length, term, count(*) AS tf FROM p GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY ALL), tot AS (SELECT count(*) AS n, avg(len(t)) AS m FROM c), a AS (SELECT query_id, len(t) AS n_terms, unnest(t) AS term FROM q),
h AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / m))), 9) AS score, count(*) AS held, any_value(n_terms) AS n_terms
  FROM a JOIN df USING (term) JOIN post USING (term), tot GROUP BY ALL)"""


@query("r8_lexical_index", f"WITH {CHUNKS}, p AS (SELECT chunk_id, unnest(t) AS term FROM c) SELECT term, count(DISTINCT chunk_id) AS df FROM p GROUP BY ALL")
def r8(spark, d):
    return retrieval.lexical_index(_chunks(spark, d)).terms


@query("r9_bm25_top_k", f"WITH {BM25}, r AS (SELECT query_id, chunk_id, round(score, 5) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM h) SELECT * FROM r WHERE rank <= 5")
def r9(spark, d, asked=_asked):
    out = retrieval.bm25_top_k(asked(spark, d), retrieval.lexical_index(_chunks(spark, d)), 5)
    return out.withColumn("score", F.round("score", 5))


@query("r9_bm25_all", f"WITH {BM25}, r AS (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM h WHERE held = n_terms) SELECT * FROM r WHERE rank <= 5")
def r9b(spark, d, asked=_asked):
    return retrieval.bm25_top_k(asked(spark, d), retrieval.lexical_index(_chunks(spark, d)), 5, "all").drop("score")


DENSE = """v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_cosine_similarity(a.e, b.e), 9) AS score FROM v a, v b WHERE a.vec_id % 50 = 0),
r AS (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s)"""


@query("r7_dense_top_k", f"WITH {DENSE} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def r7(spark, d):
    e = t.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    out = retrieval.dense_top_k(e.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id"), e, 10)
    return out.withColumn("score", F.round("score", 6))


@query("r10_rrf", """WITH a AS (SELECT user_id AS query_id, event_type AS chunk_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY max(value) DESC, event_type) AS INTEGER) AS rank FROM events GROUP BY user_id, event_type),
b AS (SELECT user_id AS query_id, event_type AS chunk_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS INTEGER) AS rank FROM events GROUP BY user_id, event_type),
u AS (SELECT *, 0 AS l FROM a UNION ALL SELECT *, 1 FROM b), f AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 12) AS score, min(struct_pack(l := l, r := rank)) AS o FROM u GROUP BY ALL),
r AS (SELECT query_id, chunk_id, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY f.score DESC, o, chunk_id) AS INTEGER) AS rank FROM f) SELECT * FROM r WHERE rank <= 3""")
def r10(spark, d):
    from ..operators.ranking import top_n

    e = t.table(spark, d, "events").groupBy(F.col("user_id").alias("query_id"), F.col("event_type").alias("chunk_id")).agg(F.max("value").alias("v"), F.count(F.lit(1)).alias("n"))
    lists = [top_n(e, ["query_id"], [f"-{c}", "chunk_id"], 100) for c in ("v", "n")]
    return retrieval.rrf(lists, top_k=3).withColumn("score", F.round("score", 9))


@query("r12_expand_query", """SELECT item_id AS query_id, CASE WHEN list_contains(t, 'the') OR list_contains(t, 'and') THEN concat_ws(' ', x, CASE WHEN list_contains(t, 'the') THEN 'article' END, CASE WHEN list_contains(t, 'and') THEN 'plus' END) ELSE x END AS text
FROM (SELECT item_id, x, """ + TOKENS.format("x") + """ AS t FROM (SELECT item_id, array_to_string(string_split(text, ' ')[:8], ' ') AS x FROM benchmark))""")
def r12(spark, d, asked=_asked):
    synonyms = spark.createDataFrame([("the", "article"), ("and", "plus")], "term string, synonym string")
    return retrieval.expand_query(asked(spark, d), synonyms)


@query("r1_split_sections", r"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(greatest(1, len(string_split(text, chr(10)))) AS BIGINT) AS sections FROM documents""")
def r1(spark, d):
    lines = F.array_join(F.transform(F.split("text", "\n"), lambda s, i: F.concat(F.lit("§1."), (i + 1).cast("string"), F.lit(" "), s)), "\n")
    docs = t.table(spark, d, "documents").select("doc_id", lines.alias("text"))
    return corpus.split_sections(docs).where("depth = 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("sections"))


@query("r2_chunk_sections", r"""WITH w AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(CASE WHEN floor(n * 1.3) <= 600 THEN 1 WHEN n <= 450 THEN 1 ELSE ceil((n - 450) / 396) + 1 END AS BIGINT) AS chunks FROM w WHERE n > 0""")
def r2(spark, d):
    sections = corpus.split_sections(t.table(spark, d, "documents"))
    return corpus.chunk_sections(sections).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))


@query("r3_split_recursive")
def r3(spark, d):
    return corpus.split_recursive(t.table(spark, d, "documents"))


@query("r4_build_corpus", "SELECT CAST(item_id AS VARCHAR) AS document, sha256(trim(text)) AS version_hash FROM benchmark")
def r4(spark, d):
    built = corpus.build_corpus(t.table(spark, d, "benchmark"), "bench", "item_id")
    return built.select("document", "version_hash")


@query("r5_upsert_chunks", "SELECT item_id AS chunk_id, sha256(text || CASE WHEN item_id % 3 = 0 THEN '!' ELSE '' END) AS version_hash FROM benchmark")
def r5(spark, d):
    b = t.table(spark, d, "benchmark").select(F.col("item_id").alias("chunk_id"), F.col("text").alias("content")).withColumn("version_hash", F.sha2("content", 256))
    new = b.withColumn("content", F.concat("content", F.when(F.col("chunk_id") % 3 == 0, "!").otherwise(""))).withColumn("version_hash", F.sha2("content", 256))
    return corpus.upsert_chunks(b.where("chunk_id % 2 = 0"), new).select("chunk_id", "version_hash")


@query("r13_retrieve")
def r13(spark, d):
    hits = retrieval.retrieve(_asked_whole(spark, d), _chunks(spark, d).withColumn("parent_chunk_id", F.lit(None).cast("long")))
    return hits.select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


@query("j17_resolve_refs", "SELECT conv_id * 1000 + turn AS chunk_id, '§151.0' || (turn % 4) || '(a)' AS ref, turn % 4 < 2 AS resolved FROM conversations UNION SELECT conv_id * 1000 + turn, 'Article ' || conv_id % 9, false FROM conversations")
def j17(spark, d):
    known = F.concat(F.lit("§151.0"), (F.col("turn") % 2).cast("string"), F.lit("(a)"))
    c = _cited(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), known.alias("citation"), text.cross_refs(F.col("body")).alias("cross_refs"))
    return joins.resolve_refs(c)


@query("e6_session_rollup", "SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 'user') AS user_turns, max_by(role, turn) AS last_role FROM conversations GROUP BY ALL")
def e6(spark, d):
    return evaluation.session_rollup(t.table(spark, d, "conversations"), "conv_id")


def _items(spark, d):
    b = t.table(spark, d, "benchmark")
    n = F.col("item_id")
    expected = F.when(n % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("§"), n.cast("string")), F.lit("§x")))
    return b.select(n.alias("id"), expected.alias("expected_citations"), F.array(F.lit("zz")).alias("must_not_say"), F.when(n % 4 == 0, "refusal_calibration").otherwise("factual").alias("failure_mode"))


@query("e1_recall_at_k", "SELECT item_id AS id, CASE WHEN item_id % 5 = 0 THEN 1.0 WHEN item_id % 2 = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS recall_at_k FROM benchmark")
def e1(spark, d):
    hits = t.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 2 * 5 + 1).alias("rank"), F.concat(F.lit("§"), "item_id", F.lit("(a)")).alias("citation"))
    return evaluation.recall_at_k(_items(spark, d), hits, 5).select("id", "recall_at_k")


@query("e2_citation_accuracy", "SELECT item_id AS id, CASE WHEN item_id % 5 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS citation_accuracy FROM benchmark")
def e2(spark, d):
    answers = t.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.concat(F.lit("as §  "), "item_id", F.lit(" says")).alias("answer"))
    return evaluation.citation_accuracy(_items(spark, d), answers).select("id", "citation_accuracy")


@query("e3_refusal_calibration", "SELECT item_id AS id, CASE WHEN item_id % 4 <> 0 THEN -1.0 WHEN item_id % 8 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS refusal_calibration FROM benchmark")
def e3(spark, d):
    answers = t.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.when(F.col("item_id") % 8 == 0, "This is Not  covered here").otherwise("yes").alias("answer"))
    return evaluation.refusal_calibration(_items(spark, d), answers).select("id", "refusal_calibration")


@query("e4_run_eval", """WITH i AS (SELECT CASE WHEN item_id % 4 = 0 THEN 'refusal_calibration' ELSE 'factual' END AS mode, CASE WHEN item_id % 5 = 0 THEN 1.0 ELSE 0.5 END AS share, CASE WHEN item_id % 4 = 0 THEN 1.0 ELSE -1.0 END AS refusal FROM benchmark),
l AS (SELECT mode, unnest([struct_pack(m := 'citation_accuracy', v := share, t := 0.6), struct_pack(m := 'recall_at_k', v := share, t := 0.7), struct_pack(m := 'refusal_calibration', v := refusal, t := 0.8)]) AS e FROM i),
b AS (SELECT mode, e FROM l UNION ALL SELECT 'all', e FROM l)
SELECT mode AS "group", e.m AS metric, round(CAST(avg(nullif(e.v, -1)) AS DOUBLE), 6) AS mean, count(nullif(e.v, -1)) AS n, count(*) FILTER (WHERE e.v = -1) AS skipped, round(CAST(avg(nullif(e.v, -1)) AS DOUBLE), 6) >= max(e.t) AS passed FROM b GROUP BY ALL""")
def e4(spark, d):
    b = t.table(spark, d, "benchmark")
    hits = b.select(F.col("item_id").alias("query_id"), F.lit(1).alias("rank"), F.concat(F.lit("§"), "item_id").alias("citation"))
    answers = b.select(F.col("item_id").alias("id"), F.concat(F.lit("not found in §"), "item_id").alias("answer"))
    return evaluation.run_eval(_items(spark, d), answers, hits)[1]


@query("e5_regressions", """WITH h AS (SELECT event_type AS metric, CAST(ts AS DATE) AS ts, round(avg(value), 6) AS value FROM events GROUP BY ALL),
b AS (SELECT a.metric, a.ts, a.value, quantile_cont(b.value, 0.5) AS baseline FROM h a LEFT JOIN h b ON a.metric = b.metric AND b.ts >= a.ts - 7 AND b.ts < a.ts GROUP BY ALL)
SELECT metric, ts, value, round(baseline, 6) AS baseline, coalesce(value < baseline * 0.95, false) AS regressed FROM b""")
def e5(spark, d):
    h = t.table(spark, d, "events").groupBy(F.col("event_type").alias("metric"), F.col("ts").cast("date").alias("ts")).agg(F.round(F.avg("value"), 6).alias("value"))
    return evaluation.regressions(h).withColumn("baseline", F.round("baseline", 6))


@query("f22_context_block", "SELECT conv_id, string_agg('[' || turn_no || '] §' || turn || ' (chat)' || chr(10) || left(text, 4000), chr(10) || chr(10) ORDER BY turn_no) AS block FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS turn_no FROM conversations) GROUP BY ALL")
def f22(spark, d):
    entry = F.struct("turn", "role", "text")
    rows = t.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(entry)).alias("m"))
    chunks = F.transform("m", lambda x: F.struct(F.concat(F.lit("§"), x["turn"].cast("string")).alias("citation"), F.lit("chat").alias("authority"), x["text"].alias("content_with_prefix")))
    return rows.select("conv_id", text.context_block(chunks).alias("block"))


@query("f23_retrieval_query", "SELECT event_id, 'NYC rat risk NTA ' || event_type || ': risk score ' || printf('%.2f', value) || '. Top risk factors: ' || event_type || '. What are the relevant health code regulations, seasonal patterns, and mitigation actions?' AS q FROM events")
def f23(spark, d):
    factors = F.array(text.describe_factor(F.col("event_type"), F.col("value")))
    return t.table(spark, d, "events").select("event_id", text.retrieval_query(F.col("event_type"), F.col("value"), factors).alias("q"))


@query("f23_summary_prompt", """WITH e AS (SELECT *, CAST(ts AS DATE) AS d FROM events)
SELECT event_id, 'NTA: ' || event_type || chr(10) || 'Week: ' || d || chr(10) || 'Current risk score: ' || CAST(round(CAST(CAST(value / 100 AS VARCHAR) AS DECIMAL(30, 20)), 3) AS DECIMAL(12, 3)) || ' (decile 3/10)' || chr(10) || chr(10) || 'Top contributing factors:' || chr(10)
  || '  - ' || event_type || CASE WHEN value - 50 > 0 THEN ' increases' ELSE ' decreases' END || ' risk (SHAP=' || printf('%+.4f', round(value - 50, 6)) || ')' || chr(10) || chr(10) || '12-week forecast trend (p50 risk score):' || chr(10)
  || '  - 2024-01-08: 0.050' || chr(10) || '  - 2024-01-15: 0.100' || chr(10) || '  - 2024-01-22: 0.150' || chr(10) || '  - 2024-01-29: 0.200' || chr(10) || '  - … → 2024-03-25: 0.600' || chr(10) || chr(10)
  || 'Relevant context (from NYC policy and public health sources):' || chr(10) || chr(10) || '[§1.2]' || chr(10) || event_type || chr(10) || chr(10)
  || 'Please write a 2–3 sentence risk summary for this NTA that a resident or building owner would find useful.' AS prompt FROM e""")
def f23b(spark, d):
    factors = F.array(text.describe_factor(F.col("event_type"), F.col("value") - 50))
    weeks = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.struct(F.date_add(F.lit("2024-01-01").cast("date"), 7 * i).alias("forecast_week"), (i / 20.0).alias("p50")))
    chunks = F.array(F.struct(F.lit("§1.2").alias("citation"), F.col("event_type").alias("content")))
    e = t.table(spark, d, "events")
    return e.select("event_id", text.summary_prompt(F.col("event_type"), F.col("ts").cast("date"), F.col("value") / 100, F.lit(3), factors, weeks, chunks).alias("prompt"))


@query("r6_embed", f"WITH {CHUNKS} SELECT chunk_id, len(t) > 0 AS unit FROM c")
def r6(spark, d):
    e = retrieval.embed(_chunks(spark, d), "content")
    norm = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return e.select("chunk_id", (F.abs(norm - 1) < 1e-4).alias("unit"))


@query("r11_rerank", f"""WITH {BM25}, r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS first FROM h), s AS (SELECT r.*, len(list_intersect(q.t, c.t)) / len(q.t) AS s FROM r JOIN q USING (query_id) JOIN c USING (chunk_id) WHERE first <= 20),
k AS (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, first, chunk_id) AS INTEGER) AS rank FROM s) SELECT * FROM k WHERE rank <= 6""")
def r11(spark, d, asked=_asked):
    hits = retrieval.bm25_top_k(asked(spark, d), retrieval.lexical_index(_chunks(spark, d)), 20)
    rows = retrieval.with_chunks(hits.join(asked(spark, d), "query_id"), _chunks(spark, d))
    return retrieval.rerank(rows, retrieval.overlap_score).select("query_id", "chunk_id", "rank")


@query("j16_expand_parents", """SELECT conv_id AS query_id, turn AS rank, turn % 2 = 1 AS expanded FROM (SELECT DISTINCT conv_id, turn FROM conversations)""")
def j16(spark, d):
    c = t.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("query_id"), F.col("turn").cast("int").alias("rank")).agg(F.min("text").alias("content"))
    hits = c.withColumns({"chunk_id": F.concat_ws("/", "query_id", "rank"), "parent_chunk_id": F.when(F.col("rank") % 2 == 1, F.concat_ws("/", F.lit("p"), "query_id")), "content_with_prefix": F.col("content")})
    parents = c.select(F.concat_ws("/", F.lit("p"), "query_id").alias("chunk_id"), F.lit("one two").alias("content_with_prefix")).distinct()
    return joins.expand_parents(hits, parents, 10**9).select("query_id", F.col("rank").cast("long").alias("rank"), "expanded")


@query("r14_link_parents", "SELECT item_id, true AS linked FROM benchmark")
def r14(spark, d):
    b = t.table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("document"), "item_id")
    rows = b.select("item_id", "document", F.lit("§1.2(a)").alias("citation"), F.concat_ws("-", "document", F.lit("a")).alias("chunk_id")).unionByName(
        b.select("item_id", "document", F.lit("§1.2").alias("citation"), F.concat_ws("-", "document", F.lit("s")).alias("chunk_id"))
    )
    linked = corpus.link_parents(rows).where("citation = '§1.2(a)'")
    return linked.select("item_id", (F.col("parent_chunk_id") == F.concat_ws("-", "document", F.lit("s"))).alias("linked"))


@query("r7_index_all_cells", ORACLES["r7_dense_top_k"])
def r7b(spark, d):
    """A stored vector index, built of a half of the vectors and extended by the other; every cell is probed, so the answer is exact."""
    e = t.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    index = vector_index.build(e.where("chunk_id % 2 = 0"), t.scratch(spark, "vector-index"))
    vector_index.extend(e.where("chunk_id % 2 = 1"), index)
    asked = e.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    return vector_index.search(asked, index, 10, index.cells).withColumn("score", F.round("score", 6))


@query("r7_index_top_k")
def r7c(spark, d):
    """As many probes as find 0.95 of the neighbours of a bounded sample of the queries."""
    e = t.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    index = vector_index.build(e, t.scratch(spark, "vector-index"))
    asked = e.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    return vector_index.search(asked, index, 10, vector_index.probes_for(asked, index))


def _lexical_store(spark, d):
    """A stored lexical index of the documents, built of a third of them and extended twice."""
    path = t.scratch(spark, "lexical-index")
    for part in range(3):
        lexical_store.extend(_chunks(spark, d).where(F.col("chunk_id") % 3 == part), path)
    return path


@query("r8_stored_index", ORACLES["r8_lexical_index"])
def r8b(spark, d):
    return lexical_store.terms(spark, _lexical_store(spark, d))


@query("r9_stored_top_k", ORACLES["r9_bm25_top_k"].replace(ASKED, ASKED_WHOLE))
def r9c(spark, d):
    return lexical_store.search(_asked_whole(spark, d), _lexical_store(spark, d), 5).withColumn("score", F.round("score", 5))


@query("r9_stored_all", ORACLES["r9_bm25_all"].replace(ASKED, ASKED_WHOLE))
def r9d(spark, d):
    return lexical_store.search(_asked_whole(spark, d), _lexical_store(spark, d), 5, "all").drop("score")


#: The queries that ask with the first eight words, asked with whole items.
def _share(arrays, queries, texts):
    """The weighted share of a query's distinct words that a text holds."""
    import regex

    split = lambda text: [w for w in regex.split(r"[^\p{L}0-9]+", text.lower()) if w]
    held = [(set(split(q)), set(split(x))) for q, x in zip(queries, texts, strict=True)]
    return arrays["weight"][0] * np.array([len(q & x) / len(q) if q else 0.0 for q, x in held])


def r11b(spark, d):
    """Re-ranking by a model from the registry, applied in batches, over the whole texts of the items."""
    at = t.scratch(spark, "registry")
    hooks.save_arrays(spark, {"weight": np.array([0.25])}, at, "share", "v1")
    hooks.save_arrays(spark, {"weight": np.array([1.0])}, at, "share", "v2")
    hits = retrieval.bm25_top_k(_asked_whole(spark, d), retrieval.lexical_index(_chunks(spark, d)), 20)
    rows = retrieval.with_chunks(hits.join(_asked_whole(spark, d), "query_id"), _chunks(spark, d))
    return retrieval.rerank(rows, hooks.batch_scorer(at, "share", _share)).select("query_id", "chunk_id", "rank")


for _name, _query in {"r9_bm25_top_k": r9, "r9_bm25_all": r9b, "r11_rerank": r11, "r12_expand_query": r12}.items():
    _sql = ORACLES[_name].replace(ASKED, ASKED_WHOLE).replace("array_to_string(string_split(text, ' ')[:8], ' ')", "text")
    query(f"{_name}_whole", _sql)(lambda spark, d, _query=_query: _query(spark, d, _asked_whole))

query("r11_rerank_batch", ORACLES["r11_rerank_whole"])(r11b)
