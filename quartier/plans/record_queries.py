"""Queries of files, streams and stored tables, and of operators' whole results where another query looks at a part of them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from ..functions import keys, text
from ..operators import aggregates, corpus, evaluation, forecast, joins, retrieval, series, spatial, validation
from ..sources import features, normalize, store
from ..streaming import alerts, ingest
from . import panel_queries, scoring_queries, text_queries
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


def _written_lines(spark, rows, name):
    """JSON text rows as a file of lines in the shared folder."""
    path = t.scratch(spark, name)
    rows.write.text(path)
    return path


@query("s7_read_polygons", """SELECT CAST(n_nationkey AS VARCHAR) AS nta_id, n_name AS name, CAST(n_regionkey AS VARCHAR) AS borough, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 2 END AS INTEGER) AS rings,
  CAST(n_nationkey % 5 AS DOUBLE) AS x, CAST(n_nationkey // 5 AS DOUBLE) AS y, CASE WHEN n_nationkey % 2 = 0 THEN 1.0 ELSE 7.5 END::DOUBLE AS area FROM nation""")
def s7(spark, d):
    n = t.table(spark, d, "nation")
    x, y, k = (F.col("n_nationkey") % 5).cast("double"), F.floor(F.col("n_nationkey") / 5).cast("double"), F.col("n_nationkey")
    ring = lambda by: F.array(*[F.array(x + i + by, y + j) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    single, multi = F.to_json(F.array(ring(0))), F.to_json(F.array(F.array(ring(0)), F.array(ring(10))))
    head = lambda kind, c: F.concat(F.lit('{"type":"' + kind + '","coordinates":'), c, F.lit("}"))
    geometry = F.when(k % 2 == 0, head("Polygon", single)).otherwise(head("MultiPolygon", multi))
    size = F.when(k % 2 == 0, "").otherwise(',"shape_area":"7.5"')
    feature = F.concat(F.lit('{"type":"Feature","properties":{"nta2020":"'), k.cast("string"), F.lit('","ntaname":"'), "n_name", F.lit('","boroname":"'), F.col("n_regionkey").cast("string"), F.lit('"'), size, F.lit('},"geometry":'), geometry, F.lit("}"))
    body = n.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.array_sort(F.collect_list(feature)), ",\n"), F.lit("]}")).alias("value"))  # a file of areas
    rows = store.read_polygons(spark, _written_lines(spark, body, "polygons"))
    corner = F.col("rings")[0][0]
    return rows.select("nta_id", "name", "borough", F.size("rings").alias("rings"), corner["x"].alias("x"), corner["y"].alias("y"), "area")


@query("s14_read_spans", "SELECT CAST(event_id AS VARCHAR) AS span_id, event_type AS name, ts, floor(value * 1000) / 1000 AS duration_ms, user_id AS tokens_in FROM events WHERE event_id % 7 <> 0")
def s14(spark, d):
    e = t.table(spark, d, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    span = F.when(F.col("event_id") % 7 != 0, F.col("event_id").cast("string"))
    rows = e.select(F.to_json(F.struct(F.lit("t").alias("trace_id"), span.alias("span_id"), F.col("event_type").alias("name"), start.alias("start_time_ns"), (start + F.floor(F.col("value") * 1000) * 1000).alias("end_time_ns"), F.col("user_id").alias("tokens_in"))).alias("value"))
    rows = store.read_spans(spark, _written_lines(spark, rows, "spans"))
    return rows.select("span_id", "name", F.col("ts").cast("timestamp_ntz").alias("ts"), "duration_ms", "tokens_in")


@query("s15_read_gold", "SELECT CAST(item_id AS VARCHAR) AS id, text AS question, CASE WHEN item_id % 2 = 0 THEN '§' || item_id || '|§x' END AS expected, CASE WHEN item_id % 4 = 0 THEN 'refusal_calibration' ELSE 'factual' END AS failure_mode FROM benchmark")
def s15(spark, d):
    n = F.col("item_id")
    expected = F.when(n % 2 == 0, F.array(F.concat(F.lit("§"), n.cast("string")), F.lit("§x")))
    mode = F.when(n % 4 == 0, "refusal_calibration").otherwise("factual")
    b = t.table(spark, d, "benchmark")
    rows = b.select(F.to_json(F.struct(n.cast("string").alias("id"), F.col("text").alias("question"), expected.alias("expected_citations"), mode.alias("failure_mode"))).alias("value"))
    rows = rows.unionByName(spark.range(1).select(F.lit('{"question":"without an id"}').alias("value")))
    gold = store.read_gold(spark, _written_lines(spark, rows, "gold"))
    return gold.select("id", "question", F.when(F.col("expected_citations").isNotNull(), F.array_join("expected_citations", "|")).alias("expected"), "failure_mode")


@query("s18_registry", "SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS DOUBLE) AS code, CAST(2 AS BIGINT) AS versions FROM customer")
def s18(spark, d):
    c = t.table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    path = t.scratch(spark, "registry")
    indexer = StringIndexer(inputCol="c_mktsegment", outputCol="code", stringOrderType="alphabetAsc", handleInvalid="keep")
    for version, rows in (("v1", c.where("c_custkey < 0")), ("v2", c)):
        store.registry_save(Pipeline(stages=[indexer]).fit(rows), path, "segments", version, {"rows": version})
    versions = store.registry_list(spark, path).where("name = 'segments'").agg(F.count(F.lit(1)).alias("versions"))
    return store.registry_load(spark, path, "segments").transform(c).select("c_custkey", "code").crossJoin(F.broadcast(versions))  # one row


@query("s19_read_strings", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name AS \"customer name\", CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE lpad(CAST(c_nationkey AS VARCHAR), 4, '0') END AS nation FROM customer")
def s19(spark, d):
    c = t.table(spark, d, "customer")
    nation = F.when(F.col("c_custkey") % 3 != 0, F.lpad(F.col("c_nationkey").cast("string"), 4, "0"))
    path = t.scratch(spark, "delimited")
    c.select(F.col("c_custkey").alias(" C_CUSTKEY "), F.col("c_name").alias("Customer Name"), nation.alias("NATION ")).write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return normalize.read_strings(spark, path)


@query("s13_incremental_cursor", """SELECT 'events' AS source, max(ts) AS value, count(*) + 3 AS "rows" FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00' UNION ALL SELECT 'other', TIMESTAMP '2024-01-01 00:00:00', 5""")
def s13(spark, d):
    cursor = spark.createDataFrame([("events", dt.datetime(2024, 1, 20), 3), ("other", dt.datetime(2024, 1, 1), 5)], "source string, value timestamp, rows long")
    return store.incremental(t.table(spark, d, "events"), cursor, "events", "ts")[1]


@query("f11_cache_key", "SELECT doc_id, sha1(concat_ws('|', CAST(doc_id AS VARCHAR), lang, text)) AS key FROM documents")
def f11(spark, d):
    return t.table(spark, d, "documents").select("doc_id", keys.cache_key(F.col("doc_id"), F.col("lang"), F.col("text")).alias("key"))


TERMS = r"""'(?i)"([^"]{2,60})"\s+(?:means?|shall\s+mean)\s+([^\.]{5,200})'"""


@query("f15_defined_terms_whole", f"""WITH b AS (SELECT conv_id, turn, '"' || role || ' note" means ' || text || ' "Turn' || turn || '" shall mean the last one. "USER NOTE" mean nothing at all.' AS body FROM conversations),
m AS (SELECT conv_id, turn, unnest(regexp_extract_all(body, {TERMS}, 1)) AS term, unnest(regexp_extract_all(body, {TERMS}, 2)) AS meaning, generate_subscripts(regexp_extract_all(body, {TERMS}, 1), 1) AS i FROM b)
SELECT conv_id, turn, lower(term) AS term, trim(max_by(meaning, i)) AS meaning FROM m GROUP BY conv_id, turn, lower(term)""")
def f15(spark, d):
    c = t.table(spark, d, "conversations")
    body = F.concat(F.lit('"'), "role", F.lit(' note" means '), "text", F.lit(' "Turn'), F.col("turn").cast("string"), F.lit('" shall mean the last one. "USER NOTE" mean nothing at all.'))
    return c.select("conv_id", "turn", F.explode(text.defined_terms(body)).alias("term", "meaning"))


@query("f25_fill_missing", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END, 0.5) AS a, coalesce(CASE WHEN c_custkey % 2 > 0 THEN c_acctbal END, 0.5) AS b, 0.5::DOUBLE AS c, 0.5::DOUBLE AS d, CASE WHEN c_custkey % 5 > 0 THEN c_acctbal END AS other FROM customer")
def f25(spark, d):
    c = t.table(spark, d, "customer")
    some = lambda n: F.when(F.col("c_custkey") % n > 0, F.col("c_acctbal"))
    return series.fill_missing(c.select("c_custkey", some(3).alias("a"), some(2).alias("b"), some(5).alias("other")), ["a", "b", "c", "d"], 0.5)


@query("j3_queen_islands", """WITH p AS (SELECT n_nationkey AS k, n_nationkey % 5 + CASE WHEN n_nationkey >= 20 THEN 100 * n_nationkey ELSE 0 END AS x, n_nationkey // 5 AS y FROM nation)
SELECT a.k AS nta_id, coalesce(string_agg(b.k, ',' ORDER BY b.k), '') AS neighbors FROM p a LEFT JOIN p b ON a.k <> b.k AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY ALL""")
def j3(spark, d):
    away = F.when(F.col("nta_id") >= 20, 100.0 * F.col("nta_id")).otherwise(0.0)
    moved = F.transform("rings", lambda r: F.transform(r, lambda p: F.struct((p["x"] + away).alias("x"), p["y"].alias("y"))))
    out = spatial.queen_adjacency(t.squares(spark, d).withColumn("rings", moved))
    return out.select("nta_id", F.array_join("neighbors", ",").alias("neighbors"))


@query("j4_spatial_lag_rows", f"""WITH {t.PANEL}, {panel_queries.ADJACENT}, m AS (SELECT src AS nta_id, week_start, avg(complaints_count_lag_4w) AS v FROM adj JOIN panel ON dst = nta_id GROUP BY ALL)
SELECT p.nta_id, p.week_start, round(m.v, 9) AS neighbor_complaints_lag_4w FROM panel p LEFT JOIN m USING (nta_id, week_start)""")
def j4(spark, d):
    rows = joins.build_panel(t.labels(spark, d), {"c": t.complaints(spark, d)}, ["complaints_count"]).select("nta_id", "week_start", "complaints_count_lag_4w")
    out = spatial.spatial_lag(rows, spatial.adjacency_edges(t.squares(spark, d)), [("complaints_count_lag_4w", 0, "m")])
    return out.select("nta_id", "week_start", F.round("m", 9).alias("neighbor_complaints_lag_4w"))


@query("j9_crosswalk_weights", f"""WITH {panel_queries.XWALK}, y AS (SELECT src, dst, weight * CASE WHEN src % 10 = 0 THEN 1.1 WHEN src % 10 = 1 THEN 1.005 ELSE 1 END AS weight FROM xwalk)
SELECT 'missing' AS kind, s_suppkey + 20 AS id, NULL::DOUBLE AS total FROM supplier WHERE s_suppkey + 20 NOT IN (SELECT dst FROM y)
UNION ALL SELECT 'weights', src, round(sum(weight), 6) FROM y GROUP BY src HAVING abs(sum(weight) - 1) > 0.01""")
def j9(spark, d):
    scale = F.when(F.col("src") % 10 == 0, 1.1).when(F.col("src") % 10 == 1, 1.005).otherwise(1.0)
    ids = t.table(spark, d, "supplier").select((F.col("s_suppkey") + 20).alias("s"))
    out = spatial.crosswalk_gaps(panel_queries._crosswalk(spark, d).withColumn("weight", F.col("weight") * scale), ids, "s")
    return out.withColumn("total", F.round("total", 6))


WORDS = r"len(list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> ''))"


@query("j16_expand_parents_budget", f"""WITH RECURSIVE h AS (SELECT conv_id AS query_id, CAST(turn AS INTEGER) AS rank, {WORDS.format('text')} AS own, text, CASE WHEN turn % 3 <> 2 THEN 'of ' || role || ': ' || text END AS parent FROM conversations),
e AS (SELECT *, {WORDS.format('parent')} AS extra, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i, sum(own) OVER (PARTITION BY query_id) AS s FROM h),
f AS (SELECT query_id, i, rank, coalesce(s + extra <= 150, false) AS expanded, s + CASE WHEN coalesce(s + extra <= 150, false) THEN extra ELSE 0 END AS total FROM e WHERE i = 1
  UNION ALL SELECT e.query_id, e.i, e.rank, coalesce(total + extra <= 150, false), total + CASE WHEN coalesce(total + extra <= 150, false) THEN extra ELSE 0 END FROM f JOIN e ON e.query_id = f.query_id AND e.i = f.i + 1)
SELECT query_id, rank, expanded, CASE WHEN expanded THEN parent || chr(10) || chr(10) || '---' || chr(10) || chr(10) || text ELSE text END AS content FROM f JOIN e USING (query_id, i, rank)""")
def j16(spark, d):
    c = t.table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").cast("int").alias("rank"), F.col("text").alias("content"), "role")
    name = F.concat_ws("/", F.lit("p"), "query_id", "rank")
    hits = c.withColumns({"chunk_id": F.concat_ws("/", "query_id", "rank"), "parent_chunk_id": F.when(F.col("rank") % 3 != 2, name), "content_with_prefix": F.col("content")}).drop("role")
    parents = c.select(name.alias("chunk_id"), F.concat(F.lit("of "), "role", F.lit(": "), "content").alias("content_with_prefix"))
    return joins.expand_parents(hits, parents, 150).select("query_id", "rank", "expanded", F.col("content_with_prefix").alias("content"))


@query("a14_median_composite_rest", """SELECT l_suppkey AS area, year(l_shipdate) * 10 + quarter(l_shipdate) AS quarter, l_linenumber AS band, 0 AS y, 0 AS x, quantile_cont(l_extendedprice, 0.5) AS value, count(*) AS n_obs
FROM lineitem WHERE l_returnflag = 'N' AND l_quantity < 20 AND NOT (l_suppkey % 3 = 0 AND quarter(l_shipdate) % 2 = 0) GROUP BY ALL""")
def a14(spark, d):
    items = t.table(spark, d, "lineitem")
    quarter = F.year("l_shipdate") * 10 + F.quarter("l_shipdate")
    pixels = items.select(F.col("l_suppkey").alias("area"), quarter.alias("quarter"), F.col("l_linenumber").alias("band"), F.lit(0).alias("y"), F.lit(0).alias("x"), F.col("l_extendedprice").alias("value"), F.when(F.col("l_returnflag") == "N", 4).otherwise(9).alias("scl"), F.col("l_quantity").alias("cloud"))
    done = pixels.where((F.col("area") % 3 == 0) & (F.col("quarter") % 2 == 0)).select("area", "quarter").distinct()
    return aggregates.median_composite(pixels, done=done)


@query("m9_metric_bundle_all", f"""WITH {t.SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY p DESC, doc_id) AS r, rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2.0 AS k,
  count(*) OVER (PARTITION BY lang) AS n FROM scored),
g AS (SELECT lang, p, count(*) AS n, sum(y) AS pos FROM scored GROUP BY ALL), c AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp FROM g WINDOW w AS (PARTITION BY lang ORDER BY p DESC)),
ap AS (SELECT lang, round(coalesce(sum(pos * cp / cn) / nullif(sum(pos), 0), 0), 6) AS average_precision FROM c GROUP BY ALL),
b AS (SELECT lang, least(floor(p * 10), 9) AS bin, abs(avg(p) - avg(y)) AS gap FROM scored GROUP BY ALL), ce AS (SELECT lang, round(avg(gap), 6) AS calibration_error FROM b GROUP BY ALL),
m AS (SELECT lang, round((sum(k) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0), 6) AS roc_auc, round(avg((p - y) * (p - y)), 6) AS brier,
  round(coalesce((sum(y) FILTER (WHERE r <= greatest(1, n // 10)) / max(greatest(1, n // 10))) / nullif(sum(y) / count(*), 0), 0), 6) AS top_decile_lift FROM r GROUP BY ALL)
SELECT * FROM m JOIN ap USING (lang) JOIN ce USING (lang)""")
def m9(spark, d):
    out = validation.metric_bundle(t.scored(spark, d), "y", "p", "doc_id", ["lang"])
    return out.select("lang", *[F.round(c, 6).alias(c) for c in ("roc_auc", "brier", "top_decile_lift", "average_precision", "calibration_error")])


@query("m3_leak_report", f"""WITH {t.LABELS}, e AS (SELECT max(week_start) AS b FROM labels), f AS (SELECT i AS fold, b - CAST(28 * (4 - i) AS INTEGER) AS val_end FROM e, range(5) r(i)),
g AS (SELECT fold, val_end, val_end - 21 AS val_start, val_end - 49 AS train_end FROM f)
SELECT CAST(fold AS INTEGER) AS fold, max(week_start) FILTER (WHERE week_start <= g.train_end) AS train_end, min(week_start) FILTER (WHERE week_start > g.train_end) AS val_start,
  count(*) FILTER (WHERE week_start <= g.train_end) AS train_rows, true AS ok FROM labels JOIN g ON week_start <= g.train_end OR week_start BETWEEN g.val_start AND val_end GROUP BY ALL""")
def m3(spark, d):
    return validation.leak_report(validation.expanding_folds(t.labels(spark, d)))


@query("p5_forecast_rows", scoring_queries.ORACLES["p1_forecast"].replace("SELECT f.nta_id, CAST(i", "SELECT DATE '2020-08-01' AS as_of, 'v1' AS model_version, f.nta_id, CAST(i"))
def p5(spark, d):
    s = scoring_queries._series(spark, d)
    return forecast.materialize_forecast(scoring_queries.p1(spark, d), dt.date(2020, 8, 1), "v1", s.select("nta_id").distinct(), "nta_id")[0]


_P1 = scoring_queries.ORACLES["p1_forecast"]


@query("p6_forecast_lookup", f"""WITH {scoring_queries.SERIES}, fc AS ({_P1}), r AS (SELECT nta_id, max(week_start) AS w, round(avg(v), 9) AS score FROM s GROUP BY ALL UNION ALL SELECT 'none', DATE '2020-02-03', 0.02)
SELECT nta_id, forecast_week, p10 AS ci_low, p50 AS score, p90 AS ci_high, false AS is_stub FROM fc
UNION ALL SELECT nta_id, w + CAST(7 * i AS INTEGER), round(greatest(score - 0.05, 0), 6), round(score, 6), round(least(score + 0.05, 1), 6), true FROM r, range(1, 13) x(i) WHERE nta_id NOT IN (SELECT nta_id FROM fc)""")
def p6(spark, d):
    fc = scoring_queries.p1(spark, d)
    old = fc.withColumns({"as_of": F.lit("2020-07-01").cast("date"), "p50": F.lit(0.123)})
    requests = scoring_queries._series(spark, d).groupBy("nta_id").agg(F.max("week_start").alias("week_start"), F.round(F.avg("v"), 9).alias("score"))
    none = spark.range(1).select(F.lit("none").alias("nta_id"), F.lit("2020-02-03").cast("date").alias("week_start"), F.lit(0.02).alias("score"))
    return forecast.forecast_for(requests.unionByName(none), old.unionByName(fc.withColumn("as_of", F.lit("2020-08-01").cast("date"))))


MARKED = r"""b AS (SELECT doc_id, 'Before all. ' || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda s, i: '§ 1.' || i || CASE WHEN i % 2 = 0 THEN ' ' ELSE chr(10) END || s || chr(10) || '(a) one' || chr(10) || '(2) two ' || i), chr(10)) AS body FROM documents)"""
MARK_SQL = r"'(?m)^(§\s*\d+[.\-]\d+[\w.]*)(?:\s+([^\n]{0,120}))?'"


def _marked(spark, d):
    lines = F.transform(F.split("text", "\n"), lambda s, i: F.concat(F.lit("§ 1."), (i + 1).cast("string"), F.when((i + 1) % 2 == 0, " ").otherwise("\n"), s, F.lit("\n(a) one\n(2) two "), (i + 1).cast("string")))
    return t.table(spark, d, "documents").select("doc_id", F.concat(F.lit("Before all. \n"), F.array_join(lines, "\n")).alias("text"))


@query("r1_sections_whole", rf"""WITH {MARKED}, m AS (SELECT doc_id, regexp_extract_all(body, {MARK_SQL}, 1) AS c, regexp_extract_all(body, {MARK_SQL}, 2) AS t, regexp_split_to_array(body, {MARK_SQL})[2:] AS x FROM b),
u AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, replace(unnest(c), ' ', '') AS citation, trim(unnest(t), concat(' ', chr(9), chr(10), chr(13), chr(160))) AS title, trim(unnest(x), concat(' ', chr(9), chr(10), chr(13), chr(160))) AS content FROM m)
SELECT doc_id, citation, title, content, 0 AS depth FROM u
UNION ALL SELECT doc_id, citation || '(' || l || ')', '', CASE WHEN l = 'a' THEN 'one' ELSE 'two ' || substr(citation, 4) END, 1 FROM u, (VALUES ('a'), ('2')) v(l) WHERE content LIKE '%(a) one%'""")
def r1(spark, d):
    return corpus.split_sections(_marked(spark, d)).select("doc_id", "citation", "title", "content", "depth")


@query("r2_chunk_texts", r"""WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w FROM documents WHERE length(trim(text, concat(' ', chr(9), chr(10), chr(13)))) > 0),
n AS (SELECT *, CASE WHEN floor(len(w) * 1.3) <= 600 OR len(w) <= 450 THEN 1 ELSE CAST(ceil((len(w) - 450) / 396) AS INTEGER) + 1 END AS parts FROM w)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, '§(full)' || CASE WHEN i > 0 THEN '(part ' || (i + 1) || ')' ELSE '' END AS citation,
  CASE WHEN floor(len(w) * 1.3) <= 600 THEN trim(text, concat(' ', chr(9), chr(10), chr(13))) ELSE array_to_string(w[396 * i + 1 : 396 * i + 450], ' ') END AS content FROM n, LATERAL (SELECT unnest(range(parts)) AS i)""")
def r2(spark, d):
    return corpus.chunk_sections(corpus.split_sections(t.table(spark, d, "documents"))).select("doc_id", "citation", "content")


@query("r4_corpus_rows", r"""WITH b AS (SELECT CAST(item_id AS VARCHAR) AS document, trim(text) AS content FROM benchmark), h AS (SELECT *, sha256(content) AS version_hash FROM b),
u AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(document || ':§(full):' || version_hash)) AS d FROM h)
SELECT document, '§(full)' AS citation, 'bench' AS authority, content, version_hash, 'From bench ' || document || ' §(full): ' || content AS content_with_prefix, CAST(floor(len(list_filter(regexp_split_to_array(content, '\s+'), lambda w: w <> '')) * 1.3) AS INTEGER) AS token_count,
  substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(d, 17, 1)) - 1) % 4 + 1, 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS chunk_id FROM u""")
def r4(spark, d):
    built = corpus.build_corpus(t.table(spark, d, "benchmark"), "bench", "item_id")
    return built.select("document", "citation", "authority", "content", "version_hash", "content_with_prefix", "token_count", "chunk_id")


@query("r5_upserted_chunks", "SELECT item_id AS chunk_id, text || CASE WHEN item_id % 3 = 0 THEN '!' ELSE '' END AS content, CASE WHEN item_id % 2 = 0 AND item_id % 3 <> 0 THEN 'old' ELSE 'new' END AS load FROM benchmark")
def r5(spark, d):
    b = t.table(spark, d, "benchmark").select(F.col("item_id").alias("chunk_id"), F.col("text").alias("content"), F.lit("old").alias("load")).withColumn("version_hash", keys.version_hash(F.col("content")))
    new = b.withColumn("content", F.concat("content", F.when(F.col("chunk_id") % 3 == 0, "!").otherwise(""))).withColumns({"version_hash": keys.version_hash(F.col("content")), "load": F.lit("new")})
    return corpus.upsert_chunks(b.where("chunk_id % 2 = 0"), new).select("chunk_id", "content", "load")


def _letter_counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([[float((x or "").count(c)) for c in "aeiou"] for x in texts])


@query("r6_embed_encoder", """WITH c AS (SELECT doc_id, list_transform(['a', 'e', 'i', 'o', 'u'], lambda x: CAST(length(text) - length(replace(text, x, '')) AS DOUBLE)) AS v FROM documents), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM c)
SELECT doc_id AS chunk_id, CAST(i AS INTEGER) AS i, round(coalesce(v[i] / nullif(n, 0), 0), 4) AS x FROM n, range(1, 6) r(i)""")
def r6(spark, d):
    e = retrieval.embed(text_queries._chunks(spark, d), "content", _letter_counts)
    return e.select("chunk_id", F.posexplode("embedding").alias("i", "x")).select("chunk_id", (F.col("i") + 1).alias("i"), F.round(F.col("x").cast("double"), 4).alias("x"))


@query("r14_linked_rows", """SELECT 'c' || conv_id || '-' || turn AS chunk_id, CASE WHEN turn % 3 = 0 THEN NULL WHEN turn % 3 = 1 THEN 's' || conv_id WHEN conv_id % 2 = 0 THEN 'p' || conv_id END AS parent_chunk_id FROM conversations
UNION ALL SELECT DISTINCT 's' || conv_id, NULL FROM conversations UNION ALL SELECT DISTINCT 'p' || conv_id, NULL FROM conversations WHERE conv_id % 2 = 0""")
def r14(spark, d):
    c = t.table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("document"), "conv_id", "turn")
    # of three turns one is a section of its own, one a paragraph of §1.2, and one of §1.3, which is there as a parent only
    citation = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("§9."), "turn")).when(F.col("turn") % 3 == 1, "§1.2(a)").otherwise("§1.3(b)(part 2)")
    rows = c.select("document", citation.alias("citation"), F.concat(F.lit("c"), "document", F.lit("-"), "turn").alias("chunk_id"))
    docs = c.select("document", "conv_id").distinct()
    more = docs.select("document", F.lit("§1.2").alias("citation"), F.concat(F.lit("s"), "document").alias("chunk_id"))
    parents = docs.where("conv_id % 2 = 0").select("document", F.lit("§1.3(parent)").alias("citation"), F.concat(F.lit("p"), "document").alias("chunk_id"))
    return corpus.link_parents(rows.unionByName(more).unionByName(parents)).select("chunk_id", "parent_chunk_id")


_ASKED = text_queries.BM25.replace(text_queries.ASKED, text_queries.ASKED_WHOLE)


@query("r13_retrieve_lexical", f"""WITH {_ASKED}, r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS first FROM h), s AS (SELECT r.*, len(list_intersect(q.t, c.t)) / len(q.t) AS s FROM r JOIN q USING (query_id) JOIN c USING (chunk_id) WHERE first <= 30),
k AS (SELECT query_id, chunk_id, round(s, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, first, chunk_id) AS INTEGER) AS rank FROM s) SELECT query_id, rank, chunk_id, score FROM k WHERE rank <= 6""")
def r13(spark, d):
    hits = retrieval.retrieve(text_queries._asked_whole(spark, d), text_queries._chunks(spark, d), lexical_only=True)
    return hits.select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


@query("e6_sessions", "SELECT conv_id AS session_id, CASE WHEN conv_id % 2 = 0 THEN 'old' END AS name FROM (SELECT DISTINCT conv_id FROM conversations)")
def e6(spark, d):
    c = t.table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"))
    old = c.where("session_id % 2 = 0").distinct().withColumn("name", F.lit("old"))
    return evaluation.get_or_create_sessions(old, c)


def _stream(spark, d, name):
    """A table as a stream. Its file or folder is linked by a glob, as file sources read folders."""
    path = f"{d}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


@query("st1_stream_upsert", "SELECT user_id, max_by(event_id, struct_pack(t := ts, e := event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY ALL")
def st1(spark, d):
    path = t.scratch(spark, "stream-upsert")
    rows = _stream(spark, d, "events").select("user_id", "event_id", "ts")
    ingest.stream_upsert(rows, f"{path}/table", ["user_id"], f"{path}/state", order=["ts", "event_id"]).awaitTermination()
    return ingest.current_table(spark, f"{path}/table").select("user_id", "event_id", "ts")


@query("st2_stream_weekly_counts", "SELECT event_type, CAST(date_trunc('week', ts) AS DATE) AS week_start, count(*) AS n FROM events GROUP BY ALL")
def st2(spark, d):
    path = t.scratch(spark, "stream-counts")
    weeks = ingest.stream_weekly_counts(_stream(spark, d, "events").select("event_type", "ts"), "event_type", "ts", "3650 days")
    ingest.stream_upsert(weeks, f"{path}/table", ["event_type", "week_start"], f"{path}/state").awaitTermination()
    return ingest.current_table(spark, f"{path}/table").select("event_type", "week_start", "n")


@query("st2_stream_add", "SELECT event_type, CAST(date_trunc('week', ts) AS DATE) AS week_start, count(*) AS n, sum(user_id)::BIGINT AS users FROM events GROUP BY ALL")
def st2b(spark, d):
    """Counts added to the stored table by each micro-batch of a stream, two of them."""
    from ..functions.dates import week_start

    path = t.scratch(spark, "stream-add")
    rows = t.table(spark, d, "events").select("event_type", week_start(F.col("ts")).alias("week_start"), F.lit(1).cast("long").alias("n"), F.col("user_id").alias("users"), (F.col("event_id") % 2).alias("half"))
    for half in (0, 1):  # a batch each
        rows.where(F.col("half") == half).drop("half").coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.drop("half").schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    ingest.stream_upsert(stream, f"{path}/table", ["event_type", "week_start"], f"{path}/state", add=["n", "users"]).awaitTermination()
    return ingest.current_table(spark, f"{path}/table").select("event_type", "week_start", "n", "users")


@query("st3_stream_late_rows", "SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'")
def st3(spark, d):
    path = t.scratch(spark, "stream-late")
    rows = ingest.stream_later_than(_stream(spark, d, "events").select("event_id", "ts"), "ts", dt.datetime(2024, 1, 20))
    ingest.stream_upsert(rows, f"{path}/table", ["event_id"], f"{path}/state").awaitTermination()
    return ingest.current_table(spark, f"{path}/table").select("event_id", "ts")


@query("st4_stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def st4(spark, d):
    path = t.scratch(spark, "stream-dedupe")
    once = ingest.stream_dedupe(_stream(spark, d, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")), ["user_id", "event_type"], "ts", "3650 days")
    once.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/table").awaitTermination()
    return spark.read.parquet(f"{path}/table").select("user_id", "event_type")


@query("st5_stream_usage", """WITH p(model, usd_in, usd_out) AS (VALUES ('click', 3.0, 15.0), ('view', 0.5, 1.5))
SELECT CAST(ts AS DATE) AS day, event_type AS model, count(*) AS calls, round(CAST(sum((user_id * coalesce(usd_in, 0.0) + user_id * 2 * coalesce(usd_out, 0.0)) / 1e6) AS DOUBLE), 6) AS cost FROM events LEFT JOIN p ON model = event_type GROUP BY ALL""")
def st5(spark, d):
    path = t.scratch(spark, "stream-usage")
    prices = spark.createDataFrame([("click", 3.0, 15.0), ("view", 0.5, 1.5)], "model string, usd_in double, usd_out double")
    spans = _stream(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("model"), F.col("user_id").alias("tokens_in"), (F.col("user_id") * 2).alias("tokens_out"))
    ingest.stream_upsert(ingest.stream_usage(spans, prices, delay="3650 days"), f"{path}/table", ["day", "model"], f"{path}/state").awaitTermination()
    return ingest.current_table(spark, f"{path}/table").select("day", "model", "calls", "cost")


@query("st5_spend_alerts", """WITH p(model, usd_in, usd_out) AS (VALUES ('click', 3.0, 15.0), ('view', 0.5, 1.5)),
e AS (SELECT CAST(ts AS DATE) AS day, ts, CAST((user_id * coalesce(usd_in, 0.0) + user_id * 2 * coalesce(usd_out, 0.0)) / 1e6 AS DOUBLE) AS cost, event_id % 10 = 3 AND ts < (SELECT max(ts) FROM events) - INTERVAL 5 DAY AS late FROM events LEFT JOIN p ON model = event_type),
d AS (SELECT day, count(*) AS calls, sum(cost) AS cost FROM e WHERE NOT late GROUP BY ALL), l AS (SELECT sum(cost) / count(DISTINCT day) AS most FROM e), n AS (SELECT count(*) FILTER (WHERE late) AS dropped, max(ts) FILTER (WHERE NOT late) - INTERVAL 1 DAY AS mark FROM e)
SELECT day, 'alert' AS kind, calls, round(cost, 6) AS cost, dropped FROM d, l, n WHERE cost > most
UNION ALL SELECT day, 'total', calls, round(cost, 6), dropped FROM d, n WHERE CAST(day + 1 AS TIMESTAMP) <= mark""")
def st5b(spark, d):
    """Three loads: the first ten days, the days after them, and then rows that come days too late and are dropped and counted."""
    path = t.scratch(spark, "stream-alerts")
    prices = spark.createDataFrame([("click", 3.0, 15.0), ("view", 0.5, 1.5)], "model string, usd_in double, usd_out double")
    rows = t.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("model"), F.col("user_id").alias("tokens_in"), (F.col("user_id") * 2).alias("tokens_out"), "event_id")
    priced = rows.join(prices, "model", "left").select("ts", ((F.col("tokens_in") * F.coalesce("usd_in", F.lit(0.0)) + F.col("tokens_out") * F.coalesce("usd_out", F.lit(0.0))) / 1e6).alias("cost"))
    first, last, total, days = priced.agg(F.min("ts"), F.max("ts"), F.sum("cost"), F.count_distinct(F.to_date("ts"))).first()
    late = (F.col("event_id") % 10 == 3) & (F.col("ts") < F.lit(last - dt.timedelta(days=5)))
    early = F.col("ts") < F.lit(dt.datetime.combine(first.date() + dt.timedelta(days=10), dt.time()))
    loads = [~late & early, ~late & ~early, late]
    for load in loads:
        rows.where(load).drop("event_id").write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(rows.drop("event_id").schema).parquet(f"{path}/in")
        query = alerts.write_batches(alerts.stream_spend(stream, prices, limit=total / days), f"{path}/out", f"{path}/state")
        query.awaitTermination()
    out = alerts.read_batches(spark, f"{path}/out")
    cost = F.round(F.col("cost") * 1e6) / 1e6  # the double itself, as SQL rounds it; F.round("cost", 6) rounds its shortest decimals
    return out.select("day", "kind", "calls", cost.alias("cost"), F.lit(alerts.dropped_late(query)).cast("long").alias("dropped"))


@query("s16_feature_collections", "SELECT event_id, value AS lon, user_id AS lat, event_type AS kind FROM events WHERE event_id % 5 <> 0")
def s16b(spark, d):
    """Points written as feature collections by the data source, some without a place, and read again in parts with the kind pushed to the reader."""
    features.register(spark)
    path = t.scratch(spark, "features")
    e = t.table(spark, d, "events")
    properties = F.map_from_arrays(F.array(F.lit("event_id"), F.lit("kind")), F.array(F.col("event_id").cast("string"), F.col("event_type")))
    placed = F.col("event_id") % 5 != 0
    e.select(properties.alias("properties"), F.when(placed, "Point").alias("kind"), F.when(placed, F.to_json(F.array(F.col("value"), F.col("user_id").cast("double")))).alias("coordinates")).write.format("features").mode("overwrite").save(path)
    rows = spark.read.format("features").option("part_bytes", 1 << 16).load(path).where("kind = 'Point'")
    at = F.from_json("coordinates", "array<double>")
    return rows.select(F.col("properties")["event_id"].cast("long").alias("event_id"), at[0].alias("lon"), at[1].cast("long").alias("lat"), F.col("properties")["kind"].alias("kind"))
