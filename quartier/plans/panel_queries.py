"""Queries of sources, keys, panel, space and series."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import dates, keys, numbers
from ..operators import aggregates, cover, joins, panel_store, ranking, series, spatial
from ..sources import normalize, store
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


@query("a1_weekly_labels", f"WITH {t.LABELS} SELECT * FROM labels")
def a1(spark, d):
    return t.labels(spark, d)


@query("a2_weekly_permits", f"WITH {t.ITEMS} SELECT * FROM permits")
def a2(spark, d):
    return t.permits(spark, d)


@query("a2_weekly_pests", f"WITH {t.ITEMS} SELECT * FROM pests")
def a2b(spark, d):
    return t.pests(spark, d)


@query("a3_weekly_weather", f"WITH {t.WEATHER} SELECT * FROM weather")
def a3(spark, d):
    return t.weather(spark, d)


@query("a4_static_profile", f"WITH {t.STATIC} SELECT * FROM static")
def a4(spark, d):
    return t.static(spark, d)


@query("j6_build_panel", f"WITH {t.PANEL} SELECT * FROM panel")
def j6(spark, d):
    return t.panel(spark, d)


@query("j6_incremental_panel", f"""WITH {t.LABELS}, {t.COMPLAINTS}
SELECT l.nta_id, l.week_start, l.total_count, l.positive_count, round(l.positive_count / l.total_count, 4) AS positive_rate, l.positive_count > 0 AS positive_ind, coalesce(c.complaints_count, 0) AS complaints_count,
  b.total_count AS total_count_lag_1w, e.total_count AS total_count_lag_4w, k.total_count AS total_count_lag_12w
FROM labels l LEFT JOIN comp c USING (nta_id, week_start) LEFT JOIN labels b ON b.nta_id = l.nta_id AND b.week_start = l.week_start - 7
LEFT JOIN labels e ON e.nta_id = l.nta_id AND e.week_start = l.week_start - 28 LEFT JOIN labels k ON k.nta_id = l.nta_id AND k.week_start = l.week_start - 84""")
def j6b(spark, d):
    """Three loads: orders to the end of 1997, later ones, and those of spring 1996 once more, as corrections come."""
    at = t.scratch(spark, "panel")
    rows = t.inspections(spark, d)
    for number, mine in enumerate((F.col("d") < "1998-01-01", F.col("d") >= "1998-01-01", F.col("d").between("1996-03-01", "1996-05-31"))):
        panel_store.load(rows.where(mine), at, number, ["o_orderkey"], "d", weekly_panel)
    return spark.read.parquet(f"{at}/panel").select("nta_id", "week_start", *[c for c in PANEL_COLUMNS])


PANEL_COLUMNS = ["total_count", "positive_count", "positive_rate", "positive_ind", "complaints_count", "total_count_lag_1w", "total_count_lag_4w", "total_count_lag_12w"]


def weekly_panel(facts):
    """Panel rows of inspections, with lags by calendar, so that a row depends on the weeks of its lags alone."""
    counted = aggregates.weekly_counts(facts, "nta_id", "d", {"positive_count": F.col("result") == "F", "complaints_count": F.col("o_orderpriority") == "1-URGENT"})
    return joins.build_panel(series.lags(counted, "total_count", mode="calendar"), {})


@query("j5_attach_area", f"WITH {t.INSPECTIONS} SELECT nta_id, result, count(*) AS n FROM insp GROUP BY ALL")
def j5(spark, d):
    return t.inspections(spark, d).groupBy("nta_id", "result").agg(F.count(F.lit(1)).alias("n"))


@query("w1_lags_by_row", f"WITH {t.INSPECTIONS}, {t.COMPLAINTS} SELECT * FROM complaints")
def w1(spark, d):
    return t.complaints(spark, d)


@query("w1_lags_by_calendar", f"""WITH {t.INSPECTIONS}, {t.COMPLAINTS} SELECT a.nta_id, a.week_start, a.complaints_count, b.complaints_count AS complaints_count_lag_1w,
  c.complaints_count AS complaints_count_lag_4w FROM comp a LEFT JOIN comp b ON a.nta_id = b.nta_id AND a.week_start = b.week_start + 7
  LEFT JOIN comp c ON a.nta_id = c.nta_id AND a.week_start = c.week_start + 28""")
def w1b(spark, d):
    base = t.complaints(spark, d).select("nta_id", "week_start", "complaints_count")
    return series.lags(base, "complaints_count", (1, 4), mode="calendar")


@query("f6_regime_flags", f"""WITH {t.LABELS} SELECT week_start, count(*) AS n, week_start BETWEEN DATE '1996-03-01' AND DATE '1996-06-30' AS closed,
  week_start >= DATE '1998-01-01' AS open_ended, false AS never FROM labels GROUP BY ALL""")
def f6(spark, d):
    regimes = (("closed", "1996-03-01", "1996-06-30"), ("open_ended", "1998-01-01", None), ("never", None, None))
    weeks = t.labels(spark, d).groupBy("week_start").agg(F.count(F.lit(1)).alias("n"))
    return dates.regime_flags(weeks, regimes=regimes)


@query("f7_safe_rate", """SELECT l_suppkey, round(CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) / nullif(count(*) FILTER (WHERE l_linestatus = 'F'), 0), 4) AS rate,
  count(*) FILTER (WHERE l_returnflag = 'R') > 0 AS ind FROM lineitem GROUP BY ALL""")
def f7(spark, d):
    c = t.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("a"), F.count_if(F.col("l_linestatus") == "F").alias("b"))
    return c.select("l_suppkey", numbers.safe_rate(F.col("a"), F.col("b")).alias("rate"), numbers.indicator(F.col("a")).alias("ind"))


@query("f1_normalize_key", """SELECT c_custkey, CASE WHEN regexp_matches(c_name, '[1-9]') THEN lpad(right(regexp_replace(c_name, '[^0-9]', '', 'g'), 10), 10, '0') END AS key FROM customer""")
def f1(spark, d):
    return t.table(spark, d, "customer").select("c_custkey", keys.normalize_key(F.col("c_name")).alias("key"))


@query("f2_resolve_key", """WITH k AS (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS key,
  CASE WHEN c_nationkey = 0 THEN '0000000000' WHEN c_nationkey % 3 = 0 THEN lpad(CAST(c_nationkey AS VARCHAR), 10, '0') END AS billing FROM customer)
SELECT c_custkey, CASE WHEN c_custkey = 0 THEN NULL WHEN billing IS NOT NULL AND billing <> '0000000000' THEN billing ELSE key END AS effective FROM k""")
def f2(spark, d):
    n = F.col("c_nationkey")
    billing = F.when(n == 0, "0000000000").when(n % 3 == 0, keys.normalize_key(n))
    return t.table(spark, d, "customer").select("c_custkey", keys.resolve_key(keys.normalize_key(F.col("c_custkey")), billing).alias("effective"))


@query("f3_week_start", "SELECT event_id, CAST(date_trunc('week', ts) AS DATE) AS week_start FROM events")
def f3(spark, d):
    return t.table(spark, d, "events").select("event_id", dates.week_start(F.col("ts")).alias("week_start"))


@query("f5_degree_days", f"""WITH {t.WEATHER} SELECT date, round(greatest(18.0 - tavg_c, 0.0), 4) AS hdd, round(greatest(tavg_c - 18.0, 0.0), 4) AS cdd FROM daily""")
def f5(spark, d):
    heating, cooling = numbers.degree_days(F.col("tavg_c"))
    return t.daily(spark, d).select("date", heating.alias("hdd"), cooling.alias("cdd"))


@query("f8_encode_prefix", "SELECT c_custkey, CASE left(c_mktsegment, 2) WHEN 'AU' THEN 1 WHEN 'BU' THEN 2 WHEN 'FU' THEN 3 ELSE 0 END AS code FROM customer")
def f8(spark, d):
    return t.table(spark, d, "customer").select("c_custkey", keys.encode_prefix(F.col("c_mktsegment"), {"AU": 1, "BU": 2, "FU": 3}).alias("code"))


@query("f9_bbox_coverage", f"""WITH {t.POINTS} SELECT count(*) AS "rows", round(avg(CASE WHEN lon BETWEEN 1 AND 4 AND lat BETWEEN 0.5 AND 5 THEN 1 ELSE 0 END), 6) AS coverage FROM points""")
def f9(spark, d):
    inside = F.when(numbers.in_bbox(F.col("lon"), F.col("lat"), (1, 0.5, 4, 5)), F.col("lon"))
    return numbers.coverage(t.points(spark, d).select(inside.alias("x")), "x")


@query("f10_centroid", "SELECT n_nationkey AS nta_id, n_nationkey % 5 + 0.5 AS lon, n_nationkey // 5 + 0.5 AS lat FROM nation")
def f10(spark, d):
    return t.squares(spark, d).select("nta_id", numbers.centroid(F.col("rings")).alias("c")).select("nta_id", "c.lon", "c.lat")


@query("f11_hashes", "SELECT item_id, sha256(text) AS version_hash FROM benchmark")
def f11(spark, d):
    return t.table(spark, d, "benchmark").select("item_id", keys.version_hash(F.col("text")).alias("version_hash"))


@query("f12_uuid5", """WITH h AS (SELECT item_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(text)) AS d FROM benchmark)
SELECT item_id, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(d, 17, 1)) - 1) % 4 + 1, 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS id FROM h""")
def f12(spark, d):
    import uuid

    return t.table(spark, d, "benchmark").select("item_id", keys.uuid5(uuid.NAMESPACE_URL, F.col("text")).alias("id"))


@query("f18_clip", "SELECT c_custkey, round(least(greatest(c_acctbal / 5000, 0.0), 1.0), 6) AS score FROM customer")
def f18(spark, d):
    return t.table(spark, d, "customer").select("c_custkey", numbers.round6(numbers.clip01(F.col("c_acctbal") / 5000)).alias("score"))


@query("f26_week_calendar", """WITH e AS (SELECT min(ts) AS a, max(ts) AS b FROM events), w AS (SELECT unnest(generate_series(CAST(date_trunc('week', a) AS TIMESTAMP), CAST(CAST(b AS DATE) AS TIMESTAMP), INTERVAL 7 DAY)) AS s FROM e)
SELECT CAST(w.s AS DATE) AS week_start, count(event_id) AS n FROM w LEFT JOIN events ON CAST(date_trunc('week', ts) AS TIMESTAMP) = w.s GROUP BY ALL""")
def f26(spark, d):
    events = t.week_of_events(spark, d)
    a, b = events.agg(F.min("ts").cast("date"), F.max("ts").cast("date")).first()
    counts = events.groupBy("week_start").agg(F.count(F.lit(1)).alias("n"))
    return dates.week_calendar(spark, a, b).join(counts, "week_start", "left").fillna(0, subset=["n"])


@query("f27_risk_tier", f"WITH {t.SCORED} SELECT doc_id, CASE WHEN p > 0.7 THEN 'high' WHEN p > 0.4 THEN 'medium' ELSE 'low' END AS tier FROM scored")
def f27(spark, d):
    return t.scored(spark, d).select("doc_id", numbers.risk_tier(F.col("p")).alias("tier"))


@query("s3_normalize_restaurants", """SELECT CAST(l_suppkey AS VARCHAR) || '_' || strftime(l_shipdate, '%Y-%m-%d') || '_' || upper(trim(l_returnflag)) AS record_id,
  l_returnflag = 'R' AS is_pest_violation, count(*) AS n FROM lineitem GROUP BY ALL""")
def s3(spark, d):
    raw = t.table(spark, d, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("camis"), F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss").alias("inspection_date"),
        F.concat(F.lit(" "), F.lower("l_returnflag")).alias("violation_code"),
    )
    return normalize.normalize_restaurants(raw, ("R",)).groupBy("record_id", "is_pest_violation").agg(F.count(F.lit(1)).alias("n"))


@query("s1_normalize_inspections", """SELECT CAST(o_orderkey AS VARCHAR) AS inspection_id, CAST(o_orderdate AS DATE) AS inspection_date,
  CASE WHEN o_custkey > 0 THEN lpad(CAST(o_custkey AS VARCHAR), 10, '0') END AS bbl, o_custkey = 0 AS raw_bbl_missing, o_orderstatus AS result FROM orders WHERE o_orderkey % 10 <> 0""")
def s1(spark, d):
    raw = t.table(spark, d, "orders").select(
        F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderkey").cast("string")).alias("inspectionid"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("inspectiondate"),
        F.col("o_custkey").cast("string").alias("bbl"), F.col("o_orderstatus").alias("result"),
    )
    return normalize.normalize_inspections(raw).select("inspection_id", "inspection_date", "bbl", "raw_bbl_missing", "result")


@query("s9_read_page", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 10")
def s9(spark, d):
    return normalize.read_page(t.table(spark, d, "customer"), "c_acctbal > 0", ["-c_acctbal", "c_custkey"], ["c_custkey", "c_acctbal"], 20, 10)


@query("s10_retain_last", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) - 365")
def s10(spark, d):
    orders = t.table(spark, d, "orders")
    today = orders.agg(F.max("o_orderdate").cast("date")).first()[0]
    return normalize.retain_last(orders, "o_orderdate", 365, F.lit(today)).select("o_orderkey")


@query("s11_upsert", """WITH s AS (SELECT c_custkey + 50 AS c_custkey, max_by(struct_pack(n := c_nationkey, b := c_acctbal * 2), c_acctbal) AS r FROM customer WHERE c_custkey % 2 = 0 GROUP BY ALL)
SELECT coalesce(c.c_custkey, s.c_custkey) AS c_custkey, CASE WHEN s.c_custkey IS NOT NULL THEN r.n ELSE c_nationkey END AS c_nationkey,
  CASE WHEN s.c_custkey IS NOT NULL THEN r.b ELSE c_acctbal END AS c_acctbal FROM customer c FULL JOIN s ON c.c_custkey = s.c_custkey""")
def s11(spark, d):
    target = t.table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    source = target.where("c_custkey % 2 = 0").withColumns({"c_custkey": F.col("c_custkey") + 50, "c_acctbal": F.col("c_acctbal") * 2})
    return store.upsert(target, source, ["c_custkey"])


@query("s12_upsert_add", """WITH b AS (SELECT l_suppkey, l_quantity FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_suppkey, l_quantity FROM lineitem WHERE l_linestatus = 'O')
SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS quantity FROM b GROUP BY ALL""")
def s12(spark, d):
    items = t.table(spark, d, "lineitem")
    part = lambda c: items.where(c).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))
    return store.upsert_add(part("l_returnflag = 'R'"), part("l_linestatus = 'O'"), ["l_suppkey"], ["n", "quantity"])


@query("s13_incremental", "SELECT event_id, user_id FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'")
def s13(spark, d):
    cursor = spark.createDataFrame([("events", dt.datetime(2024, 1, 20), 0)], "source string, value timestamp, rows long")
    return store.incremental(t.table(spark, d, "events"), cursor, "events", "ts")[0].select("event_id", "user_id")


@query("s8_resolve_columns", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def s8(spark, d):
    return normalize.resolve_columns(t.table(spark, d, "nation"), {"id": ["nation_id", "N Nation Key"], "name": ["N_NAME"]})


@query("s16_to_geojson", """SELECT '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || (n_nationkey % 5 + 0.5) || ',' || (n_nationkey // 5 + 0.5) || ']},"properties":{"nta_id":' || n_nationkey || ',"name":"' || n_name || '"}}' AS feature FROM nation""")
def s16(spark, d):
    c = t.squares(spark, d).select("nta_id", "name", numbers.centroid(F.col("rings")).alias("c"))
    return store.to_geojson(c.select("nta_id", "name", "c.lon", "c.lat"))


@query("j1_within_join", f"WITH {t.POINTS} SELECT o_orderkey, CAST(floor(lon) + 5 * floor(lat) AS INTEGER) AS nta_id FROM points WHERE lon < 5 AND lat < 5")
def j1(spark, d):
    return spatial.within_join(t.points(spark, d), t.squares(spark, d), 1.0).select("o_orderkey", "nta_id")


@query("j1_within_cover", """WITH hot AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 2.315 ELSE (o_orderkey * 37 % 600) / 100.0 + 0.005 END AS lon,
  CASE WHEN o_orderkey % 3 = 0 THEN 1.7525 ELSE (o_orderkey * 53 % 600) / 100.0 + 0.0025 END AS lat FROM orders)
SELECT o_orderkey, n_nationkey AS nta_id FROM hot JOIN nation ON abs(lon - n_nationkey % 5 - 0.5) + abs(lat - n_nationkey // 5 - 0.5) < 0.5 + 0.25 * (n_nationkey % 3)""")
def j1c(spark, d):
    """Diamonds of three sizes, which overlap, and a third of the points at one place."""
    k = F.col("n_nationkey")
    x, y, r = (k % 5) + 0.5, F.floor(k / 5) + 0.5, (k % 3) * 0.25 + 0.5
    corner = lambda i, j: F.struct((x + i * r).alias("x"), (y + j * r).alias("y"))
    areas = t.table(spark, d, "nation").select(k.alias("nta_id"), F.array(F.array(corner(1, 0), corner(0, 1), corner(-1, 0), corner(0, -1))).alias("rings"))
    o = F.col("o_orderkey")
    places = t.table(spark, d, "orders").select(
        "o_orderkey", F.when(o % 3 == 0, 2.315).otherwise((o * 37 % 600) / 100.0 + 0.005).alias("lon"), F.when(o % 3 == 0, 1.7525).otherwise((o * 53 % 600) / 100.0 + 0.0025).alias("lat")
    )
    return cover.within_cover(places, cover.cover(areas)).select("o_orderkey", "nta_id")


@query("j2_fill_area", f"""WITH {t.POINTS} SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN -1 WHEN lon < 5 AND lat < 5 THEN CAST(floor(lon) + 5 * floor(lat) AS INTEGER) END AS nta_id FROM points""")
def j2(spark, d):
    rows = t.points(spark, d).withColumn("nta_id", F.when(F.col("o_orderkey") % 2 == 0, F.lit(-1)))
    return spatial.fill_area(rows, t.squares(spark, d), cell=1.0).select("o_orderkey", "nta_id")


ADJACENT = """adj AS (SELECT a.n_nationkey AS src, b.n_nationkey AS dst FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey
  AND abs(a.n_nationkey % 5 - b.n_nationkey % 5) <= 1 AND abs(a.n_nationkey // 5 - b.n_nationkey // 5) <= 1)"""


@query("j3_queen_adjacency", f"WITH {ADJACENT} SELECT * FROM adj")
def j3(spark, d):
    return spatial.adjacency_edges(t.squares(spark, d))


@query("j4_spatial_lag", f"""WITH {t.PANEL}, {ADJACENT}, lag1 AS (SELECT src AS nta_id, week_start + 7 AS week_start, avg(positive_rate) AS v FROM adj JOIN panel ON dst = nta_id GROUP BY ALL),
lag4 AS (SELECT src AS nta_id, week_start + 28 AS week_start, avg(complaints_count) AS v FROM adj JOIN panel ON dst = nta_id GROUP BY ALL)
SELECT p.nta_id, p.week_start, round(lag1.v, 9) AS neighbor_rate, round(lag4.v, 9) AS neighbor_complaints FROM panel p
LEFT JOIN lag1 USING (nta_id, week_start) LEFT JOIN lag4 USING (nta_id, week_start)""")
def j4(spark, d):
    rate = joins.build_panel(t.labels(spark, d), {"c": t.complaints(spark, d)}, ["complaints_count"]).select("nta_id", "week_start", "positive_rate", "complaints_count")
    out = spatial.spatial_lag(rate, spatial.adjacency_edges(t.squares(spark, d)), [("positive_rate", 1, "neighbor_rate"), ("complaints_count", 4, "neighbor_complaints")])
    return out.select("nta_id", "week_start", F.round("neighbor_rate", 9).alias("neighbor_rate"), F.round("neighbor_complaints", 9).alias("neighbor_complaints"))


XWALK = """x AS (SELECT l_partkey AS src, l_suppkey AS dst, CAST(sum(l_quantity) AS DOUBLE) AS w FROM lineitem GROUP BY ALL),
xwalk AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS weight FROM x)"""


def _crosswalk(spark, d):
    raw = t.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.sum("l_quantity").cast("double").alias("weight"))
    return spatial.normalize_crosswalk(raw)


@query("j7_normalize_crosswalk", f"WITH {XWALK} SELECT src, dst, weight FROM xwalk")
def j7(spark, d):
    return _crosswalk(spark, d)


@query("j8_allocate", f"WITH {XWALK} SELECT dst, round(sum(p_retailprice * weight), 4) AS value FROM part JOIN xwalk ON p_partkey = src GROUP BY ALL")
def j8(spark, d):
    values = t.table(spark, d, "part").select(F.col("p_partkey").alias("src"), F.col("p_retailprice").alias("value"))
    return spatial.allocate(values, _crosswalk(spark, d)).withColumn("value", F.round("value", 4))


@query("j9_crosswalk_gaps", f"WITH {XWALK} SELECT 'missing' AS kind, s_suppkey + 20 AS id FROM supplier WHERE s_suppkey + 20 NOT IN (SELECT dst FROM xwalk)")
def j9(spark, d):
    ids = t.table(spark, d, "supplier").select((F.col("s_suppkey") + 20).alias("s"))
    return spatial.crosswalk_gaps(_crosswalk(spark, d), ids, "s").select("kind", "id")


@query("j10_rollup_weighted", f"""WITH {XWALK} SELECT dst, round(sum(p_retailprice * weight), 4) AS price, round(sum(p_size * weight), 4) AS size, lpad(CAST(dst AS VARCHAR), 6, '0') AS id FROM part JOIN xwalk ON p_partkey = src GROUP BY ALL""")
def j10(spark, d):
    values = t.table(spark, d, "part").select(F.col("p_partkey").alias("src"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"))
    out = spatial.rollup_weighted(values, _crosswalk(spark, d), ["price", "size"])
    return out.select("dst", F.round("price", 4).alias("price"), F.round("size", 4).alias("size"), spatial.padded_id((F.col("dst"), 6)).alias("id"))


def _requests(spark, d):
    c = t.table(spark, d, "customer").where("c_nationkey IS NOT NULL")
    return c.select("c_custkey", F.col("c_nationkey").alias("nta_id"), F.date_add(F.lit("1995-01-02").cast("date"), (F.col("c_custkey") % 400 * 7).cast("int")).alias("week_start"))


REQUESTS = "req AS (SELECT c_custkey, c_nationkey AS nta_id, DATE '1995-01-02' + CAST(c_custkey % 400 * 7 AS INTEGER) AS week_start FROM customer WHERE c_nationkey IS NOT NULL)"


@query("j11_row_or_latest", f"""WITH {t.LABELS}, {REQUESTS}, latest AS (SELECT nta_id, max(week_start) AS w FROM labels GROUP BY ALL)
SELECT c_custkey, coalesce(e.week_start, l.week_start) AS row_week, coalesce(e.total_count, l.total_count) AS total_count, e.week_start IS NOT NULL AS is_exact
FROM req r LEFT JOIN labels e ON r.nta_id = e.nta_id AND r.week_start = e.week_start JOIN latest m ON m.nta_id = r.nta_id JOIN labels l ON l.nta_id = m.nta_id AND l.week_start = m.w""")
def j11(spark, d):
    return joins.asof_latest(_requests(spark, d), t.labels(spark, d)).select("c_custkey", "row_week", "total_count", "is_exact")


@query("j11_asof_past", f"""WITH {t.LABELS}, {REQUESTS} SELECT c_custkey, l.week_start AS row_week, l.total_count, l.week_start = r.week_start AS is_exact
FROM req r ASOF JOIN labels l ON r.nta_id = l.nta_id AND r.week_start >= l.week_start""")
def j11b(spark, d):
    out = joins.asof_latest(_requests(spark, d), t.labels(spark, d), allow_future=False)
    return out.select("c_custkey", "row_week", "total_count", "is_exact")


@query("j12_latest_valid", """SELECT user_id, max_by(event_id, ts) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE value > 50)
WHERE r = 1 GROUP BY ALL""")
def j12(spark, d):
    rows = t.table(spark, d, "events").select("user_id", "ts", "event_id", "value")
    return joins.latest_valid(rows, ["user_id"], "ts", F.col("value") > 50).select("user_id", "event_id")


@query("j13_cached_or_compute", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN -1.0 ELSE c_custkey * 2.0 END AS score FROM customer")
def j13(spark, d):
    wanted = t.table(spark, d, "customer").select("c_custkey")
    cache = wanted.where("c_custkey % 3 = 0").withColumn("score", F.lit(-1.0))
    return joins.cached_or_compute(cache, wanted, ["c_custkey"], lambda k: k.withColumn("score", F.col("c_custkey") * 2.0))


@query("j14_enrich", "SELECT s_suppkey, s_nationkey AS nta_id, n_name AS name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def j14(spark, d):
    s = t.table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nta_id"))
    return joins.enrich(s, t.squares(spark, d).select("nta_id", "name"))


@query("j18_bias_frame", f"WITH {t.LABELS} SELECT nta_id, week_start, positive_count, n_name AS name FROM labels JOIN nation ON nta_id = n_nationkey")
def j18(spark, d):
    return joins.bias_frame(t.labels(spark, d), t.squares(spark, d).select("nta_id", "name")).select("nta_id", "week_start", "positive_count", "name")


@query("a5_area_week_counts", f"""WITH {t.POINTS} SELECT CAST(floor(lon) + 5 * floor(lat) AS INTEGER) AS nta_id, CAST(date_trunc('week', inspection_date) AS DATE) AS week_start, count(*) AS n
FROM points WHERE lon < 5 AND lat < 5 GROUP BY ALL""")
def a5(spark, d):
    return aggregates.weekly_counts(spatial.within_join(t.points(spark, d), t.squares(spark, d), 1.0), "nta_id", "inspection_date", {}, total="n")


@query("a6_area_profile", f"WITH {t.LABELS} SELECT nta_id, round(avg(positive_count), 6) AS positive_count_mean, CAST(sum(total_count) AS BIGINT) AS total_count_sum, count(*) AS weeks FROM labels GROUP BY ALL HAVING sum(total_count) >= 50")
def a6(spark, d):
    return aggregates.area_profile(t.labels(spark, d), "nta_id", "positive_count", "total_count", 50).withColumn("positive_count_mean", F.round("positive_count_mean", 6))


@query("a14_median_composite", """SELECT l_suppkey AS area, year(l_shipdate) * 10 + quarter(l_shipdate) AS quarter, l_linenumber AS band, 0 AS y, 0 AS x, quantile_cont(l_extendedprice, 0.5) AS value, count(*) AS n_obs
FROM lineitem WHERE l_returnflag = 'N' AND l_quantity < 20 GROUP BY ALL""")
def a14(spark, d):
    items = t.table(spark, d, "lineitem")
    pixels = items.select(
        F.col("l_suppkey").alias("area"), (F.year("l_shipdate") * 10 + F.quarter("l_shipdate")).alias("quarter"), F.col("l_linenumber").alias("band"), F.lit(0).alias("y"), F.lit(0).alias("x"),
        F.col("l_extendedprice").alias("value"), F.when(F.col("l_returnflag") == "N", 4).otherwise(9).alias("scl"), F.col("l_quantity").alias("cloud"),
    )
    return aggregates.median_composite(pixels)


@query("a22_min_support", f"WITH {t.LABELS} SELECT * FROM labels WHERE total_count >= 3")
def a22(spark, d):
    return aggregates.min_support(t.labels(spark, d), "total_count", 3)


@query("w3_regularize", f"""WITH {t.LABELS}, span AS (SELECT nta_id, min(week_start) AS a, max(week_start) AS b FROM labels GROUP BY ALL),
weeks AS (SELECT nta_id, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS week_start FROM span)
SELECT nta_id, week_start, coalesce(total_count, 0) AS total_count, coalesce(positive_count, 0) AS positive_count FROM weeks LEFT JOIN labels USING (nta_id, week_start)""")
def w3(spark, d):
    return series.regularize(t.labels(spark, d))


@query("w2_fill_series", f"""WITH {t.LABELS}, g AS (SELECT nta_id, week_start, CASE WHEN total_count % 3 = 0 THEN NULL ELSE total_count END AS v FROM labels)
SELECT nta_id, week_start, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY nta_id ORDER BY week_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(v IGNORE NULLS) OVER (PARTITION BY nta_id ORDER BY week_start ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS v FROM g""")
def w2(spark, d):
    g = t.labels(spark, d).select("nta_id", "week_start", F.when(F.col("total_count") % 3 != 0, F.col("total_count")).alias("v"))
    return series.fill_series(g, ["v"])


@query("w4_static_last", "SELECT nta_id, arg_max(total_count, week_start) AS total_count FROM labels_w WHERE n >= 52 GROUP BY ALL".replace("labels_w", f"(WITH {t.LABELS} SELECT *, count(*) OVER (PARTITION BY nta_id) AS n FROM labels)"))
def w4(spark, d):
    return series.static_last(series.min_length(t.labels(spark, d)), ["total_count"])


@query("w5_tail_split", f"WITH {t.LABELS} SELECT nta_id, week_start, CASE WHEN row_number() OVER (PARTITION BY nta_id ORDER BY week_start DESC) <= 12 THEN 'test' ELSE 'train' END AS role FROM labels QUALIFY count(*) OVER (PARTITION BY nta_id) > 12")
def w5(spark, d):
    return series.tail_split(t.labels(spark, d)).select("nta_id", "week_start", "role")


@query("w8_extend_known", f"""WITH {t.LABELS}, last AS (SELECT nta_id, max(week_start) AS w, arg_max(total_count, week_start) AS total_count FROM labels GROUP BY ALL)
SELECT nta_id, w + CAST(7 * i AS INTEGER) AS week_start, total_count FROM last, range(1, 13) r(i)""")
def w8(spark, d):
    return series.extend_known(t.labels(spark, d).select("nta_id", "week_start", "total_count"))


@query("w11_relative_share", "SELECT l_orderkey, l_linenumber, CAST(round(100 * l_quantity / max(l_quantity) OVER (PARTITION BY l_orderkey)) AS INTEGER) AS share_pct FROM lineitem")
def w11(spark, d):
    rows = t.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return series.relative_share(rows, "l_orderkey", "l_quantity").drop("l_quantity")


@query("w10_series_bundle", f"""WITH {t.LABELS} SELECT nta_id, array_to_string(list(total_count ORDER BY week_start), ',') AS target, array_to_string(list(positive_count ORDER BY week_start), ',') AS past FROM labels GROUP BY ALL""")
def w10(spark, d):
    b = series.series_bundle(t.labels(spark, d), "total_count", ["positive_count"], ["total_count"], ["positive_count"])
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return b.select("nta_id", text("target").alias("target"), text("past.positive_count").alias("past"))


@query("t1_recent_in_area", f"""WITH {t.POINTS} SELECT o_orderkey, inspection_date FROM points WHERE floor(lon) = 2 AND floor(lat) = 2 AND inspection_date >= DATE '1997-01-01' ORDER BY inspection_date DESC, o_orderkey LIMIT 50""")
def t1(spark, d):
    return ranking.recent_in_area(t.points(spark, d), t.squares(spark, d), 12, dt.date(1997, 1, 1), 50, cell=1.0).select("o_orderkey", "inspection_date")


@query("t2_top_areas", f"WITH {t.LABELS} SELECT nta_id, total_count FROM labels WHERE week_start = DATE '1996-06-03' ORDER BY total_count DESC, nta_id LIMIT 5")
def t2(spark, d):
    return ranking.top_n(t.labels(spark, d).where("week_start = DATE '1996-06-03'"), [], ["-total_count", "nta_id"], 5).select("nta_id", "total_count")


@query("t4_top_per_group", "SELECT c_nationkey, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rank FROM customer QUALIFY rank <= 3")
def t4(spark, d):
    return ranking.top_n(t.table(spark, d, "customer"), ["c_nationkey"], ["-c_acctbal", "c_custkey"], 3).select("c_nationkey", "c_custkey", "rank")


@query("t5_latest_weeks", f"WITH {t.LABELS} SELECT DISTINCT week_start FROM labels ORDER BY week_start DESC LIMIT 12")
def t5(spark, d):
    return ranking.latest_weeks(t.labels(spark, d))


@query("t7_missing_ids", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def t7(spark, d):
    return ranking.missing_ids(t.table(spark, d, "customer"), t.table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("t7_shared_dates", "SELECT CAST(o_orderdate AS DATE) AS d FROM orders INTERSECT SELECT CAST(l_shipdate AS DATE) FROM lineitem")
def t7b(spark, d):
    a, b = (t.table(spark, d, n).select(F.col(c).cast("date").alias("d")) for n, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate")))
    return ranking.shared_dates(a, b, "d")


@query("s2_normalize_complaints", "SELECT CAST(o_orderdate AS DATE) AS created_date, CAST(o_orderkey % 100 AS DOUBLE) AS lon, 1.5 AS lat FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 7 <> 0".replace("1.5 AS lat", "CAST(1.5 AS DOUBLE) AS lat"))
def s2(spark, d):
    raw = t.table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("complaint_type"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("created_date"),
        F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_orderkey") % 100).cast("string")).alias("longitude"), F.lit("1.5").alias("latitude"),
    )
    return normalize.normalize_complaints(raw, "1-URGENT")


@query("s4_normalize_permits", """SELECT source, count(*) AS n, count(DISTINCT permit_key) AS keys FROM (SELECT 'now' AS source, 'dob_now_' || o_orderkey || '_' || strftime(o_orderdate, '%Y-%m-%d') AS permit_key FROM orders
UNION ALL SELECT 'legacy', 'old_' || l_orderkey || '_' || strftime(l_shipdate, '%Y-%m-%d') FROM lineitem WHERE l_linestatus = 'F') GROUP BY ALL""")
def s4(spark, d):
    day = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    a = t.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("job_filing_number"), day("o_orderdate").alias("issued_date"))
    b = t.table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("job__"), F.when(F.col("l_linestatus") == "F", day("l_shipdate")).alias("issuance_date"), F.col("l_linestatus").alias("job_type"))
    out = normalize.normalize_permits({"dob_now": a, "old": b})
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("permit_key").alias("keys"))


@query("s5_normalize_lots", "SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS bbl, CAST(floor(abs(c_acctbal)) AS INTEGER) AS unitsres, left(c_mktsegment, 2) AS landuse, CAST(c_nationkey AS VARCHAR) AS nta2020 FROM customer WHERE c_custkey > 0")
def s5(spark, d):
    raw = t.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("bbl"), F.col("c_acctbal").cast("string").alias("unitsres"), F.col("c_mktsegment").alias("landuse"), F.col("c_nationkey").cast("string").alias("nta2020"))
    return normalize.normalize_lots(raw).select("bbl", "unitsres", "landuse", "nta2020")


@query("s6_normalize_weather", f"WITH {t.WEATHER} SELECT date, round(tavg_c, 6) AS tavg_c, prcp_mm, round(greatest(18.0 - tavg_c, 0.0), 4) AS hdd, round(greatest(tavg_c - 18.0, 0.0), 4) AS cdd FROM daily")
def s6(spark, d):
    out = normalize.normalize_weather(t.daily(spark, d).withColumnsRenamed({"date": "time", "tavg_c": "tavg", "prcp_mm": "prcp"}))
    return out.withColumn("tavg_c", F.round("tavg_c", 6))
