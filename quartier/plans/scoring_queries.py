"""Queries of metrics, deciles, models and forecasts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import aggregates, forecast, joins, models, ranking, series, validation
from ..sources import store
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


@query("m1_holdout_split", f"WITH {t.LABELS} SELECT nta_id, week_start, CASE WHEN week_start > (SELECT max(week_start) FROM labels) - 84 THEN 'test' ELSE 'train' END AS role FROM labels")
def m1(spark, d):
    return validation.holdout_split(t.labels(spark, d)).select("nta_id", "week_start", "role")


@query("m1_holdout_distinct_weeks", f"""WITH {t.LABELS}, w AS (SELECT DISTINCT week_start FROM labels ORDER BY 1 DESC LIMIT 12)
SELECT nta_id, week_start, CASE WHEN week_start >= (SELECT min(week_start) FROM w) THEN 'test' ELSE 'train' END AS role FROM labels""")
def m1b(spark, d):
    return validation.holdout_split(t.labels(spark, d), by="distinct_weeks").select("nta_id", "week_start", "role")


@query("m2_expanding_folds", f"""WITH {t.LABELS}, e AS (SELECT max(week_start) AS b FROM labels), f AS (SELECT i AS fold, b - CAST(28 * (4 - i) AS INTEGER) AS val_end FROM e, range(5) r(i)),
g AS (SELECT fold, val_end, val_end - 21 AS val_start, val_end - 49 AS train_end FROM f)
SELECT CAST(fold AS INTEGER) AS fold, CASE WHEN week_start <= train_end THEN 'train' ELSE 'val' END AS role, count(*) AS n, min(week_start) AS first, max(week_start) AS last
FROM labels JOIN g ON week_start <= train_end OR week_start BETWEEN val_start AND val_end GROUP BY ALL""")
def m2(spark, d):
    folds = validation.expanding_folds(t.labels(spark, d))
    return folds.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("week_start").alias("first"), F.max("week_start").alias("last"))


@query("m4_average_precision", f"""WITH {t.SCORED}, g AS (SELECT lang, p, count(*) AS n, sum(y) AS pos FROM scored GROUP BY ALL),
c AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp FROM g WINDOW w AS (PARTITION BY lang ORDER BY p DESC))
SELECT lang, round(coalesce(sum(pos * cp / cn) / nullif(sum(pos), 0), 0), 6) AS average_precision FROM c GROUP BY ALL""")
def m4(spark, d):
    out = validation.average_precision(t.scored(spark, d), "y", "p", ["lang"])
    return out.withColumn("average_precision", F.round("average_precision", 6))


@query("m5_roc_auc", f"""WITH {t.SCORED}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM scored)
SELECT round((sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS roc_auc FROM r""")
def m5(spark, d):
    return validation.roc_auc(t.scored(spark, d), "y", "p").withColumn("roc_auc", F.round("roc_auc", 6))


@query("m6_brier", f"WITH {t.SCORED} SELECT lang, round(avg((p - y) * (p - y)), 6) AS brier FROM scored GROUP BY ALL")
def m6(spark, d):
    return validation.brier(t.scored(spark, d), "y", "p", ["lang"]).withColumn("brier", F.round("brier", 6))


@query("m7_top_decile_lift", f"""WITH {t.SCORED}, r AS (SELECT *, row_number() OVER (ORDER BY p DESC, doc_id) AS r, count(*) OVER () AS n FROM scored)
SELECT round((sum(y) FILTER (WHERE r <= greatest(1, n // 10)) / max(greatest(1, n // 10))) / (sum(y) / count(*)), 6) AS top_decile_lift FROM r""")
def m7(spark, d):
    return validation.top_decile_lift(t.scored(spark, d), "y", "p", "doc_id").withColumn("top_decile_lift", F.round("top_decile_lift", 6))


@query("m8_calibration", f"""WITH {t.SCORED} SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS mean_y, round(abs(avg(p) - avg(y)), 6) AS gap FROM scored GROUP BY ALL""")
def m8(spark, d):
    out = validation.calibration(t.scored(spark, d), "y", "p")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_p", "mean_y", "gap")})


@query("m9_metric_bundle", f"""WITH {t.SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY p DESC, doc_id) AS r, rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2.0 AS k,
  count(*) OVER (PARTITION BY lang) AS n FROM scored)
SELECT lang, round((sum(k) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0), 6) AS roc_auc, round(avg((p - y) * (p - y)), 6) AS brier,
  round(coalesce((sum(y) FILTER (WHERE r <= greatest(1, n // 10)) / max(greatest(1, n // 10))) / nullif(sum(y) / count(*), 0), 0), 6) AS top_decile_lift FROM r GROUP BY ALL""")
def m9(spark, d):
    out = validation.metric_bundle(t.scored(spark, d), "y", "p", "doc_id", ["lang"])
    return out.select("lang", *[F.round(c, 6).alias(c) for c in ("roc_auc", "brier", "top_decile_lift")])


THRESHOLDS = f"{t.SCORED}, th AS (SELECT quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM scored)"


@query("a9_decile_thresholds", f"WITH {THRESHOLDS} SELECT CAST(i AS INTEGER) AS decile, round(q[i], 6) AS threshold FROM th, range(1, 11) r(i)")
def a9(spark, d):
    th = aggregates.decile_thresholds(t.scored(spark, d), "p")
    return th.select(F.posexplode("thresholds").alias("i", "v")).select((F.col("i") + 1).alias("decile"), F.round("v", 6).alias("threshold"))


@query("w6_decile_ceil", f"WITH {THRESHOLDS} SELECT doc_id, CAST(least(len(list_filter(q, lambda x: x < p)) + 1, 10) AS INTEGER) AS decile FROM scored, th")
def w6(spark, d):
    s = t.scored(spark, d)
    return aggregates.assign_decile(s, "p", aggregates.decile_thresholds(s, "p")).select("doc_id", "decile")


@query("w6_decile_floor", f"WITH {THRESHOLDS} SELECT doc_id, CAST(greatest(len(list_filter(q, lambda x: x <= p)), 1) AS INTEGER) AS decile FROM scored, th")
def w6b(spark, d):
    s = t.scored(spark, d)
    return aggregates.assign_decile(s, "p", aggregates.decile_thresholds(s, "p"), "floor").select("doc_id", "decile")


@query("a10_decile_histogram", f"""WITH {THRESHOLDS}, a AS (SELECT CAST(least(len(list_filter(q, lambda x: x < p)) + 1, 10) AS INTEGER) AS decile FROM scored, th)
SELECT CAST(i AS INTEGER) AS decile, count(a.decile) AS n, (SELECT count(*) FROM a WHERE decile >= 8) AS high_risk FROM range(1, 11) r(i) LEFT JOIN a ON a.decile = i GROUP BY i""")
def a10(spark, d):
    return aggregates.decile_histogram(w6(spark, d))


@query("a7_profile", """SELECT 'orders' AS "table", count(*) AS "rows", count(DISTINCT o_orderkey) AS keys, CAST(min(o_orderdate) AS DATE) AS first_date, CAST(max(o_orderdate) AS DATE) AS last_date,
  round(100.0 * count(*) FILTER (WHERE o_custkey IS NULL) / count(*), 2) AS null_custkey FROM orders""")
def a7(spark, d):
    out = aggregates.profile(t.table(spark, d, "orders"), "orders", "o_orderdate", ["o_custkey"], ["o_orderkey"])
    return out.withColumn("null_custkey", F.col("null_pct")["o_custkey"]).drop("null_pct")


@query("a8_unmatched_report", """WITH s AS (SELECT 'a' AS source, o_custkey % 7 = 0 AS bad FROM orders UNION ALL SELECT 'b', l_suppkey % 5 = 0 FROM lineitem)
SELECT source, count(*) AS total, count(*) FILTER (WHERE bad) AS unmatched, CAST(round(100.0 * count(*) FILTER (WHERE bad) / count(*), 2) AS DOUBLE) AS pct FROM s GROUP BY ALL""")
def a8(spark, d):
    a = t.table(spark, d, "orders").select(F.col("o_custkey").alias("raw"), F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("key"))
    b = t.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("raw"), F.when(F.col("l_suppkey") % 5 != 0, F.col("l_suppkey")).alias("key"))
    return aggregates.unmatched_report({"a": a, "b": b}, "raw", "key")


def _ranks(*cols):
    return ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}" for c in cols)


@query("a11_spearman", f"""WITH r AS (SELECT {_ranks('p_size', 'p_retailprice', 'n')} FROM (SELECT p_size, p_retailprice, length(p_name) AS n FROM part))
SELECT 'p_size' AS x, 'p_retailprice' AS y, round(corr(r_p_size, r_p_retailprice), 6) AS rho FROM r UNION ALL SELECT 'p_size', 'n', round(corr(r_p_size, r_n), 6) FROM r
UNION ALL SELECT 'p_retailprice', 'n', round(corr(r_p_retailprice, r_n), 6) FROM r""")
def a11(spark, d):
    part = t.table(spark, d, "part").withColumn("n", F.length("p_name"))
    return aggregates.spearman_matrix(part, ["p_size", "p_retailprice", "n"], "p_partkey")


@query("a12_ols", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, regr_count(l_extendedprice, l_quantity)::BIGINT AS n FROM lineitem GROUP BY ALL")
def a12(spark, d):
    out = aggregates.ols(t.table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return out.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), "n")


@query("a13_box_stats", """WITH q AS (SELECT c_mktsegment, quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.5) AS median, quantile_cont(c_acctbal, 0.75) AS q3, count(*) AS n FROM customer GROUP BY ALL)
SELECT c_mktsegment, n, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, min(c_acctbal) AS whisker_low, max(c_acctbal) AS whisker_high
FROM customer JOIN q USING (c_mktsegment) WHERE c_acctbal BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL""")
def a13(spark, d):
    out = aggregates.box_stats(t.table(spark, d, "customer"), "c_acctbal", "c_mktsegment")
    return out.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


@query("a15_score_distribution", "SELECT user_id, min(value) AS score_min, round(quantile_cont(value, 0.5), 6) AS score_median, max(value) AS score_max, count(*) AS n FROM events GROUP BY ALL")
def a15(spark, d):
    return aggregates.score_distribution(t.table(spark, d, "events"), "user_id", "value").withColumn("score_median", F.round("score_median", 6))


@query("a16_mean_abs_contribution", "SELECT event_type AS feature, round(avg(abs(value - 50)), 6) AS mean_abs FROM events GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 3")
def a16(spark, d):
    rows = t.table(spark, d, "events").select(F.col("event_type").alias("feature"), (F.col("value") - 50).alias("contribution"))
    return aggregates.mean_abs_contribution(rows, 3).withColumn("mean_abs", F.round("mean_abs", 6))


@query("a17_cv_summary", "SELECT event_type AS model, round(avg(value), 6) AS value_mean, round(stddev_pop(value), 6) AS value_std, count(*) AS folds FROM events GROUP BY ALL")
def a17(spark, d):
    out = aggregates.cv_summary(t.table(spark, d, "events").withColumnRenamed("event_type", "model"), "model", ["value"])
    return out.withColumns({c: F.round(c, 6) for c in ("value_mean", "value_std")})


@query("a18_prevalence", f'WITH {t.LABELS} SELECT count(*) AS "rows", round(avg(CAST(positive_count > 0 AS INTEGER)), 6) AS prevalence, min(week_start) AS first, max(week_start) AS last FROM labels')
def a18(spark, d):
    rows = t.labels(spark, d).withColumn("y", (F.col("positive_count") > 0).cast("int"))
    return aggregates.prevalence(rows, "y", "week_start").withColumn("prevalence", F.round("prevalence", 6))


@query("a19_usage_cost", """WITH p(model, usd_in, usd_out) AS (VALUES ('click', 3.0, 15.0), ('view', 0.5, 1.5)),
m AS (SELECT CAST(ts AS DATE) AS day, event_type AS model, count(*) AS calls, CAST(sum(user_id) AS BIGINT) AS tokens_in, CAST(sum(user_id * 2) AS BIGINT) AS tokens_out,
  CAST(sum((user_id * coalesce(usd_in, 0.0) + user_id * 2 * coalesce(usd_out, 0.0)) / 1e6) AS DECIMAL(10, 6)) AS cost FROM events LEFT JOIN p ON model = event_type GROUP BY ALL)
SELECT day, model, calls, tokens_in, tokens_out, CAST(cost AS DOUBLE) AS cost, sum(cost) OVER (PARTITION BY day) > 0.02 AS over_limit FROM m""")
def a19(spark, d):
    prices = spark.createDataFrame([("click", 3.0, 15.0), ("view", 0.5, 1.5)], "model string, usd_in double, usd_out double")
    spans = t.table(spark, d, "events").select("ts", F.col("event_type").alias("model"), F.col("user_id").alias("tokens_in"), (F.col("user_id") * 2).alias("tokens_out"))
    return aggregates.usage_cost(spans, prices, 0.02).withColumn("cost", F.col("cost").cast("double"))


@query("a21_prediction_coverage", f'WITH {t.LABELS} SELECT count(*) AS "rows", count(DISTINCT nta_id) AS areas, min(week_start) AS first_week, max(week_start) AS last_week, CAST(25 * 345 AS BIGINT) AS expected, round(count(*) / (25 * 345), 6) AS coverage FROM labels')
def a21(spark, d):
    return aggregates.prediction_coverage(t.labels(spark, d), 25, 345)


@query("w7_quantile_bins", """WITH e AS (SELECT list_sort(list_distinct(quantile_cont(p_size, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS q FROM part)
SELECT p_partkey, CAST(len(list_filter(q[2:-2], lambda x: x < p_size)) AS INTEGER) AS bin FROM part, e""")
def w7(spark, d):
    return series.quantile_bins(t.table(spark, d, "part").select("p_partkey", "p_size"), "p_size").select("p_partkey", "bin")


@query("w9_flat_forecast", f"""WITH {t.SCORED} SELECT doc_id, DATE '2024-01-01' + CAST(7 * i AS INTEGER) AS forecast_week, round(greatest(p - 0.05, 0.0), 6) AS ci_low, round(p, 6) AS score, round(least(p + 0.05, 1.0), 6) AS ci_high, true AS is_stub
FROM scored, range(1, 13) r(i)""")
def w9(spark, d):
    s = t.scored(spark, d).select("doc_id", F.lit("2024-01-01").cast("date").alias("week_start"), F.col("p").alias("score"))
    return series.flat_forecast(s, key="doc_id")


@query("f24_feature_matrix", f"WITH {t.LABELS} SELECT nta_id, week_start, left(CAST(nta_id AS VARCHAR), 2) AS borough, CAST(total_count AS DOUBLE) AS total_count, CAST(positive_count > 0 AS DOUBLE) AS ind, 0.0 AS absent FROM labels".replace("CAST(positive_count > 0 AS DOUBLE)", "CAST(CAST(positive_count > 0 AS INTEGER) AS DOUBLE)").replace("0.0 AS absent", "CAST(0 AS DOUBLE) AS absent"))
def f24(spark, d):
    rows = t.labels(spark, d).withColumn("ind", numbers.indicator(F.col("positive_count")))
    return series.fill_missing(series.feature_matrix(rows, ["total_count", "ind", "absent"]), ["absent"])


def _oofs(spark, d):
    base = t.labels(spark, d).select("nta_id", "week_start", F.round(F.col("positive_count") / F.col("total_count"), 6).alias("score"))
    return {"trees": base.where("total_count % 4 <> 0"), "series": base.where("total_count % 3 = 0").withColumn("score", F.col("score") / 2)}


@query("j15_meta_features", f"""WITH {t.LABELS}, b AS (SELECT nta_id, week_start, total_count, round(positive_count / total_count, 6) AS s FROM labels)
SELECT nta_id, week_start, s AS trees, CASE WHEN total_count % 3 = 0 THEN s / 2 ELSE s END AS series, total_count % 3 <> 0 AS series_fallback FROM b WHERE total_count % 4 <> 0""")
def j15(spark, d):
    out = joins.meta_features(t.labels(spark, d), _oofs(spark, d), "trees")
    return out.select("nta_id", "week_start", "trees", "series", "series_fallback")


@query("t6_union_results", f"WITH {t.LABELS}, b AS (SELECT total_count, round(positive_count / total_count, 6) AS s FROM labels) SELECT 'trees' AS model, count(*) AS n, round(avg(s), 6) AS score FROM b WHERE total_count % 4 <> 0 UNION ALL SELECT 'series', count(*), round(avg(s / 2), 6) FROM b WHERE total_count % 3 = 0")
def t6(spark, d):
    return ranking.union_results(_oofs(spark, d)).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("score"))


@query("t3_top_factors", "SELECT l_orderkey, array_to_string(list(l_linenumber ORDER BY abs(l_quantity - 25) DESC, CAST(l_linenumber AS VARCHAR))[:2], ',') AS top FROM lineitem GROUP BY ALL")
def t3(spark, d):
    f = F.struct(F.col("l_linenumber").cast("string").alias("feature"), (F.col("l_quantity") - 25).alias("contribution"))
    rows = t.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(f).alias("f"))  # an order has a few lines
    return ranking.top_factors(rows, "f", 2).select("l_orderkey", F.array_join(F.transform("top_factors", lambda x: x["feature"]), ",").alias("top"))


def _series(spark, d):
    """Daily event counts by type, read as weekly steps."""
    rows = t.table(spark, d, "events").groupBy(F.col("event_type").alias("nta_id"), F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("nta_id", F.date_add(F.lit("2020-01-06").cast("date"), 7 * F.datediff("day", F.lit("2024-01-01"))).alias("week_start"), (F.col("n") / 200).alias("v"))


SERIES = "s AS (SELECT event_type AS nta_id, DATE '2020-01-06' + CAST(7 * (CAST(ts AS DATE) - DATE '2024-01-01') AS INTEGER) AS week_start, count(*) / 200 AS v FROM events GROUP BY ALL)"


@query("p1_forecast", f"""WITH {SERIES}, d AS (SELECT *, v - lag(v) OVER (PARTITION BY nta_id ORDER BY week_start) AS r, row_number() OVER (PARTITION BY nta_id ORDER BY week_start DESC) AS k FROM s),
f AS (SELECT nta_id, max(week_start) AS w, avg(v) AS m, quantile_cont(r, [0.1, 0.5, 0.9]) AS q FROM d WHERE k <= 20 GROUP BY ALL HAVING count(*) >= 20)
SELECT f.nta_id, CAST(i AS INTEGER) AS step, w + CAST(7 * i AS INTEGER) AS forecast_week, round(least(greatest(coalesce(s.v, m) + q[1], 0), 1), 6) AS p10,
  round(least(greatest(coalesce(s.v, m) + q[2], 0), 1), 6) AS p50, round(least(greatest(coalesce(s.v, m) + q[3], 0), 1), 6) AS p90
FROM f CROSS JOIN range(1, 13) r(i) LEFT JOIN s ON s.nta_id = f.nta_id AND s.week_start = w + CAST(7 * i AS INTEGER) - 70""")
def p1(spark, d):
    return forecast.forecast(_series(spark, d), "nta_id", "week_start", "v", context=20, season=10)


@query("p2_summarize_draws", "SELECT user_id, round(q[1], 6) AS p10, round(q[2], 6) AS p50, round(q[3], 6) AS p90 FROM (SELECT user_id, quantile_cont(value, [0.1, 0.5, 0.9]) AS q FROM events GROUP BY ALL)")
def p2(spark, d):
    out = forecast.summarize_draws(t.table(spark, d, "events"), ["user_id"])
    return out.select("user_id", *[F.round(c, 6).alias(c) for c in ("p10", "p50", "p90")])


@query("p3_backtest_mae", f"""WITH {SERIES} SELECT round(avg(abs(a.v - b.v)), 6) AS mae, count(*) AS n FROM s a JOIN s b ON a.nta_id = b.nta_id AND b.week_start = a.week_start + 7""")
def p3(spark, d):
    s = _series(spark, d)
    fc = s.select("nta_id", F.date_add("week_start", 7).alias("forecast_week"), F.col("v").alias("p50"))
    out = forecast.backtest_mae(fc, s.select("nta_id", F.col("week_start").alias("forecast_week"), F.col("v").alias("actual")), "nta_id")
    return out.withColumn("mae", F.round("mae", 6))


def _stepwise(source: str) -> str:
    """CTEs of forecasts by step over a table (nta_id, week_start, v), as ``bands``."""
    return f"""b AS (SELECT nta_id, week_start AS w, v, avg(v) OVER (PARTITION BY nta_id ORDER BY week_start ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS lv,
  row_number() OVER (PARTITION BY nta_id ORDER BY week_start DESC) AS k FROM {source}), r AS (SELECT CAST(i AS INTEGER) AS i FROM range(1, 9) x(i)),
e AS (SELECT a.nta_id, i, a.v - o.lv AS p, a.v - o.lv - (p.v - q.lv) AS s FROM b a CROSS JOIN r JOIN b o ON o.nta_id = a.nta_id AND o.w = a.w - 7 * i
  LEFT JOIN b p ON p.nta_id = a.nta_id AND p.w = a.w - 56 LEFT JOIN b q ON q.nta_id = a.nta_id AND q.w = o.w - 56 WHERE a.k <= 20),
g AS (SELECT nta_id, i, quantile_cont(p, [0.1, 0.5, 0.9]) AS qp, count(p) AS np, quantile_cont(s, [0.1, 0.5, 0.9]) AS qs, count(s) AS ns FROM e GROUP BY ALL HAVING count(p) >= 4),
h AS (SELECT g.nta_id, g.i, l.w, l.lv, ns >= 4 AND p.v - q.lv IS NOT NULL AS own, l.lv + (p.v - q.lv) AS ahead, CASE WHEN own THEN qs ELSE qp END AS q, CASE WHEN own THEN ns ELSE np END AS n
  FROM g JOIN b l ON l.nta_id = g.nta_id AND l.k = 1 LEFT JOIN b p ON p.nta_id = g.nta_id AND p.w = l.w + 7 * g.i - 56 LEFT JOIN b q ON q.nta_id = g.nta_id AND q.w = l.w - 56),
c AS (SELECT nta_id, r.i, max(h.i) AS j FROM h JOIN r ON h.i <= r.i GROUP BY ALL HAVING min(h.i) = 1),
bands AS (SELECT c.nta_id, c.i AS step, h.w + 7 * c.i AS forecast_week, CASE WHEN own AND c.i = c.j THEN ahead ELSE lv END AS f, q, n AS n_errors FROM c JOIN h ON h.nta_id = c.nta_id AND h.i = c.j),
fc AS (SELECT nta_id, step, forecast_week, round(least(greatest(f + q[1], 0), 1), 6) AS p10, round(least(greatest(f + q[2], 0), 1), 6) AS p50, round(least(greatest(f + q[3], 0), 1), 6) AS p90, n_errors FROM bands)"""


@query("p1_forecast_by_step", f"WITH {SERIES}, {_stepwise('s')} SELECT * FROM fc")
def p1b(spark, d):
    return forecast.forecast_by_step(_series(spark, d), "nta_id", "week_start", "v", 8, season=8, origins=20, least=4)


@query("p3_backtest_bands", f"""WITH {SERIES}, t AS (SELECT *, row_number() OVER (PARTITION BY nta_id ORDER BY week_start DESC) AS back FROM s), past AS (SELECT * FROM t WHERE back > 8), {_stepwise('past')}
SELECT step, count(*) AS n, round(avg(CAST(v BETWEEN p10 AND p90 AS INTEGER)), 6) AS covered, round(avg(p90 - p10), 7) AS width, round(avg(abs(p50 - v)), 7) AS mae
FROM fc JOIN t ON t.nta_id = fc.nta_id AND t.week_start = fc.forecast_week AND back <= 8 GROUP BY ALL""")
def p3b(spark, d):
    out = forecast.backtest_bands(_series(spark, d), "nta_id", "week_start", "v", 8, season=8, origins=20, least=4)
    return out.withColumns({c: F.round(c, n) for c, n in (("covered", 6), ("width", 7), ("mae", 7))})


@query("p4_count_to_prob", f"WITH {SERIES}, m AS (SELECT nta_id, avg(v) AS m FROM s GROUP BY ALL) SELECT nta_id, round(m / max(m) OVER (), 6) AS score FROM m")
def p4(spark, d):
    return forecast.count_to_prob(_series(spark, d).withColumnRenamed("v", "p50"), "nta_id").withColumn("score", F.round("score", 6))


@query("p5_materialize_forecast", f"WITH {SERIES} SELECT count(DISTINCT nta_id) + 1 AS series, CAST(1 AS BIGINT) AS failed FROM s")
def p5(spark, d):
    s = _series(spark, d)
    wanted = s.select("nta_id").distinct().unionByName(spark.range(1).select(F.lit("none").alias("nta_id")))
    return forecast.materialize_forecast(p1(spark, d), dt.date(2020, 8, 1), "v1", wanted, "nta_id")[1]


@query("p6_forecast_for")
def p6(spark, d):
    fc = p1(spark, d).withColumn("as_of", F.lit("2020-08-01").cast("date"))
    requests = _series(spark, d).groupBy("nta_id").agg(F.max("week_start").alias("week_start"), F.avg("v").alias("score"))
    return forecast.forecast_for(requests.unionByName(requests.limit(1).withColumn("nta_id", F.lit("none"))), fc)


FEATURES = ["complaints_count", "complaints_count_lag_1w", "weather_tavg_c", "weather_prcp_mm", "units_total"]


def _training(spark, d):
    parts = {"c": t.complaints(spark, d), "w": t.weather(spark, d), "s": t.static(spark, d)}
    rows = joins.build_panel(t.labels(spark, d), parts, ["complaints_count"]).withColumn("y", F.col("positive_ind").cast("double"))
    rows = rows.withColumns({c: F.col(c).cast("double") for c in FEATURES}).withColumn("row", F.concat_ws("|", "nta_id", "week_start"))
    return t.stored(validation.holdout_split(rows.select("nta_id", "week_start", "row", "y", *FEATURES)), "training")


@query("l5_train_and_evaluate")
def l5(spark, d):
    rows = _training(spark, d)
    train, test = (rows.where(F.col("role") == r).drop("role") for r in ("train", "test"))
    metrics, _, _ = models.train_and_evaluate(train, test, FEATURES, "y", models.fit_logistic, "row", "logistic")
    return models.ablation_table(metrics)


@query("l10_materialize_scores")
def l10(spark, d):
    rows = _training(spark, d)
    model = models.fit_gbt(rows.where("role = 'train'"), FEATURES, "y", rounds=20)
    return models.materialize_scores(rows.drop("role"), model, "v1", FEATURES)


@query("l6_group_models")
def l6(spark, d):
    rows = _training(spark, d).withColumn("borough", (F.col("nta_id") % 5).cast("int"))
    common = models.fit_logistic(rows.where("role = 'train'"), FEATURES, "y")  # for groups without a model
    rows = models.positive_score(common.transform(rows), "prior")
    out = models.group_models(rows.where("role = 'train'").drop("role"), rows.where("role = 'test'").drop("role"), "borough", FEATURES, "y", fallback="prior", date="week_start")
    return out.select("row", "borough", "status", F.round("score", 6).alias("score"))


@query("l3_categories", "WITH c AS (SELECT c_mktsegment, CAST(row_number() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_custkey % 2 = 0)) SELECT c_custkey, coalesce(code, -1) AS code FROM customer LEFT JOIN c USING (c_mktsegment)")
def l3(spark, d):
    c = t.table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return models.apply_categories(c, models.fit_categories(c.where("c_custkey % 2 = 0"), "c_mktsegment"), "c_mktsegment", "code").select("c_custkey", "code")


@query("l11_pca_embeddings")
def l11(spark, d):
    out, _ = models.pca_embeddings(t.table(spark, d, "embeddings"), "embedding", 8, "vec_id")
    return out.select("vec_id", F.round(F.abs(F.col("pca")[0]), 4).alias("first"))


@query("f4_quarters", """WITH e AS (SELECT min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders), q AS (SELECT CAST(unnest(generate_series(CAST(date_trunc('quarter', a) AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 3 MONTH)) AS DATE) AS f, b FROM e)
SELECT year(f) || '-Q' || quarter(f) AS quarter, f AS first_day, least(last_day(CAST(f + INTERVAL 2 MONTH AS DATE)), b) AS last_day FROM q""")
def f4(spark, d):
    from ..functions.dates import quarters_between

    a, b = t.table(spark, d, "orders").agg(F.min("o_orderdate").cast("date"), F.max("o_orderdate").cast("date")).first()
    return quarters_between(spark, a, b, b)


def _pixels(spark, d):
    """Each supplier is an image of line items: line number across, quantity down."""
    return t.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("area"), F.lit("q").alias("quarter"), (F.col("l_linenumber") % 3).alias("band"), F.col("l_quantity").cast("int").alias("y"), F.col("l_linenumber").alias("x"), F.col("l_extendedprice").alias("value"),
        F.when(F.col("l_returnflag") == "N", 4).otherwise(9).alias("scl"), F.col("l_quantity").alias("cloud"),
    )


@query("f20_band_zscore", """WITH p AS (SELECT l_suppkey AS area, l_linenumber % 3 AS band, l_extendedprice AS value FROM lineitem), s AS (SELECT band, avg(value) AS m, stddev_pop(value) AS sd FROM p GROUP BY ALL)
SELECT area, band, count(*) AS n, round(sum((value - m) / (sd + 1e-6)), 4) AS total FROM p JOIN s USING (band) GROUP BY ALL""")
def f20(spark, d):
    pixels = _pixels(spark, d)
    stats = pixels.groupBy("band").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return aggregates.band_zscore(pixels, stats).groupBy("area", "band").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("f21_centre_crop", """WITH p AS (SELECT l_suppkey AS area, CAST(l_quantity AS INTEGER) AS y, l_linenumber AS x FROM lineitem), e AS (SELECT area, greatest(0, CAST(floor((max(y) + 1 - 4) / 2) AS INTEGER)) AS y0, greatest(0, CAST(floor((max(x) + 1 - 4) / 2) AS INTEGER)) AS x0 FROM p GROUP BY ALL)
SELECT area, CAST(y - y0 AS BIGINT) AS y, CAST(x - x0 AS BIGINT) AS x, count(*) AS n FROM p JOIN e USING (area) WHERE y - y0 BETWEEN 0 AND 3 AND x - x0 BETWEEN 0 AND 3 GROUP BY ALL""")
def f21(spark, d):
    return aggregates.centre_crop(_pixels(spark, d), 4, ["area"]).groupBy("area", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).agg(F.count(F.lit(1)).alias("n"))


@query("a20_eval_summary", f"""WITH {t.SCORED}, i AS (SELECT lang, CASE WHEN y = 1 THEN p ELSE -1 END AS m FROM scored), b AS (SELECT * FROM i UNION ALL SELECT 'all', m FROM i)
SELECT lang AS "group", 'm' AS metric, round(avg(nullif(m, -1)), 6) AS mean, count(nullif(m, -1)) AS n, count(*) FILTER (WHERE m = -1) AS skipped, round(avg(nullif(m, -1)), 6) >= 0.4 AS passed FROM b GROUP BY ALL""")
def a20(spark, d):
    items = t.scored(spark, d).select("lang", F.when(F.col("y") == 1, F.col("p")).otherwise(F.lit(-1.0)).alias("m"))
    return aggregates.eval_summary(items, {"m": 0.4}, "lang")


@query("l1_logistic")
def l1(spark, d):
    rows = _training(spark, d)
    model = models.fit_logistic(rows.where("role = 'train'"), FEATURES, "y")
    return models.positive_score(model.transform(rows.where("role = 'test'"))).select("row", F.round("score", 4).alias("score"))


@query("l7_fusion")
def l7(spark, d):
    rows = _training(spark, d)
    train = rows.where("role = 'train'")
    model, isotonic = models.fit_fusion(train, FEATURES, "y", validation.holdout_split(train.drop("role")).where("role = 'test'"))
    return models.apply_fusion(rows.where("role = 'test'"), model, isotonic).select("row", "fused_class", F.round("fused_score", 4).alias("fused_score"))


@query("l8_mlp")
def l8(spark, d):
    rows = _training(spark, d)
    model = models.fit_mlp(rows.where("role = 'train'"), FEATURES, "y")
    return models.positive_score(model.transform(rows.where("role = 'test'"))).select("row", F.round("score", 4).alias("score"))


@query("l9_linear_attribution")
def l9(spark, d):
    rows = _training(spark, d)
    model = models.fit_logistic(rows.where("role = 'train'"), FEATURES, "y")
    out = models.linear_attribution(rows.where("role = 'test'"), model, FEATURES, 2)
    return out.select("row", F.explode("top_factors").alias("f")).select("row", "f.feature", F.round("f.contribution", 4).alias("contribution"))


@query("s17_out_of_fold", f"WITH {t.LABELS} SELECT nta_id || '|' || week_start AS key, round(positive_count / total_count, 6) AS value FROM labels")
def s17(spark, d):
    path = t.scratch(spark, "oof")
    store.write_oof(t.labels(spark, d).withColumn("score", F.col("positive_count") / F.col("total_count")), path)
    rows = store.read_oof(spark, path)
    return rows.select(F.concat_ws("|", "nta_id", F.col("week_start").cast("string")).alias("key"), F.round("score", 6).alias("value"))
