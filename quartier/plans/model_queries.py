"""Queries of model steps whose results SQL can state: calibration, batch scoring, group routing, stacking inputs and ablation tables."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import functions as F

from ..operators import aggregates, models, sketches, stacking, tree_attribution, validation
from . import scoring_queries
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


@query("l2_boosted_trees")
def l2(spark, d):
    rows = scoring_queries._training(spark, d).withColumn("area", (F.col("nta_id") % 5).cast("string"))
    model = models.fit_gbt(rows.where("role = 'train'"), [*scoring_queries.FEATURES, "area"], "y", category="area", rounds=5)
    return models.positive_score(model.transform(rows.where("role = 'test'"))).select("row", F.round("score", 6).alias("score"))


@query("l4_calibrate", f"""WITH {t.SCORED}, g AS (SELECT round(p, 2) AS p, count(*) AS n, sum(y) AS pos FROM scored GROUP BY ALL), o AS (SELECT *, row_number() OVER (ORDER BY p) AS i, sum(n) OVER (ORDER BY p) AS cn, sum(pos) OVER (ORDER BY p) AS cp FROM g),
a AS (SELECT lo.i AS j, hi.i AS k, (hi.cp - lo.cp + lo.pos) / (hi.cn - lo.cn + lo.n) AS m FROM o lo JOIN o hi ON lo.i <= hi.i),
f AS (SELECT o.i, o.p, a.j, min(a.m) AS m FROM o JOIN a ON a.j <= o.i AND a.k >= o.i GROUP BY ALL), fit AS (SELECT p, max(m) AS calibrated FROM f GROUP BY ALL)
SELECT doc_id, round(calibrated, 6) AS calibrated FROM scored JOIN fit ON round(scored.p, 2) = fit.p""")
def l4(spark, d):
    """The least-squares monotone fit: at each score the greatest, over starts before it, of the least mean up to ends after it."""
    rows = t.scored(spark, d).withColumn("p", F.round("p", 2))
    out = models.apply_calibration(rows, models.calibrate(rows, "y", "p"), "p")
    return out.select("doc_id", F.round("calibrated", 6).alias("calibrated"))


#: A model whose score SQL can repeat: complaints over complaints and five more.
FIXED = "SELECT *, complaints_count / (complaints_count + 5.0) AS p1, 1 - complaints_count / (complaints_count + 5.0) AS p0 FROM __THIS__"


def _fixed_model() -> PipelineModel:
    return PipelineModel(stages=[SQLTransformer(statement=FIXED), VectorAssembler(inputCols=["p0", "p1"], outputCol="probability")])


@query("l10_materialize_deciles", f"""WITH {t.LABELS}, {t.COMPLAINTS}, p AS (SELECT nta_id, week_start, coalesce(complaints_count, 0) AS c FROM labels LEFT JOIN complaints USING (nta_id, week_start)),
s AS (SELECT nta_id, week_start, round(c / (c + 5.0), 6) AS risk_score FROM p), q AS (SELECT quantile_cont(risk_score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM s)
SELECT nta_id, week_start, risk_score, CAST(least(len(list_filter(q, lambda x: x < risk_score)) + 1, 10) AS INTEGER) AS risk_decile, 'v2' AS model_version FROM s, q
UNION ALL SELECT nta_id, week_start, 0.25, 3, 'v1' FROM labels WHERE total_count > 2""")
def l10(spark, d):
    from ..operators import joins

    panel = joins.build_panel(t.labels(spark, d), {"c": t.complaints(spark, d)}, ["complaints_count"]).select("nta_id", "week_start", F.col("complaints_count").cast("double").alias("complaints_count"))
    labels = t.labels(spark, d)
    old = lambda rows, version: rows.select("nta_id", "week_start", F.lit(0.25).alias("risk_score"), F.lit(3).alias("risk_decile"), F.lit(version).alias("model_version"))
    # what is stored of the old version stays, and of the new one is written over
    stored = old(labels.where("total_count > 2"), "v1").unionByName(old(labels.where("total_count = 1"), "v2"))
    return models.materialize_scores(panel, _fixed_model(), "v2", ["complaints_count"], stored)


@query("l6_group_routing", f"""WITH {t.LABELS}, r AS (SELECT nta_id || '|' || week_start AS "row", nta_id % 5 AS borough, CASE WHEN positive_count > 0 THEN 1 ELSE 0 END AS y, week_start > (SELECT max(week_start) FROM labels) - 84 AS test FROM labels),
g AS (SELECT CASE WHEN borough = 4 THEN 9 ELSE borough END AS borough, count(*) AS n, count(DISTINCT CASE WHEN borough = 2 THEN 0 ELSE y END) AS classes FROM r WHERE NOT test GROUP BY ALL),
m AS (SELECT max(n) AS most FROM g)
SELECT "row", r.borough, CASE WHEN g.n IS NULL THEN 'skipped_no_training' WHEN g.n > most - 1 THEN 'skipped_too_large' WHEN classes < 2 THEN 'skipped_one_class' ELSE 'ok' END AS status,
  CASE WHEN coalesce(g.n <= most - 1 AND classes = 2, false) THEN NULL ELSE 0.5::DOUBLE END AS fallback FROM r LEFT JOIN g ON g.borough = r.borough, m WHERE test""")
def l6(spark, d):
    """Which groups get a model: one is too large, one has a single class, one has no training rows; those fall back."""
    rows = scoring_queries._training(spark, d).withColumn("borough", (F.col("nta_id") % 5).cast("int")).withColumn("prior", F.lit(0.5))
    train = rows.where("role = 'train'").withColumns({"y": F.when(F.col("borough") == 2, 0.0).otherwise(F.col("y")), "borough": F.when(F.col("borough") == 4, 9).otherwise(F.col("borough"))})
    most = train.groupBy("borough").count().agg(F.max("count")).first()[0]
    out = models.group_models(train.drop("role"), rows.where("role = 'test'").drop("role"), "borough", scoring_queries.FEATURES, "y", max_rows=most - 1, fallback="prior")
    return out.select("row", "borough", "status", F.when(F.col("status") != "ok", F.col("score")).alias("fallback"))


@query("l12_ablation_table", """WITH m AS (SELECT event_type AS model, user_id % 3 AS fold, avg(value) / 500 AS ap, max(value) / 500 AS auc FROM events GROUP BY ALL)
SELECT model, round(avg(ap) FILTER (WHERE fold < 2), 6) AS cv_mean, round(stddev_pop(ap) FILTER (WHERE fold < 2), 6) AS cv_std, round(max(ap) FILTER (WHERE fold = 2), 6) AS test_average_precision, round(max(auc) FILTER (WHERE fold = 2), 6) AS roc_auc FROM m GROUP BY ALL""")
def l12(spark, d):
    fold = (F.col("user_id") % 3).cast("int")
    m = t.table(spark, d, "events").groupBy(F.col("event_type").alias("model"), fold.alias("fold")).agg((F.avg("value") / 500).alias("average_precision"), (F.max("value") / 500).alias("roc_auc"))
    m = m.withColumns({"stage": F.when(F.col("fold") < 2, "cv").otherwise("test"), "brier": F.lit(0.1), "top_decile_lift": F.lit(1.0)})
    return models.ablation_table(m).select("model", *[F.round(c, 6).alias(c) for c in ("cv_mean", "cv_std", "test_average_precision", "roc_auc")])


@query("l5_cv_folds", f"""WITH {t.LABELS}, {t.COMPLAINTS}, e AS (SELECT max(week_start) - 84 AS b FROM labels), v AS (SELECT i AS fold, b - CAST(28 * (4 - i) AS INTEGER) AS val_end FROM e, range(5) r(i)),
r AS (SELECT fold, CASE WHEN positive_count > 0 THEN 1 ELSE 0 END AS y, coalesce(complaints_count, 0) AS c FROM labels LEFT JOIN complaints USING (nta_id, week_start) JOIN v ON week_start BETWEEN val_end - 21 AND val_end WHERE week_start <= (SELECT b FROM e))
SELECT 'fixed' AS model, 'cv' AS stage, CAST(fold AS INTEGER) AS fold, round(avg((c / (c + 5.0) - y) * (c / (c + 5.0) - y)), 6) AS brier FROM r GROUP BY ALL""")
def l5(spark, d):
    """Validation folds of a fitter that always gives the same model, so that SQL can repeat its scores."""
    rows = scoring_queries._training(spark, d)
    train, test = (rows.where(F.col("role") == r).drop("role") for r in ("train", "test"))
    metrics, _, _ = models.train_and_evaluate(train, test, ["complaints_count"], "y", lambda *_: _fixed_model(), "row", "fixed")
    return metrics.where("stage = 'cv'").select("model", "stage", "fold", F.round("brier", 6).alias("brier"))


@query("l7_meta_inputs", f"""WITH {t.SCORED} SELECT doc_id, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS fused_class FROM scored WHERE p <> 0.5""")
def l7(spark, d):
    """The threshold of the stacked class, with the identity as calibration."""
    rows = t.scored(spark, d).where("p <> 0.5")
    line = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "y double, p double")  # two points of the identity
    model = PipelineModel(stages=[SQLTransformer(statement="SELECT *, p AS p1, 1 - p AS p0 FROM __THIS__"), VectorAssembler(inputCols=["p0", "p1"], outputCol="probability")])
    return models.apply_fusion(rows, model, models.calibrate(line, "y", "p")).select("doc_id", "fused_class")


@query("m10_positive_share", f"WITH {t.SCORED} SELECT lang, count(*) AS n, round(avg(y), 6) AS share FROM scored GROUP BY ALL")
def m10(spark, d):
    """What the calibration bins add up to over all scores."""
    bins = validation.calibration(t.scored(spark, d), "y", "p", ["lang"], 7)
    return bins.groupBy("lang").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.col("mean_y")) / F.sum("n"), 6).alias("share"))


@query("l9_tree_attribution")
def l9b(spark, d):
    """The two leading features of each row's margin, by boosted trees with a category."""
    rows = scoring_queries._training(spark, d).withColumn("area", (F.col("nta_id") % 5).cast("string"))
    model = models.fit_gbt(rows.where("role = 'train'"), [*scoring_queries.FEATURES, "area"], "y", category="area", rounds=5)
    out = tree_attribution.tree_attribution(rows.where("role = 'test'"), model, 2)
    return out.select("row", F.explode("top_factors").alias("f")).select("row", "f.feature", F.round("f.contribution", 6).alias("contribution"))


@query("a9_thresholds_from_states")
def a9d(spark, d):
    """Tenths of all line items' prices from the states kept for each month in two loads, beside the exact ones."""
    path, tenths = t.scratch(spark, "states"), [i / 10 for i in range(1, 11)]
    rows = t.table(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("month"), "l_extendedprice", "l_linenumber")
    for load, part in enumerate((F.col("l_linenumber") <= 3, F.col("l_linenumber") > 3)):
        sketches.add_states(rows.where(part), path, load, "l_extendedprice", ["month"])
    kept = sketches.thresholds_from_states(sketches.read_states(spark, path, ["month"]), tenths)
    exact = aggregates.exact_quantiles(rows, "l_extendedprice", tenths, "exact")
    both = kept.crossJoin(exact)  # one row each
    return both.select("n", F.posexplode(F.arrays_zip("thresholds", "exact")).alias("tenth", "x")).select((F.col("tenth") + 1).alias("tenth"), "x.thresholds", "x.exact", "n")


@query("l7_stacking")
def l7b(spark, d):
    """Out-of-fold scores of two base models, a model over them that is calibrated on later weeks, and its scores of the test weeks."""
    rows = scoring_queries._training(spark, d)
    train, test = (rows.where(F.col("role") == r).drop("role") for r in ("train", "test"))
    trees = lambda r, f, y: models.fit_gbt(r, f, y, rounds=5)
    stack = stacking.fit_stack(train, scoring_queries.FEATURES, "y", {"line": models.fit_logistic, "trees": trees}, "trees", "row", n_folds=3)
    return stack.score(test, "row").select("row", "fused_class", *[F.round(c, 4).alias(c) for c in ("line", "trees", "fused_score")])
