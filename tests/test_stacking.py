import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartier.operators import models, stacking, validation


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(5)
    rows = []
    for week in range(70):
        for area in range(12):
            a, b = rng.normal(size=2)
            p = 1 / (1 + np.exp(-(1.5 * a + np.sign(b) * 1.2)))
            rows.append((area, dt.date(2022, 1, 3) + dt.timedelta(weeks=week), float(a), float(b), float(rng.random() < p)))
    return spark.createDataFrame(rows, "nta_id int, week_start date, a double, b double, y double")


def small_gbt(train, features, label):
    return models.fit_gbt(train, features, label, rounds=4)


def test_meta_rows_are_out_of_fold_and_calibration_is_later(spark, panel):
    split = validation.holdout_split(panel)
    train, test = (split.where(F.col("role") == r).drop("role") for r in ("train", "test"))
    learned = []

    def watched(rows, features, label):
        learned.append(rows.agg(F.max("week_start")).first()[0])
        return models.fit_logistic(rows, features, label)

    stack = stacking.fit_stack(train, ["a", "b"], "y", {"line": watched, "trees": small_gbt}, "line", "nta_id", n_folds=3)
    spans = {r.role: r for r in stack.rows.groupBy("role").agg(F.min("week_start").alias("first"), F.max("week_start").alias("last")).collect()}
    assert spans["train"].last < spans["calibrate"].first and spans["calibrate"].last < test.agg(F.min("week_start")).first()[0]
    starts = sorted(r.first for r in stack.rows.groupBy("fold").agg(F.min("week_start").alias("first")).collect())
    assert len(learned) == 4 and all(end < start for end, start in zip(learned[:3], starts, strict=True))  # no base model saw the weeks that it scores
    assert stack.rows.count() == stack.rows.select("nta_id", "week_start").distinct().count() == 3 * 4 * 12
    scored = stack.score(test, "nta_id")
    assert scored.count() == test.count() and scored.where("fused_class <> cast(fused_score >= 0.5 AS int)").isEmpty()
    joined = scored.join(test.select("nta_id", "week_start", "y"), ["nta_id", "week_start"])
    auc = {c: validation.roc_auc(joined, "y", c).first()[0] for c in ("fused", "line", "trees")}
    assert auc["fused"] > max(0.7, min(auc["line"], auc["trees"]))
    # the second model is the logistic one over the two scores
    want = models.fit_logistic(stack.rows.where("role = 'train'"), ["line", "trees"], "y")
    assert np.allclose(want.stages[-1].coefficients.toArray(), stack.fusion.stages[-1].coefficients.toArray(), atol=1e-6)


def test_leak_is_found(spark, panel):
    folds = validation.expanding_folds(panel, "week_start", 2)
    assert validation.leak_report(folds).where("NOT ok").isEmpty()
    shared = folds.where("role = 'train' AND fold = 1").withColumn("role", F.lit("val"))
    with pytest.raises(ValueError):
        validation.assert_no_leak(folds.unionByName(shared))
