"""Folds fitted side by side, and trees that stop by watched rows."""

import datetime as dt
import random
import threading

import pytest
from pyspark.sql import functions as F

from quartier.operators import models, validation

FEATURES = ["x", "z"]


@pytest.fixture(scope="module")
def train(spark):
    rnd = random.Random(11)
    rows = [(i, dt.date(2022, 1, 3) + dt.timedelta(weeks=i % 60), x := rnd.random(), rnd.random(), int(x + rnd.gauss(0, 0.3) > 0.5)) for i in range(1800)]
    return spark.createDataFrame(rows, "key long, week_start date, x double, z double, y int").cache()


def plain(scored):
    return [sorted((r.key, r.fold, round(r.score, 9)) for r in rows.collect()) for rows in scored]


def test_folds_side_by_side_equal_one_after_the_other(spark, train):
    tagged = validation.expanding_folds(train, "week_start", 3)
    names, at_once = set(), threading.Barrier(3, timeout=60)

    def fitter(rows, features, label):
        at_once.wait()  # passes only when three fits are under way
        names.add(spark.sparkContext.getLocalProperty("spark.job.description"))
        return models.fit_logistic(rows, features, label)

    spark.sparkContext.setJobDescription("folds")
    got = plain(models.score_folds(tagged, FEATURES, "y", fitter, parallel=3))
    spark.sparkContext.setJobDescription(None)
    want = plain(models.score_folds(tagged, FEATURES, "y", models.fit_logistic, parallel=1))
    assert got == want and len(got) == 3 and all(got) and names == {"folds"}
    assert [{r[1] for r in rows} for rows in got] == sorted([{r[1] for r in rows} for rows in got], key=min)


def test_a_fit_that_fails_fails_the_call(train):
    def fitter(rows, features, label):
        raise RuntimeError("no fit")

    with pytest.raises(RuntimeError, match="no fit"):
        models.score_folds(validation.expanding_folds(train, "week_start", 2), FEATURES, "y", fitter, parallel=2)


def test_trees_stop_by_watched_rows(train):
    flagged = models.flag_latest(train.unionByName(train.limit(1).withColumn("week_start", F.lit(None).cast("date"))))
    assert flagged.where("watched").select("week_start").distinct().count() == 4
    assert flagged.where("week_start IS NULL AND NOT watched").count() == 1
    stopped = models.fit_gbt(flagged, FEATURES, "y", rounds=40, watched="watched", tolerance=0.01)
    whole = models.fit_gbt(train, FEATURES, "y", rounds=40)
    assert 0 < stopped.stages[-1].getNumTrees < whole.stages[-1].getNumTrees == 40
    # the watched rows are not learned from: with other labels there, the first tree is the same
    turned = flagged.withColumn("y", F.when(F.col("watched"), 1 - F.col("y")).otherwise(F.col("y")))
    first = lambda rows: models.fit_gbt(rows, FEATURES, "y", rounds=2, watched="watched", tolerance=0.5).stages[-1].trees[0].toDebugString.split("\n")[1:]
    assert first(turned) == first(flagged)
