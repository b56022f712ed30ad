"""Model pipelines on pyspark.ml: baselines, boosting, calibration, stacking, attribution and batch scoring."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import PCA, Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import work
from ..sources.store import upsert
from .aggregates import assign_decile, decile_thresholds
from .series import fill_missing
from .validation import expanding_folds, metric_bundle

Fitter = Callable[[DataFrame, Sequence[str], str], PipelineModel]


def fit_logistic(train: DataFrame, features: Sequence[str], label: str, c: float = 1.0) -> PipelineModel:
    """Medians for missing values, standardised features, ridge-regularised logistic regression."""
    filled = [f"{f}_filled" for f in features]
    n = max(1, train.count())
    return Pipeline(stages=[
        Imputer(strategy="median", inputCols=list(features), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="raw_features"),
        StandardScaler(withMean=True, inputCol="raw_features", outputCol="features"),
        LogisticRegression(labelCol=label, regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=200),
    ]).fit(train)


def fit_gbt(train: DataFrame, features: Sequence[str], label: str, category: str | None = None, rounds: int = 50, seed: int = 0, watched: str | None = None, tolerance: float = 0.001) -> PipelineModel:
    """Boosted trees with learning rate 0.05; a category column is indexed, unseen values in a bin of their own.

    Given a flag column ``watched``, its rows are not learned from: boosting stops where a round no longer lowers their loss by the share ``tolerance``.
    """
    stages, cols = [], [f for f in features if f != category]
    filled = [f"{f}_filled" for f in cols]
    stages.append(Imputer(strategy="median", inputCols=cols, outputCols=filled))
    if category:
        stages.append(StringIndexer(inputCol=category, outputCol=f"{category}_index", handleInvalid="keep"))
        filled.append(f"{category}_index")
    stages += [VectorAssembler(inputCols=filled, outputCol="features"), GBTClassifier(labelCol=label, stepSize=0.05, maxIter=rounds, maxDepth=4, seed=seed, validationTol=tolerance)]
    if watched:
        stages[-1].setValidationIndicatorCol(watched)
    return Pipeline(stages=stages).fit(train)


def fit_mlp(train: DataFrame, features: Sequence[str], label: str, hidden: Sequence[int] = (64, 32), seed: int = 0) -> PipelineModel:
    filled = [f"{f}_filled" for f in features]
    return Pipeline(stages=[
        Imputer(strategy="median", inputCols=list(features), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="raw_features"),
        StandardScaler(withMean=True, inputCol="raw_features", outputCol="features"),
        MultilayerPerceptronClassifier(labelCol=label, layers=[len(filled), *hidden, 2], maxIter=100, seed=seed),
    ]).fit(train)


def positive_score(scored: DataFrame, out: str = "score") -> DataFrame:
    """The probability of class 1 as a plain column, without the pipeline's working columns."""
    drop = [c for c in scored.columns if c.endswith(("_filled", "_index")) or c in ("raw_features", "features", "rawPrediction", "probability", "prediction")]
    return scored.withColumn(out, vector_to_array("probability")[1]).drop(*drop)


def fit_categories(df: DataFrame, col: str) -> DataFrame:
    """(col, code): values in order, from 0. A category has few distinct values."""
    return df.where(F.col(col).isNotNull()).select(col).distinct().withColumn("code", F.row_number().over(Window.orderBy(col)) - 1)


def apply_categories(df: DataFrame, mapping: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Codes of a mapping learned in training; unseen values and nulls are -1."""
    name = out or f"{col}_code"
    return df.join(mapping.withColumnRenamed("code", name), col, "left").fillna(-1, subset=[name])


def calibrate(scored: DataFrame, y: str, p: str) -> IsotonicRegressionModel:
    """Isotonic regression of labels on scores."""
    return IsotonicRegression(labelCol=y, featuresCol=p).fit(scored.select(F.col(y).cast("double").alias(y), p))


def apply_calibration(scored: DataFrame, model: IsotonicRegressionModel, p: str, out: str = "calibrated") -> DataFrame:
    values = model.setFeaturesCol(p).setPredictionCol(out).transform(scored)
    return values.withColumn(out, F.least(F.greatest(F.col(out), F.lit(0.0)), F.lit(1.0)))


def flag_latest(rows: DataFrame, weeks: int = 4, date: str = "week_start", out: str = "watched") -> DataFrame:
    """Adds a flag for the rows of the last ``weeks`` weeks, for fits that stop by them. Rows without a date are not flagged."""
    last = rows.agg(F.max(date).alias("_last"))
    flagged = F.coalesce(F.col(date) > F.date_sub("_last", 7 * weeks), F.lit(False))
    return rows.crossJoin(F.broadcast(last)).withColumn(out, flagged).drop("_last")  # one row


def score_folds(tagged: DataFrame, features: Sequence[str], label: str, fitter: Fitter, parallel: int = 4) -> list[DataFrame]:
    """The validation rows of each fold, in order, with the score of a model of that fold's training rows.

    Up to ``parallel`` fits are under way at a time, each a chain of Spark jobs that share the executors, so that the short jobs of one fit fill the gaps
    of another. A table that is tagged at great cost is written first. A fit that fails fails the call.
    """
    folds = [r.fold for r in tagged.select("fold").distinct().orderBy("fold").collect()]

    def fit(fold: int) -> DataFrame:
        mine = tagged.where(F.col("fold") == fold)
        model = fitter(mine.where("role = 'train'"), features, label)
        return positive_score(model.transform(mine.where("role = 'val'")))

    if parallel <= 1 or len(folds) <= 1:
        return [fit(fold) for fold in folds]
    with ThreadPoolExecutor(min(parallel, len(folds))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(fit), fold) for fold in folds]]


def train_and_evaluate(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, fitter: Fitter, key: str, name: str = "model", date: str = "week_start", n_folds: int = 5, parallel: int = 4, **folds) -> tuple[DataFrame, PipelineModel, DataFrame]:
    """Validation folds, a calibration on the last of them, and a fit on all training rows for the test.

    Returns metrics (model, stage, fold, ...), the final model, and the out-of-fold scores. Folds are few and fitted ``parallel`` at a time;
    the tagged rows and the scores are written to the shared folder, so that a caller reads scores and fits nothing again.
    """
    tagged = work.stored(expanding_folds(train, date, n_folds, **folds), "folds")
    oof = work.stored(reduce(DataFrame.unionByName, score_folds(tagged, features, label, fitter, parallel)), "out-of-fold")
    last = oof.where(F.col("fold") == oof.agg(F.max("fold")).first()[0])
    isotonic = calibrate(last, label, "score")
    final = fitter(train, features, label)
    tested = apply_calibration(positive_score(final.transform(test)), isotonic, "score")
    cv = metric_bundle(oof, label, "score", key, ["fold"]).select(F.lit(name).alias("model"), F.lit("cv").alias("stage"), "*")
    held = metric_bundle(tested, label, "calibrated", key).select(F.lit(name).alias("model"), F.lit("test").alias("stage"), F.lit(None).cast("int").alias("fold"), "*")
    metrics = cv.unionByName(held)
    return train.sparkSession.createDataFrame(metrics.collect(), metrics.schema), final, oof  # a row for each fold and one for the test


def group_models(train: DataFrame, test: DataFrame, by: str, features: Sequence[str], label: str, max_rows: int = 10_000, fallback: str | None = None, date: str | None = None, tail: float = 0.2) -> DataFrame:
    """A small ridge logistic model for each group, for groups within ``max_rows`` and with both classes; others are skipped.

    Given a date column, a group's model learns from its earlier rows, and the last share ``tail`` of them calibrates it, monotonically; a group
    whose earlier rows have one class only learns from all and is not calibrated.

    Returns test rows with group_score, status and, given a fallback column, score: the group's or the fallback.
    A group that is too large never gathers in one task: only its count is looked at.
    """
    sizes = train.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(label).alias("_classes"))
    status = F.when(F.col("_n").isNull(), "skipped_no_training").when(F.col("_n") > max_rows, "skipped_too_large").when(F.col("_classes") < 2, "skipped_one_class").otherwise("ok")
    known = test.select(by).distinct().join(sizes, by, "left").select(by, status.alias("status"))
    use = known.where("status = 'ok'").select(by)
    cols = list(features)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        late = pdf.iloc[:0]
        if date:
            pdf = pdf.sort_values([date, *cols], kind="stable")
            cut = len(pdf) - int(tail * len(pdf))
            if pdf[label].iloc[:cut].nunique() > 1:
                pdf, late = pdf.iloc[:cut], pdf.iloc[cut:]
        x = pdf[cols].astype(float)
        middle = x.median().fillna(0.0)
        x = x.fillna(middle)
        mean, std = x.mean(), x.std(ddof=0).replace(0, 1.0)
        design = lambda rows: np.column_stack([np.ones(len(rows)), (rows[cols].astype(float).fillna(middle) - mean) / std])
        a = design(pdf)
        y, w = pdf[label].to_numpy(float), np.zeros(a.shape[1])
        ridge = np.diag([0.0] + [1.0] * len(cols))
        for _ in range(25):
            q = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a * (q * (1 - q))[:, None]).T @ a + ridge + 1e-9 * np.eye(len(w)), a.T @ (y - q) - ridge @ w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        at, to = isotonic_steps(1 / (1 + np.exp(-design(late) @ w)), late[label].to_numpy(float)) if len(late) else ([], [])
        return pd.DataFrame({by: [pdf[by].iloc[0]], "w": [w.tolist()], "mean": [mean.tolist()], "std": [std.tolist()], "middle": [middle.tolist()], "at": [list(at)], "to": [list(to)]})

    kind = train.schema[by].dataType.simpleString()
    rows = train.join(use, by, "left_semi").select(by, label, *cols, *([date] if date else []))
    fitted = rows.groupBy(by).applyInPandas(fit, f"{by} {kind}, w array<double>, mean array<double>, std array<double>, middle array<double>, at array<double>, to array<double>")
    terms = [F.col("w")[i + 1] * (F.coalesce(F.col(c).cast("double"), F.col("middle")[i]) - F.col("mean")[i]) / F.col("std")[i] for i, c in enumerate(cols)]
    logit = reduce(lambda a, b: a + b, terms, F.col("w")[0])
    out = test.join(known, by, "left").join(fitted, by, "left").withColumn("group_score", F.when(F.col("w").isNotNull(), 1 / (1 + F.exp(-logit))))
    out = out.withColumn("group_score", F.when(F.size("at") > 0, _on_steps(F.col("group_score"), F.col("at"), F.col("to"))).otherwise(F.col("group_score")))
    out = out.drop("w", "mean", "std", "middle", "at", "to")
    return out.withColumn("score", F.coalesce("group_score", fallback)) if fallback else out


def isotonic_steps(p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct scores in order and the least-squares monotone means of the labels there: neighbours that fall are pooled."""
    at, place = np.unique(p, return_inverse=True)
    n, total = np.bincount(place).astype(float), np.bincount(place, weights=y)
    pools: list[list[float]] = []
    for size, s in zip(n, total, strict=True):
        pools.append([size, s, 1])
        while len(pools) > 1 and pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return at, np.concatenate([np.full(int(k), s / size) for size, s, k in pools])


def _on_steps(p: Column, at: Column, to: Column) -> Column:
    """Linear between the steps, and level beyond the first and the last."""
    i = F.size(F.filter(at, lambda x: x <= p))
    low, high = F.greatest(i, F.lit(1)), F.least(i + 1, F.size(at))
    x0, x1, y0, y1 = F.element_at(at, low), F.element_at(at, high), F.element_at(to, low), F.element_at(to, high)
    return F.when(x1 > x0, y0 + (y1 - y0) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (p - x0) / (x1 - x0)))).otherwise(y0)


def fit_fusion(train: DataFrame, features: Sequence[str], label: str, calibration: DataFrame) -> tuple[PipelineModel, IsotonicRegressionModel]:
    """A logistic model over the base models' out-of-fold scores, calibrated on the last time fold."""
    model = fit_logistic(train, features, label)
    return model, calibrate(positive_score(model.transform(calibration), "fused"), label, "fused")


def apply_fusion(df: DataFrame, model: PipelineModel, isotonic: IsotonicRegressionModel, threshold: float = 0.5) -> DataFrame:
    out = apply_calibration(positive_score(model.transform(df), "fused"), isotonic, "fused", "fused_score")
    return out.withColumn("fused_class", (F.col("fused_score") >= threshold).cast("int"))


def linear_attribution(df: DataFrame, model: PipelineModel, features: Sequence[str], n: int = 5) -> DataFrame:
    """Adds contributions (feature, contribution) of every feature, coefficient times standardised value, and top_factors, the n largest."""
    from .ranking import top_factors

    logistic, scaler, imputer = model.stages[-1], model.stages[2], model.stages[0]
    medians = imputer.surrogateDF.first()
    parts = []
    for i, f in enumerate(features):
        z = (F.coalesce(F.col(f).cast("double"), F.lit(float(medians[f]))) - float(scaler.mean[i])) / (float(scaler.std[i]) or 1.0)
        parts.append(F.struct(F.lit(f).alias("feature"), (float(logistic.coefficients[i]) * z).alias("contribution")))
    return top_factors(df.withColumn("contributions", F.array(*parts)), "contributions", n)


def tree_importances(df: DataFrame, model: PipelineModel, n: int = 20) -> DataFrame:
    """(feature, importance) of a boosted model's leading features."""
    assembler, trees = model.stages[-2], model.stages[-1]
    rows = [(c.removesuffix("_filled"), float(v)) for c, v in zip(assembler.getInputCols(), trees.featureImportances.toArray(), strict=True)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(n)


def materialize_scores(panel: DataFrame, model: PipelineModel, version: str, features: Sequence[str], stored: DataFrame | None = None, key: str = "nta_id", week: str = "week_start", rule: str = "ceil") -> DataFrame:
    """Scores of all area-weeks with deciles over all of them, upserted into the stored predictions."""
    scored = positive_score(model.transform(fill_missing(panel, features)), "risk_score").select(key, week, F.round("risk_score", 6).alias("risk_score"))
    out = assign_decile(scored, "risk_score", decile_thresholds(scored, "risk_score"), rule, out="risk_decile").withColumn("model_version", F.lit(version))
    return out if stored is None else upsert(stored, out, [key, week, "model_version"])


def pca_embeddings(df: DataFrame, vec: str, k: int, key: str = "nta_id", prefix: str | None = None) -> tuple[DataFrame, list[float]]:
    """(key, pca array<double>) of the first k components of centred vectors, and the shares of variance. Signs are arbitrary."""
    rows = df.select(key, array_to_vector(F.transform(vec, lambda x: x.cast("double"))).alias("raw"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="raw", outputCol="centred").fit(rows).transform(rows)
    model = PCA(k=k, inputCol="centred", outputCol="pca").fit(centred)
    out = model.transform(centred).select(key, vector_to_array("pca").alias("pca"))
    if prefix:
        out = out.select(key, *[F.col("pca")[i].alias(f"{prefix}{i}") for i in range(k)])
    return out, [float(x) for x in model.explainedVariance]


def ablation_table(metrics: DataFrame) -> DataFrame:
    """model, mean and deviation of validation precision, and test metrics, best first."""
    cv = metrics.where("stage = 'cv'").groupBy("model").agg(F.avg("average_precision").alias("cv_mean"), F.stddev_pop("average_precision").alias("cv_std"))
    test = metrics.where("stage = 'test'").select("model", F.col("average_precision").alias("test_average_precision"), "roc_auc", "brier", "top_decile_lift")
    return cv.join(test, "model", "full_outer").orderBy(F.desc("test_average_precision"), "model")
