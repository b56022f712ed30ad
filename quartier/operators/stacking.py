"""Stacking: base models' out-of-fold scores, a second model over them, and a calibration on rows that are later than all it learned from."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import work
from .joins import meta_features
from .models import Fitter, apply_fusion, fit_fusion, positive_score, score_folds
from .validation import expanding_folds


def out_of_fold(tagged: DataFrame, features: Sequence[str], label: str, fitter: Fitter, key: str, date: str = "week_start") -> DataFrame:
    """(key, date, label, fold, score) of the validation rows of each fold, scored by a model of that fold's training rows alone. Folds are few."""
    scored = score_folds(tagged, features, label, fitter)
    return reduce(DataFrame.unionByName, [rows.select(key, date, label, "fold", "score") for rows in scored])


@dataclass
class Stack:
    """Base models fitted on all training rows, the model over their scores, and its calibration."""

    bases: dict[str, PipelineModel]
    primary: str
    fusion: PipelineModel
    isotonic: IsotonicRegressionModel
    #: what the second model learned from (role ``train``), and what it was calibrated on (role ``calibrate``)
    rows: DataFrame

    def score(self, df: DataFrame, key: str, date: str = "week_start", threshold: float = 0.5) -> DataFrame:
        """(key, date, a score for each base model, fused, fused_score, fused_class)."""
        scores = {name: positive_score(model.transform(df)).select(key, date, "score") for name, model in self.bases.items()}
        return apply_fusion(meta_features(df.select(key, date), scores, self.primary, key=key, week=date), self.fusion, self.isotonic, threshold)


def fit_stack(train: DataFrame, features: Sequence[str], label: str, bases: Mapping[str, Fitter], primary: str, key: str, date: str = "week_start", n_folds: int = 5, **folds) -> Stack:
    """Fits base models on expanding folds, joins their out-of-fold scores by (key, date), fits the second model on all folds but the last and calibrates on that.

    (key, date) tells training rows apart. Rows that a base model has no score for take the primary one's.
    """
    tagged = work.stored(expanding_folds(train, date, n_folds, **folds), "folds")
    oofs = {name: work.stored(out_of_fold(tagged, features, label, fitter, key, date), f"oof-{name}") for name, fitter in bases.items()}
    rows = meta_features(oofs[primary].select(key, date, label, "fold"), oofs, primary, key=key, week=date)
    last = oofs[primary].agg(F.max("fold")).first()[0]
    rows = work.stored(rows.withColumn("role", F.when(F.col("fold") < last, "train").otherwise("calibrate")), "meta-rows")
    fusion, isotonic = fit_fusion(rows.where("role = 'train'").drop("role"), list(bases), label, rows.where("role = 'calibrate'").drop("role"))
    return Stack({name: fitter(train, features, label) for name, fitter in bases.items()}, primary, fusion, isotonic, rows)
