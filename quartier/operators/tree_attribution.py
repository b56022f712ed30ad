"""Additive attribution of boosted trees: what each feature adds to a row's margin.

The value of a set of known features is the tree's expectation when the other splits are followed by the shares of training rows that went each way, and a
feature's contribution is its Shapley value over all sets. Along the path to one leaf a known feature leaves 1 or 0, depending on whether the row
satisfies its splits there, and an unknown one the product of its shares; so the sum over all sets needs no more than the coefficients of one
polynomial in the features of the path, and whole batches of rows are worked on at once. Contributions and the base add up to the margin.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import work
from .ranking import top_factors


@dataclass
class Leaf:
    value: float
    #: features of the path, and for each the splits (threshold or set of categories, and whether the path goes left) and the product of shares
    features: list[int]
    splits: list[list[tuple[float | frozenset, bool]]]
    shares: list[float]


def leaves(model) -> list[Leaf]:
    """The leaves of all trees of a boosted model, their values times the tree's weight; no more than trees times two to the depth."""
    spark = SparkSession.active()
    path = work.folder(spark, "trees")
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    weights, found = model.treeWeights, []
    trees: dict[int, dict[int, object]] = {}
    for r in data.collect():
        trees.setdefault(r.treeID, {})[r.nodeData.id] = r.nodeData

    def walk(nodes: dict, at: int, weight: float, path: dict) -> None:
        node = nodes[at]
        if node.leftChild < 0:
            found.append(Leaf(node.prediction * weight, list(path), [p[0] for p in path.values()], [p[1] for p in path.values()]))
            return
        split = node.split
        where = frozenset(split.leftCategoriesOrThreshold) if split.numCategories > 0 else split.leftCategoriesOrThreshold[0]
        for child, left in ((node.leftChild, True), (node.rightChild, False)):
            splits, share = path.get(split.featureIndex, ([], 1.0))
            share *= nodes[child].rawCount / node.rawCount
            walk(nodes, child, weight, path | {split.featureIndex: ([*splits, (where, left)], share)})

    for tree, nodes in sorted(trees.items()):
        walk(nodes, 0, weights[tree], {})
    return found


def base_of(held: list[Leaf]) -> float:
    """The expectation when no feature is known."""
    return math.fsum(leaf.value * math.prod(leaf.shares) for leaf in held)


def contributions(x: np.ndarray, held: list[Leaf]) -> np.ndarray:
    """Contributions of rows by features."""
    out = np.zeros(x.shape)
    for leaf in held:
        m = len(leaf.features)
        if not m:
            continue
        known = np.ones((m, len(x)))
        for i, (feature, splits) in enumerate(zip(leaf.features, leaf.splits, strict=True)):
            for where, left in splits:
                goes = np.isin(x[:, feature], list(where)) if isinstance(where, frozenset) else x[:, feature] <= where
                known[i] *= goes == left
        weight = np.array([math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m) for s in range(m)])
        for i, feature in enumerate(leaf.features):
            # sets of s other features that are known: the coefficient of t to the s in the product of (share + known t)
            sets = np.zeros((m, len(x)))
            sets[0] = 1
            for k in range(m):
                if k != i:
                    sets[1:] = sets[1:] * leaf.shares[k] + sets[:-1] * known[k]
                    sets[0] *= leaf.shares[k]
            out[:, feature] += leaf.value * (known[i] - leaf.shares[i]) * (weight @ sets)
    return out


def tree_attribution(df: DataFrame, model: PipelineModel, n: int = 5) -> DataFrame:
    """Adds ``base``, ``margin``, ``contributions`` (feature, contribution) of every feature, which with the base add up to the margin, and ``top_factors``, the n largest.

    The model is a pipeline that ends with an assembler and boosted trees, like ``fit_gbt`` gives.
    """
    assembler, trees = model.stages[-2], model.stages[-1]
    held = leaves(trees)  # bounded by the model
    names = [c.removesuffix("_filled").removesuffix("_index") for c in assembler.getInputCols()]

    @F.pandas_udf("array<double>")
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            x = np.stack(vectors.to_numpy()) if len(vectors) else np.zeros((0, len(names)))
            yield pd.Series(list(contributions(x.astype(np.float64), held)))

    columns = [c for c in df.columns if c not in ("base", "margin", "contributions", "top_factors")]
    scored = model.transform(df).select(*columns, vector_to_array("rawPrediction")[1].alias("margin"), each(vector_to_array(trees.getFeaturesCol())).alias("_c"))
    parts = F.array(*[F.struct(F.lit(name).alias("feature"), F.col("_c")[i].alias("contribution")) for i, name in enumerate(names)])
    return top_factors(scored.select(*columns, F.lit(base_of(held)).alias("base"), "margin", parts.alias("contributions")), "contributions", n)
