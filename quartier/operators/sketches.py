"""Quantiles from mergeable sketches that are kept for each week, so that thresholds over any weeks need no second look at the scores.

A state is a KLL sketch of a few kilobytes, whatever the number of rows. States of the same or of different weeks merge; a load writes those of its own rows as one more
batch and leaves the others alone. ``rank_error`` is the bound, in shares of the rows, that a quantile's rank keeps to with 99 % confidence.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size of a sketch: four times the usual one.
K = 800


def rank_error(k: int = K) -> float:
    """Of a single quantile, as the sketch's authors measured it."""
    return 2.296 / k**0.9723


def quantile_states(df: DataFrame, value: str, by: Sequence[str] = (), k: int = K) -> DataFrame:
    """(by..., state, n) of the values; nulls and values that are no numbers are left out, groups without any have no state."""
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).withColumn("_v", v)
    return rows.groupBy(*by).agg(F.kll_sketch_agg_double("_v", k).alias("state"), F.count(F.lit(1)).alias("n")).where("n > 0")


def merged_states(states: DataFrame, by: Sequence[str] = (), k: int = K) -> DataFrame:
    """States of all rows with the same ``by`` in one."""
    return states.groupBy(*by).agg(F.kll_merge_agg_double("state", k).alias("state"), F.sum("n").alias("n")).where("n > 0")


def quantiles_of(state: str | Column, shares: Sequence[float]) -> Column:
    return F.kll_sketch_get_quantile_double(state, F.array(*[F.lit(float(s)) for s in shares]))


def add_states(df: DataFrame, path: str, batch: int, value: str, by: Sequence[str], k: int = K) -> None:
    """Writes the states of a load; a load that is repeated under its number replaces itself."""
    quantile_states(df, value, by, k).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_states(spark: SparkSession, path: str, by: Sequence[str], k: int = K) -> DataFrame:
    """The kept states, those of several loads merged."""
    return merged_states(spark.read.parquet(path).drop("batch"), by, k)


def thresholds_from_states(states: DataFrame, shares: Sequence[float], k: int = K) -> DataFrame:
    """One row with the quantiles over all states, and how many rows they stand for; no row without states."""
    return merged_states(states, (), k).select(quantiles_of("state", shares).alias("thresholds"), "n")
