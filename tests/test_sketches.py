import numpy as np
from pyspark.sql import functions as F

from quartier.operators import aggregates, sketches

TENTHS = [i / 10 for i in range(1, 11)]


def worst(values, shares, found):
    """The greatest distance of a share from the ranks that a quantile has among the values."""
    values = np.sort(values)
    low, high = (np.searchsorted(values, found, side=s) / len(values) for s in ("left", "right"))
    return max(max(a - s, s - b, 0) for s, a, b in zip(shares, low, high, strict=True))


def test_thresholds_of_weeks_keep_to_the_bound(spark, tmp_path):
    rng = np.random.default_rng(3)
    weeks = rng.integers(0, 12, 60_000)
    values = np.where(rng.random(60_000) < 0.3, 0.25, rng.beta(2, 5, 60_000) + weeks / 40)  # a third of the rows are one value
    df = spark.createDataFrame([(int(w), float(v)) for w, v in zip(weeks, values, strict=True)] + [(3, None), (4, float("nan")), (99, None)], "week int, score double").repartition(7)
    path = str(tmp_path / "states")
    late = F.pmod(F.xxhash64("score"), F.lit(10)) == 0
    sketches.add_states(df.where(~late | late.isNull()), path, 0, "score", ["week"])
    for _ in range(2):  # a load that is repeated counts once
        sketches.add_states(df.where(late), path, 1, "score", ["week"])
    states = sketches.read_states(spark, path, ["week"])
    assert {r.week: r.n for r in states.collect()} == {w: int((weeks == w).sum()) for w in range(12)}
    bound = sketches.rank_error()
    row = sketches.thresholds_from_states(states, TENTHS).first()
    error = worst(values, TENTHS, row.thresholds)
    print(bound, error)
    assert row.n == 60_000 and error <= 2 * bound
    some = sketches.thresholds_from_states(states.where("week IN (2, 5)"), TENTHS).first()
    assert worst(values[(weeks == 2) | (weeks == 5)], TENTHS, some.thresholds) <= 2 * bound
    exact = aggregates.exact_quantiles(df.where("score = score"), "score", TENTHS).first()[0]
    assert max(abs(a - b) for a, b in zip(row.thresholds, exact, strict=True)) < 0.02
    assert sketches.thresholds_from_states(states.limit(0), TENTHS).count() == 0
    assert sum(len(r.state) for r in states.collect()) < 12 * 20_000
