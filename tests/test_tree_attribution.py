import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from quartier.operators import models, tree_attribution


def frame(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3))
    borough = rng.choice(["MN", "BX", "BK", "QN"], 600)
    z = 2 * x[:, 0] - x[:, 1] * (borough == "MN") + (borough == "BX") + rng.normal(scale=0.5, size=600)
    rows = [(i, *map(float, a), str(b), int(v > 0.3)) for i, (a, b, v) in enumerate(zip(x, borough, z, strict=True))]
    rows[5] = (5, None, *rows[5][2:])
    return spark.createDataFrame(rows, "i int, a double, b double, c double, borough string, y int")


def brute(x, held):
    """Shapley values by enumerating all sets of features."""
    n = len(x)

    def value(known):
        total = 0.0
        for leaf in held:
            p = leaf.value
            for f, splits, share in zip(leaf.features, leaf.splits, leaf.shares, strict=True):
                goes = all((x[f] in w if isinstance(w, frozenset) else x[f] <= w) == left for w, left in splits)
                p *= float(goes) if f in known else share
            total += p
        return total

    out = []
    for j in range(n):
        others = [k for k in range(n) if k != j]
        out.append(sum(math.factorial(s) * math.factorial(n - s - 1) / math.factorial(n) * (value({*sub, j}) - value(set(sub))) for s in range(n) for sub in itertools.combinations(others, s)))
    return out


def test_contributions_equal_brute_force_and_add_up(spark):
    df = frame(spark)
    model = models.fit_gbt(df, ["a", "b", "c", "borough"], "y", category="borough", rounds=6)
    got = tree_attribution.tree_attribution(df.withColumn("base", F.lit(7)), model, 2).collect()
    assert len(got) == 600
    for r in got:
        assert abs(r.base + sum(c.contribution for c in r.contributions) - r.margin) < 1e-9
        assert [c.feature for c in r.contributions] == ["a", "b", "c", "borough"]
        assert [f.feature for f in r.top_factors] == [c.feature for c in sorted(r.contributions, key=lambda c: -abs(c.contribution))[:2]]
    held = tree_attribution.leaves(model.stages[-1])
    assert any(isinstance(w, frozenset) for leaf in held for splits in leaf.splits for w, _ in splits)  # categories are split too
    rows = {r.i: r.features.toArray() for r in model.transform(df).where("i < 12").collect()}
    for r in got:
        if r.i in rows:
            assert np.allclose([c.contribution for c in r.contributions], brute(rows[r.i], held), atol=1e-9)
    mean = np.mean([[abs(c.contribution) for c in r.contributions] for r in got], axis=0)
    assert mean.argmax() == 0 and mean[2] < mean[1]
    assert tree_attribution.tree_attribution(df.limit(0), model).count() == 0
