"""Bands by step against a plain loop, and their coverage on series that wander."""

import datetime as dt
import random

import numpy as np
import pytest

from quartier.operators import forecast

START = dt.date(2018, 1, 1)


def walks(spark, n, weeks, seed=5, gaps=()):
    rnd, rows = random.Random(seed), []
    for key in range(n):
        v = 0.5
        for w in range(weeks):
            v += rnd.gauss(0, 0.01)
            if (key, w) not in gaps:
                rows.append((key, START + dt.timedelta(weeks=w), v))
    return rows, spark.createDataFrame(rows, "area long, week date, v double")


def plain(rows, horizon, recent, season, origins, least):
    out = {}
    for key in {r[0] for r in rows}:
        line = sorted((d, v) for k, d, v in rows if k == key)
        value = dict(line)
        level = {d: np.mean([v for _, v in line[max(0, i - recent + 1) : i + 1]]) for i, (d, _) in enumerate(line)}
        week = lambda d, n: d + dt.timedelta(weeks=n)

        def ahead(origin, i):
            target, before = week(origin, i - season), week(origin, -season)
            return level[origin] + value[target] - level[before] if target in value and before in level else None

        last, band = line[-1][0], None
        for i in range(1, horizon + 1):
            seen = [(v, week(d, -i)) for d, v in line[-origins:] if week(d, -i) in level]
            plain = [v - level[o] for v, o in seen]
            seasonal = [v - ahead(o, i) for v, o in seen if ahead(o, i) is not None]
            centre = level[last]
            if len(seasonal) >= least and ahead(last, i) is not None:
                centre, band = ahead(last, i), (np.quantile(seasonal, [0.1, 0.5, 0.9]), len(seasonal))
            elif len(plain) >= least:
                band = np.quantile(plain, [0.1, 0.5, 0.9]), len(plain)
            if band is None:
                break
            out[key, i] = [week(last, i), *np.clip(centre + band[0], 0, 1), band[1]]
    return out


@pytest.mark.parametrize("season", [12, 20])
def test_bands_equal_plain_loop(spark, season):
    rows, df = walks(spark, 4, 60, gaps={(1, 30), (1, 31), (2, 50)})
    rows += [(9, START + dt.timedelta(weeks=w), 0.25) for w in range(3)]
    df = spark.createDataFrame(rows, df.schema)
    got = {(r.area, r.step): r for r in forecast.forecast_by_step(df, "area", "week", "v", season=season, origins=40).collect()}
    want = plain(rows, 12, 4, season, 40, 8)
    assert set(got) == set(want) and 9 not in {k for k, _ in got}
    for at, (when, p10, p50, p90, n) in want.items():
        r = got[at]
        assert (r.forecast_week, r.n_errors) == (when, n)
        assert np.allclose([r.p10, r.p50, r.p90], [p10, p50, p90], atol=2e-6)


def test_steps_with_few_errors_take_the_step_before(spark):
    rows, df = walks(spark, 1, 12)
    got = {r.step: r.n_errors for r in forecast.forecast_by_step(df, "area", "week", "v", season=52).collect()}
    assert got == {i: max(12 - i, 8) for i in range(1, 13)}


def test_bands_widen_and_cover(spark):
    _, df = walks(spark, 150, 170)
    got = {r.step: r for r in forecast.backtest_bands(df, "area", "week", "v", origins=104, season=52).collect()}
    assert got[12].width > 1.3 * got[1].width
    assert all(r.n == 150 for r in got.values())
    # one shared tail for each series: the mean over steps is held to, single steps loosely
    assert 0.7 < np.mean([r.covered for r in got.values()]) < 0.9


def test_empty_nulls_and_short_seasons(spark):
    df = spark.createDataFrame([(1, START, None), (None, START, 0.5)], "area long, week date, v double")
    assert forecast.forecast_by_step(df, "area", "week", "v").isEmpty()
    assert forecast.backtest_bands(df, "area", "week", "v").isEmpty()
    with pytest.raises(ValueError):
        forecast.forecast_by_step(df, "area", "week", "v", season=4)
