"""Loads of a stored panel against one full build, and which files they leave alone."""

import datetime as dt
import glob

import pytest

from quartier.operators import panel_store
from quartier.plans import panel_queries

SCHEMA = "o_orderkey long, nta_id int, d date, result string, o_orderpriority string"
DAY = dt.date(2023, 1, 2)


def facts(spark, rows):
    return spark.createDataFrame([(k, a, None if day is None else DAY + dt.timedelta(days=day), r, "1-URGENT" if k % 3 == 0 else "2") for k, a, day, r in rows], SCHEMA)


def table(df):
    return sorted(tuple(map(str, r)) for r in df.select("nta_id", "week_start", *panel_queries.PANEL_COLUMNS).collect())


def files(at):
    return {f for f in glob.glob(f"{at}/panel/*/*.parquet")}


@pytest.fixture
def first():
    return [(k, k % 4, (k * 13) % 280, "F" if k % 5 == 0 else "O") for k in range(600)]


def test_two_loads_equal_one_build(spark, tmp_path, first):
    at = f"{tmp_path}/p"
    more = [(1000 + k, k % 4, 140 + k % 7, "F") for k in range(20)] + [(2000, 1, None, "F"), (2001, None, 150, "O"), (2002, 2, 400, "F")]
    changed = [(k, a, day, "F") for k, a, day, _ in first if day in (141, 142)]  # the same keys once more, with another result
    panel_store.load(facts(spark, first), at, 0, ["o_orderkey"], "d", panel_queries.weekly_panel)
    before = files(at)
    weeks = panel_store.load(facts(spark, more + changed), at, 1, ["o_orderkey"], "d", panel_queries.weekly_panel)
    final = {r[0]: r for r in first} | {r[0]: r for r in more + changed}
    want = table(panel_queries.weekly_panel(facts(spark, list(final.values()))))
    assert table(spark.read.parquet(f"{at}/panel")) == want
    assert weeks == sorted({DAY + dt.timedelta(days=start, weeks=n) for start in (140, 147, 399) for n in panel_store.REACH})
    # files of weeks that depend on no touched week are those of the first load
    kept = {f for f in before if dt.date.fromisoformat(f.split("week_start=")[1][:10]) not in weeks}
    assert kept and kept <= files(at)
    # a load that is repeated changes nothing
    panel_store.load(facts(spark, more + changed), at, 1, ["o_orderkey"], "d", panel_queries.weekly_panel)
    assert table(spark.read.parquet(f"{at}/panel")) == want


def test_a_refresh_reads_only_the_weeks_it_needs(spark, tmp_path, first):
    at = f"{tmp_path}/p"
    panel_store.add_facts(facts(spark, first), f"{at}/facts", 0, "d")
    rows = panel_store.read_facts(spark, f"{at}/facts", facts(spark, first).schema, ["o_orderkey"], [DAY])
    assert {r.d for r in rows.collect()} <= {DAY + dt.timedelta(days=n) for n in range(7)}
    assert "PartitionFilters: [week" in rows._jdf.queryExecution().executedPlan().toString().replace("isnotnull(week#", "week#")


def test_empty_load(spark, tmp_path, first):
    at = f"{tmp_path}/p"
    panel_store.load(facts(spark, first), at, 0, ["o_orderkey"], "d", panel_queries.weekly_panel)
    before = files(at)
    assert panel_store.load(facts(spark, []), at, 1, ["o_orderkey"], "d", panel_queries.weekly_panel) == []
    assert files(at) == before
