"""Exact percentiles without an aggregate that holds all values, and the queries that use them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import percentiles, screens
from panelforge.plans import registry


def refused(*_, **__):
    raise AssertionError("percentile keeps a map of all values")


@pytest.fixture
def bounded(monkeypatch):
    """Few values in order at once, coarse sketches, and no aggregate that keeps every value."""
    monkeypatch.setattr(F, "percentile", refused)
    monkeypatch.setattr(percentiles, "FEW", 5)
    monkeypatch.setattr(percentiles, "GRID", 6)
    monkeypatch.setattr(percentiles, "PRECISION", 10)


def test_percentiles_are_exact_whatever_the_sketches_say(spark, bounded):
    rng = np.random.default_rng(5)
    own = {
        1: rng.standard_normal(700).tolist(), 2: [0.0] * 300 + [-0.0] * 50 + rng.integers(-2, 3, 200).tolist(), 3: [7.5],
        4: [float("-inf"), float("inf"), *range(90)], None: (rng.standard_normal(90) ** 9).tolist(), 5: [],
    }
    rows = [(g, float(v)) for g, values in own.items() for v in values] + [(g, None) for g in own]
    df = spark.createDataFrame(rows, "g int, v double").repartition(5)
    levels = [0.0, 0.05, 0.5, 0.98, 1.0]
    got = percentiles.percentiles(df, "v", levels, "g")
    assert set(got) == {1, 2, 3, 4, None}
    for g, told in got.items():
        x = np.sort(own[g])
        for p, v in zip(levels, told, strict=True):
            at = (len(x) - 1) * p
            low, high = x[int(at)], x[min(int(at) + 1, len(x) - 1)]
            want = low if low == high or at == int(at) else low + (high - low) * (at - int(at))
            assert v == want
    assert percentiles.percentiles(df.filter("g = 5"), "v", levels) == {}
    assert screens.percentile_bounds(df.filter("g = 1"), "v", 0.25, None) == (pytest.approx(np.quantile(own[1], 0.25)), None)
    assert screens.percentile_bounds(df.filter("g = 5"), "v", 0.25, 0.5) == (None, None)


@pytest.mark.parametrize("name", ["trim_percentile", "trimmed_sort_ls"])
def test_trims_start_no_python_on_executors(spark, sf, monkeypatch, name):
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refused)
    monkeypatch.setattr(percentiles, "FEW", 40)
    rows = registry.QUERIES[name](spark, sf)
    assert "Python" not in rows._jdf.queryExecution().toString() and rows.count()


@pytest.mark.parametrize("name", ["strategy_lattice", "winsor_ex_post", "trim_percentile", "variant_impact", "trimmed_sort_ls"])
def test_queries_hold_no_map_of_all_values(spark, sf, monkeypatch, name):
    want = sorted(map(str, registry.QUERIES[name](spark, sf).collect()))
    monkeypatch.setattr(F, "percentile", refused)
    monkeypatch.setattr(percentiles, "FEW", 40)
    assert sorted(map(str, registry.QUERIES[name](spark, sf).collect())) == want and want


def test_trimmed_sort_deals_rows_thrice_and_keeps_a_month_twice(spark, sf):
    """Days by entity and day, then all months by entity, then cross-sections by month; of a cross-section only its
    counts and its ranks keep rows, and the months' few rows are written as one file."""
    rows = registry.QUERIES["trimmed_sort_ls"](spark, sf)
    plan = rows._jdf.queryExecution().executedPlan().toString().splitlines()
    steps = lambda kind: [x for x in plan if f" {kind} " in f" {x.lstrip(' +-:')}"]
    assert len([x for x in steps("Exchange") if "hashpartitioning" in x]) == 3
    assert len([x for x in steps("Window") if "l_partkey" not in x and "[date#" in x]) == 2
    assert rows.rdd.getNumPartitions() == 1 and rows.count()
