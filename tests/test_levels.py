"""Quantiles, thresholds and levels: boundaries, fallbacks, overrides."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkgrid.constants import FIXED_THRESHOLDS, LEVEL_ORDINAL
from sparkgrid.operators import levels
from sparkgrid.operators.quantiles import exact_quantiles, median
from tests.helpers import frame, hours

PS = [0.0, 0.1, 0.25, 0.35, 0.5, 0.65, 0.75, 0.9, 1.0]
WAYS = [{}, {"aggregate_rows": 0}, {"aggregate_rows": 0, "window_rows": 0}]


def quantiles(spark, values, **limits):
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(3)
    return {r.p: r.q for r in exact_quantiles(df, {"v": (F.col("v"), PS)}, **limits).collect()}


@pytest.mark.parametrize("limits", WAYS)
@pytest.mark.parametrize("values", [
    [5.0], [1, 2], [3] * 40, list(range(101)), [0] * 60 + [1] * 3 + list(np.linspace(-9, 9, 38)),
    list(np.random.default_rng(1).normal(0, 1e5, 500)) + [1e12], [7.5] * 300 + [1e9, -1e9, 7.25],
])
def test_quantiles_equal_pandas(spark, values, limits):
    found, series = quantiles(spark, values, **limits), pd.Series(values, dtype=float)
    assert set(found) == set(PS)
    for p in PS:
        assert found[p] == pytest.approx(series.quantile(p), rel=1e-12, abs=1e-9)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-20, 20), min_size=1, max_size=60))
def test_quantiles_of_any_values(spark, values):
    series = pd.Series(values, dtype=float)
    for limits in WAYS[1:]:
        found = quantiles(spark, values, **limits)
        assert all(found[p] == pytest.approx(series.quantile(p)) for p in PS)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert exact_quantiles(df, {"v": (F.col("v"), PS)}).count() == 0
    assert median(df, "v").count() == 0


def thresholds(spark, gaps, **kw):
    df = spark.createDataFrame([(float(g),) for g in gaps], "pred_gap double")
    return levels.quantile_thresholds(df, **kw).first().asDict()


@pytest.mark.parametrize("n,quantile", [(9, False), (10, True)])
def test_sides_need_ten_rows(spark, n, quantile):
    gaps = [100.5 * i for i in range(1, n + 1)] + [-77.7 * i for i in range(1, n + 1)] + [0.0] * 30
    found = thresholds(spark, gaps)
    if not quantile:
        assert found == FIXED_THRESHOLDS
        return
    pos, neg = pd.Series([g for g in gaps if g > 0]), pd.Series([g for g in gaps if g < 0])
    expected = {"low_def": pos.quantile(.25), "high_def": pos.quantile(.65), "crit_def": pos.quantile(.9),
                "low_sur": neg.quantile(.75), "high_sur": neg.quantile(.35), "crit_sur": neg.quantile(.1)}
    assert found == pytest.approx(expected)
    cut = thresholds(spark, gaps, truncate=True)
    assert cut == {k: float(int(v)) for k, v in expected.items()}


def test_thresholds_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "pred_gap double")
    assert levels.quantile_thresholds(empty).first().asDict() == FIXED_THRESHOLDS


def test_thresholds_are_ordered(spark):
    t = thresholds(spark, np.random.default_rng(3).normal(0, 5_000, 300))
    assert t["crit_def"] >= t["high_def"] >= t["low_def"] > 0 > t["low_sur"] >= t["high_sur"] >= t["crit_sur"]


EDGES = [
    (8000.1, "CRITICAL"), (8000.0, "HIGH"), (3000.1, "HIGH"), (3000.0, "MODERATE"), (500.1, "MODERATE"),
    (500.0, "BALANCED"), (0.0, "BALANCED"), (-500.0, "BALANCED"), (-500.1, "SURPLUS"), (-3000.0, "SURPLUS"),
    (-3000.1, "HIGH SURPLUS"), (-8000.0, "HIGH SURPLUS"), (-8000.1, "CRITICAL SURPLUS"), (None, None),
]


def test_level_boundaries(spark):
    df = spark.createDataFrame([(g,) for g, _ in EDGES], "pred_gap double")
    table = spark.createDataFrame([tuple(FIXED_THRESHOLDS.values())], list(FIXED_THRESHOLDS))
    for thr in (FIXED_THRESHOLDS, table):
        got = {r.pred_gap: r.level for r in levels.classify(df, thresholds=thr).collect()}
        assert got == dict(EDGES)
    ordinals = levels.classify(df).select("level", levels.ordinal(F.col("level")).alias("o")).distinct().collect()
    assert {r.level: r.o for r in ordinals if r.level} == LEVEL_ORDINAL


@pytest.mark.parametrize("gap,text", [
    (12345.5, "Deficit of 12,346 MW"), (8000.5, "Deficit of 8,000 MW"), (0.5, "Gap of 0 MW"), (-0.4, "Gap of -0 MW"),
    (-499.6, "Gap of -500 MW"), (-1234.5, "Surplus of 1,234 MW"), (-99999.5, "Surplus of 100,000 MW"),
])
def test_detail_rounds_half_to_even(spark, gap, text):
    df = spark.createDataFrame([(gap,)], "pred_gap double")
    found = levels.classify(df, detail_name="detail").first().detail
    assert found.startswith(text + " — ")


def test_overrides_replace_two_thresholds(spark):
    df = spark.createDataFrame([(100.0,), (60.0,), (40.0,)], "pred_gap double")
    out = levels.classify(df, overrides={"crit_def": 90, "high_def": 50, "low_def": 30})
    assert [r.level for r in out.collect()] == ["CRITICAL", "HIGH", "MODERATE"]


@pytest.mark.parametrize("gap_max,critical", [(54321, None), (54321, 40000), (-5, None), (0, 7)])
def test_override_limits(spark, gap_max, critical):
    gaps = spark.createDataFrame([(float(gap_max),), (-321.9,)], "pred_gap double")
    r = levels.override_limits(gaps, critical=critical).first()
    top = max(gap_max, -321) if gap_max > -321 else -321
    crit = 8000 if critical is None else critical
    assert (r.gap_min, r.gap_max) == (-321, top)
    assert (r.crit_from, r.crit_to) == (max(0, top // 10), max(top, 1))
    assert r.crit_step == max(100, (top - top // 10) // 50)
    assert (r.high_from, r.high_to) == (max(0, top // 20), crit)
    assert (r.high_value, r.high_step) == (min(3000, crit), max(100, crit // 50))


def test_series_have_their_own_thresholds(spark):
    rng = np.random.default_rng(5)
    parts = [hours(40, pred_gap=rng.normal(0, s, 40)).assign(series=f"s{s}") for s in (10, 1000)]
    pdf = pd.concat(parts)
    df = frame(spark, pdf)
    per_series = levels.quantile_thresholds(df, keys=["series"])
    for r in per_series.collect():
        pos = pdf[(pdf.series == r.series) & (pdf.pred_gap > 0)].pred_gap
        assert r.crit_def == pytest.approx(pos.quantile(0.9))
    out = levels.classify(df, thresholds=per_series, keys=["series"])
    assert out.count() == 80 and out.where("level is null").count() == 0
