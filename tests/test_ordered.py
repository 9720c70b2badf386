"""Positions, lags, rolling statistics, splits and sequences against pandas."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkgrid.constants import DEMAND_FEATURES
from sparkgrid.operators import features
from sparkgrid.operators.ordered import POS, SIZE, buckets, with_position
from tests.helpers import column, frame, gappy, hours, same


def test_positions_are_dense_per_series(spark):
    sizes = {"a": 1, "b": 57, "c": 400}
    pdf = pd.concat([hours(n, v=np.arange(n, dtype=float)).assign(series=s) for s, n in sizes.items()])
    rows = with_position(frame(spark, pdf), keys=["series"]).df
    for s, n in sizes.items():
        part = rows.where(F.col("series") == s)
        assert (column(part, POS) == np.arange(n)).all()
        assert (column(part, SIZE) == n).all()
        assert (column(part, "v") == np.arange(n)).all()


def test_one_series_is_split_over_partitions(spark):
    # Small partitions would be merged again.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = with_position(spark.range(20_000).select(F.col("id").alias("ts")), "ts").df
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows.inputFiles()) == 8
    assert rows.agg(F.count_distinct(POS), F.min(POS), F.max(POS)).first()[:] == (20_000, 0, 19_999)
    assert rows.where(F.col(POS) != F.col("ts")).count() == 0


@pytest.mark.parametrize("rows", [167, 168, 169, 700])
def test_rolling_and_lags_equal_pandas(spark, rows):
    values = gappy(rows, 0.002, rows)
    pdf = hours(rows, v=values)
    b = buckets(frame(spark, pdf), 168, bucket_rows=180).lags("v", {"l1": 1, "l168": 168})
    for n in (6, 24, 72, 168):
        b = b.rolling("v", n, f"m{n}", f"s{n}")
    out, s = b.close(), pd.Series(values)
    same(column(out, "l1"), s.shift(1))
    same(column(out, "l168"), s.shift(168))
    for n in (6, 24, 72, 168):
        same(column(out, f"m{n}"), s.shift(1).rolling(n).mean())
        same(column(out, f"s{n}"), s.shift(1).rolling(n).std(), 1e-4)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(1, 300), st.integers(40, 90), st.integers(33, 40))
def test_long_windows_do_not_depend_on_buckets(spark, rows, bucket_rows, n):
    values = gappy(rows, 0.01, rows)
    out = buckets(frame(spark, hours(rows, v=values)), n, bucket_rows=bucket_rows).rolling("v", n, "m", "s").close()
    s = pd.Series(values).shift(1).rolling(n)
    same(column(out, "m"), s.mean())
    same(column(out, "s"), s.std(), 1e-4)


def test_constant_window_has_no_deviation(spark):
    values = np.r_[np.linspace(0, 1e6, 100), np.full(120, 12345.678)]
    out = buckets(frame(spark, hours(220, v=values)), 100, bucket_rows=100).rolling("v", 100, "m", "s").close()
    assert column(out, "s")[-1] == pytest.approx(0, abs=1e-9)


def test_demand_features_equal_pandas(spark):
    values = gappy(500, 0.01)
    pdf = hours(500, load_actual=values)
    out = features.demand_features(frame(spark, pdf))
    p = pdf.dropna().set_index("ts")
    load = p.load_actual
    for k in (1, 2, 3, 24, 48, 168):
        p[f"lag_{k}h"] = load.shift(k)
    for k in (6, 24, 168):
        p[f"roll_{k}h"] = load.shift(1).rolling(k).mean()
    for k in (24, 168):
        p[f"roll_std_{k}h"] = load.shift(1).rolling(k).std()
    for name, value, period in (("hour", p.index.hour, 24), ("month", p.index.month, 12),
                                ("dow", p.index.dayofweek, 7)):
        p[f"{name}_sin"], p[f"{name}_cos"] = np.sin(2 * np.pi * value / period), np.cos(2 * np.pi * value / period)
    p["is_weekend"], p["year"] = (p.index.dayofweek >= 5).astype(int), p.index.year
    p = p.dropna()
    assert len(p) == out.count()
    for c in DEMAND_FEATURES:
        same(column(out, c), p[c], 1e-4)


@pytest.mark.parametrize("rows", [1, 4, 5, 99])
def test_time_split(spark, rows):
    out = features.time_split(frame(spark, hours(rows, v=np.ones(rows))))
    order = [r.split for r in out.orderBy("ts").collect()]
    train = int(rows * 0.80)
    assert order == ["train"] * train + ["test"] * (rows - train)


def test_sequences(spark):
    x = np.arange(60, dtype=float)
    out = features.sequences(frame(spark, hours(60, x=x, y=x * 2)), ["x", "y"], "y", 24)
    rows = out.orderBy("ts").collect()
    assert len(rows) == 36
    for i, r in enumerate(rows):
        assert r.sequence == [[float(j), 2.0 * j] for j in range(i, i + 24)]
        assert r.target == 2.0 * (i + 24)


def test_no_data_row_passes_through_one_task(spark):
    rows = frame(spark, hours(400, load_actual=gappy(400, 0.0)))
    plan = features.demand_features(rows)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan
    # The counts per partition, and nothing else, are exchanged to a single partition.
    for before in plan.split("SinglePartition")[1:]:
        assert "_part" in before.splitlines()[1]


def test_rolling_windows_share_one_exchange(spark):
    rows = frame(spark, hours(400, v=gappy(400, 0.0)))
    out = buckets(rows, 168).rolling("v", 168, "m", "s").rolling("v", 72, "m2").close()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(_bucket") == 1
    # The offsets, and per window one sort of the tails and one of the heads.
    assert plan.count("Sort [") == 1 + 2 * 2


def test_first_and_last_rows(spark):
    rows = frame(spark, hours(50, v=np.arange(50, dtype=float)))
    assert [r.v for r in features.first_rows(rows, 3).collect()] == [0, 1, 2]
    assert [r.v for r in features.last_rows(rows, 3).collect()] == [47, 48, 49]
