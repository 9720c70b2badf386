"""Calendar functions, aggregates and resampling against pandas, with edge cases."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkgrid.functions.calendar import calendar, season
from sparkgrid.functions.columns import clip, nan_to_null, signed_whole
from sparkgrid.operators import clean, rollups, stats
from tests.helpers import column, frame, gappy, hours, same


def test_calendar_over_a_leap_year_end(spark):
    pdf = pd.DataFrame({"ts": pd.date_range("2016-12-30", "2017-01-02", freq="5h")})
    out = calendar(frame(spark, pdf)).orderBy("ts").toPandas()
    t = pdf.ts.dt
    assert list(out.day_of_year) == list(t.dayofyear) and 366 in list(out.day_of_year)
    assert list(out.day_of_week) == list(t.dayofweek)
    assert list(out.is_weekend) == list((t.dayofweek >= 5).astype(int))
    seasons = spark.createDataFrame([(m,) for m in range(1, 13)], "m int").select("m", season("m").alias("s"))
    assert [r.s for r in seasons.orderBy("m").collect()] == ["Winter"] * 2 + ["Spring"] * 3 + ["Summer"] * 3 + [
        "Autumn"] * 3 + ["Winter"]


@pytest.mark.parametrize("unit", ["D", "W"])
def test_resample_keeps_empty_bins(spark, unit):
    pdf = hours(24 * 20, v=gappy(480, 0.2))
    pdf = pdf[(pdf.ts < "2018-12-31") | (pdf.ts > "2019-01-11 05:00")]
    out = rollups.resample(frame(spark, pdf), unit)
    expected = pdf.set_index("ts").resample(unit).mean()
    assert [r.ts for r in out.orderBy("ts").collect()] == [t.to_pydatetime() for t in expected.index]
    same(column(out, "v"), expected.v)


def test_resample_of_nothing(spark):
    assert rollups.resample(frame(spark, hours(1, v=[1.0])).limit(0), "D").count() == 0


def test_yearly_summary_rounds_half_to_even(spark):
    pdf = pd.DataFrame({"ts": pd.to_datetime(["2019-01-01", "2019-06-01"]), "pred_gap": [0.0, 5.0],
                        "pred_demand": [1.0, 2.0], "pred_solar": [3.0, 4.0], "pred_wind": [1.0, 0.0]})
    row = rollups.yearly_summary(frame(spark, pdf), 0).first()
    assert (row.avg_gap, row.avg_demand, row.avg_solar, row.avg_wind, row.pct_deficit) == (2, 2, 4, 0, 50)


def test_pivot_equals_pandas(spark):
    pdf = pd.DataFrame({"ts": pd.date_range("2015-11-01", "2017-02-10", freq="7h")})
    pdf["pred_gap"] = np.sin(np.arange(len(pdf)))
    out = rollups.year_month_pivot(frame(spark, pdf)).orderBy("year").toPandas().set_index("year")
    expected = pdf.pivot_table(values="pred_gap", index=pdf.ts.dt.year, columns=pdf.ts.dt.month, aggfunc="mean")
    np.testing.assert_allclose(out.to_numpy(dtype=float), expected.reindex(columns=range(1, 13)).to_numpy())


def test_describe_equals_pandas(spark):
    pdf = hours(300, a=gappy(300, 0.1), b=np.arange(300) * 1.0)
    out = stats.describe(frame(spark, pdf), ["a", "b"]).toPandas().set_index("column")
    expected = pdf[["a", "b"]].describe().T
    for ours, theirs in zip(("count", "mean", "std", "min", "q25", "q50", "q75", "max"), expected.columns):
        np.testing.assert_allclose(out.loc[["a", "b"], ours], expected[theirs], atol=0.0501)


def test_correlation_of_constant_and_missing(spark):
    pdf = hours(60, a=gappy(60, 0.2, 1), b=gappy(60, 0.2, 2), c=np.full(60, 4.0))
    out = {(r["first"], r.second): r.corr for r in stats.correlation_pairs(frame(spark, pdf), ["a", "b", "c"]).collect()}
    assert out[("b", "a")] == pytest.approx(pdf.a.corr(pdf.b))
    assert out[("c", "a")] is None and out[("c", "b")] is None
    row = stats.correlations(frame(spark, pdf), {"ab": ("a", "b"), "ac": ("a", "c")}).first()
    assert row.ab == pytest.approx(pdf.a.corr(pdf.b)) and row.ac is None


@pytest.mark.parametrize("values", [np.linspace(-3, 7, 211), np.full(10, 2.0), gappy(100, 0.3)])
def test_histogram_equals_numpy(spark, values):
    out = stats.histogram(frame(spark, hours(len(values), v=values)), "v", 20).orderBy("bin").collect()
    known = values[~np.isnan(values)]
    counts, edges = np.histogram(known, 20)
    assert sum(r.rows for r in out) == len(known)
    np.testing.assert_allclose([r.low for r in out], edges[:-1])
    # A value on an inner edge may fall to either side of it in floating point.
    assert np.abs(np.array([r.rows for r in out]) - counts).sum() <= 2


def test_extremes_take_the_first_of_equals(spark):
    means = spark.createDataFrame([(0, None), (3, 5.0), (1, 5.0), (2, 4.0)], "hour int, v double")
    found = stats.group_extremes(means, "hour", {"most": ("v", "most"), "least": ("v", "least")}).first()
    assert (found.most, found.least) == (1, 2)


def test_metrics_equal_formulas(spark):
    y, f = gappy(80, 0.1, 3), gappy(80, 0.1, 4)
    row = stats.metrics(frame(spark, hours(80, y=y, f=f)), "y", {"m": "f"}).first()
    both = ~np.isnan(y) & ~np.isnan(f)
    e = y[both] - f[both]
    assert row.rows == both.sum()
    assert row.mae == pytest.approx(np.abs(e).mean())
    assert row.rmse == pytest.approx(np.sqrt((e**2).mean()))
    assert row.r2 == pytest.approx(1 - (e**2).sum() / ((y[both] - y[both].mean()) ** 2).sum())


def test_frequency_sums_to_all(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "level string")
    out = [(r.level, r.rows, r.pct) for r in stats.frequency(df, "level").collect()]
    assert out == [("c", 2, 50.0), ("a", 1, 25.0), ("b", 1, 25.0)]


def test_shares_count_missing_as_not_met(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (None,), (-2.0,)], "g double")
    assert stats.gap_shares(df, "g").first()[:] == (25.0, 50.0)


def test_missing_profile(spark):
    out = {r.column: (r.missing, r.missing_pct) for r in
           clean.missing_profile(frame(spark, hours(3, v=[1.0, np.nan, np.nan]))).collect()}
    assert out == {"ts": (0, 0.0), "v": (2, 66.67)}


def test_clip_and_nan(spark):
    df = spark.createDataFrame([(-1.0,), (float("nan"),), (None,), (300.0,)], "v double")
    rows = nan_to_null(df).select(clip("v", 0, 100).alias("v")).collect()
    assert [r.v for r in rows] == [0.0, None, None, 100.0]


def test_signed_text(spark):
    df = spark.createDataFrame([(1234.5,), (-0.2,), (0.0,), (-98765.4,)], "v double")
    assert [r.t for r in df.select(signed_whole("v", "+").alias("t")).collect()] == ["+1,234", "-0", "+0", "-98,765"]


def test_duplicate_time_is_an_error(spark):
    twice = frame(spark, pd.concat([hours(2, v=[1.0, 2.0]), hours(1, v=[3.0])]))
    with pytest.raises(ValueError, match="more than one row"):
        clean.require_unique(twice)
    clean.require_unique(twice.where("v < 3"))


def test_date_slice_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    frame(spark, hours(24 * 40, v=np.arange(960) * 1.0)).write.parquet(path)
    rows, label, unit = clean.date_slice(spark.read.parquet(path), 2019, 1)
    assert (label, unit, rows.count()) == ("Jan 2019", None, 744)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2019-01-01" in plan and "LessThan(ts,2019-02-01" in plan
    assert clean.date_slice(rows)[1:] == ("All years", "W")
    assert rows.agg(F.min("ts")).first()[0] == dt.datetime(2019, 1, 1)
