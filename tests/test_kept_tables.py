"""Day states, range quantiles and checked files against whole recomputation."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkgrid.operators import daystates, rangequantiles, rollups
from sparkgrid.operators.quantiles import exact_quantiles
from sparkgrid.session import stage
from sparkgrid.sources import readers
from tests.helpers import frame, hours

KEYS = ["series_id"]


def measured(n=24 * 150, seed=1, name="a"):
    rng = np.random.default_rng(seed)
    values = {c: np.where(rng.random(n) < 0.05, np.nan, rng.normal(10, 300, n).round(2)) for c in daystates.MEASURES}
    pdf = hours(n, **values)
    pdf["series_id"] = name
    return pdf


def two_series(spark):
    a, b = measured(), measured(24 * 90, 2, None)
    return frame(spark, a).unionByName(frame(spark, b))


def folders(tmp_path):
    return str(tmp_path / "hours"), str(tmp_path / "states")


def rows_of(df, by=2):
    """Rows in order of their first values; numbers need only be close."""
    rows = sorted(map(tuple, df.collect()), key=lambda r: str(r[:by]))
    return [tuple(pytest.approx(v, rel=1e-9, abs=1e-9, nan_ok=True) if isinstance(v, float) else v for v in r) for r in rows]


def values_of(df, by=2):
    return sorted(map(tuple, df.collect()), key=lambda r: str(r[:by]))


def test_appended_and_corrected_days(spark, tmp_path):
    rows = stage(two_series(spark))
    cut = datetime(2019, 5, 10)
    path, states = folders(tmp_path)
    daystates.create(rows.where(F.col("ts") < cut), path, states, keys=KEYS)
    before = {(r.series_id, r.day): r for r in spark.read.parquet(states).collect()}

    ten = rows.where((F.col("ts") >= cut) & (F.col("ts") < cut + timedelta(days=10)))
    assert daystates.update(spark, ten, path, states, keys=KEYS).count() == 10
    fixed = rows.where((F.col("ts") == datetime(2019, 2, 3, 7))).withColumn("pred_gap", F.lit(-5000.0))
    anew = daystates.update(spark, fixed, path, states, keys=KEYS).collect()
    assert {(r.series_id, str(r.day)) for r in anew} == {("a", "2019-02-03"), (None, "2019-02-03")}
    # The same corrections once more change nothing.
    daystates.update(spark, fixed, path, states, keys=KEYS)

    final = rows.where(F.col("ts") < cut + timedelta(days=10)).withColumn(
        "pred_gap", F.when(F.col("ts") == datetime(2019, 2, 3, 7), -5000.0).otherwise(F.col("pred_gap")))
    kept = spark.read.parquet(states)
    untouched = [r for r in kept.collect() if (r.series_id, r.day) in before and str(r.day) != "2019-02-03"]
    assert untouched and all(before[r.series_id, r.day] == r for r in untouched)
    whole = daystates.day_states(final, keys=KEYS)
    assert values_of(kept.select(*whole.columns)) == rows_of(whole)
    assert values_of(daystates.yearly_summary(kept, 3, KEYS)) == rows_of(
        rollups.yearly_summary(final, 3, keys=KEYS).select(*KEYS, "year", "avg_gap", "avg_demand", "avg_solar", "avg_wind",
                                                         "pct_deficit"))
    assert values_of(daystates.year_month_pivot(kept, keys=KEYS)) == rows_of(rollups.year_month_pivot(final, keys=KEYS))
    for unit in ("D", "W"):
        assert values_of(daystates.resample(kept, unit, keys=KEYS)) == rows_of(
            rollups.resample(final, unit, keys=KEYS, columns=daystates.MEASURES))
    assert spark.read.parquet(path).count() == final.count()


def test_arrivals_that_are_none_or_twice(spark, tmp_path):
    rows = stage(two_series(spark))
    path, states = folders(tmp_path)
    daystates.create(rows, path, states, keys=KEYS)
    assert daystates.update(spark, rows.where("ts is null"), path, states, keys=KEYS).count() == 0
    one = rows.limit(1)
    with pytest.raises(ValueError, match="several arrivals for one hour"):
        daystates.update(spark, one.union(one), path, states, keys=KEYS)


def test_months_that_did_not_change_are_not_read(spark, tmp_path):
    path, states = folders(tmp_path)
    daystates.create(two_series(spark), path, states, keys=KEYS)
    plan = spark.read.parquet(path).where(F.col(daystates.MONTH).isin(["2019-03"]))._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "2019-03" in plan.split("PartitionFilters")[1]


@pytest.fixture(scope="module")
def ranged(spark, tmp_path_factory):
    rng = np.random.default_rng(7)
    n = 24 * 400
    pdf = hours(n, value=np.where(rng.random(n) < 0.1, np.nan, np.where(rng.random(n) < 0.3, 0.0, rng.normal(0, 5000, n).round(1))))
    pdf["series_id"] = np.where(rng.random(n) < 0.4, "a", None)
    pdf.loc[5, "value"], pdf.loc[9, "value"] = np.inf, -np.inf
    rows = stage(frame(spark, pdf))
    path = str(tmp_path_factory.mktemp("ranges") / "t")
    rangequantiles.create(rows, "value", path, keys=KEYS)
    return rows, path


P = [0.0, 0.1, 0.25, 0.5, 0.65, 0.9, 1.0]


@pytest.mark.parametrize("seed", range(5))
def test_any_range_is_exact(spark, ranged, seed):
    rows, path = ranged
    rng = np.random.default_rng(seed)
    start = datetime(2018, 12, 28) + timedelta(hours=int(rng.integers(0, 24 * 200)))
    end = start + timedelta(hours=int(rng.integers(1, 24 * 200)))
    if seed == 0:
        start, end = datetime(2019, 2, 1), datetime(2019, 6, 1)     # whole months only
    if seed == 1:
        start, end = datetime(2019, 2, 3, 5), datetime(2019, 2, 20)  # within a month
    inside = rows.where((F.col("ts") >= start) & (F.col("ts") < end))
    found = rangequantiles.quantiles(spark, path, P, start, end, KEYS)
    expected = exact_quantiles(inside, {"value": (F.col("value"), P)}, KEYS)
    columns = [*KEYS, "p", "n", "q"]
    assert values_of(found.select(*columns)) == values_of(expected.select(*columns)) and found.count() == 2 * len(P)


def test_range_without_values(spark, ranged):
    assert rangequantiles.quantiles(spark, ranged[1], P, datetime(2030, 1, 1), datetime(2031, 1, 1), KEYS).count() == 0


def test_second_read_fetches_wanted_bins_only(spark, ranged):
    rows, path = ranged
    start, end = datetime(2019, 2, 1), datetime(2019, 6, 1)
    hits = rangequantiles.wanted_bins(spark, path, [0.1, 0.9], start, end, KEYS).collect()
    wanted = rangequantiles.wanted_values(spark, path, [h.bin for h in hits], start, end)
    inside = rows.where((F.col("ts") >= start) & (F.col("ts") < end) & F.col("value").isNotNull()).count()
    assert 0 < wanted.count() < 0.1 * inside
    plan = wanted._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "In(bin" in plan and "PartitionFilters: [isnotnull(month_of" in plan
    # Whole months are counted without their values.
    counted = rangequantiles.wanted_bins(spark, path, [0.5], start, end, KEYS)
    assert f"{path}/values" not in counted._jdf.queryExecution().toString()


def test_bins_rise_with_the_value(spark):
    values = sorted([0.0, -1e-9, 1e-9, 1.0, -1.0, 1e300, -1e300, float("inf"), float("-inf"), *np.linspace(-3, 3, 101).tolist()])
    bins = [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").orderBy("k").select(
        rangequantiles.value_bin(F.col("v"))).collect()]
    assert bins == sorted(bins)


def test_good_and_rejected_rows_add_up(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "one.csv").write_text(
        "utc_timestamp,a,b,other\n2019-01-01T00:00:00Z,1,2,x\nsoon,1,2,x\n2019-01-01T02:00:00Z,1,n/a,x\n,1,2,x\n"
        "2019-01-01T04:00:00Z,,,\n2019-01-01T05:00:00Z,1\n2019-01-01T06:00:00Z,1,2,x,5\n")
    (tmp_path / "raw" / "two.csv").write_text("utc_timestamp,a,b,other\n2019-01-01T07:00:00Z,7,8,not a number\n")
    good, rejected = readers.read_checked(spark, str(tmp_path / "raw"), ["a", "b"])
    assert sorted((r.a, r.b) for r in good.collect() if r.a) == [(1.0, 2.0), (7.0, 8.0)] and good.count() == 3
    found = {r.line: (r.reason, r.file.rsplit("/", 1)[1]) for r in rejected.collect()}
    assert found == {"soon,1,2,x": ("time", "one.csv"), "2019-01-01T02:00:00Z,1,n/a,x": ("value", "one.csv"),
                     ",1,2,x": ("time", "one.csv"), "2019-01-01T05:00:00Z,1": ("columns", "one.csv"),
                     "2019-01-01T06:00:00Z,1,2,x,5": ("columns", "one.csv")}
    with pytest.raises(ValueError, match="columns not in"):
        readers.read_checked(spark, str(tmp_path / "raw"), ["absent"])
