"""Series without a name, several series at once, and checks of what is written and joined."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkgrid import session
from sparkgrid.operators import features, levels, rollups, stats
from sparkgrid.operators.fill import Fill, fill
from sparkgrid.operators.ordered import with_position
from sparkgrid.operators.quantiles import exact_quantiles
from sparkgrid.operators.supply import reconstruct
from sparkgrid.plans import reports
from sparkgrid.plans.dashboard import dashboard
from sparkgrid.sources import readers, writers

START = dt.datetime(2020, 1, 1)


def series(spark, names=("a", None), n=40):
    rows = [(name, START + dt.timedelta(hours=k), float(k * (1 + i)) if k % 5 else None)
            for i, name in enumerate(names) for k in range(n)]
    return spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, value double").repartition(3)


def test_no_row_of_a_null_series_is_lost(spark):
    df = series(spark)
    made = [
        features.lags(df, "value", {"lag": 2}, keys=["series_id"]),
        features.time_split(df, keys=["series_id"]),
        fill(df, {"value": Fill("both")}, keys=["series_id"]),
        levels.classify(df, "value", levels.quantile_thresholds(df, "value", ["series_id"]), ["series_id"]),
    ]
    for result in made:
        assert {r.series_id: r["count"] for r in result.groupBy("series_id").count().collect()} == {"a": 40, None: 40}
    assert made[2].where("value is null").isEmpty()


VALUES = [0.0, -0.0, 1.5, -7.25, 1e308, float("inf"), float("-inf"), 3.0, 3.0, 0.1, 0.2, 0.30000000000000004]


@pytest.mark.parametrize("values", [VALUES, VALUES + [float("nan")] * 3, [float("inf")] * 4, [-0.0, 0.0], [2.5],
                                    [0.1 * k for k in range(997)]])
def test_all_ways_to_quantiles_agree(spark, values):
    df = spark.createDataFrame([(name, v) for name in ("x", None) for v in values], "s string, v double")
    wanted = {"v": (F.col("v"), [0.0, 0.1, 0.25, 0.5, 0.65, 0.9, 0.95, 1.0])}

    def found(**limits):
        return sorted((r.s or "", r.p, r.n, repr(r.q)) for r in exact_quantiles(df, wanted, ["s"], **limits).collect())
    expected = found()
    assert len(expected) == 16
    with pytest.raises(ValueError, match="may not be named"):
        exact_quantiles(df.withColumnRenamed("s", "k"), wanted, ["k"])
    assert found(aggregate_rows=0) == expected
    assert found(aggregate_rows=0, window_rows=0) == expected


def test_times_must_be_unique_and_rows_without_time_have_no_place(spark):
    df = series(spark, ("a",), 10)
    twice = df.union(df.where("value = 3"))
    for operator in (lambda x: fill(x, {"value": Fill()}), lambda x: features.lags(x, "value", {"l": 1}),
                     lambda x: features.time_split(x)):
        with pytest.raises(ValueError, match="more than one row"):
            operator(twice)
    with_nulls = df.union(spark.createDataFrame([("a", None, 1.0)] * 2, df.schema))
    assert with_position(with_nulls).df.count() == 10


def test_counting_equal_times_needs_no_exchange(spark):
    by = ["series_id", "ts"]
    ordered = series(spark).repartitionByRange(*by).sortWithinPartitions(*by).withColumn(
        "same", F.count("*").over(Window.partitionBy(*by)))
    plan = ordered._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "hashpartitioning" not in plan


def test_joins_broadcast_by_rows_and_bytes(spark, monkeypatch):
    left = series(spark)
    right = spark.createDataFrame([("a", "x" * 1000), (None, "y")], "series_id string, word string")

    def plan():
        joined = session.join_small(left, right, ["series_id"])
        assert joined.count() == 80
        return joined._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan()
    monkeypatch.setattr(session, "BROADCAST_BYTES", 500)
    assert "strategy=broadcast" not in plan()
    rows, size = session.table_size(right)
    assert rows == 2 and size > 1000


def test_staged_tables_are_dropped_by_their_owner(spark, tmp_path):
    with session.staging(spark) as folder:
        table = session.stage(spark.range(5))
        assert table.count() == 5 and folder in table.inputFiles()[0]
    with pytest.raises(Exception, match="FILE_NOT_EXIST|FileNotFound|does not exist"):
        table.count()


def test_empty_bins_over_centuries(spark):
    far = spark.createDataFrame([(dt.datetime(1800, 1, 1), 1.0), (dt.datetime(2200, 1, 1), 2.0)],
                                "ts timestamp_ntz, v double")
    every = rollups.add_empty_bins(far, "ts", F.make_dt_interval(F.lit(0), F.lit(1)))
    row = every.agg(F.count("*").alias("n"), F.countDistinct("ts").alias("d"), F.sum("v").alias("v")).first()
    hours = (dt.datetime(2200, 1, 1) - dt.datetime(1800, 1, 1)).days * 24 + 1
    assert (row.n, row.d, row.v) == (hours, hours, 3.0)


def test_years_reach_the_scan_as_ranges(spark, tmp_path):
    path = str(tmp_path / "gaps")
    rows = spark.range(1000).select((F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(F.col("id").cast("int"))).alias("ts"),
                                    *[F.col("id").cast("double").alias(c) for c in (
                                        "solar_gen", "wind_gen", "load_actual", "load_forecast", "supply_gap")])
    rows.write.parquet(path)
    for made in (rollups.months(spark.read.parquet(path), 2021), reports.year_series(spark.read.parquet(path))):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(ts," in plan and "LessThan(ts," in plan


def test_reconstruct_keeps_series_apart(spark):
    rows = [(s, START + dt.timedelta(hours=k), p if k else p / 2, p, 10.0, 20.0, 5.0, -6.0)
            for s, p in (("a", 0.5), ("b", 2.0), (None, -1.0)) for k in range(4)]
    df = spark.createDataFrame(rows, "s string, ts timestamp_ntz, solar_profile double, wind_profile double, "
                                     "solar_cap double, wind_cap double, solar_raw double, wind_raw double")
    peak = {r.s: (r.solar, r.wind) for r in reconstruct(df, "peak", keys=["s"]).groupBy("s").agg(
        F.max("solar_gen").alias("solar"), F.max("wind_gen").alias("wind")).collect()}
    assert peak == {"a": (15_000.0, 22_500.0), "b": (30_000.0, 45_000.0), None: (0.0, 0.0)}
    empty_b = df.withColumn("solar_profile", F.when(F.col("s") != "b", F.col("solar_profile")))
    made = reconstruct(empty_b, "capacity", keys=["s"], min_rows=2)
    last = {r.s: (r.solar_gen, r.wind_gen) for r in made.where(F.hour("ts") == 3).collect()}
    assert last == {"a": (5.0, 10.0), "b": (5.0, 0.0), None: (5.0, 0.0)}


def test_csv_keeps_text(spark, tmp_path):
    path = str(tmp_path / "csv")
    df = spark.createDataFrame([("HIGH", "Act, now", 1.5, "n1")], "level string, action string, gap double, note string")
    writers.write_table(df, path, "csv")
    assert readers.read_table(spark, path, "csv", text=["note"]).collect() == df.collect()


def gaps(spark):
    rows = [(s, START + dt.timedelta(hours=k), 50.0 + k % 24 + i, 10.0, 5.0, float((k * 37 + i) % 100 - 40))
            for i, s in enumerate(("a", None)) for k in range(24 * 40)]
    return spark.createDataFrame(
        rows, "s string, ts timestamp_ntz, pred_demand double, pred_solar double, pred_wind double, pred_gap double")


def test_dashboard_of_several_series(spark):
    df = gaps(spark)
    board, alone = dashboard(df, keys=["s"]), dashboard(df.where("s is null"))
    own = board.kpis.where("s is null").drop("s").first()
    assert own == alone.kpis.first()
    assert board.levels.where("s is null").drop("s").collect() == alone.levels.collect()
    assert board.log.where("s is null").drop("s").collect() == alone.log.collect()
    for name in ("thresholds", "yearly", "heatmap", "years", "limits", "median"):
        mine = getattr(board, name).where("s is null").drop("s").collect()
        assert mine == getattr(alone, name).drop("s").collect(), name
    assert board.rows.count() == 2 * 24 * 40


def test_statistics_of_several_series(spark):
    df = gaps(spark)
    single = df.where("s is null").drop("s")
    for operator in (lambda x, k: stats.describe(x, ["pred_gap"], keys=k),
                     lambda x, k: stats.histogram(x, "pred_gap", 7, k).orderBy("bin"),
                     lambda x, k: stats.extremes(x, ["pred_gap"], k),
                     lambda x, k: stats.gap_shares(x, "pred_gap", k),
                     lambda x, k: rollups.by_season(x, ["pred_gap"], keys=k).orderBy("ordinal"),
                     lambda x, k: rollups.fullest_year(x, keys=k),
                     lambda x, k: features.last_rows(x, 3, keys=k)):
        assert operator(df, ["s"]).where("s is null").drop("s").collect() == operator(single, []).collect()
