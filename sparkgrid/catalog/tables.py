"""Sources and sinks: tables written to the shared folder and read back."""

from pyspark.sql import functions as F

from sparkgrid.catalog.base import FIXED_SQL, level_case, lookup_case, query
from sparkgrid.constants import ACTIONS, CLEANING_COLUMNS, RAW_TIME
from sparkgrid.operators.clean import date_slice
from sparkgrid.operators.features import first_rows
from sparkgrid.operators.levels import classify
from sparkgrid.operators.stats import column_types
from sparkgrid.session import staging_path
from sparkgrid.sources import readers, writers
from sparkgrid.sources.views import grid_daily, grid_hourly, table
from sparkgrid.streaming.live import classify_stream, run_to_table

_MEASURES = ["solar_gen", "wind_gen", "wind_onshore", "wind_offshore", "load_actual", "load_forecast",
             "solar_capacity", "price"]


@query("raw_csv", "select ts, " + ", ".join(
    "solar_cap solar_capacity" if c == "solar_capacity" else c for c in _MEASURES) + " from hourly", "hourly")
def _(spark, d):
    """A wide raw CSV under its long column names, read back pruned, parsed and renamed."""
    long = {short: name for name, short in CLEANING_COLUMNS.items()}
    raw = (
        grid_hourly(spark, d).withColumnRenamed("solar_cap", "solar_capacity")
        .withColumnsRenamed({"ts": RAW_TIME, **long})
        .withColumn(RAW_TIME, F.date_format(RAW_TIME, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    )
    path = staging_path(spark, "raw-csv")
    writers.write_table(raw, path, "csv")
    return readers.read_short(spark, path).withColumn("ts", F.col("ts").cast("timestamp_ntz")).select("ts", *_MEASURES)


@query("partitioned_table", """select ts, pred_gap, cast(year(ts) as int) "year" from daily
  where year(ts) = 1998 and month(ts) between 3 and 3""", "daily")
def _(spark, d):
    """One month of a table partitioned by year: one folder is read."""
    path = staging_path(spark, "gap")
    writers.write_table(grid_daily(spark, d), path)
    return date_slice(readers.read_table(spark, path), 1998, 3)[0].select("ts", "pred_gap", "year")


@query("csv_report", "select ts, pred_demand, pred_gap from daily", "daily")
def _(spark, d):
    path = staging_path(spark, "report")
    writers.write_table(grid_daily(spark, d).select("ts", "pred_demand", "pred_gap"), path, "csv")
    return readers.read_table(spark, path, "csv").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("larger_source", "select ts, pred_gap from daily", "daily")
def _(spark, d):
    full = grid_daily(spark, d).select("ts", "pred_gap")
    part = full.where("pred_gap > 0")
    missing = readers.try_read(spark, staging_path(spark, "absent"))
    return readers.choose_source(missing, readers.choose_source(full, part))


@query("existing_columns", "select o_orderkey, o_totalprice from orders")
def _(spark, d):
    return readers.select_existing(table(spark, d, "orders"), ["o_orderkey", "not_there", "o_totalprice"])


@query("live_levels", """select ts, "value" - 60 pred_gap, case when "value" - 60 > 80 then 'CRITICAL'
  when "value" - 60 > 30 then 'HIGH' when "value" - 60 > 5 then 'MODERATE' when "value" - 60 >= -5 then 'BALANCED'
  when "value" - 60 >= -30 then 'SURPLUS' when "value" - 60 >= -50 then 'HIGH SURPLUS' else 'CRITICAL SURPLUS' end
  "level" from events""")
def _(spark, d):
    """Arriving rows classified as they come, then read back."""
    schema = table(spark, d, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    gaps = rows.select("ts", (F.col("value") - 60).alias("pred_gap"))
    thresholds = {"low_def": 5, "high_def": 30, "crit_def": 80, "low_sur": -5, "high_sur": -30, "crit_sur": -50}
    return run_to_table(classify_stream(gaps, thresholds).select("ts", "pred_gap", "level"))


@query("csv_interventions", f"""select *, {lookup_case('level', ACTIONS)} "action" from (
  select ts, pred_gap, {level_case('pred_gap', overrides=FIXED_SQL)} "level" from daily)""", "daily")
def _(spark, d):
    """Levels and actions written as CSV and read back without a schema."""
    path = staging_path(spark, "interventions")
    writers.write_table(classify(grid_daily(spark, d).select("ts", "pred_gap")), path, "csv")
    return readers.read_table(spark, path, "csv").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("column_types", " union all ".join(
    f"""select cast({k} as int) "position", '{c}' "column", '{t}' "type", count({c}) known from orders"""
    for k, (c, t) in enumerate([("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
                                ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")])))
def _(spark, d):
    return column_types(table(spark, d, "orders"))


@query("preview_rows", "select * from daily order by ts limit 5", "daily")
def _(spark, d):
    """The first five rows in time, with all columns."""
    return first_rows(grid_daily(spark, d), 5)
