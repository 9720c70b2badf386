"""Tables that are kept up to date as hours arrive: day states, counts per month, checked raw files, live features."""

from datetime import datetime

from pyspark.sql import functions as F

from sparkgrid.catalog.base import query, rounded
from sparkgrid.constants import CLEANING_COLUMNS, MONTH_NAMES, RAW_TIME
from sparkgrid.operators import daystates, rangequantiles
from sparkgrid.session import staging_path
from sparkgrid.sources import readers, writers
from sparkgrid.sources.views import cents, grid_daily, grid_hourly, regional_demand, table
from sparkgrid.streaming.features import stream_features
from sparkgrid.streaming.live import run_to_table

# Hours up to 1996 are there, the later ones arrive, and with them corrections of the seventh of May of each year.
_ARRIVES = datetime(1997, 1, 1)
_CORRECTED = """, corrected as (select ts, pred_demand, pred_solar, pred_wind,
  pred_gap + case when month(ts) = 5 and day(ts) = 7 then 4096 else 0 end pred_gap from daily)"""


def kept_states(spark, d):
    """The states of all days after an update, and those that it computed anew."""
    old = grid_daily(spark, d).select("ts", *daystates.MEASURES)
    seventh = (F.month("ts") == 5) & (F.day("ts") == 7)
    corrected = old.withColumn("pred_gap", F.col("pred_gap") + F.when(seventh, 4096).otherwise(0))
    hours, states = staging_path(spark, "hours"), staging_path(spark, "states")
    daystates.create(old.where(F.col("ts") < F.lit(_ARRIVES)), hours, states)
    anew = daystates.update(spark, corrected.where((F.col("ts") >= F.lit(_ARRIVES)) | seventh), hours, states)
    return spark.read.parquet(states), anew


@query("incremental_yearly", _CORRECTED + """ select cast(year(ts) as int) "year", round_even(avg(pred_gap), 0) avg_gap,
  round_even(avg(pred_demand), 0) avg_demand, round_even(avg(pred_solar), 0) avg_solar,
  round_even(avg(pred_wind), 0) avg_wind,
  round_even(avg(case when pred_gap > 0 then 1.0 else 0.0 end) * 100, 0) pct_deficit from corrected group by 1""", "daily")
def _(spark, d):
    return daystates.yearly_summary(kept_states(spark, d)[0])


@query("incremental_pivot", _CORRECTED + """ select cast(year(ts) as int) "year", """ + ", ".join(
    f"round(avg(case when month(ts) = {i + 1} then pred_gap end), 4) + 0.0 \"{m}\"" for i, m in enumerate(MONTH_NAMES)) +
       " from corrected group by 1", "daily")
def _(spark, d):
    return rounded(daystates.year_month_pivot(kept_states(spark, d)[0]), 4)


@query("touched_days", """select cast(cast(ts as date) as timestamp) ts, count(*) "rows", count(case when pred_gap +
  case when month(ts) = 5 and day(ts) = 7 then 4096 else 0 end > 0 then 1 end) deficits from daily
  where ts >= timestamp '1997-01-01' or (month(ts) = 5 and day(ts) = 7) group by 1""", "daily")
def _(spark, d):
    """The days whose states an update computes anew."""
    return kept_states(spark, d)[1].select(F.col("day").cast("timestamp_ntz").alias("ts"), "rows", "deficits")


@query("incremental_weekly_by_series", """, binned as (select series_id, date_trunc('week', ts) + interval 6 days b,
  avg(load_actual) load_actual from regional group by 1, 2),
spine as (select series_id, unnest(generate_series(mn, mx, interval 7 days)) b
  from (select series_id, min(b) mn, max(b) mx from binned group by 1))
select spine.series_id, cast(spine.b as timestamp) ts, round(load_actual, 4) + 0.0 load_actual from spine
  left join binned on spine.b = binned.b and spine.series_id = binned.series_id""", "regional")
def _(spark, d):
    """Weeks of each series from day states that took every third day later."""
    rows, keys, late = regional_demand(spark, d), ["series_id"], F.dayofyear("ts") % 3 == 0
    hours, states = staging_path(spark, "hours"), staging_path(spark, "states")
    options = {"measures": ["load_actual"], "gap": "load_actual", "keys": keys}
    daystates.create(rows.where(~late), hours, states, **options)
    daystates.update(spark, rows.where(late), hours, states, **options)
    return rounded(daystates.resample(spark.read.parquet(states), "W", ["load_actual"], keys), 4)


_P = [0.1, 0.25, 0.5, 0.65, 0.9]
_RANGE = "ts >= timestamp '1994-02-10' and ts < timestamp '1997-06-01'"


@query("quantiles_of_range", " union all ".join(f"""select cast({p} as double) p, count(pred_gap) n,
  round(quantile_cont(pred_gap, {p}), 6) + 0.0 q from daily where {_RANGE}""" for p in _P), "daily")
def _(spark, d):
    path = staging_path(spark, "ranges")
    rangequantiles.create(grid_daily(spark, d), "pred_gap", path)
    return rounded(rangequantiles.quantiles(spark, path, _P, datetime(1994, 2, 10), datetime(1997, 6, 1)), 6, "q")


@query("quantiles_of_range_by_series", " union all ".join(f"""select series_id, cast({p} as double) p,
  count(load_actual) n, round(quantile_cont(load_actual, {p}), 6) + 0.0 q from regional where {_RANGE} group by 1"""
                                                           for p in _P), "regional")
def _(spark, d):
    path, keys = staging_path(spark, "ranges"), ["series_id"]
    rangequantiles.create(regional_demand(spark, d), "load_actual", path, keys=keys)
    found = rangequantiles.quantiles(spark, path, _P, datetime(1994, 2, 10), datetime(1997, 6, 1), keys)
    return rounded(found, 6, "q")


@query("rejected_rows", """select case when day(ts) = 3 and hour(ts) % 5 = 0 then 'time'
  when day(ts) = 4 and hour(ts) % 7 = 0 then 'value' else 'good' end outcome, count(*) "rows",
  count(case when day(ts) = 3 and hour(ts) % 5 = 0 or day(ts) = 4 and hour(ts) % 7 = 0 then 1 end) lines
  from hourly group by 1""", "hourly")
def _(spark, d):
    """A raw file in which some times and numbers are unreadable: good and rejected rows add up to it."""
    long = {short: name for name, short in CLEANING_COLUMNS.items()}
    raw = grid_hourly(spark, d).withColumnRenamed("solar_cap", "solar_capacity").withColumnsRenamed({"ts": RAW_TIME, **long})
    bad_time = (F.day(RAW_TIME) == 3) & (F.hour(RAW_TIME) % 5 == 0)
    bad_value = (F.day(RAW_TIME) == 4) & (F.hour(RAW_TIME) % 7 == 0)
    price = long["price"]
    damaged = raw.withColumn(price, F.when(bad_value, F.lit("n/a")).otherwise(F.col(price).cast("string"))).withColumn(
        RAW_TIME, F.when(bad_time, F.lit("yesterday")).otherwise(F.date_format(RAW_TIME, "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    path = staging_path(spark, "raw-csv")
    writers.write_table(damaged, path, "csv")
    good, rejected = readers.read_checked(spark, path, CLEANING_COLUMNS)
    both = good.select(F.lit("good").alias("outcome"), F.lit(None).cast("string").alias("line")).unionByName(
        rejected.select(F.col("reason").alias("outcome"), "line"))
    return both.groupBy("outcome").agg(F.count("*").alias("rows"), F.count("line").alias("lines"))


@query("live_features", """, rolled as (select series_id, ts, "value", lag("value", 1) over w lag_1,
  lag("value", 24) over w lag_24,
  case when count("value") over f = 24 then avg("value") over f end mean_24,
  case when count("value") over f = 24 then stddev_samp("value") over f end std_24
  from series window w as (partition by series_id order by ts, "value"),
  f as (partition by series_id order by ts, "value" rows between 24 preceding and 1 preceding))
select series_id, ts, "value", lag_1, lag_24, round(mean_24, 6) + 0.0 mean_24, round(std_24, 6) + 0.0 std_24 from rolled
  where ts <= (select date_trunc('milliseconds', max(ts)) - interval 1 hour from series)""", "series")
def _(spark, d):
    """Features of arriving events, one series per type; those of the last hour still wait for the watermark."""
    schema = table(spark, d, "events").schema
    arriving = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    rows = arriving.select(F.col("event_type").alias("series_id"), "ts", cents("value").cast("double").alias("value"))
    made = stream_features(rows, "value", {"lag_1": 1, "lag_24": 24}, {24: ("mean_24", "std_24")}, "1 hour",
                           keys=["series_id"])
    return rounded(run_to_table(made), 6, "mean_24", "std_24")
