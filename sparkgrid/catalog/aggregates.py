"""Calendar aggregates, resampling, summary statistics."""

from pyspark.sql import functions as F

from sparkgrid.catalog.base import query, rounded, tidy
from sparkgrid.catalog.cleaning import clean_hourly, scored_hourly
from sparkgrid.constants import CORRELATION_COLUMNS, MONTH_NAMES
from sparkgrid.functions.columns import share
from sparkgrid.operators import rollups, stats
from sparkgrid.operators.quantiles import exact_quantiles, median
from sparkgrid.sources.views import demand_predictions, event_series, grid_daily, grid_hourly, regional_demand

D = ["pred_demand", "pred_solar", "pred_wind", "pred_gap"]


def _avgs(columns):
    return ", ".join(f"avg({c}) {c}" for c in columns)


DESCRIBED = ["pred_demand", "actual_demand", "pred_solar", "pred_wind", "pred_gap"]


@query("describe", " union all ".join(f"""select '{c}' "column", count({c}) "count", round_even(avg({c}), 1) mean,
  round_even(stddev_samp({c}), 1) std, min({c}) "min", round_even(quantile_cont({c}, 0.25), 1) q25,
  round_even(quantile_cont({c}, 0.5), 1) q50, round_even(quantile_cont({c}, 0.75), 1) q75, max({c}) "max"
  from daily""" for c in DESCRIBED), "daily")
def _(spark, d):
    return stats.describe(grid_daily(spark, d), DESCRIBED)


@query("hourly_average", f"""select cast(hour(ts) as int) "hour", {_avgs(["solar_gen", "wind_gen", "load_actual"])}
  from clean group by 1""", "clean")
def _(spark, d):
    return rollups.by_hour(clean_hourly(spark, d), ["solar_gen", "wind_gen", "load_actual"])


@query("weekday_weekend", """select cast(hour(ts) as int) "hour",
  avg(case when isodow(ts) < 6 then load_actual end) weekday, avg(case when isodow(ts) >= 6 then load_actual end) weekend
  from hourly group by 1""", "hourly")
def _(spark, d):
    return rollups.weekday_weekend_by_hour(grid_hourly(spark, d), "load_actual")


@query("season_average", f""", names as (select * from (values (0, 'Winter'), (1, 'Spring'), (2, 'Summer'), (3, 'Autumn'))
  t(ordinal, season)),
means as (select case when month(ts) in (12, 1, 2) then 'Winter' when month(ts) in (3, 4, 5) then 'Spring'
  when month(ts) in (6, 7, 8) then 'Summer' else 'Autumn' end season, {_avgs(D)} from daily group by 1)
select cast(ordinal as int) ordinal, names.season, {", ".join(D)} from names
  left join means on names.season = means.season""", "daily")
def _(spark, d):
    return rollups.by_season(grid_daily(spark, d), D)


@query("season_absent", """, names as (select * from (values (0, 'Winter'), (1, 'Spring'), (2, 'Summer'), (3, 'Autumn'))
  t(ordinal, season)),
means as (select case when month(ts) in (12, 1, 2) then 'Winter' when month(ts) in (3, 4, 5) then 'Spring'
  when month(ts) in (6, 7, 8) then 'Summer' else 'Autumn' end season, avg(load_actual) load_actual
  from hourly group by 1)
select cast(ordinal as int) ordinal, names.season, load_actual from names
  left join means on names.season = means.season""", "hourly")
def _(spark, d):
    return rollups.by_season(grid_hourly(spark, d), ["load_actual"])


@query("monthly_gap", """select cast(month(ts) as int) "month", avg(pred_gap) pred_gap from daily group by 1""", "daily")
def _(spark, d):
    return rollups.by_month(grid_daily(spark, d), ["pred_gap"])


@query("monthly_load_by_series", """select series_id, cast(month(ts) as int) "month", avg(load_actual) load_actual
  from regional group by 1, 2""", "regional")
def _(spark, d):
    return rollups.by_month(regional_demand(spark, d), ["load_actual"], keys=["series_id"])


def _yearly(decimals):
    return f"""select cast(year(ts) as int) "year", round_even(avg(pred_gap), {decimals}) avg_gap,
  round_even(avg(pred_demand), {decimals}) avg_demand, round_even(avg(pred_solar), {decimals}) avg_solar,
  round_even(avg(pred_wind), {decimals}) avg_wind,
  round_even(avg(case when pred_gap > 0 then 1.0 else 0.0 end) * 100, {decimals}) pct_deficit from daily group by 1"""


@query("yearly_summary", _yearly(0), "daily")
def _(spark, d):
    return rollups.yearly_summary(grid_daily(spark, d), 0)


@query("yearly_summary_decimal", _yearly(1), "daily")
def _(spark, d):
    return rollups.yearly_summary(grid_daily(spark, d), 1)


@query("deficit_share", """select avg(case when pred_gap > 0 then 1.0 else 0.0 end) * 100 pct_deficit,
  avg(case when pred_gap <= 0 then 1.0 else 0.0 end) * 100 pct_surplus from scored""", "scored")
def _(spark, d):
    return stats.gap_shares(scored_hourly(spark, d), "pred_gap")


@query("deficit_share_by_series", """select series_id, avg(case when "value" > 5000 then 1.0 else 0.0 end) * 100 pct
  from series group by 1""", "series")
def _(spark, d):
    return event_series(spark, d).groupBy("series_id").agg(share(F.col("value") > 5000).alias("pct"))


@query("kpis", """select avg(pred_gap) avg_gap, avg(pred_demand) avg_demand, avg(pred_solar) avg_solar,
  avg(pred_wind) avg_wind, avg(case when pred_gap > 0 then 1.0 else 0.0 end) * 100 pct_deficit,
  avg(case when pred_gap <= 0 then 1.0 else 0.0 end) * 100 pct_surplus from daily""", "daily")
def _(spark, d):
    return stats.kpis(grid_daily(spark, d))


@query("extremes", """select avg(pred_demand) pred_demand_mean, min(pred_demand) pred_demand_min,
  max(pred_demand) pred_demand_max, avg(pred_gap) pred_gap_mean, min(pred_gap) pred_gap_min,
  max(pred_gap) pred_gap_max from daily""", "daily")
def _(spark, d):
    return stats.extremes(grid_daily(spark, d), ["pred_demand", "pred_gap"])


@query("median_gap", "select round(quantile_cont(pred_gap, 0.5), 4) + 0.0 \"median\" from daily", "daily")
def _(spark, d):
    return rounded(median(grid_daily(spark, d), "pred_gap"), 4)


_QUANTILES = " union all ".join(
    f"""select series_id, cast({p} as double) p, count(*) n, round(quantile_cont("value", {p}), 4) + 0.0 q
  from series group by 1""" for p in (0.1, 0.25, 0.5, 0.9))


def _quantiles(spark, d, **limits):
    wanted = {"value": (F.col("value"), [0.1, 0.25, 0.5, 0.9])}
    q = exact_quantiles(event_series(spark, d), wanted, ["series_id"], **limits)
    return q.select("series_id", "p", "n", tidy(F.col("q"), 4).alias("q"))


@query("quantiles_by_series", _QUANTILES, "series")
def _(spark, d):
    return _quantiles(spark, d)


@query("quantiles_from_bins", _QUANTILES, "series")
def _(spark, d):
    """The way taken by groups too large for one aggregate."""
    return _quantiles(spark, d, aggregate_rows=0)


@query("quantiles_from_ranges", _QUANTILES, "series")
def _(spark, d):
    """The way taken by bins too large for one window."""
    return _quantiles(spark, d, aggregate_rows=0, window_rows=0)


_PAIRS = [(b, a) for i, a in enumerate(CORRELATION_COLUMNS) for b in CORRELATION_COLUMNS[i + 1:]]


@query("correlation_pairs", " union all ".join(
    f"""select '{a}' "first", '{b}' "second", case when stddev_pop(cast("{a}" as double)) * stddev_pop(cast("{b}"
  as double)) > 0 then round(corr("{a}", "{b}"), 8) + 0.0 end corr from clean
  where "{a}" is not null and "{b}" is not null""" for a, b in _PAIRS), "clean")
def _(spark, d):
    return rounded(stats.correlation_pairs(clean_hourly(spark, d), CORRELATION_COLUMNS), 8)


@query("correlations", """select round(corr(pred_solar, pred_demand), 8) + 0.0 solar_demand,
  round(corr(pred_wind, pred_demand), 8) + 0.0 wind_demand, round(corr(actual_solar, actual_demand), 8) + 0.0 actual
  from daily""", "daily")
def _(spark, d):
    return rounded(stats.correlations(grid_daily(spark, d), {
        "solar_demand": ("pred_solar", "pred_demand"), "wind_demand": ("pred_wind", "pred_demand"),
        "actual": ("actual_solar", "actual_demand")}), 8)


def histogram_sql(source: str, column: str) -> str:
    return f""", ends as (select min({column}) lo, max({column}) hi from {source}),
counted as (select least(cast(floor(80 * ({column} - lo) / (hi - lo)) as int) + 1, 80) bin, count(*) c
  from {source}, ends where {column} is not null group by 1)
select cast(b as int) bin, round(lo + (b - 1) * ((hi - lo) / 80), 4) + 0.0 low,
  round(lo + b * ((hi - lo) / 80), 4) + 0.0 high, coalesce(c, 0) "rows"
  from ends, (select unnest(generate_series(1, 80)) b) left join counted on bin = b"""


@query("histogram", histogram_sql("daily", "pred_gap"), "daily")
def _(spark, d):
    return rounded(stats.histogram(grid_daily(spark, d), "pred_gap"), 4, "low", "high")


@query("peak_groups", """, hours as (select cast(hour(ts) as int) h, avg(load_actual) l, avg(solar_gen) s from clean group by 1)
select (select h from hours where l is not null order by l desc, h limit 1) peak_load_hour,
  (select h from hours where s is not null order by s desc, h limit 1) peak_solar_hour,
  (select h from hours where s is not null order by s, h limit 1) least_solar_hour""", "clean")
def _(spark, d):
    hours = rollups.by_hour(clean_hourly(spark, d), ["load_actual", "solar_gen"])
    return stats.group_extremes(hours, "hour", {
        "peak_load_hour": ("load_actual", "most"), "peak_solar_hour": ("solar_gen", "most"),
        "least_solar_hour": ("solar_gen", "least")})


@query("fullest_year", """select cast(year(ts) as int) "year", count(*) "rows" from daily group by 1
  order by 2 desc, 1 limit 1""", "daily")
def _(spark, d):
    return rollups.fullest_year(grid_daily(spark, d))


@query("year_month_pivot", """select cast(year(ts) as int) "year", """ + ", ".join(
    f"avg(case when month(ts) = {i + 1} then pred_gap end) \"{m}\"" for i, m in enumerate(MONTH_NAMES)) +
       " from daily group by 1", "daily")
def _(spark, d):
    return rollups.year_month_pivot(grid_daily(spark, d))


@query("years", "select distinct cast(year(ts) as int) \"year\" from daily", "daily")
def _(spark, d):
    return rollups.years(grid_daily(spark, d))


@query("months", "select distinct cast(month(ts) as int) \"month\" from daily where year(ts) = 2001", "daily")
def _(spark, d):
    return rollups.months(grid_daily(spark, d), 2001)


def resample_sql(source: str, label: str, step: str, columns: list[str]) -> str:
    return f""", binned as (select {label} b, {_avgs(columns)} from {source} group by 1),
spine as (select unnest(generate_series(mn, mx, interval {step})) b from (select min(b) mn, max(b) mx from binned))
select cast(spine.b as timestamp) ts, {", ".join(columns)} from spine left join binned on spine.b = binned.b"""


@query("resample_daily", resample_sql("daily", "date_trunc('day', ts)", "1 day", D), "daily")
def _(spark, d):
    return rollups.resample(grid_daily(spark, d), "D", columns=D)


@query("resample_daily_hours", resample_sql("hourly", "date_trunc('day', ts)", "1 day",
                                            ["load_actual", "solar_gen", "wind_gen"]), "hourly")
def _(spark, d):
    return rollups.resample(grid_hourly(spark, d), "D", columns=["load_actual", "solar_gen", "wind_gen"])


@query("resample_weekly", resample_sql("daily", "date_trunc('week', ts) + interval 6 days", "7 days", D), "daily")
def _(spark, d):
    return rollups.resample(grid_daily(spark, d), "W", columns=D)


@query("resample_by_series", """, binned as (select series_id, date_trunc('week', ts) + interval 6 days b,
  avg(load_actual) load_actual from regional group by 1, 2),
spine as (select series_id, unnest(generate_series(mn, mx, interval 7 days)) b
  from (select series_id, min(b) mn, max(b) mx from binned group by 1))
select spine.series_id, cast(spine.b as timestamp) ts, load_actual from spine
  left join binned on spine.b = binned.b and spine.series_id = binned.series_id""", "regional")
def _(spark, d):
    return rollups.resample(regional_demand(spark, d), "W", keys=["series_id"])


@query("error_by_hour", """select cast(hour(ts) as int) "hour", avg(abs(load_actual - pred_gbt)) gbt,
  avg(abs(load_actual - pred_rf)) rf, avg(abs(load_actual - baseline_forecast)) baseline
  from predictions group by 1""", "predictions")
def _(spark, d):
    return stats.error_by_hour(demand_predictions(spark, d), "load_actual",
                               {"gbt": "pred_gbt", "rf": "pred_rf", "baseline": "baseline_forecast"})


@query("forecast_error", "select avg(abs(forecast_error)) mae, avg(forecast_error) mean_error from clean", "clean")
def _(spark, d):
    return stats.forecast_error(clean_hourly(spark, d))


@query("preview", """select count(*) "rows", cast(8 as int) "columns", min(ts) first_ts, max(ts) last_ts
  from daily""", "daily")
def _(spark, d):
    return stats.preview(grid_daily(spark, d))


# --- several series, one of them without a name -----------------------------

_PARTS = """, parts as (select nullif(series_id, 'view') series_id, ts, "value" from series)"""


def _parts(spark, d):
    return event_series(spark, d).withColumn("series_id", F.nullif(F.col("series_id"), F.lit("view")))


_NULL_QUANTILES = _PARTS + " " + " union all ".join(
    f"""select series_id, cast({p} as double) p, count(*) n, round(quantile_cont("value", {p}), 4) + 0.0 q
  from parts group by 1""" for p in (0.25, 0.5, 0.9))


def _null_quantiles(spark, d, **limits):
    found = exact_quantiles(_parts(spark, d), {"v": (F.col("value"), [0.25, 0.5, 0.9])}, ["series_id"], **limits)
    return rounded(found.drop("name"), 4, "q")


@query("quantiles_null_series", _NULL_QUANTILES, "series")
def _(spark, d):
    return _null_quantiles(spark, d)


@query("quantiles_null_series_from_bins", _NULL_QUANTILES, "series")
def _(spark, d):
    return _null_quantiles(spark, d, aggregate_rows=0)


@query("describe_by_series", _PARTS + """ select series_id, 'value' "column", count("value") "count",
  round_even(avg("value"), 1) mean, round_even(stddev_samp("value"), 1) std, min("value") "min",
  round_even(quantile_cont("value", 0.25), 1) q25, round_even(quantile_cont("value", 0.5), 1) q50,
  round_even(quantile_cont("value", 0.75), 1) q75, max("value") "max" from parts group by 1""", "series")
def _(spark, d):
    return stats.describe(_parts(spark, d), ["value"], keys=["series_id"])


@query("frequency_by_series", """, sized as (select series_id, case when load_actual > 20000000 then 'high' else 'low' end size
  from regional), counted as (select series_id, size, count(*) "rows" from sized group by all)
select series_id, size, "rows", "rows" / sum("rows") over (partition by series_id) * 100 pct from counted""", "regional")
def _(spark, d):
    size = F.when(F.col("load_actual") > 20_000_000, "high").otherwise("low")
    return stats.frequency(regional_demand(spark, d).withColumn("size", size), "size", ["series_id"])


@query("histogram_by_series", _PARTS + """, ends as (select series_id, min("value") lo, max("value") hi from parts group by 1),
counted as (select p.series_id, least(cast(floor(8 * ("value" - lo) / (hi - lo)) as int) + 1, 8) bin, count(*) c
  from parts p join ends e on p.series_id is not distinct from e.series_id group by all)
select e.series_id, cast(b as int) bin, round(lo + (b - 1) * ((hi - lo) / 8), 4) + 0.0 low,
  round(lo + b * ((hi - lo) / 8), 4) + 0.0 high, coalesce(c, 0) "rows"
  from ends e cross join (select unnest(generate_series(1, 8)) b)
  left join counted n on bin = b and n.series_id is not distinct from e.series_id""", "series")
def _(spark, d):
    return rounded(stats.histogram(_parts(spark, d), "value", 8, ["series_id"]), 4, "low", "high")


@query("kpis_by_series", """, gaps as (select series_id, load_actual pred_demand, load_actual / 4 pred_solar,
  load_actual / 2 pred_wind, load_actual - 20000000 pred_gap from regional)
select series_id, round(avg(pred_gap), 4) + 0.0 avg_gap, round(avg(pred_demand), 4) + 0.0 avg_demand,
  round(avg(pred_solar), 4) + 0.0 avg_solar, round(avg(pred_wind), 4) + 0.0 avg_wind,
  avg(case when pred_gap > 0 then 1.0 else 0.0 end) * 100 pct_deficit,
  avg(case when pred_gap <= 0 then 1.0 else 0.0 end) * 100 pct_surplus from gaps group by 1""", "regional")
def _(spark, d):
    load = F.col("load_actual")
    rows = regional_demand(spark, d).select("series_id", load.alias("pred_demand"), (load / 4).alias("pred_solar"),
                                            (load / 2).alias("pred_wind"), (load - 20_000_000).alias("pred_gap"))
    return rounded(stats.kpis(rows, ["series_id"]), 4, "avg_gap", "avg_demand", "avg_solar", "avg_wind")


@query("correlation_pairs_by_series", """, pairs as (select series_id, load_actual a, day(ts) b, month(ts) c from regional)
select series_id, 'b' "first", 'a' "second", round(corr(b, a), 8) + 0.0 corr from pairs group by 1
union all select series_id, 'c', 'a', round(corr(c, a), 8) + 0.0 from pairs group by 1
union all select series_id, 'c', 'b', round(corr(c, b), 8) + 0.0 from pairs group by 1""", "regional")
def _(spark, d):
    rows = regional_demand(spark, d).select("series_id", F.col("load_actual").alias("a"), F.day("ts").alias("b"),
                                            F.month("ts").alias("c"))
    return rounded(stats.correlation_pairs(rows, ["a", "b", "c"], ["series_id"]), 8)


@query("fullest_year_by_series", """select series_id, cast("year" as int) "year", "rows" from (
  select *, row_number() over (partition by series_id order by "rows" desc, "year") r from (
    select series_id, year(ts) "year", count(*) "rows" from regional group by all)) where r = 1""", "regional")
def _(spark, d):
    return rollups.fullest_year(regional_demand(spark, d), keys=["series_id"])


@query("seasons_by_series", """, names as (select * from (values (0, 'Winter'), (1, 'Spring'), (2, 'Summer'), (3, 'Autumn'))
  t(ordinal, season)),
means as (select series_id, case when month(ts) in (12, 1, 2) then 'Winter' when month(ts) in (3, 4, 5) then 'Spring'
  when month(ts) in (6, 7, 8) then 'Summer' else 'Autumn' end season, avg(load_actual) load_actual from regional group by all)
select s.series_id, cast(ordinal as int) ordinal, n.season, round(load_actual, 4) + 0.0 load_actual
  from (select distinct series_id from means) s cross join names n
  left join means m on m.series_id = s.series_id and m.season = n.season""", "regional")
def _(spark, d):
    return rounded(rollups.by_season(regional_demand(spark, d), ["load_actual"], keys=["series_id"]), 4)
