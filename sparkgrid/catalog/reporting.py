"""The tables behind figures, printed reports and the interactive view."""

from pyspark.sql import functions as F

from sparkgrid.catalog.aggregates import histogram_sql, resample_sql
from sparkgrid.catalog.base import FIXED_SQL, level_case, lookup_case, query, rounded
from sparkgrid.catalog.cleaning import clean_hourly, scored_hourly
from sparkgrid.constants import ACTIONS, LEVEL_ORDINAL
from sparkgrid.operators import levels
from sparkgrid.operators.clean import date_slice
from sparkgrid.plans import dashboard as board
from sparkgrid.plans import reports
from sparkgrid.sources.views import demand_predictions, grid_daily

_HALVES = "case when {0} > 0 then {0} end deficit, case when {0} <= 0 then {0} end surplus"


def fixed_levels(spark, d):
    """Hourly gaps, scaled to the fixed thresholds, with level and action."""
    rows = scored_hourly(spark, d).withColumn("pred_gap", F.col("pred_gap") / 8).dropna(subset=["pred_gap"])
    return levels.classify(rows)


_FIXED = f""", leveled as (select ts, pred_solar, pred_wind, pred_demand, pred_gap / 8 pred_gap,
  {level_case('pred_gap / 8', overrides=FIXED_SQL)} "level" from scored where pred_gap is not null)"""


@query("report_year_series", f"""select ts, solar_gen, wind_gen, load_actual, load_forecast, supply_gap,
  {_HALVES.format('supply_gap')} from clean where "year" = (select "year" from clean group by 1
  order by count(*) desc, 1 limit 1)""", "clean")
def _(spark, d):
    return reports.year_series(clean_hourly(spark, d))


@query("report_hour_pattern", """select "hour", avg(solar_gen) solar_gen, avg(wind_gen) wind_gen,
  avg(load_actual) load_actual, avg(case when is_weekend = 0 then load_actual end) weekday,
  avg(case when is_weekend = 1 then load_actual end) weekend from clean group by 1""", "clean")
def _(spark, d):
    return reports.hour_pattern(clean_hourly(spark, d))


@query("report_seasons", """, names as (select * from (values (0, 'Winter'), (1, 'Spring'), (2, 'Summer'), (3, 'Autumn'))
  t(ordinal, season)),
means as (select season, avg(solar_gen) solar_gen, avg(wind_gen) wind_gen, avg(load_actual) load_actual,
  avg(supply_gap) supply_gap from clean group by 1)
select cast(ordinal as int) ordinal, names.season, solar_gen, wind_gen, load_actual, supply_gap from names
  left join means on names.season = means.season""", "clean")
def _(spark, d):
    return reports.season_averages(clean_hourly(spark, d))


@query("report_forecast_error_histogram", histogram_sql("clean", "forecast_error"), "clean")
def _(spark, d):
    return rounded(reports.forecast_error_report(clean_hourly(spark, d))[0], 4, "low", "high")


@query("report_forecast_error_by_hour", """select cast("hour" as int) "hour", avg(forecast_error) forecast_error
  from clean group by 1""", "clean")
def _(spark, d):
    return reports.forecast_error_report(clean_hourly(spark, d))[1]


@query("report_key_insights", """, hours as (select "hour" h, avg(load_actual) l, avg(solar_gen) s from clean group by 1),
seasons as (select season, avg(solar_gen) s from clean group by 1)
select avg(abs(forecast_error)) forecast_mae,
  (select h from hours where l is not null order by l desc, h limit 1) peak_load_hour,
  (select h from hours where s is not null order by s desc, h limit 1) peak_solar_hour,
  avg(case when supply_gap > 0 then 1.0 else 0.0 end) * 100 pct_deficit,
  avg(case when supply_gap <= 0 then 1.0 else 0.0 end) * 100 pct_surplus,
  (select season from seasons where s is not null order by s desc, season limit 1) best_solar_season,
  (select season from seasons where s is not null order by s, season limit 1) worst_solar_season,
  round(corr(renewable_total, load_actual), 8) + 0.0 corr_renewable_load,
  round(corr(solar_gen, load_actual), 8) + 0.0 corr_solar_load,
  round(corr(wind_gen, load_actual), 8) + 0.0 corr_wind_load from clean""", "clean")
def _(spark, d):
    return rounded(reports.key_insights(clean_hourly(spark, d)), 8,
                   "corr_renewable_load", "corr_solar_load", "corr_wind_load")


@query("report_week_of_predictions", "select * from predictions order by ts limit 168", "predictions")
def _(spark, d):
    return reports.week_of_predictions(demand_predictions(spark, d))


@query("report_error_histograms", """, err as (select load_actual - pred_gbt gbt, load_actual - pred_rf rf
  from predictions), long as (select 'gbt' model, gbt e from err union all select 'rf', rf from err),
ends as (select model, min(e) lo, max(e) hi from long group by 1),
counted as (select long.model, least(cast(floor(80 * (e - lo) / (hi - lo)) as int) + 1, 80) bin, count(*) c
  from long join ends on long.model = ends.model where e is not null group by 1, 2)
select cast(b as int) bin, round(lo + (b - 1) * ((hi - lo) / 80), 4) + 0.0 low,
  round(lo + b * ((hi - lo) / 80), 4) + 0.0 high, coalesce(c, 0) "rows", ends.model
  from ends cross join (select unnest(generate_series(1, 80)) b)
  left join counted on bin = b and counted.model = ends.model""", "predictions")
def _(spark, d):
    histograms, _ = reports.error_report(demand_predictions(spark, d), {"gbt": "pred_gbt", "rf": "pred_rf"})
    return rounded(histograms, 4, "low", "high")


@query("report_scatter", "select load_actual, pred_gbt from predictions", "predictions")
def _(spark, d):
    return reports.scatter(demand_predictions(spark, d), "pred_gbt")[0]


@query("report_two_week_gap", _FIXED + f"""select ts, pred_solar, pred_wind, pred_demand, pred_gap, "level",
  pred_solar solar_top, pred_solar + pred_wind wind_top, {_HALVES.format('pred_gap')},
  cast({lookup_case('level', LEVEL_ORDINAL)} as int) level_ordinal from leveled order by ts limit 336""", "scored")
def _(spark, d):
    rows = fixed_levels(spark, d).select("ts", "pred_solar", "pred_wind", "pred_demand", "pred_gap", "level")
    return reports.two_week_gap(rows)


@query("report_week_of_supply", """select ts, actual_solar solar_gen, pred_solar, actual_wind wind_gen, pred_wind
  from scored order by ts limit 168""", "scored")
def _(spark, d):
    return reports.week_of_supply(scored_hourly(spark, d).withColumnsRenamed(
        {"actual_solar": "solar_gen", "actual_wind": "wind_gen"}))


@query("report_level_share", _FIXED + """select "level", count(*) "rows",
  count(*) / (select count(*) from leveled) * 100 pct from leveled group by 1""", "scored")
def _(spark, d):
    return reports.level_report(fixed_levels(spark, d))[0]


@query("report_gap_by_hour", "select cast(hour(ts) as int) \"hour\", avg(pred_gap) pred_gap from scored group by 1",
       "scored")
def _(spark, d):
    return reports.gap_patterns(scored_hourly(spark, d))[0]


@query("report_gap_by_month", """select cast(month(ts) as int) "month", avg(pred_gap) pred_gap,
  strftime(min(ts), '%b') "name" from daily group by 1""", "daily")
def _(spark, d):
    return reports.gap_patterns(grid_daily(spark, d))[1]


_DAY = resample_sql("daily", "date_trunc('day', ts)", "1 day",
                    ["pred_demand", "pred_solar", "pred_wind", "pred_gap"])
_SHOWN = f"""select *, pred_solar solar_top, pred_solar + pred_wind wind_top, {_HALVES.format('pred_gap')} from ("""


def _wrap(sql: str) -> str:
    """The stacked and split columns around the final select of a resampling."""
    head, tail = sql.rsplit("\nselect ", 1)
    return f"{head}\n{_SHOWN}select {tail})"


@query("report_daily_overview", _wrap(_DAY), "daily")
def _(spark, d):
    return reports.daily_overview(grid_daily(spark, d).drop("actual_demand", "actual_solar", "actual_wind"))[0]


@query("report_yearly", """select cast(year(ts) as int) "year", round_even(avg(pred_gap), 0) avg_gap,
  round_even(avg(pred_demand), 0) avg_demand, round_even(avg(pred_solar), 0) avg_solar,
  round_even(avg(pred_wind), 0) avg_wind,
  round_even(avg(case when pred_gap > 0 then 1.0 else 0.0 end) * 100, 0) pct_deficit from scored group by 1""", "scored")
def _(spark, d):
    return reports.daily_overview(scored_hourly(spark, d))[1]


_TEXT = "case when {0} < 0 then '-' else '+' end || format('{{:,}}', cast(round_even(abs({0}), 0) as bigint))"


@query("report_sample", _FIXED + f"""select strftime(ts, '%Y-%m-%d %H:%M:%S') "time", {_TEXT.format('pred_gap')} gap,
  "level", {lookup_case('level', ACTIONS)} "action" from leveled order by ts limit 24""", "scored")
def _(spark, d):
    return reports.sample_report(fixed_levels(spark, d))


_LIVE = f""", live as (select ts, pred_gap, {level_case('pred_gap', overrides={
    n: f'trunc({n})' for n in ('crit_def', 'high_def', 'low_def', 'low_sur', 'high_sur', 'crit_sur')})} "level"
  from scored, thresholds where pred_gap is not null)"""


def _complete(spark, d):
    return scored_hourly(spark, d).dropna(subset=["pred_gap"])


@query("dashboard_log", _LIVE + f"""select strftime(ts, '%Y-%m-%d %H:%M') "time",
  {_TEXT.format('pred_gap')} || ' MW' predicted_gap, "level", {lookup_case('level', ACTIONS)} recommended_action
  from live order by ts desc limit 72""", "thresholds")
def _(spark, d):
    return board.dashboard(_complete(spark, d)).log


@query("dashboard_levels", _LIVE + """select "level" live_level, count(*) "rows",
  count(*) / (select count(*) from live where ts >= timestamp '2024-01-01' and ts < timestamp '2024-02-01') * 100 pct
  from live where ts >= timestamp '2024-01-01' and ts < timestamp '2024-02-01' group by 1""", "thresholds")
def _(spark, d):
    return board.dashboard(_complete(spark, d), 2024, 1).levels


@query("dashboard_series_weekly", _wrap(resample_sql(
    "daily", "date_trunc('week', ts) + interval 6 days", "7 days",
    ["pred_demand", "pred_solar", "pred_wind", "pred_gap"])), "daily")
def _(spark, d):
    rows, _, unit = date_slice(grid_daily(spark, d).select("ts", "pred_demand", "pred_solar", "pred_wind", "pred_gap"))
    return board.time_series(rows, unit)


@query("dashboard_series_daily", _wrap(resample_sql(
    "(select * from daily where year(ts) = 1997)", "date_trunc('day', ts)", "1 day",
    ["pred_demand", "pred_solar", "pred_wind", "pred_gap"])), "daily")
def _(spark, d):
    rows, _, unit = date_slice(
        grid_daily(spark, d).select("ts", "pred_demand", "pred_solar", "pred_wind", "pred_gap"), 1997)
    return board.time_series(rows, unit)


@query("dashboard_kpis", """select avg(pred_gap) avg_gap, avg(pred_demand) avg_demand, avg(pred_solar) avg_solar,
  avg(pred_wind) avg_wind, avg(case when pred_gap > 0 then 1.0 else 0.0 end) * 100 pct_deficit,
  avg(case when pred_gap <= 0 then 1.0 else 0.0 end) * 100 pct_surplus from daily where year(ts) = 1996""", "daily")
def _(spark, d):
    return board.kpis(date_slice(grid_daily(spark, d), 1996)[0])


@query("dashboard_series_hourly", f"""select ts, pred_demand, pred_solar, pred_wind, pred_gap, pred_solar solar_top,
  pred_solar + pred_wind wind_top, {_HALVES.format('pred_gap')} from daily
  where ts >= timestamp '1997-03-01' and ts < timestamp '1997-04-01'""", "daily")
def _(spark, d):
    """A month is shown as it is, without means."""
    rows, _, unit = date_slice(
        grid_daily(spark, d).select("ts", "pred_demand", "pred_solar", "pred_wind", "pred_gap"), 1997, 3)
    return board.time_series(rows, unit)


@query("dashboard_selectors", """select cast(count(distinct year(ts)) as bigint) "years",
  round(quantile_cont(pred_gap, 0.5), 4) + 0.0 "median", cast(trunc(min(pred_gap)) as bigint) gap_min,
  cast(trunc(max(pred_gap)) as bigint) gap_max from scored where pred_gap is not null""", "scored")
def _(spark, d):
    from sparkgrid.session import one_row
    shown = board.dashboard(_complete(spark, d))
    row = shown.limits.select("gap_min", "gap_max").withColumns({
        "_m": one_row(shown.median), "_y": one_row(shown.years.agg(F.count("*").alias("years")))})
    return rounded(row.select("_y.years", "_m.median", "gap_min", "gap_max"), 4)
