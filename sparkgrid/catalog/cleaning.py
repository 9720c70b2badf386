"""Cleaning, filling and row-wise derivations."""

from pyspark.sql import functions as F

from sparkgrid.catalog.base import query, rounded
from sparkgrid.functions import energy
from sparkgrid.functions.calendar import calendar, cyclical, month_name, season
from sparkgrid.functions.columns import clip
from sparkgrid.operators import clean as ops
from sparkgrid.operators.fill import Fill, fill
from sparkgrid.operators.stats import axis_limits
from sparkgrid.operators.supply import reconstruct
from sparkgrid.plans.cleaning import clean
from sparkgrid.sources.views import demand_predictions, event_series, grid_daily, grid_hourly, regional_demand

MEASURES = ["load_actual", "load_forecast", "solar_gen", "wind_gen", "wind_onshore", "wind_offshore", "price",
            "solar_cap", "wind_cap"]


def clean_hourly(spark, d):
    return clean(grid_hourly(spark, d).withColumnRenamed("solar_cap", "solar_capacity")
                 .drop("wind_cap", "solar_profile", "wind_profile"))


def scored_hourly(spark, d):
    """Stand-in predictions next to the measurements, with supply and gap."""
    rows = grid_hourly(spark, d).select(
        "ts", F.col("load_actual").alias("actual_demand"), F.col("load_forecast").alias("pred_demand"),
        F.col("solar_gen").alias("actual_solar"), F.col("wind_gen").alias("actual_wind"),
        (F.col("solar_gen") * 0.75 + 512).alias("pred_solar"), (F.col("wind_gen") * 0.5 + 8192).alias("pred_wind"))
    return energy.scored_balance(rows)


query("grid_hourly", "select * from hourly", "hourly")(grid_hourly)
query("grid_daily", "select * from daily", "daily")(grid_daily)
query("regional_demand", "select * from regional", "regional")(regional_demand)
query("scored_hourly", "select * from scored", "scored")(scored_hourly)


@query("missing_profile", " union all ".join(
    f"select '{c}' \"column\", count(*) - count({c}) missing, "
    f"round_even((count(*) - count({c})) / count(*) * 100, 2) missing_pct from hourly" for c in MEASURES), "hourly")
def _(spark, d):
    return ops.missing_profile(grid_hourly(spark, d), MEASURES)


@query("missing_total", "select cast(" + " + ".join(f"count(*) - count({c})" for c in MEASURES) +
       " as bigint) missing from hourly", "hourly")
def _(spark, d):
    return ops.missing_total(grid_hourly(spark, d), MEASURES)


@query("ffill_limited", """select ts,
  last_value(solar_gen ignore nulls) over (order by ts rows between 3 preceding and current row) solar_gen,
  last_value(wind_gen ignore nulls) over (order by ts rows between 3 preceding and current row) wind_gen
  from hourly""", "hourly")
def _(spark, d):
    return fill(grid_hourly(spark, d).select("ts", "solar_gen", "wind_gen"),
                {"solar_gen": Fill("forward", 3), "wind_gen": Fill("forward", 3)})


@query("ffill_full", """select ts, last_value(solar_cap ignore nulls) over (order by ts) solar_cap,
  last_value(wind_gen ignore nulls) over (order by ts) wind_gen from hourly""", "hourly")
def _(spark, d):
    return fill(grid_hourly(spark, d).select("ts", "solar_cap", "wind_gen"),
                {"solar_cap": Fill("forward"), "wind_gen": Fill("forward")})


@query("fill_both", """select ts, coalesce(last_value(solar_cap ignore nulls) over (order by ts),
  first_value(solar_cap ignore nulls) over (order by ts rows between current row and unbounded following)) solar_cap,
  coalesce(last_value(wind_gen ignore nulls) over (order by ts),
  first_value(wind_gen ignore nulls) over (order by ts rows between current row and unbounded following)) wind_gen
  from hourly""", "hourly")
def _(spark, d):
    return fill(grid_hourly(spark, d).select("ts", "solar_cap", "wind_gen"),
                {"solar_cap": Fill("both"), "wind_gen": Fill("both")})


@query("fill_backward", """select ts,
  first_value(wind_gen ignore nulls) over (order by ts rows between current row and unbounded following) wind_gen
  from hourly""", "hourly")
def _(spark, d):
    return fill(grid_hourly(spark, d).select("ts", "wind_gen"), {"wind_gen": Fill("backward")})


@query("interpolate_limited", "select ts, price from clean", "clean")
def _(spark, d):
    filled = fill(grid_hourly(spark, d).select("ts", "load_actual", "price"),
                  {"price": Fill("interpolate", 6), "load_actual": Fill("forward", 3)})
    return filled.where(F.col("load_actual").isNotNull()).select("ts", "price")


@query("fill_by_series", """, gappy as (select series_id, ts, case when "value" >= 3000 then "value" end v,
  row_number() over (partition by series_id order by ts) - 1 pos from series),
seen as (select *, last_value(v ignore nulls) over b pv,
  last_value(case when v is not null then pos end ignore nulls) over b pp,
  first_value(v ignore nulls) over f nv,
  first_value(case when v is not null then pos end ignore nulls) over f np from gappy
  window b as (partition by series_id order by ts rows between unbounded preceding and current row),
  f as (partition by series_id order by ts rows between current row and unbounded following))
select series_id, ts, coalesce(v, case when pos - pp <= 3 then pv end) short,
  coalesce(v, pv) "full",
  coalesce(v, case when pos - pp <= 6 then case when np is null then pv
    else pv + (nv - pv) * (pos - pp) / nullif(np - pp, 0) end end) line from seen""", "series")
def _(spark, d):
    v = F.when(F.col("value") >= 3000, F.col("value"))
    rows = event_series(spark, d).select("series_id", "ts", v.alias("short"), v.alias("full"), v.alias("line"))
    return fill(rows, {"short": Fill("forward", 3), "full": Fill("forward"), "line": Fill("interpolate", 6)},
                keys=["series_id"], ties=["short"])


query("clean_table", "select * from clean", "clean")(clean_hourly)


@query("drop_missing", """select ts, load_actual, solar_gen, wind_gen from hourly
  where load_actual is not null and solar_gen is not null and wind_gen is not null""", "hourly")
def _(spark, d):
    return ops.drop_missing(grid_hourly(spark, d).select("ts", "load_actual", "solar_gen", "wind_gen"),
                            ["load_actual", "solar_gen", "wind_gen"])


@query("drop_missing_any", """select * from hourly where load_actual is not null and load_forecast is not null
  and solar_gen is not null and wind_gen is not null and wind_onshore is not null and wind_offshore is not null
  and price is not null and solar_cap is not null and wind_cap is not null""", "hourly")
def _(spark, d):
    rows = grid_hourly(spark, d)
    return ops.drop_missing(rows, rows.columns)


@query("clip_bounds", """select ts, case when load_actual - load_forecast < 0 then 0.0
  else load_actual - load_forecast end above_zero,
  case when load_actual / load_forecast * 100 < 0 then 0.0 when load_actual / load_forecast * 100 > 100 then 100.0
  else load_actual / load_forecast * 100 end per_cent from hourly""", "hourly")
def _(spark, d):
    return grid_hourly(spark, d).select(
        "ts", clip(F.col("load_actual") - F.col("load_forecast"), 0).alias("above_zero"),
        clip(F.col("load_actual") / F.nullif(F.col("load_forecast"), F.lit(0.0)) * 100, 0, 100).alias("per_cent"))


@query("without_zone", "select ts from hourly", "hourly")
def _(spark, d):
    zoned = grid_hourly(spark, d).select(F.col("ts").cast("timestamp").alias("ts"))
    return ops.without_zone(zoned)


@query("year_slice", "select ts, pred_gap from daily where year(ts) = 1998", "daily")
def _(spark, d):
    return ops.date_slice(grid_daily(spark, d).select("ts", "pred_gap"), 1998)[0]


@query("month_slice", "select ts, pred_gap from daily where year(ts) = 1999 and month(ts) = 12", "daily")
def _(spark, d):
    return ops.date_slice(grid_daily(spark, d).select("ts", "pred_gap"), 1999, 12)[0]


@query("weekday_rows", "select ts, load_actual from hourly where isodow(ts) < 6", "hourly")
def _(spark, d):
    return ops.day_kind(grid_hourly(spark, d).select("ts", "load_actual"), weekend=False)


@query("weekend_rows", "select ts, load_actual from hourly where isodow(ts) >= 6", "hourly")
def _(spark, d):
    return ops.day_kind(grid_hourly(spark, d).select("ts", "load_actual"), weekend=True)


@query("usable_columns", """select count(solar_profile) > 600 and count(wind_profile) > 600 usable from hourly""",
       "hourly")
def _(spark, d):
    return ops.usable(grid_hourly(spark, d), "solar_profile", "wind_profile", 600)


@query("duplicate_times", """select event_type, date_trunc('hour', ts) ts, count(*) "rows" from events
  group by 1, 2 having count(*) > 1""")
def _(spark, d):
    from sparkgrid.functions.calendar import start_of_hour
    from sparkgrid.sources.views import table
    hours = table(spark, d, "events").select("event_type", start_of_hour("ts").alias("ts"))
    return ops.duplicates(hours, "ts", ["event_type"])


@query("calendar", """select ts, cast(hour(ts) as int) "hour", cast(isodow(ts) - 1 as int) day_of_week,
  cast(month(ts) as int) "month", cast(year(ts) as int) "year", cast(dayofyear(ts) as int) day_of_year,
  case when isodow(ts) >= 6 then 1 else 0 end is_weekend,
  case when month(ts) in (12, 1, 2) then 'Winter' when month(ts) in (3, 4, 5) then 'Spring'
       when month(ts) in (6, 7, 8) then 'Summer' else 'Autumn' end season from series""", "series")
def _(spark, d):
    return calendar(event_series(spark, d).select("ts")).withColumn("season", season("month"))


@query("cyclical", "select ts, " + ", ".join(
    f"round({f}(2 * pi() * {c} / {p}), 9) + 0.0 {n}_{f}"
    for c, n, p in (("hour(ts)", "hour", 24), ("month(ts)", "month", 12), ("(isodow(ts) - 1)", "dow", 7),
                    ("dayofyear(ts)", "doy", 365)) for f in ("sin", "cos")) + " from daily", "daily")
def _(spark, d):
    rows = cyclical(calendar(grid_daily(spark, d).select("ts")), "hour", "month", "day_of_week", "day_of_year")
    names = [f"{n}_{f}" for n in ("hour", "month", "dow", "doy") for f in ("sin", "cos")]
    return rounded(rows.select("ts", *names), 9)


@query("measured_balance", """select ts, solar_gen + wind_gen renewable_total,
  load_actual - (solar_gen + wind_gen) supply_gap, load_actual - load_forecast forecast_error from hourly""", "hourly")
def _(spark, d):
    return energy.measured_balance(grid_hourly(spark, d)).select(
        "ts", "renewable_total", "supply_gap", "forecast_error")


@query("utilisation", """select ts, case when solar_gen / nullif(price, 0) * 100 > 100 then 100.0
  else solar_gen / nullif(price, 0) * 100 end solar_utilisation from hourly""", "hourly")
def _(spark, d):
    return energy.utilisation(grid_hourly(spark, d), "solar_gen", "price").select("ts", "solar_utilisation")


RAW = {"solar_gen": "solar_raw", "wind_gen": "wind_raw"}


@query("reconstruct_capacity", """select ts, solar_cap_f solar_cap, wind_cap_f wind_cap,
  case when usable then solar_profile * solar_cap_f else solar_gen end solar_gen,
  case when usable then wind_profile * wind_cap_f else wind_gen end wind_gen from (
  select ts, solar_profile, wind_profile, solar_gen, wind_gen,
  (select count(solar_profile) > 100 and count(wind_profile) > 100 from hourly) usable, last_value(solar_cap ignore nulls) over (order by ts) solar_cap_f,
  last_value(wind_cap ignore nulls) over (order by ts) wind_cap_f from hourly)""", "hourly")
def _(spark, d):
    raw = grid_hourly(spark, d).withColumnsRenamed(RAW)
    return reconstruct(raw, "capacity", min_rows=100).select("ts", "solar_cap", "wind_cap", "solar_gen", "wind_gen")


@query("reconstruct_fallback", "select ts, solar_gen, wind_gen from hourly", "hourly")
def _(spark, d):
    raw = grid_hourly(spark, d).withColumnsRenamed(RAW)
    return reconstruct(raw, "capacity", min_rows=10**12).select("ts", "solar_gen", "wind_gen")


@query("reconstruct_peak", """select ts,
  case when (select max(solar_profile) from hourly) > 1 then solar_profile / (select max(solar_profile) from hourly)
    else solar_profile end * 30000.0 solar_gen,
  case when (select max(wind_profile) from hourly) > 1 then wind_profile / (select max(wind_profile) from hourly)
    else wind_profile end * 45000.0 wind_gen,
  coalesce(last_value(solar_cap ignore nulls) over (order by ts),
    first_value(solar_cap ignore nulls) over (order by ts rows between current row and unbounded following)) solar_cap
  from hourly""", "hourly")
def _(spark, d):
    return reconstruct(grid_hourly(spark, d), "peak").select("ts", "solar_gen", "wind_gen", "solar_cap")


@query("profile_over_one", """select ts,
  solar_profile * 64 / (select max(solar_profile * 64) from hourly) * 30000.0 solar_gen,
  wind_profile * 64 / (select max(wind_profile * 64) from hourly) * 45000.0 wind_gen from hourly""", "hourly")
def _(spark, d):
    from sparkgrid.operators.supply import scale_to_peak
    rows = grid_hourly(spark, d).select("ts", (F.col("solar_profile") * 64).alias("solar_profile"),
                                        (F.col("wind_profile") * 64).alias("wind_profile"))
    return scale_to_peak(rows, rows).select("ts", "solar_gen", "wind_gen")


@query("split_gap", """select ts, case when pred_gap > 0 then pred_gap end deficit,
  case when pred_gap <= 0 then pred_gap end surplus from scored""", "scored")
def _(spark, d):
    return energy.split_gap(scored_hourly(spark, d)).select("ts", "deficit", "surplus")


@query("stack_supply", "select ts, pred_solar solar_top, pred_solar + pred_wind wind_top from daily", "daily")
def _(spark, d):
    return energy.stack_supply(grid_daily(spark, d)).select("ts", "solar_top", "wind_top")


@query("month_names", "select ts, strftime(ts, '%b') \"name\" from daily", "daily")
def _(spark, d):
    return grid_daily(spark, d).select("ts", month_name(F.month("ts")).alias("name"))


@query("prediction_errors", """select ts, load_actual - pred_gbt err_gbt, abs(load_actual - pred_gbt) abs_gbt,
  load_actual - pred_rf err_rf, abs(load_actual - pred_rf) abs_rf from predictions""", "predictions")
def _(spark, d):
    rows = energy.errors(demand_predictions(spark, d), "load_actual", {"gbt": "pred_gbt", "rf": "pred_rf"})
    return rows.select("ts", "err_gbt", "abs_gbt", "err_rf", "abs_rf")


@query("axis_limits", """select least(min(load_actual), min(pred_gbt)) * 0.95 low,
  greatest(max(load_actual), max(pred_gbt)) * 1.05 high from predictions""", "predictions")
def _(spark, d):
    return axis_limits(demand_predictions(spark, d), ["load_actual", "pred_gbt"])


@query("fill_null_series", """, gappy as (select nullif(series_id, 'view') series_id, ts,
  case when "value" >= 3000 then "value" end v, row_number() over (partition by series_id order by ts) - 1 pos from series),
seen as (select *, last_value(v ignore nulls) over b pv,
  last_value(case when v is not null then pos end ignore nulls) over b pp from gappy
  window b as (partition by series_id order by ts rows between unbounded preceding and current row))
select series_id, ts, coalesce(v, case when pos - pp <= 3 then pv end) short, coalesce(v, pv) "full" from seen""", "series")
def _(spark, d):
    v = F.when(F.col("value") >= 3000, F.col("value"))
    rows = event_series(spark, d).select(F.nullif(F.col("series_id"), F.lit("view")).alias("series_id"), "ts",
                                         v.alias("short"), v.alias("full"))
    return fill(rows, {"short": Fill("forward", 3), "full": Fill("forward")}, keys=["series_id"], ties=["short"])


# Profiles by series: one exceeds 1, one is empty, one is negative in places.
_PROFILES = """, profiles as (select series_id, ts, load_actual,
  case when series_id = 'NATION_1' then null when series_id = 'NATION_2' then load_actual / 1048576 * 8 - 0.5
       when series_id = 'NATION_3' then load_actual / 1048576 + 1 else load_actual / 134217728 end profile,
  load_actual / 64 raw from regional)"""


def _profiles(spark, d):
    load, series = F.col("load_actual"), F.col("series_id")
    profile = (F.when(series == "NATION_1", F.lit(None)).when(series == "NATION_2", load / 1048576 * 8 - 0.5)
               .when(series == "NATION_3", load / 1048576 + 1).otherwise(load / 134217728))
    return regional_demand(spark, d).select(
        "series_id", "ts", "load_actual", profile.alias("solar_profile"), (profile / 2).alias("wind_profile"),
        (load / 64).alias("solar_raw"), (load / 64 - 100000).alias("wind_raw"),
        F.lit(1024.0).alias("solar_cap"), F.lit(2048.0).alias("wind_cap"))


def _floor(value: str) -> str:
    return f"case when {value} < 0 then 0.0 else {value} end"


@query("reconstruct_capacity_by_series", _PROFILES + f""", flags as (select series_id, count(profile) > 100 usable
  from profiles group by 1)
select p.series_id, ts, case when usable then {_floor('profile * 1024')} else {_floor('raw')} end solar_gen,
  case when usable then {_floor('profile / 2 * 2048')} else {_floor('raw - 100000')} end wind_gen
  from profiles p join flags f on p.series_id = f.series_id""", "regional")
def _(spark, d):
    made = reconstruct(_profiles(spark, d), "capacity", keys=["series_id"], min_rows=100)
    return made.select("series_id", "ts", "solar_gen", "wind_gen")


@query("reconstruct_peak_by_series", _PROFILES + f""", tops as (select series_id, max(profile) top from profiles group by 1)
select p.series_id, ts,
  round({_floor('case when top > 1 then profile / top else profile end * 30000.0')}, 6) + 0.0 solar_gen,
  round({_floor('case when top / 2 > 1 then profile / 2 / (top / 2) else profile / 2 end * 45000.0')}, 6) + 0.0 wind_gen
  from profiles p join tops t on p.series_id = t.series_id""", "regional")
def _(spark, d):
    made = reconstruct(_profiles(spark, d), "peak", keys=["series_id"])
    return rounded(made.select("series_id", "ts", "solar_gen", "wind_gen"), 6)


@query("utilisation_clipped", """select ts, case when u < 0 then 0.0 when u > 100 then 100.0 else u end solar_utilisation
  from (select ts, (load_actual - load_forecast) / nullif(price, 0) * 100 u from hourly)""", "hourly")
def _(spark, d):
    rows = grid_hourly(spark, d).withColumn("solar_gen", F.col("load_actual") - F.col("load_forecast"))
    return energy.utilisation(rows, "solar_gen", "price").select("ts", "solar_utilisation")
