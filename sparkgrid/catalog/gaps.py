"""Joins of demand and supply, thresholds, intervention levels."""

from pyspark.sql import functions as F

from sparkgrid.catalog.base import FIXED_SQL, level_case, lookup_case, query, rounded
from sparkgrid.catalog.cleaning import scored_hourly
from sparkgrid.constants import ACTIONS, DETAILED_ACTIONS, DETAILS, LEVEL_ORDINAL, THRESHOLD_NAMES
from sparkgrid.functions.energy import scored_balance
from sparkgrid.operators import joins, levels
from sparkgrid.operators.stats import frequency
from sparkgrid.sources.readers import demand_source
from sparkgrid.sources.views import demand_predictions, event_series, grid_daily, grid_hourly


@query("demand_supply_join", """select p.ts, load_actual, pred_gbt, pred_solar, pred_wind
  from predictions p join daily d on date_trunc('day', p.ts) - interval 8766 days = d.ts""", "predictions", "daily")
def _(spark, d):
    shifted = demand_predictions(spark, d).select(
        "ts", (F.date_trunc("day", "ts") - F.expr("interval 8766 days")).cast("timestamp_ntz").alias("day"),
        "load_actual", "pred_gbt")
    supply = grid_daily(spark, d).select(F.col("ts").alias("day"), "pred_solar", "pred_wind")
    return joins.join_demand_supply(shifted, supply, "day").drop("day")


@query("full_gap_rows", """select ts, actual_demand, pred_demand, actual_solar, actual_wind, pred_solar, pred_wind,
  pred_supply, actual_supply, pred_gap, actual_gap from (
  select p.ts, p.load_actual actual_demand, pred_gbt pred_demand, solar_gen actual_solar, wind_gen actual_wind,
  solar_gen * 0.75 pred_solar, wind_gen * 0.5 pred_wind, solar_gen * 0.75 + wind_gen * 0.5 pred_supply,
  solar_gen + wind_gen actual_supply, pred_gbt - (solar_gen * 0.75 + wind_gen * 0.5) pred_gap,
  p.load_actual - (solar_gen + wind_gen) actual_gap from predictions p join hourly h on p.ts = h.ts)
  where pred_gap is not null""", "predictions")
def _(spark, d):
    demand = demand_predictions(spark, d).withColumnRenamed("pred_gbt", "pred_demand")
    supply = grid_hourly(spark, d).select("ts", "solar_gen", "wind_gen", (F.col("solar_gen") * 0.75).alias("pred_solar"),
                                          (F.col("wind_gen") * 0.5).alias("pred_wind"))
    return scored_balance(joins.full_gap_rows(demand, supply))


@query("demand_fallback", "select ts, load_actual actual_demand, load_actual pred_demand from hourly", "hourly")
def _(spark, d):
    return demand_source(grid_hourly(spark, d), None)


@query("demand_from_model", """select p.ts, p.load_actual actual_demand, pred_gbt pred_demand
  from predictions p join hourly h on p.ts = h.ts""", "predictions")
def _(spark, d):
    return demand_source(grid_hourly(spark, d), demand_predictions(spark, d))


@query("common_times", """select ts from daily intersect
  select l_shipdate from lineitem where l_linestatus = 'O'""", "daily")
def _(spark, d):
    shipped = spark.read.parquet(f"{d}/lineitem.parquet").where("l_linestatus = 'O'").select(
        F.col("l_shipdate").alias("ts"))
    return joins.common_times(grid_daily(spark, d), shipped)


_ROUNDED = ", ".join(f"round({n}, 4) + 0.0 {n}" for n in THRESHOLD_NAMES)


@query("quantile_thresholds", f"select {_ROUNDED} from daily_thresholds", "daily_thresholds")
def _(spark, d):
    return rounded(levels.quantile_thresholds(grid_daily(spark, d)), 4)


@query("quantile_thresholds_truncated", "select " + ", ".join(f"trunc({n}) {n}" for n in THRESHOLD_NAMES) +
       " from thresholds", "thresholds")
def _(spark, d):
    return levels.quantile_thresholds(scored_hourly(spark, d), truncate=True)


def _side(name, p, test, default):
    return (f"case when count(case when g {test} 0 then 1 end) >= 10 then round(quantile_cont(case when g {test} 0 "
            f"then g end, {p}), 4) + 0.0 else {default} end {name}")


@query("quantile_thresholds_by_series", ", gapped as (select series_id, \"value\" - 6000 g from series) select series_id, " +
       ", ".join([_side("low_def", .25, ">", "500.0"), _side("high_def", .65, ">", "3000.0"),
                  _side("crit_def", .90, ">", "8000.0"), _side("low_sur", .75, "<", "-500.0"),
                  _side("high_sur", .35, "<", "-3000.0"), _side("crit_sur", .10, "<", "-8000.0")]) +
       " from gapped group by 1", "series")
def _(spark, d):
    gaps = event_series(spark, d).select("series_id", (F.col("value") - 6000).alias("pred_gap"))
    return rounded(levels.quantile_thresholds(gaps, keys=["series_id"]), 4)


def _detail_sql(gap: str) -> str:
    size = f"format('{{:,}}', cast(round_even(abs({gap}), 0) as bigint))"
    signed = f"case when {gap} < 0 then '-' else '' end || {size}"
    cases = []
    for name, text in DETAILS.items():
        before, after = text.split("{}")
        number = size if "SURPLUS" in name else signed
        cases.append(f"when '{name}' then '{before}' || {number} || '{after}'")
    return "case level " + " ".join(cases) + " end"


@query("classify_fixed", f"""select *, {lookup_case('level', DETAILED_ACTIONS)} "action", {_detail_sql('pred_gap')} detail
  from (select ts, pred_gap / 8 pred_gap, {level_case('pred_gap / 8', overrides=FIXED_SQL)} "level" from scored)""",
       "scored")
def _(spark, d):
    gaps = scored_hourly(spark, d).select("ts", (F.col("pred_gap") / 8).alias("pred_gap"))
    return levels.classify(gaps, detail_name="detail")


@query("classify_quantile", f"""select *, {lookup_case('level', ACTIONS)} "action" from (
  select ts, pred_gap, {level_case('pred_gap')} "level" from daily, daily_thresholds)""", "daily", "daily_thresholds")
def _(spark, d):
    rows = grid_daily(spark, d).select("ts", "pred_gap")
    return levels.classify(rows, thresholds=levels.quantile_thresholds(rows))


@query("classify_override", f"""select *, {lookup_case('live_level', ACTIONS)} live_action from (
  select ts, pred_gap, {level_case('pred_gap', overrides={
      'crit_def': '40000', 'high_def': '20000', 'low_def': 'trunc(low_def)', 'low_sur': 'trunc(low_sur)',
      'high_sur': 'trunc(high_sur)', 'crit_sur': 'trunc(crit_sur)'})} live_level from scored, thresholds)""", "thresholds")
def _(spark, d):
    from sparkgrid.plans.dashboard import relevel
    rows = scored_hourly(spark, d).select("ts", "pred_gap")
    return relevel(rows, levels.quantile_thresholds(rows, truncate=True), critical=40000, high=20000)


@query("classify_by_series", """, gapped as (select series_id, ts, "value" - 6000 pred_gap from series),
thr as (select series_id, """ + ", ".join([
    _side("low_def", .25, ">", "500.0"), _side("high_def", .65, ">", "3000.0"),
    _side("crit_def", .90, ">", "8000.0"), _side("low_sur", .75, "<", "-500.0"),
    _side("high_sur", .35, "<", "-3000.0"), _side("crit_sur", .10, "<", "-8000.0")]).replace(" g ", " pred_gap ") +
       f""" from gapped group by 1)
select gapped.series_id, {level_case('pred_gap')} "level", count(*) "rows" from gapped join thr
  on gapped.series_id = thr.series_id group by 1, 2""", "series")
def _(spark, d):
    gaps = event_series(spark, d).select("series_id", "ts", (F.col("value") - 6000).alias("pred_gap"))
    thresholds = rounded(levels.quantile_thresholds(gaps, keys=["series_id"]), 4)
    rows = levels.classify(gaps, thresholds=thresholds, keys=["series_id"])
    return rows.groupBy("series_id", "level").agg(F.count("*").alias("rows"))


@query("override_limits", """select gap_min, gap_max, greatest(0, gap_max // 10) crit_from, greatest(gap_max, 1) crit_to,
  crit crit_value, greatest(100, (gap_max - gap_max // 10) // 50) crit_step, greatest(0, gap_max // 20) high_from,
  crit high_to, least(high, crit) high_value, greatest(100, crit // 50) high_step from (
  select cast(trunc(min(pred_gap)) as bigint) gap_min, cast(trunc(max(pred_gap)) as bigint) gap_max from scored),
  (select cast(trunc(crit_def) as bigint) crit, cast(trunc(high_def) as bigint) high from thresholds)""", "thresholds")
def _(spark, d):
    return levels.override_limits(scored_hourly(spark, d))


@query("level_ordinals", f"""select ts, "level", cast({lookup_case('level', LEVEL_ORDINAL)} as int) ordinal from (
  select ts, {level_case('pred_gap / 8', overrides=FIXED_SQL)} "level" from scored)""", "scored")
def _(spark, d):
    gaps = scored_hourly(spark, d).select("ts", (F.col("pred_gap") / 8).alias("pred_gap"))
    return levels.classify(gaps).select("ts", "level", levels.ordinal(F.col("level")).alias("ordinal"))


@query("level_frequency", f"""select "level", "rows", "rows" / sum("rows") over () * 100 pct from (
  select {level_case('pred_gap')} "level", count(*) "rows" from daily, daily_thresholds group by 1)""",
       "daily", "daily_thresholds")
def level_frequency(spark, d):
    rows = grid_daily(spark, d).select("ts", "pred_gap")
    return frequency(levels.classify(rows, thresholds=levels.quantile_thresholds(rows)), "level")


@query("classify_null_series", """, gapped as (select nullif(series_id, 'view') series_id, ts, "value" - 6000 pred_gap from series),
thr as (select series_id, """ + ", ".join([
    _side("low_def", .25, ">", "500.0"), _side("high_def", .65, ">", "3000.0"),
    _side("crit_def", .90, ">", "8000.0"), _side("low_sur", .75, "<", "-500.0"),
    _side("high_sur", .35, "<", "-3000.0"), _side("crit_sur", .10, "<", "-8000.0")]).replace(" g ", " pred_gap ") +
       f""" from gapped group by 1)
select gapped.series_id, ts, pred_gap, {level_case('pred_gap')} "level" from gapped join thr
  on gapped.series_id is not distinct from thr.series_id""", "series")
def _(spark, d):
    gaps = event_series(spark, d).select(F.nullif(F.col("series_id"), F.lit("view")).alias("series_id"), "ts",
                                         (F.col("value") - 6000).alias("pred_gap"))
    thresholds = rounded(levels.quantile_thresholds(gaps, keys=["series_id"]), 4)
    return levels.classify(gaps, thresholds=thresholds, keys=["series_id"]).drop("action")
