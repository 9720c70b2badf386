"""Registration of queries and the SQL of the derived tables they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *tables: str):
    """Register a query; ``tables`` are the derived tables (below) its SQL selects from."""
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            parts = [CTES[t] for t in _with_parents(tables)]
            SQL[name] = (("with " + ",\n".join(parts) + "\n") if parts else "") + sql.strip()
        return function
    return register


def _with_parents(tables) -> list[str]:
    ordered: list[str] = []

    def add(name):
        for parent in PARENTS.get(name, ()):
            add(parent)
        if name not in ordered:
            ordered.append(name)
    for t in tables:
        add(t)
    return ordered


def rounded(df: DataFrame, decimals: int = 6, *columns: str) -> DataFrame:
    """Round double columns (by default all) so that the order of summation does not show."""
    names = columns or [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({c: tidy(F.col(c), decimals) for c in names})


def tidy(c: Column, decimals: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(c, decimals) + F.lit(0.0)


CTES = {
    "hourly": """e as (select date_trunc('hour', ts) ts, event_type, cast(round(value * 100) as bigint) c from events),
hh as (select ts,
  sum(case event_type when 'view' then c * 3 when 'purchase' then c end) load_c,
  sum(case when event_type = 'view' then c * 4 end) forecast_c,
  sum(case when event_type = 'click' then c end) solar_c,
  sum(case when event_type = 'error' then c end) onshore_c,
  sum(case when event_type = 'signup' then c end) offshore_c,
  max(case when event_type = 'purchase' then c end) price_c
  from e group by ts),
sp as (select unnest(generate_series(mn, mx, interval 1 hour)) ts from (select min(ts) mn, max(ts) mx from e)),
hourly as (select sp.ts,
  cast(load_c as double) load_actual, cast(forecast_c as double) load_forecast,
  cast(solar_c as double) solar_gen, cast(onshore_c + offshore_c as double) wind_gen,
  cast(onshore_c as double) wind_onshore, cast(offshore_c as double) wind_offshore,
  cast(price_c as double) price,
  cast(case when hour(sp.ts) = 0 then 100000 + 1000 * day(sp.ts) end as double) solar_cap,
  cast(case when hour(sp.ts) = 0 then 150000 + 1000 * day(sp.ts) end as double) wind_cap,
  cast(solar_c as double) / 262144 solar_profile,
  cast(onshore_c + offshore_c as double) / 524288 wind_profile
  from sp left join hh on sp.ts = hh.ts)""",
    "daily": """o as (select o_orderdate ts, sum(cast(round(o_totalprice * 100) as bigint)) pred_demand,
  cast(sum(case when o_orderstatus <> 'P' then cast(round(o_totalprice * 100) as bigint) end) as double) * 3 / 2
  actual_demand from orders group by o_orderdate),
l as (select l_shipdate ts,
  sum(case when l_returnflag = 'A' then cast(round(l_extendedprice * 100) as bigint) end) pred_solar,
  sum(case when l_returnflag = 'R' then cast(round(l_extendedprice * 100) as bigint) end) pred_wind,
  sum(case when l_returnflag = 'A' and l_linestatus = 'F' then cast(round(l_extendedprice * 100) as bigint) end) * 2
  actual_solar,
  sum(case when l_returnflag = 'R' and l_linestatus = 'F' then cast(round(l_extendedprice * 100) as bigint) end) * 2
  actual_wind from lineitem group by l_shipdate),
daily as (select o.ts, cast(pred_demand as double) pred_demand, cast(actual_demand as double) actual_demand,
  cast(pred_solar as double) pred_solar, cast(pred_wind as double) pred_wind,
  cast(actual_solar as double) actual_solar, cast(actual_wind as double) actual_wind,
  cast(pred_demand - pred_solar - pred_wind as double) pred_gap
  from o join l on o.ts = l.ts where pred_solar is not null and pred_wind is not null)""",
    "series": """series as (select event_type series_id, ts, cast(round(value * 100) as double) "value" from events)""",
    "regional": """regional as (select n_name series_id, o_orderdate ts,
  cast(sum(cast(round(o_totalprice * 100) as bigint)) as double) load_actual
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
  group by n_name, o_orderdate)""",
    "predictions": """predictions as (select ts, load_actual, load_actual * 0.75 + 4096 pred_gbt,
  load_actual * 0.5 + solar_gen pred_rf, load_forecast baseline_forecast
  from hourly where load_actual is not null)""",
    "clean": """numbered as (select *, row_number() over (order by ts) - 1 pos from hourly),
carried as (select ts, pos,
  last_value(solar_gen ignore nulls) over w3 solar_gen, last_value(wind_gen ignore nulls) over w3 wind_gen,
  last_value(wind_onshore ignore nulls) over w3 wind_onshore,
  last_value(wind_offshore ignore nulls) over w3 wind_offshore,
  last_value(load_actual ignore nulls) over w3 load_actual,
  last_value(load_forecast ignore nulls) over w3 load_forecast,
  last_value(solar_cap ignore nulls) over wb solar_capacity,
  price, last_value(price ignore nulls) over wb pv,
  last_value(case when price is not null then pos end ignore nulls) over wb pp,
  first_value(price ignore nulls) over wf nv,
  first_value(case when price is not null then pos end ignore nulls) over wf np
  from numbered window w3 as (order by ts rows between 3 preceding and current row),
  wb as (order by ts rows between unbounded preceding and current row),
  wf as (order by ts rows between current row and unbounded following)),
clean as (select ts, solar_gen, wind_gen, wind_onshore, wind_offshore, load_actual, load_forecast, solar_capacity,
  coalesce(price, case when pos - pp <= 6 then
    case when np is null then pv else pv + (nv - pv) * (pos - pp) / nullif(np - pp, 0) end end) price,
  cast(hour(ts) as int) "hour", cast(isodow(ts) - 1 as int) day_of_week, cast(month(ts) as int) "month",
  cast(year(ts) as int) "year", case when isodow(ts) >= 6 then 1 else 0 end is_weekend,
  case when month(ts) in (12, 1, 2) then 'Winter' when month(ts) in (3, 4, 5) then 'Spring'
       when month(ts) in (6, 7, 8) then 'Summer' else 'Autumn' end season,
  solar_gen + wind_gen renewable_total, load_actual - (solar_gen + wind_gen) supply_gap,
  load_actual - load_forecast forecast_error,
  case when solar_gen / nullif(solar_capacity, 0) * 100 > 100 then 100.0
       else solar_gen / nullif(solar_capacity, 0) * 100 end solar_utilisation
  from carried where load_actual is not null)""",
    "scored": """scored as (select ts, load_actual actual_demand, load_forecast pred_demand, solar_gen actual_solar,
  wind_gen actual_wind, solar_gen * 0.75 + 512 pred_solar, wind_gen * 0.5 + 8192 pred_wind,
  solar_gen * 0.75 + 512 + (wind_gen * 0.5 + 8192) pred_supply, solar_gen + wind_gen actual_supply,
  load_forecast - (solar_gen * 0.75 + 512 + (wind_gen * 0.5 + 8192)) pred_gap,
  load_actual - (solar_gen + wind_gen) actual_gap from hourly)""",
    # Linear interpolation between the two neighbouring ranks; halves of a side need ten rows.
    "thresholds": """thresholds as (select
  case when count(case when pred_gap > 0 then 1 end) >= 10
    then quantile_cont(case when pred_gap > 0 then pred_gap end, 0.25) else 500.0 end low_def,
  case when count(case when pred_gap > 0 then 1 end) >= 10
    then quantile_cont(case when pred_gap > 0 then pred_gap end, 0.65) else 3000.0 end high_def,
  case when count(case when pred_gap > 0 then 1 end) >= 10
    then quantile_cont(case when pred_gap > 0 then pred_gap end, 0.90) else 8000.0 end crit_def,
  case when count(case when pred_gap < 0 then 1 end) >= 10
    then quantile_cont(case when pred_gap < 0 then pred_gap end, 0.75) else -500.0 end low_sur,
  case when count(case when pred_gap < 0 then 1 end) >= 10
    then quantile_cont(case when pred_gap < 0 then pred_gap end, 0.35) else -3000.0 end high_sur,
  case when count(case when pred_gap < 0 then 1 end) >= 10
    then quantile_cont(case when pred_gap < 0 then pred_gap end, 0.10) else -8000.0 end crit_sur
  from scored)""",
    "daily_thresholds": """daily_thresholds as (select
  case when count(case when pred_gap > 0 then 1 end) >= 10
    then quantile_cont(case when pred_gap > 0 then pred_gap end, 0.25) else 500.0 end low_def,
  case when count(case when pred_gap > 0 then 1 end) >= 10
    then quantile_cont(case when pred_gap > 0 then pred_gap end, 0.65) else 3000.0 end high_def,
  case when count(case when pred_gap > 0 then 1 end) >= 10
    then quantile_cont(case when pred_gap > 0 then pred_gap end, 0.90) else 8000.0 end crit_def,
  case when count(case when pred_gap < 0 then 1 end) >= 10
    then quantile_cont(case when pred_gap < 0 then pred_gap end, 0.75) else -500.0 end low_sur,
  case when count(case when pred_gap < 0 then 1 end) >= 10
    then quantile_cont(case when pred_gap < 0 then pred_gap end, 0.35) else -3000.0 end high_sur,
  case when count(case when pred_gap < 0 then 1 end) >= 10
    then quantile_cont(case when pred_gap < 0 then pred_gap end, 0.10) else -8000.0 end crit_sur
  from daily)""",
}
PARENTS = {"predictions": ["hourly"], "clean": ["hourly"], "scored": ["hourly"], "thresholds": ["scored"],
           "daily_thresholds": ["daily"]}


def level_case(gap: str, prefix: str = "", overrides: dict[str, str] | None = None) -> str:
    """SQL of the level of a gap; thresholds are columns, or numbers given in ``overrides``."""
    t = {n: f"{prefix}{n}" for n in ("crit_def", "high_def", "low_def", "low_sur", "high_sur", "crit_sur")}
    t.update(overrides or {})
    return (f"case when {gap} > {t['crit_def']} then 'CRITICAL' when {gap} > {t['high_def']} then 'HIGH' "
            f"when {gap} > {t['low_def']} then 'MODERATE' when {gap} >= {t['low_sur']} then 'BALANCED' "
            f"when {gap} >= {t['high_sur']} then 'SURPLUS' when {gap} >= {t['crit_sur']} then 'HIGH SURPLUS' "
            f"when {gap} is not null then 'CRITICAL SURPLUS' end")


FIXED_SQL = {"crit_def": "8000", "high_def": "3000", "low_def": "500",
             "low_sur": "-500", "high_sur": "-3000", "crit_sur": "-8000"}


def lookup_case(key: str, values: dict) -> str:
    """SQL that maps the values of a column to constants."""
    def literal(v):
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"case {key} " + " ".join(f"when {literal(k)} then {literal(v)}" for k, v in values.items()) + " end"
