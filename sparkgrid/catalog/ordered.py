"""Positions, lags, rolling statistics, splits and sequences."""

from pyspark.sql import functions as F

from sparkgrid.catalog.base import query, rounded, tidy
from sparkgrid.constants import DEMAND_FEATURES, SOLAR_FEATURES, WIND_FEATURES
from sparkgrid.operators import features as ops
from sparkgrid.operators.joins import align_late
from sparkgrid.operators.ordered import POS, SIZE, buckets, with_position
from sparkgrid.operators.supply import reconstruct
from sparkgrid.sources.views import demand_predictions, event_series, grid_hourly, regional_demand

S = ["series_id"]


@query("positions", """select series_id, ts, row_number() over (partition by series_id order by ts) - 1 pos,
  count(*) over (partition by series_id) size from series""", "series")
def _(spark, d):
    return with_position(event_series(spark, d), "ts", S, ties=["value"]).df.select(
        "series_id", "ts", F.col(POS).alias("pos"), F.col(SIZE).alias("size"))


@query("lags", """select ts, load_actual, """ + ", ".join(
    f"lag(load_actual, {k}) over (order by ts) lag_{k}h" for k in (1, 2, 3, 24, 48, 168)) + " from hourly", "hourly")
def _(spark, d):
    return ops.lags(grid_hourly(spark, d).select("ts", "load_actual"), "load_actual",
                    {f"lag_{k}h": k for k in (1, 2, 3, 24, 48, 168)})


@query("lags_by_series", """select series_id, ts, lag("value", 1) over w lag_1h, lag("value", 168) over w lag_168h
  from series window w as (partition by series_id order by ts)""", "series")
def _(spark, d):
    return ops.lags(event_series(spark, d), "value", {"lag_1h": 1, "lag_168h": 168}, keys=S, ties=["value"]).drop("value")


def _roll(column: str, n: int, f: str, by: str = "", decimals: int = 6) -> str:
    frame = f"over ({by}order by ts rows between {n} preceding and 1 preceding)"
    return f"case when count({column}) {frame} = {n} then round({f}({column}) {frame}, {decimals}) + 0.0 end"


@query("rolling_mean", f"""select ts, {_roll('solar_gen', 6, 'avg')} roll_6h, {_roll('solar_gen', 24, 'avg')} roll_24h
  from hourly""", "hourly")
def _(spark, d):
    rows = grid_hourly(spark, d).select("ts", "solar_gen")
    return rounded(ops.rolling(rows, "solar_gen", {6: ("roll_6h", None), 24: ("roll_24h", None)}),
                   6, "roll_6h", "roll_24h").drop("solar_gen")


@query("rolling_mean_week", f"""select ts, {_roll('load_actual', 72, 'avg')} roll_72h,
  {_roll('load_actual', 168, 'avg')} roll_168h from hourly""", "hourly")
def _(spark, d):
    rows = grid_hourly(spark, d).select("ts", "load_actual")
    return rounded(ops.rolling(rows, "load_actual", {72: ("roll_72h", None), 168: ("roll_168h", None)}),
                   6, "roll_72h", "roll_168h").drop("load_actual")


@query("rolling_std", f"""select ts, {_roll('load_actual', 24, 'stddev_samp')} roll_std_24h,
  {_roll('load_actual', 168, 'stddev_samp')} roll_std_168h from hourly""", "hourly")
def _(spark, d):
    rows = grid_hourly(spark, d).select("ts", "load_actual")
    return rounded(ops.rolling(rows, "load_actual", {24: (None, "roll_std_24h"), 168: (None, "roll_std_168h")}),
                   6).drop("load_actual")


_by = "partition by series_id "


@query("rolling_by_series", f"""select series_id, ts, {_roll('"value"', 24, 'avg', _by)} mean_24,
  {_roll('"value"', 24, 'stddev_samp', _by)} std_24, {_roll('"value"', 168, 'avg', _by)} mean_168,
  {_roll('"value"', 168, 'stddev_samp', _by)} std_168 from series""", "series")
def _(spark, d):
    rows = ops.rolling(event_series(spark, d), "value", {24: ("mean_24", "std_24"), 168: ("mean_168", "std_168")},
                       keys=S, ties=["value"])
    return rounded(rows.drop("value"))


@query("time_split", """select ts, case when row_number() over (order by ts) - 1 < floor(count(*) over () * 0.80)
  then 'train' else 'test' end split from hourly""", "hourly")
def _(spark, d):
    return ops.time_split(grid_hourly(spark, d).select("ts"))


@query("time_split_by_series", """select series_id, ts, case when row_number() over (partition by series_id order by ts)
  - 1 < floor(count(*) over (partition by series_id) * 0.80) then 'train' else 'test' end split
  from regional""", "regional")
def _(spark, d):
    return ops.time_split(regional_demand(spark, d).select("series_id", "ts"), keys=S)


@query("first_rows", "select * from predictions order by ts limit 168", "predictions")
def _(spark, d):
    return ops.first_rows(demand_predictions(spark, d), 168)


@query("last_rows", "select * from predictions order by ts desc limit 72", "predictions")
def _(spark, d):
    return ops.last_rows(demand_predictions(spark, d), 72)


@query("sequences", """, known as (select * from hourly where load_actual is not null and price is not null),
splits as (select *, case when row_number() over (order by ts) - 1 < floor(count(*) over () * 0.80)
  then 'train' else 'test' end split from known),
framed as (select split, ts, load_actual target, count(*) over f n, sum(load_actual) over f load_sum,
  sum(price) over f price_sum, lag(load_actual, 24) over w first_load, lag(price, 1) over w last_price from splits
  window w as (partition by split order by ts), f as (partition by split order by ts
  rows between 24 preceding and 1 preceding))
select split, ts, target, cast(24 as int) steps, load_sum, price_sum, first_load, last_price
  from framed where n = 24""", "hourly")
def _(spark, d):
    known = grid_hourly(spark, d).select("ts", "load_actual", "price").dropna()
    rows = ops.sequences(ops.time_split(known), ["load_actual", "price"], "load_actual", 24, keys=["split"])

    def total(i):
        return F.aggregate("sequence", F.lit(0.0), lambda acc, step: acc + step[i])
    return rows.select("split", "ts", "target", F.size("sequence").alias("steps"), total(0).alias("load_sum"),
                       total(1).alias("price_sum"), F.col("sequence")[0][0].alias("first_load"),
                       F.col("sequence")[23][1].alias("last_price"))


@query("sequences_by_series", """, framed as (select series_id, ts, "value" target, count(*) over f n,
  sum("value") over f total from series
  window f as (partition by series_id order by ts rows between 24 preceding and 1 preceding))
select series_id, ts, target, total from framed where n = 24""", "series")
def _(spark, d):
    rows = ops.sequences(event_series(spark, d), ["value"], "value", 24, keys=S, ties=["value"])
    total = F.aggregate("sequence", F.lit(0.0), lambda acc, step: acc + step[0])
    return rows.select("series_id", "ts", "target", total.alias("total"))


@query("align_late", """, ranked as (select *, row_number() over (order by ts) r from predictions)
select ts, load_actual, case when r > 24 then pred_gbt end pred_late from ranked""", "predictions")
def _(spark, d):
    predictions = demand_predictions(spark, d).select("ts", "load_actual", "pred_gbt")
    late = buckets(predictions, 24).lags("pred_gbt", {"_24": 24}).close().where(F.col("_24").isNotNull())
    return align_late(predictions.drop("pred_gbt"), late.withColumnRenamed("pred_gbt", "pred_late"), ["pred_late"])


def _angles(*names):
    period = {"hour": ("hour(ts)", 24), "month": ("month(ts)", 12), "dow": ("(isodow(ts) - 1)", 7),
              "doy": ("dayofyear(ts)", 365)}
    return ", ".join(f"round({f}(2 * pi() * {period[n][0]} / {period[n][1]}), 9) + 0.0 {n}_{f}"
                     for n in names for f in ("sin", "cos"))


_FLAGS = "case when isodow(ts) >= 6 then 1 else 0 end is_weekend, cast(year(ts) as int) \"year\""


def _tidy_features(df, features):
    angles = [c for c in features if c.endswith(("_sin", "_cos"))]
    statistics = [c for c in features if "_roll" in c or c.startswith("roll")]
    return df.withColumns({c: tidy(F.col(c), 9) for c in angles} | {c: tidy(F.col(c), 6) for c in statistics})


@query("demand_features", f""", known as (select ts, load_actual from hourly where load_actual is not null),
built as (select ts, load_actual, {", ".join(f"lag(load_actual, {k}) over (order by ts) lag_{k}h"
                                             for k in (1, 2, 3, 24, 48, 168))},
  {_roll('load_actual', 6, 'avg')} roll_6h, {_roll('load_actual', 24, 'avg')} roll_24h,
  {_roll('load_actual', 168, 'avg')} roll_168h, {_roll('load_actual', 24, 'stddev_samp')} roll_std_24h,
  {_roll('load_actual', 168, 'stddev_samp')} roll_std_168h, {_angles('hour', 'month', 'dow')}, {_FLAGS} from known)
select * from built where lag_168h is not null""", "hourly")
def demand_rows(spark, d):
    rows = ops.demand_features(grid_hourly(spark, d).select("ts", "load_actual"))
    return _tidy_features(rows.select("ts", "load_actual", *DEMAND_FEATURES), DEMAND_FEATURES)


SUPPLY_SQL = f""", filled as (select ts, load_actual, solar_profile, wind_profile,
  last_value(solar_cap ignore nulls) over (order by ts) solar_cap,
  last_value(wind_cap ignore nulls) over (order by ts) wind_cap from hourly),
made as (select ts, solar_cap, wind_cap, solar_profile * solar_cap solar_gen, wind_profile * wind_cap wind_gen
  from filled where load_actual is not null and solar_profile * solar_cap is not null
  and wind_profile * wind_cap is not null),
built as (select ts, solar_gen, wind_gen, {_angles('hour', 'month', 'doy')}, {_FLAGS},
  lag(solar_gen, 1) over w solar_lag_1h, lag(solar_gen, 24) over w solar_lag_24h,
  lag(solar_gen, 168) over w solar_lag_168h, {_roll('solar_gen', 24, 'avg')} solar_roll_24h, solar_cap,
  lag(wind_gen, 1) over w wind_lag_1h, lag(wind_gen, 24) over w wind_lag_24h,
  lag(wind_gen, 168) over w wind_lag_168h, {_roll('wind_gen', 24, 'avg')} wind_roll_24h,
  {_roll('wind_gen', 72, 'avg')} wind_roll_72h, wind_cap from made window w as (order by ts))"""
_SUPPLY = SUPPLY_SQL + " select ts, {columns} from built where solar_lag_168h is not null and wind_lag_168h is not null"


def supply_rows(spark, d):
    raw = grid_hourly(spark, d).withColumnsRenamed({"solar_gen": "solar_raw", "wind_gen": "wind_raw"})
    made = reconstruct(raw, "capacity", min_rows=100).select(
        "ts", "load_actual", "solar_cap", "wind_cap", "solar_gen", "wind_gen")
    return ops.supply_features(made, fill_capacity=False)


def _quoted(names):
    return ", ".join(f'"{n}"' for n in names)


@query("solar_features", _SUPPLY.format(columns=_quoted(SOLAR_FEATURES)), "hourly")
def _(spark, d):
    return _tidy_features(supply_rows(spark, d).select("ts", *SOLAR_FEATURES), SOLAR_FEATURES)


@query("wind_features", _SUPPLY.format(columns=_quoted(WIND_FEATURES)), "hourly")
def _(spark, d):
    return _tidy_features(supply_rows(spark, d).select("ts", *WIND_FEATURES), WIND_FEATURES)


# --- a series without a name, and several series ---------------------------

NULL_SERIES = """, parts as (select nullif(series_id, 'view') series_id, ts, "value" from series)"""


def null_series(spark, d):
    """The event series with one of them unnamed."""
    return event_series(spark, d).withColumn("series_id", F.nullif(F.col("series_id"), F.lit("view")))


@query("lags_null_series", NULL_SERIES + """ select series_id, ts, lag("value", 1) over w lag_1h,
  lag("value", 24) over w lag_24h from parts window w as (partition by series_id order by ts)""", "series")
def _(spark, d):
    return ops.lags(null_series(spark, d), "value", {"lag_1h": 1, "lag_24h": 24}, keys=S, ties=["value"]).drop("value")


@query("time_split_null_series", NULL_SERIES + """ select series_id, ts, case when row_number() over w - 1
  < floor(count(*) over (partition by series_id) * 0.80) then 'train' else 'test' end split from parts
  window w as (partition by series_id order by ts)""", "series")
def _(spark, d):
    return ops.time_split(null_series(spark, d).select("series_id", "ts"), keys=S, ties=())


def _first_last(which, order):
    return f"""select series_id, ts, load_actual from (select *, row_number() over (partition by series_id
  order by ts{order}) r from regional) where r <= 5"""


@query("first_rows_by_series", _first_last("first", ""), "regional")
def _(spark, d):
    return ops.first_rows(regional_demand(spark, d), 5, keys=S)


@query("last_rows_by_series", _first_last("last", " desc"), "regional")
def _(spark, d):
    return ops.last_rows(regional_demand(spark, d), 5, keys=S)


@query("demand_features_by_series", f""", built as (select series_id, ts, load_actual,
  {", ".join(f"lag(load_actual, {k}) over w lag_{k}h" for k in (1, 24, 168))},
  {_roll('load_actual', 6, 'avg', _by, 3)} roll_6h, {_roll('load_actual', 168, 'avg', _by, 3)} roll_168h,
  {_roll('load_actual', 168, 'stddev_samp', _by, 3)} roll_std_168h from regional
  window w as (partition by series_id order by ts))
select * from built where lag_168h is not null""", "regional")
def _(spark, d):
    rows = ops.demand_features(regional_demand(spark, d), keys=S)
    return rounded(rows.select("series_id", "ts", "load_actual", "lag_1h", "lag_24h", "lag_168h", "roll_6h",
                               "roll_168h", "roll_std_168h"), 3, "roll_6h", "roll_168h", "roll_std_168h")


@query("supply_features_by_series", f""", made as (select series_id, ts, load_actual / 4 solar_gen,
  load_actual / 2 wind_gen from regional),
built as (select series_id, ts, lag(solar_gen, 1) over w solar_lag_1h, lag(wind_gen, 168) over w wind_lag_168h,
  {_roll('solar_gen', 24, 'avg', _by)} solar_roll_24h, {_roll('wind_gen', 72, 'avg', _by)} wind_roll_72h
  from made window w as (partition by series_id order by ts))
select * from built where wind_lag_168h is not null""", "regional")
def _(spark, d):
    made = regional_demand(spark, d).withColumns({
        "solar_gen": F.col("load_actual") / 4, "wind_gen": F.col("load_actual") / 2,
        "solar_cap": F.lit(1.0), "wind_cap": F.lit(1.0)})
    rows = ops.supply_features(made, keys=S)
    return rounded(rows.select("series_id", "ts", "solar_lag_1h", "wind_lag_168h", "solar_roll_24h", "wind_roll_72h"),
                   6, "solar_roll_24h", "wind_roll_72h")
