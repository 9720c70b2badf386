"""Models, metrics and comparisons."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkgrid.catalog.base import query, rounded, tidy
from sparkgrid.catalog.cleaning import clean_hourly
from sparkgrid.catalog.ordered import SUPPLY_SQL, supply_rows
from sparkgrid.constants import DEMAND_FEATURES
from sparkgrid.operators import models, recurrent, stats
from sparkgrid.operators.features import demand_features, time_split
from sparkgrid.plans.demand import compare, forecast_demand
from sparkgrid.plans.full_gap import full_gap
from sparkgrid.plans.supply_gap import supply_gap
from sparkgrid.session import stage, staging_path
from sparkgrid.sources.views import demand_predictions, grid_hourly


def demand_split(spark, d):
    rows = demand_features(grid_hourly(spark, d).select("ts", "load_actual", "load_forecast"))
    return time_split(rows)


def supply_split(spark, d):
    return time_split(supply_rows(spark, d))


def _train(rows):
    return rows.where(F.col("split") == "train")


# Which rows a model trains on and scores.
_SPLIT = """case when row_number() over (order by ts) - 1 < floor(count(*) over () * 0.80) then 'train'
  else 'test' end split"""
_LOADS = f""", known as (select ts, load_actual, lag(load_actual, 168) over (order by ts) before
  from hourly where load_actual is not null),
model_rows as (select ts, load_actual, {_SPLIT} from known where before is not null)"""


@query("demand_model_rows", _LOADS + " select ts, split, load_actual from model_rows", "hourly")
def _(spark, d):
    return demand_split(spark, d).select("ts", "split", "load_actual")


@query("supply_model_rows", f"""{SUPPLY_SQL}, model_rows as (select ts, solar_gen, wind_gen, {_SPLIT} from built
  where solar_lag_168h is not null and wind_lag_168h is not null) select * from model_rows""", "hourly")
def _(spark, d):
    return supply_split(spark, d).select("ts", "solar_gen", "wind_gen", "split")


# Fitted trees have no SQL twin: these queries return what the models say, at full size, and the tests compare the models
# with plain versions that try every split.
@query("demand_boosted_trees")
def _(spark, d):
    rows = demand_split(spark, d)
    model = models.demand_boosted(_train(rows))
    return rounded(models.score(model, rows, "pred_gbt").select("ts", "split", "load_actual", "pred_gbt"))


@query("demand_random_forest")
def _(spark, d):
    rows = demand_split(spark, d)
    model = models.demand_forest(_train(rows))
    return rounded(models.score(model, rows, "pred_rf").select("ts", "split", "load_actual", "pred_rf"))


@query("solar_boosted_trees")
def _(spark, d):
    rows = supply_split(spark, d)
    model = models.solar_boosted(_train(rows))
    return rounded(models.score(model, rows, "pred_solar", 0).select("ts", "split", "solar_gen", "pred_solar"))


@query("wind_boosted_trees")
def _(spark, d):
    rows = supply_split(spark, d)
    model = models.wind_boosted(_train(rows))
    return rounded(models.score(model, rows, "pred_wind", 0).select("ts", "split", "wind_gen", "pred_wind"))


@query("boosting_rounds")
def _(spark, d):
    """Errors of the solar and the wind model on the test rows after each round."""
    rows = supply_split(spark, d)
    pair = models.supply_boosted(_train(rows), test=rows.where(F.col("split") == "test"))
    each = [m.rounds.select(F.lit(n).alias("model"), "*") for n, m in zip(("solar", "wind"), pair)]
    return rounded(each[0].unionByName(each[1]))


@query("feature_importances")
def _(spark, d):
    """The twelve most important features of the boosted demand model, the least of them first."""
    model = models.demand_boosted(_train(demand_split(spark, d)))
    top = models.top_importances(models.importances(model))
    place = F.row_number().over(Window.orderBy("importance", F.desc("feature")))  # twelve rows
    return rounded(top.select(place.alias("place"), "feature", "importance"), 9)


def _recurrent(spark, d):
    rows = demand_split(spark, d)
    return rows, recurrent.fit_recurrent(_train(rows), DEMAND_FEATURES, "load_actual")


@query("demand_recurrent")
def _(spark, d):
    """The recurrent network's answers on the test rows that have a day of test rows before them."""
    rows, model = _recurrent(spark, d)
    return rounded(recurrent.predict(model, rows.where(F.col("split") == "test"), "pred_lstm"), 3)


@query("recurrent_epochs")
def _(spark, d):
    """Errors in training and validation after each epoch, of the scaled load."""
    return rounded(spark.createDataFrame(_recurrent(spark, d)[1].epochs, "epoch int, loss double, val_loss double"), 6)


@query("reloaded_model", _LOADS + """ select ts, true same, true other_features_refused from model_rows""", "hourly")
def _(spark, d):
    rows = demand_split(spark, d)
    path = staging_path(spark, "model")
    fitted = models.demand_forest(_train(rows))
    models.save_model(fitted, path)
    model = models.load_model(spark, path)
    models.check_features(model, DEMAND_FEATURES)
    try:
        models.check_features(model, DEMAND_FEATURES[::-1])
        refused = False
    except ValueError:
        refused = True
    both = models.score(model, models.score(fitted, rows, "before"), "after")
    return both.select("ts", (F.col("before") == F.col("after")).alias("same"),
                       F.lit(refused).alias("other_features_refused"))


@query("demand_predictions")
def _(spark, d):
    return rounded(forecast_demand(clean_hourly(spark, d)).predictions)


def _raw(spark, d):
    return grid_hourly(spark, d).withColumnsRenamed({"solar_gen": "solar_raw", "wind_gen": "wind_raw"})


# The profiles have fewer rows than the plan asks for, so the measured generation is taken.
@query("gap_interventions")
def _(spark, d):
    return rounded(supply_gap(_raw(spark, d), demand_predictions(spark, d)).interventions)


@query("full_gap")
def _(spark, d):
    raw = stage(_raw(spark, d), "raw")
    demand = models.demand_forest(_train(demand_split(spark, d)))
    supply = supply_gap(raw, None, mode="peak")
    return rounded(full_gap(raw.select("ts", "load_actual"), raw, demand, supply.solar, supply.wind, supply.mode))


_MODELS = {"gbt": "pred_gbt", "rf": "pred_rf", "baseline": "baseline_forecast"}
_METRICS = " union all ".join(f"""select '{n}' model, count({c}) "rows", avg(abs(load_actual - {c})) mae,
  sqrt(avg((load_actual - {c}) * (load_actual - {c}))) rmse,
  1 - avg((load_actual - {c}) * (load_actual - {c})) / var_pop(load_actual) r2
  from predictions where {c} is not null""" for n, c in _MODELS.items())


@query("metrics", f"""select model, "rows", round(mae, 6) + 0.0 mae, round(rmse, 6) + 0.0 rmse, round(r2, 8) + 0.0 r2
  from ({_METRICS})""", "predictions")
def _(spark, d):
    return _tidy_metrics(stats.metrics(demand_predictions(spark, d), "load_actual", _MODELS))


def _tidy_metrics(df):
    return df.withColumns({c: tidy(F.col(c), n) for c, n in
                           (("mae", 6), ("rmse", 6), ("r2", 8), ("improvement_pct", 6)) if c in df.columns})


_COMPARED = f""", table_ as ({_METRICS}), base as (select mae base_mae from table_ where model = 'baseline'),
compared as (select *, case when model <> 'baseline' then (base_mae - mae) / base_mae * 100 end improvement
  from table_, base)"""


@query("model_comparison", _COMPARED + """ select model, "rows", round(mae, 6) + 0.0 mae, round(rmse, 6) + 0.0 rmse,
  round(r2, 8) + 0.0 r2, round(improvement, 6) + 0.0 improvement_pct,
  case when model = 'baseline' then 'baseline' when improvement > 0 then 'better' else 'worse' end verdict
  from compared""", "predictions")
def _(spark, d):
    return _tidy_metrics(compare(demand_predictions(spark, d)))


@query("best_model", _COMPARED + """ select model, round(mae, 6) + 0.0 mae from compared where model <> 'baseline'
  order by compared.mae, model limit 1""", "predictions")
def _(spark, d):
    return _tidy_metrics(stats.best_model(compare(demand_predictions(spark, d)), "baseline")).select("model", "mae")


@query("minmax_scale", """, ends as (select min(load_actual) a, max(load_actual) b, min(price) c, max(price) d
  from hourly where day(ts) < 22 and load_actual is not null and price is not null)
select ts, round((load_actual - a) / (b - a), 9) + 0.0 load_actual, round((price - c) / (d - c), 9) + 0.0 price,
  round(load_actual, 6) + 0.0 restored from hourly, ends""", "hourly")
def _(spark, d):
    rows = stage(grid_hourly(spark, d).select("ts", "load_actual", "price"), "scale")
    scaler = models.MinMax.fit(rows.where(F.day("ts") < 22).dropna(), ["load_actual", "price"])
    scaled = scaler.transform(rows)
    restored = scaler.inverse(scaled.withColumn("restored", F.col("load_actual")), "restored", "load_actual")
    return rounded(rounded(restored, 9, "load_actual", "price"), 6, "restored")
