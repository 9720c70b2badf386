"""Clean table → demand models, their comparison and predictions."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgrid.constants import DEMAND_FEATURES
from sparkgrid.operators import recurrent
from sparkgrid.operators.features import demand_features, time_split
from sparkgrid.operators.models import demand_boosted, demand_forest, score
from sparkgrid.operators.stats import model_comparison
from sparkgrid.operators.trees import TreeModel
from sparkgrid.session import join_keys, stage

MODELS = {"gbt": "pred_gbt", "rf": "pred_rf"}
RECURRENT = {"lstm": "pred_lstm"}


@dataclass
class DemandResult:
    models: dict[str, TreeModel | recurrent.RecurrentModel]
    predictions: DataFrame      # test rows: keys, ts, load_actual, pred_gbt, pred_rf, [pred_lstm], [baseline_forecast]
    comparison: DataFrame       # on the test rows
    scored: DataFrame           # all rows, with split; "train" rows are in-sample


def forecast_demand(clean: DataFrame, ts: str = "ts", keys: Iterable[str] = (), gbt_rounds: int = 500,
                    gbt_depth: int = 6, rf_trees: int = 200, rf_depth: int = 20, lstm_epochs: int = 0) -> DemandResult:
    """Train on the first 80 % of the rows of each series, score all, compare on the rest.

    The lags run over the rows with a known load. A known forecast is needed for
    the comparison only, so rows without one are not dropped. With
    ``lstm_epochs`` a recurrent network is trained too; it answers for the test
    rows that have a whole day of test rows before them.
    """
    keys = list(keys)
    # Read by two fits and by scoring; the split has written the rows once, and found their times unique.
    rows = time_split(demand_features(clean, ts, keys), ts=ts, keys=keys)
    train, test = (rows.where(F.col("split") == s) for s in ("train", "test"))
    models = {"gbt": demand_boosted(train, gbt_rounds, gbt_depth, test), "rf": demand_forest(train, rf_trees, rf_depth)}
    scored = rows
    for name, column in MODELS.items():
        scored = score(models[name], scored, column)
    columns = [*keys, ts, "load_actual", *MODELS.values()]
    if lstm_epochs:
        models["lstm"] = recurrent.fit_recurrent(train, DEMAND_FEATURES, "load_actual", ts=ts, keys=keys, epochs=lstm_epochs)
        late = recurrent.predict(models["lstm"], test, "pred_lstm", ts, keys).drop("load_actual")
        scored = join_keys(scored, late, [*keys, ts], "left", known=[ts])
        columns += RECURRENT.values()
    if "load_forecast" in scored.columns:
        scored = scored.withColumnRenamed("load_forecast", "baseline_forecast")
        columns.append("baseline_forecast")
    # Written, so that no reader runs the trees again.
    scored = stage(scored.select(*columns, "split"), "scored")
    predictions = scored.where(F.col("split") == "test").drop("split")
    return DemandResult(models, predictions, compare(predictions, keys), scored)


def compare(predictions: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """Metrics of the model columns present, against the forecast column if present."""
    present = {n: c for n, c in {**MODELS, **RECURRENT, "baseline": "baseline_forecast"}.items() if c in predictions.columns}
    return model_comparison(predictions, "load_actual", present, "baseline", keys)
