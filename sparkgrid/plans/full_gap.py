"""Clean + raw table + fitted models → classified gap of all years."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from sparkgrid.constants import DEMAND_FEATURES, SOLAR_FEATURES, WIND_FEATURES
from sparkgrid.functions.energy import scored_balance
from sparkgrid.operators.features import demand_features, supply_features, time_split
from sparkgrid.operators.joins import full_gap_rows
from sparkgrid.operators.levels import classify, quantile_thresholds
from sparkgrid.operators.models import check_features, score
from sparkgrid.operators.supply import reconstruct
from sparkgrid.operators.trees import TreeModel
from sparkgrid.session import stage


def full_gap(clean: DataFrame, raw: DataFrame, demand_model: TreeModel, solar_model: TreeModel,
             wind_model: TreeModel, mode: str, ts: str = "ts", keys: Iterable[str] = ()) -> DataFrame:
    """Score every complete hour, join demand with supply, classify by quantile thresholds.

    ``split`` tells the hours that the demand model was trained on ("train")
    from the others, as ``forecast_demand`` cuts them.
    ``mode`` is the one the supply models were trained with (``SupplyResult.mode``).
    """
    keys = list(keys)
    for model, features in ((demand_model, DEMAND_FEATURES), (solar_model, SOLAR_FEATURES),
                            (wind_model, WIND_FEATURES)):
        check_features(model, features)
    hours = time_split(demand_features(clean.select(*keys, ts, "load_actual"), ts, keys), ts=ts, keys=keys)
    demand = score(demand_model, hours, "pred_demand")
    made = reconstruct(raw, mode, ts, keys).select(
        *keys, ts, "load_actual", "solar_gen", "wind_gen", "solar_cap", "wind_cap")
    supply = supply_features(made, ts, keys, fill_capacity=False)
    supply = score(wind_model, score(solar_model, supply, "pred_solar", 0), "pred_wind", 0)
    # Read for the thresholds and again for the result: written once.
    rows = stage(scored_balance(full_gap_rows(demand, supply, ts, keys)), "full-gap")
    return classify(rows, "pred_gap", quantile_thresholds(rows, "pred_gap", keys), keys)
