"""Raw table + demand predictions → supply models and classified gap of the test rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgrid.constants import FIXED_THRESHOLDS
from sparkgrid.operators.features import supply_features, time_split
from sparkgrid.operators.levels import classify
from sparkgrid.operators.models import score, supply_boosted
from sparkgrid.operators.stats import metrics
from sparkgrid.operators.supply import reconstruct
from sparkgrid.operators.trees import TreeModel
from sparkgrid.session import join_keys, stage
from sparkgrid.sources.readers import demand_source


@dataclass
class SupplyResult:
    solar: TreeModel
    wind: TreeModel
    metrics: DataFrame
    interventions: DataFrame
    mode: str                   # how the models' generation was made; score with the same


def gap_rows(supply: DataFrame, demand: DataFrame, ts: str = "ts", keys: Iterable[str] = ()) -> DataFrame:
    """Demand, predicted supply and both gaps for the hours present in both tables."""
    keys = list(keys)
    joined = join_keys(
        demand, supply.select(*keys, ts, "pred_solar", "pred_wind",
                              (F.col("solar_gen") + F.col("wind_gen")).alias("_actual_supply")),
        [*keys, ts], known=[ts])
    predicted = F.col("pred_solar") + F.col("pred_wind")
    return joined.select(
        *keys, ts, "actual_demand", "pred_demand", "pred_solar", "pred_wind",
        predicted.alias("pred_supply"),
        (F.col("pred_demand") - predicted).alias("pred_gap"),
        (F.col("actual_demand") - F.col("_actual_supply")).alias("actual_gap"),
    )


def supply_gap(raw: DataFrame, predictions: DataFrame | None, mode: str = "capacity", ts: str = "ts",
               keys: Iterable[str] = (), rounds: int = 400, solar_depth: int = 6, wind_depth: int = 7,
               thresholds: Mapping[str, float] = FIXED_THRESHOLDS) -> SupplyResult:
    """Train solar and wind on the first 80 %, then classify the gap of the remaining rows."""
    keys = list(keys)
    made = reconstruct(raw, mode, ts, keys).select(
        *keys, ts, "load_actual", "solar_gen", "wind_gen", "solar_cap", "wind_cap")
    rows = time_split(supply_features(made, ts, keys, fill_capacity=False), ts=ts, keys=keys)
    train, test = (rows.where(F.col("split") == s) for s in ("train", "test"))
    solar, wind = supply_boosted(train, rounds, solar_depth, wind_depth, test)
    # Written, so that metrics and result do not run the trees again.
    scored = stage(score(wind, score(solar, test, "pred_solar", 0), "pred_wind", 0).select(
        *keys, ts, "load_actual", "solar_gen", "wind_gen", "pred_solar", "pred_wind"), "scored")
    quality = metrics(scored, "solar_gen", {"solar": "pred_solar"}, keys).unionByName(
        metrics(scored, "wind_gen", {"wind": "pred_wind"}, keys))
    gaps = gap_rows(scored, demand_source(scored, predictions, ts=ts, keys=keys), ts, keys)
    return SupplyResult(solar, wind, quality, classify(gaps, "pred_gap", thresholds, detail_name="detail"), mode)
