"""The demand, solar and wind models, scaling and scoring."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import MinMaxScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgrid.constants import DEMAND_FEATURES, SOLAR_FEATURES, WIND_FEATURES
from sparkgrid.functions.columns import clip
from sparkgrid.operators import trees
from sparkgrid.operators.trees import Boosting, TreeModel

# Rounds (or trees) and depths of the models.
DEMAND_SIZE, FOREST_SIZE, SOLAR_SIZE, WIND_SIZE = (500, 6), (200, 20), (400, 6), (400, 7)


def demand_boosted(train: DataFrame, rounds: int = DEMAND_SIZE[0], depth: int = DEMAND_SIZE[1],
                   test: DataFrame | None = None) -> TreeModel:
    return trees.fit_boosted(train, {"demand": Boosting(DEMAND_FEATURES, "load_actual", rounds, depth)}, test)["demand"]


def demand_forest(train: DataFrame, number: int = FOREST_SIZE[0], depth: int = FOREST_SIZE[1]) -> TreeModel:
    """Random forest; nodes of fewer than five rows are not split."""
    return trees.fit_forest(train, DEMAND_FEATURES, "load_actual", number, depth, least_rows=5)


def supply_boosted(train: DataFrame, rounds: int = SOLAR_SIZE[0], solar_depth: int = SOLAR_SIZE[1],
                   wind_depth: int = WIND_SIZE[1], test: DataFrame | None = None) -> tuple[TreeModel, TreeModel]:
    """The solar and the wind model, grown in the same passes."""
    both = trees.fit_boosted(train, {"solar": Boosting(SOLAR_FEATURES, "solar_gen", rounds, solar_depth),
                                     "wind": Boosting(WIND_FEATURES, "wind_gen", rounds, wind_depth)}, test)
    return both["solar"], both["wind"]


def solar_boosted(train: DataFrame, rounds: int = SOLAR_SIZE[0], depth: int = SOLAR_SIZE[1],
                  test: DataFrame | None = None) -> TreeModel:
    return trees.fit_boosted(train, {"solar": Boosting(SOLAR_FEATURES, "solar_gen", rounds, depth)}, test)["solar"]


def wind_boosted(train: DataFrame, rounds: int = WIND_SIZE[0], depth: int = WIND_SIZE[1],
                 test: DataFrame | None = None) -> TreeModel:
    return trees.fit_boosted(train, {"wind": Boosting(WIND_FEATURES, "wind_gen", rounds, depth)}, test)["wind"]


def score(model: TreeModel, df: DataFrame, name: str, floor: float | None = None) -> DataFrame:
    """Add the prediction as ``name``; generation is bounded below by ``floor=0``."""
    scored = trees.predict(model, df, name)
    return scored if floor is None else scored.withColumn(name, clip(name, floor))


def feature_names(model: TreeModel) -> list[str]:
    return list(model.features)


def check_features(model: TreeModel, features: Iterable[str]) -> None:
    """Fail unless the model was trained on exactly these features in this order."""
    trained, given = feature_names(model), list(features)
    if trained != given:
        raise ValueError(f"feature mismatch: trained on {trained}, given {given}")


def save_model(model: TreeModel, path: str) -> None:
    trees.save(model, path)


def load_model(spark, path: str) -> TreeModel:
    return trees.load(spark, path)


def importances(model: TreeModel) -> DataFrame:
    """(feature, importance), one row per feature of the model: mean gain, or for forests the share of all gains."""
    return trees.importances(model, "total_gain" if model.average else "gain")


def top_importances(table: DataFrame, n: int = 12) -> DataFrame:
    """The ``n`` most important features, the least of them first."""
    return table.orderBy(F.desc("importance"), "feature").limit(n).orderBy("importance", F.desc("feature"))


class MinMax:
    """Scaling of columns to 0…1 by the range of the training rows; the target can be scaled back.

    A column that is constant in training is only shifted, so that it becomes 0 there.
    """

    def __init__(self, model: PipelineModel):
        self.model = model
        scaler = model.stages[-1]
        names = model.stages[0].getInputCols()
        self.low = dict(zip(names, map(float, scaler.originalMin)))
        self.high = dict(zip(names, map(float, scaler.originalMax)))

    @classmethod
    def fit(cls, train: DataFrame, columns: list[str]) -> MinMax:
        assembler = VectorAssembler(inputCols=list(columns), outputCol="_raw")
        return cls(Pipeline(stages=[assembler, MinMaxScaler(inputCol="_raw", outputCol="_scaled")]).fit(train))

    @classmethod
    def load(cls, path: str) -> MinMax:
        return cls(PipelineModel.load(path))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    def _range(self, column: str) -> float:
        return (self.high[column] - self.low[column]) or 1.0

    def transform(self, df: DataFrame) -> DataFrame:
        """Replace each fitted column by its scaled value."""
        return df.withColumns({c: (F.col(c) - self.low[c]) / self._range(c) for c in self.low})

    def inverse(self, df: DataFrame, column: str, of: str) -> DataFrame:
        """Scale ``column`` back to the range of the fitted column ``of``."""
        return df.withColumn(column, F.col(column) * self._range(of) + self.low[of])
