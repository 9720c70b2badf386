"""The models of the registered queries have the size of the reference."""

import pytest

import __spark_entry__
from sparkgrid.operators import trees
from tests.test_trees import FEATURES, frame, table

SIZES = {
    "demand_boosted_trees": [(500, 6)], "feature_importances": [(500, 6)], "demand_predictions": [(500, 6), (200, 20)],
    "solar_boosted_trees": [(400, 6)], "wind_boosted_trees": [(400, 7)], "boosting_rounds": [(400, 6), (400, 7)],
    "gap_interventions": [(400, 6), (400, 7)], "demand_random_forest": [(200, 20)], "reloaded_model": [(200, 20)],
    "full_gap": [(200, 20), (400, 6), (400, 7)],
}


@pytest.mark.parametrize("name", SIZES)
def test_models_are_whole(spark, monkeypatch, name):
    asked, fit_boosted, fit_forest = [], trees.fit_boosted, trees.fit_forest

    def boosted(train, models, *rest, **more):
        asked.extend((m.rounds, m.depth) for m in models.values())
        assert all((m.rate, m.share) == (0.05, 0.8) for m in models.values())
        small = {n: trees.Boosting(m.features, m.target, 2, 2) for n, m in models.items()}
        return fit_boosted(train, small, *rest, **more)

    def forest(train, features, target, number, depth, least_rows):
        asked.append((number, depth))
        assert least_rows == 5
        return fit_forest(train, features, target, 2, 3, least_rows)

    monkeypatch.setattr(trees, "fit_boosted", boosted)
    monkeypatch.setattr(trees, "fit_forest", forest)
    __spark_entry__.queries()[name](spark, "/root/testdata/sf0.01").first()
    assert asked == SIZES[name]


def test_many_rounds(spark):
    """Five hundred rounds fit what a few cannot."""
    df, test = frame(spark, *table(500)), frame(spark, *table(300, 5))
    model = trees.fit_boosted(df, {"m": trees.Boosting(FEATURES, "y", 500, 6)}, test)["m"]
    rounds = sorted(model.rounds.collect())
    assert len(rounds) == model.trees == 500
    assert rounds[-1].mae < 0.35 * rounds[9].mae and rounds[-1].rmse < 0.35 * rounds[9].rmse
