"""The recurrent network: gradients by differences, places of the blocks, and what it learns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkgrid.operators import recurrent
from sparkgrid.operators.features import time_split
from sparkgrid.operators.growing import Held, Spread
from sparkgrid.session import stage
from tests.helpers import frame, hours


def small(rows=7, steps=5, width=3, seed=1):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(rows, steps, width)), rng.normal(size=rows), recurrent.begun(width, (4, 3), 5, seed)


@pytest.mark.parametrize("dropped", [False, True])
def test_gradients_equal_differences(dropped):
    x, y, w = small()
    drops = recurrent._drops(np.random.default_rng(3), w, len(x), x.shape[1]) if dropped else None
    loss, found = recurrent.gradients(x, y, w, drops)
    assert loss == pytest.approx(recurrent.gradients(x, y, w, drops)[0])
    rng = np.random.default_rng(4)
    for name, value in w.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in value.shape)
            ends = []
            for step in (1e-5, -1e-5):
                moved = {**w, name: value.copy()}
                moved[name][at] += step
                ends.append(recurrent.gradients(x, y, moved, drops)[0])
            assert found[name][at] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-4, abs=1e-6), (name, at)
    if not dropped:
        assert np.abs(recurrent.answers(x, w) - y).sum() == pytest.approx(loss)


def test_steps_by_hand():
    """One unit, one step: the layer's formula written out."""
    w = recurrent.begun(1, (1, 1), 2, 5)
    x = np.array([[[0.7]]])
    out, _ = recurrent._layer(x, w, 0)
    i, f, g, o = (0.7 * w["in0"][0] + w["bias0"])
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    assert f == pytest.approx(0.7 * w["in0"][0, 1] + 1)
    assert out[0, 0, 0] == pytest.approx(sigmoid(o) * np.tanh(sigmoid(i) * np.tanh(g)))


def sequences_of(rows, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.random((rows, 6, 2))
    return recurrent.Sequences(x, x[:, -1, 0] * 0.6 + x[:, 0, 1] * 0.3, rng.integers(0, 1 << 62, rows).astype(np.uint64))


def test_spread_blocks_do_the_same(spark):
    parts = [sequences_of(90, 1), sequences_of(70, 2)]
    test = [sequences_of(40, 3)]
    w = recurrent.begun(2, (5, 4), 3)
    held = recurrent.train(Held(recurrent._joined(parts)), Held(test), 160, w, 4)
    rdd = spark.sparkContext.parallelize(parts, 1).mapPartitions(recurrent._joined)
    spread = recurrent.train(Spread(rdd), Spread(spark.sparkContext.parallelize(test, 1)), 160, w, 4)
    for name in w:
        np.testing.assert_allclose(held[0][name], spread[0][name], rtol=1e-9)
    assert held[1] == spread[1] and [e for e, _, _ in held[1]] == [1, 2, 3, 4]
    # Two tasks step together on twice the rows.
    pair = Spread(spark.sparkContext.parallelize(parts, 2))
    errors = [e for _, e, _ in recurrent.train(pair, Held(test), 90, w, 12)[1]]
    assert errors[-1] < errors[0]


def test_training_keeps_the_best(monkeypatch):
    told = iter([3.0, 2.0, 2.5, 1.9, 2.2, 2.1, 2.0, 1.95])
    seen = []

    class Tests:
        def total(self, *_):
            return next(told), 1, {}

    monkeypatch.setattr(recurrent, "_misses", lambda w: seen.append(w))
    w = recurrent.begun(2, (3, 2), 2)
    best, history = recurrent.train(Held([sequences_of(50)]), Tests(), 50, w, 30, 3)
    assert [e for _, _, e in history] == [3.0, 2.0, 2.5, 1.9, 2.2, 2.1, 2.0]
    assert all((best[n] == seen[3][n]).all() for n in w)


@pytest.fixture(scope="module")
def fitted(spark):
    n = 500
    rng = np.random.default_rng(6)
    h = np.arange(n)
    load = 1000 + 300 * np.sin(2 * np.pi * h / 24) + rng.normal(0, 5, n)
    rows = time_split(stage(frame(spark, hours(n, load=load, day_sin=np.sin(2 * np.pi * h / 24), day_cos=np.cos(2 * np.pi * h / 24)))))
    train = rows.where(F.col("split") == "train")
    return rows, recurrent.fit_recurrent(train, ["load", "day_sin", "day_cos"], "load", 12, epochs=25)


def test_network_learns_the_day(fitted):
    rows, model = fitted
    test = recurrent.predict(model, rows.where(F.col("split") == "test"), "pred")
    found = test.agg(F.count("*").alias("n"), F.avg(F.abs(F.col("load") - F.col("pred"))).alias("mae"),
                     F.avg(F.abs(F.col("load") - 1000)).alias("flat")).first()
    assert found.n == 100 - 12 and found.mae < 0.4 * found.flat
    assert model.epochs[-1][2] < model.epochs[0][2] and len(model.epochs) <= 25


def test_saved_network_answers_the_same(spark, fitted, tmp_path):
    rows, model = fitted
    recurrent.save(model, spark, str(tmp_path / "n"))
    again = recurrent.load(spark, str(tmp_path / "n"))
    a = recurrent.predict(model, rows, "p").withColumnRenamed("load", "x")
    b = recurrent.predict(again, rows, "q")
    both = a.join(b, "ts")
    assert both.count() == 500 - 12 and both.where("abs(p - q) > 1e-9").count() == 0


def test_no_rows(spark, fitted):
    with pytest.raises(ValueError, match="no training rows"):
        recurrent.fit_recurrent(fitted[0].limit(0), ["load"], "load")
