"""Boosted trees and forests against plain versions that try every split of every node."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkgrid.operators import growing, trees
from sparkgrid.session import stage

FEATURES = ["a", "b", "c", "d", "flag"]


def table(n=500, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(0, 1, n), rng.integers(0, 12, n), rng.random(n) * 100, rng.normal(50, 9, n),
                         rng.integers(0, 2, n)]).astype(float)
    y = np.round(900 * np.sin(x[:, 0]) + 40 * x[:, 1] + np.where(x[:, 4] > 0, 3 * x[:, 2], 0) + rng.normal(0, 20, n), 2)
    return x, y


def frame(spark, x, y, partitions=4):
    rows = [(*map(float, r), float(v)) for r, v in zip(x, y)]
    return stage(spark.createDataFrame(rows, ", ".join(f"{f} double" for f in [*FEATURES, "y"])).repartition(partitions))


def keys_of(df):
    """The hash of each row, by its values."""
    names = [*FEATURES, "y"]
    found = df.select(*names, F.xxhash64(*names).alias("_k")).collect()
    return {tuple(r)[:-1]: r["_k"] for r in found}


def plain_cuts(x):
    return [np.unique(np.quantile(x[:, f], np.arange(1, growing.BINS) / growing.BINS)) for f in range(x.shape[1])]


def grown(x, g, w, cuts, columns, depth, penalty, least_rows, least_gain, leaf):
    """{path: (feature, threshold, gain, weight) or (value, weight)} by trying all cuts of all nodes."""
    out = {}

    def node(rows, path):
        gradient, weight = g[rows] @ w[rows], w[rows].sum()
        best = None
        if len(path) < depth and len(rows) >= least_rows:
            for f in columns:
                for cut in cuts[f]:
                    left = x[rows, f] <= cut
                    if left.all() or not left.any():
                        continue
                    gl, wl = g[rows][left] @ w[rows][left], w[rows][left].sum()
                    gain = (gl ** 2 / (wl + penalty) + (gradient - gl) ** 2 / (weight - wl + penalty)
                            - gradient ** 2 / (weight + penalty))
                    if gain > least_gain + 1e-9 * gradient ** 2 / (weight + penalty) and (
                            best is None or gain > best[0] * (1 + 1e-12)):
                        best = gain, f, cut, left
        if best is None:
            out[path] = leaf(gradient, weight), weight
            return
        gain, f, cut, left = best
        out[path] = f, cut, gain, weight
        node(rows[left], path + "0")
        node(rows[~left], path + "1")

    node(np.flatnonzero(w > 0), "")
    return out


def value(tree, row):
    path = ""
    while len(tree[path]) == 4:
        f, cut, _, _ = tree[path]
        path += "0" if row[f] <= cut else "1"
    return tree[path][0]


def by_path(nodes, k):
    """The same form from the rows of a node table."""
    own = {r.node: r for r in nodes if r.tree == k}
    out = {}

    def walk(at, path):
        r = own[at]
        if r.feature is None:
            out[path] = r.value, r.cover
        else:
            out[path] = FEATURES.index(r.feature), r.threshold, r.gain, r.cover
            walk(r.left, path + "0")
            walk(r.right, path + "1")

    walk(0, "")
    return out


def same(ours, plain):
    assert set(ours) == set(plain)
    for path, p in plain.items():
        assert len(ours[path]) == len(p)
        if len(p) == 4:
            assert ours[path][0] == p[0]
        assert ours[path] == pytest.approx(p, rel=1e-6, abs=1e-6)


ROUNDS, DEPTH, RATE = 20, 4, 0.3


@pytest.fixture(scope="module")
def boosted(spark):
    x, y = table()
    df = frame(spark, x, y)
    test = frame(spark, *table(200, 4))
    model = trees.fit_boosted(df, {"m": trees.Boosting(FEATURES, "y", ROUNDS, DEPTH, RATE)}, test)["m"]
    return x, y, df, test, model


def test_every_split_equals_the_plain_version(boosted):
    x, y, df, _, model = boosted
    keys = keys_of(df)
    key = np.array([keys[(*r, v)] for r, v in zip(map(tuple, x), y)])
    cuts, scores, nodes = plain_cuts(x), np.full(len(y), round(y.mean(), 6)), model.nodes.collect()
    for k in range(ROUNDS):
        w = (growing.uniform(key, k) < 0.8).astype(float)
        columns = trees.columns_of(len(FEATURES), 0.8, k)
        assert len(columns) == 4
        tree = grown(x, y - scores, w, cuts, columns, DEPTH, 1.0, 2, 1e-6, lambda g, h: RATE * g / (h + 1))
        same(by_path(nodes, k), tree)
        scores += [value(tree, r) for r in x]
    found = {tuple(r)[:-1]: r.p for r in trees.predict(model, df, "p").collect()}
    assert [found[(*r, v)] for r, v in zip(map(tuple, x), y)] == pytest.approx(scores, rel=1e-9)


def test_errors_of_the_rounds(boosted):
    _, y, df, test, model = boosted
    rounds = sorted(model.rounds.collect())
    assert [r["round"] for r in rounds] == list(range(1, ROUNDS + 1))
    miss = F.col("y") - F.col("p")
    last = trees.predict(model, test, "p").agg(F.avg(F.abs(miss)).alias("mae"), F.sqrt(F.avg(miss * miss)).alias("rmse"),
                                                F.count("*").alias("n")).first()
    assert (rounds[-1].rows, rounds[-1].mae, rounds[-1].rmse) == (last.n, pytest.approx(last.mae), pytest.approx(last.rmse))
    assert rounds[-1].mae < 0.3 * rounds[0].mae


def test_rows_may_lie_anywhere(spark, boosted, monkeypatch):
    """Spread over tasks, with other partitions, blocks, passes and carried rounds, rows give the same nodes."""
    x, y, _, _, model = boosted
    expected = sorted(model.nodes.collect(), key=lambda r: (r.tree, r.node))
    for name, number in (("BLOCK_ROWS", 37), ("TASK_ROWS", 40), ("HELD_ROWS", 0), ("PASS_CELLS", 1), ("HELD_CELLS", 300)):
        monkeypatch.setattr(growing, name, number)
    monkeypatch.setattr(trees, "ROLL", 3)
    monkeypatch.setattr(trees, "REBASE", 6)
    df = frame(spark, x[::-1], y[::-1], 13)
    again = trees.fit_boosted(df, {"m": trees.Boosting(FEATURES, "y", 10, DEPTH, RATE)}, df.limit(100))["m"]
    assert [r["round"] for r in sorted(again.rounds.collect())] == list(range(1, 11))
    found = sorted(again.nodes.collect(), key=lambda r: (r.tree, r.node))
    paths = [by_path(found, k) for k in range(10)]
    assert paths == [by_path(expected, k) for k in range(10)]


def test_patience_ends_at_the_best_round(spark):
    x, y = table(120)
    noise = np.random.default_rng(1).normal(0, 500, 120)
    df, test = frame(spark, x, noise), frame(spark, *table(80, 9))
    model = trees.fit_boosted(df, {"m": trees.Boosting(FEATURES, "y", 400, 3, 0.5)}, test, patience=5)["m"]
    rounds = sorted(model.rounds.collect())
    assert len(rounds) == model.trees < 60
    assert rounds[-1].mae == min(r.mae for r in rounds)
    assert model.nodes.select("tree").distinct().count() == model.trees


def test_two_models_in_one_pass(spark, boosted):
    x, y, df, _, model = boosted
    pair = trees.fit_boosted(df, {"m": trees.Boosting(FEATURES, "y", 4, DEPTH, RATE),
                                  "n": trees.Boosting(["c", "a"], "d", 6, 2, RATE)})
    assert pair["m"].trees == 4 and pair["n"].trees == 6
    assert {r.feature for r in pair["n"].nodes.select("feature").distinct().collect()} <= {"a", "c", None}
    predicted = trees.predict(pair["n"], df, "p").agg(F.avg(F.abs(F.col("d") - F.col("p"))), F.avg(F.abs(F.col("d") - 50))).first()
    assert predicted[0] < predicted[1]


def test_forest_equals_the_plain_version(spark):
    x, y = table(300)
    df = frame(spark, x, y)
    model = trees.fit_forest(df, FEATURES, "y", 6, 20)
    keys, nodes = keys_of(df), model.nodes.collect()
    key = np.array([keys[(*r, v)] for r, v in zip(map(tuple, x), y)])
    cuts, base, total = plain_cuts(x), round(y.mean(), 6), np.zeros(len(y))
    for k in range(6):
        w = growing.poisson(key, k)
        tree = grown(x, y - base, w, cuts, range(5), 20, 0.0, 5, 0.0, lambda g, h: g / h + base)
        ours = by_path(nodes, k)
        same(ours, tree)
        assert max(map(len, ours)) > 8
        total += [value(tree, r) for r in x]
    found = {tuple(r)[:-1]: r.p for r in trees.predict(model, df, "p").collect()}
    assert [found[(*r, v)] for r, v in zip(map(tuple, x), y)] == pytest.approx(total / 6, rel=1e-9)


def test_walks_agree(spark, boosted, monkeypatch):
    """Arrays inside the projection, joins over the node table, and a recursive query of another engine."""
    import duckdb
    _, _, df, _, model = boosted
    rows = df.withColumn("a", F.when(F.col("a") > 2, None).otherwise(F.col("a"))).withColumn("node", F.lit("own"))
    arrays = sorted(map(tuple, trees.predict(model, rows, "p").collect()), key=str)
    monkeypatch.setattr(trees, "MODEL_BYTES", 0)
    joined = sorted(map(tuple, trees.predict(model, rows, "p").collect()), key=str)
    assert [r[:-1] for r in arrays] == [r[:-1] for r in joined] and len(arrays) == 500
    for a, b in zip(arrays, joined):
        assert (a[-1] is None) == (b[-1] is None) == (a[0] is None)
        assert a[-1] is None or a[-1] == pytest.approx(b[-1], rel=1e-12)
    nodes, data = model.nodes.toPandas(), df.toPandas()  # noqa: F841
    walked = duckdb.sql(f"""with recursive r as (select row_number() over () i, * from data),
      x as (unpivot r on {', '.join(FEATURES)} into name feature value x),
      w as (select i, tree, 0 node from r, (select distinct tree from nodes)
        union all select w.i, w.tree, case when x.x > n.threshold then n."right" else n."left" end
        from w join nodes n using (tree, node) join x on x.i = w.i and x.feature = n.feature)
      select r.*, {model.base} + s p from r join (select i, sum(n.value) s from w join nodes n using (tree, node)
        where n.feature is null group by i) using (i)""").fetchall()
    found = {tuple(r)[:-1]: r.p for r in trees.predict(model, df, "p").collect()}
    assert len(walked) == 500
    for r in walked:
        assert found[r[1:-1]] == pytest.approx(r[-1], rel=1e-9)


def test_spread_forest_is_the_same(spark, monkeypatch):
    df = frame(spark, *table(200))
    nodes = []
    for held in (10_000, 0):
        monkeypatch.setattr(growing, "HELD_ROWS", held)
        nodes.append(trees.fit_forest(df, FEATURES, "y", 5, 6).nodes.collect())
    assert [by_path(nodes[0], k) for k in range(5)] == [by_path(nodes[1], k) for k in range(5)]


def test_importances_follow_from_the_nodes(boosted):
    model = boosted[-1]
    nodes = [r for r in model.nodes.collect() if r.feature]
    for kind in ("gain", "total_gain", "splits"):
        plain = {f: 0.0 for f in FEATURES}
        for f in FEATURES:
            own = [r for r in nodes if r.feature == f]
            if kind == "gain":
                plain[f] = sum(r.gain for r in own) / len(own) if own else 0.0
            elif kind == "splits":
                plain[f] = float(len(own))
            else:
                wholes = {r.tree: sum(n.gain for n in nodes if n.tree == r.tree) for r in own}
                plain[f] = sum(r.gain / wholes[r.tree] for r in own)
        whole = sum(plain.values())
        found = {r.feature: r.importance for r in trees.importances(model, kind).collect()}
        assert found == pytest.approx({f: v / whole for f, v in plain.items()})


def test_saved_nodes_score_the_same(spark, boosted, tmp_path):
    _, _, df, _, model = boosted
    trees.save(model, str(tmp_path / "m"))
    again = trees.load(spark, str(tmp_path / "m"))
    assert (again.features, again.base, again.trees, again.depth) == (model.features, model.base, model.trees, model.depth)
    both = trees.predict(again, trees.predict(model, df, "p"), "q")
    assert both.where("p = q").count() == 500


def test_plain_tables(spark):
    x, _ = table(40)
    constant = frame(spark, x, np.full(40, 7.5))
    model = trees.fit_boosted(constant, {"m": trees.Boosting(FEATURES, "y", 3, 4)})["m"]
    assert {r.p for r in trees.predict(model, constant, "p").collect()} == {7.5} and model.nodes.count() == 3
    same_rows = frame(spark, np.ones((30, 5)), np.arange(30.0))
    forest = trees.fit_forest(same_rows, FEATURES, "y", 3, 5)
    assert forest.nodes.count() == 3
    with pytest.raises(ValueError, match="no complete training rows"):
        trees.fit_forest(constant.where("y < 0"), FEATURES, "y", 2, 3)
    assert math.isfinite(trees.predict(forest, same_rows, "p").first().p)
