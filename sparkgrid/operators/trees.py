"""Boosted trees and forests as tables of nodes: fitting, importances, scoring, saving."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrid.operators import growing
from sparkgrid.operators.growing import (
    Block, Growing, Held, Spec, Spread, Tree, binned, block_rdd, feature_cuts, grow, poisson, uniform,
)
from sparkgrid.session import one_row, stage

SEED = 42
PENALTY = 1.0                # of leaf weights in boosting
LEAST_GAIN = 1e-6
ROLL = 8                     # rounds after which scores are carried on
REBASE = 64                  # rounds after which they are computed anew from the written blocks
MODEL_BYTES = 256 << 20      # largest model that is sent to all tasks
NODE_BYTES = 40
NODES = ("tree int, node int, feature string, threshold double, left int, right int, value double, gain double, "
         "cover double")


@dataclass
class TreeModel:
    """A fitted model: its nodes as a written table (``NODES``), and how their values add up.

    A row goes left if its feature is at most the threshold. Leaves have no
    feature and point to themselves; node 0 is the root.
    """

    nodes: DataFrame
    features: list[str]
    base: float
    average: bool            # the mean of the trees' values, else base + their sum
    trees: int
    depth: int
    rounds: DataFrame | None = None   # (round, rows, mae, rmse) on the test rows, if any were given


@dataclass
class Boosting:
    """What a boosted model is fitted by."""

    features: list[str]
    target: str
    rounds: int
    depth: int
    rate: float = 0.05
    share: float = 0.8       # of the rows of each tree, by a hash of the row, and of its columns


def _scale(rows: int, span: float) -> float:
    """Whole gradients per unit: a power of two with which sums over all rows stay exact in a double."""
    return 2.0 ** min(40, math.floor(math.log2((1 << 52) / (max(rows, 1) * 4 * span)))) if span > 0 else 1.0


def _known(rows: DataFrame, features: list[str], targets: list[str]) -> DataFrame:
    return rows.select(*dict.fromkeys([*features, *targets])).dropna("any")


def _extent(rows: DataFrame, targets: list[str]) -> dict[str, tuple[float, float]]:
    """(mean, largest distance from it) of each target."""
    row = rows.agg(*[f(t).cast("double").alias(f"{n}_{i}") for i, t in enumerate(targets)
                     for n, f in (("mean", F.avg), ("low", F.min), ("high", F.max))]).first()
    out = {}
    for i, t in enumerate(targets):
        if row[f"mean_{i}"] is None:
            raise ValueError("no complete training rows")
        base = round(row[f"mean_{i}"], 6)  # the order of summation does not show
        out[t] = base, max(row[f"high_{i}"] - base, base - row[f"low_{i}"])
    return out


def columns_of(features: int, share: float, salt: int) -> np.ndarray:
    """The columns that a tree may use."""
    some = max(1, int(features * share))
    return np.sort(np.random.default_rng([SEED, salt]).permutation(features)[:some])


def fit_boosted(train: DataFrame, models: dict[str, Boosting], test: DataFrame | None = None,
                patience: int | None = None) -> dict[str, TreeModel]:
    """Boosted regression trees, all ``models`` at once: one round adds a tree to each.

    Rows and columns are drawn per tree. With ``test`` the error after each
    round is kept; with ``patience`` a model ends at its best round once that
    many rounds were no better. Rows with missing values take no part.
    """
    spark = train.sparkSession
    names = list(models)
    features = list(dict.fromkeys(f for m in models.values() for f in m.features))
    targets = list(dict.fromkeys(m.target for m in models.values()))
    rows = _known(train, features, targets)
    cuts, extent = feature_cuts(rows, features), _extent(rows, targets)
    table = binned(rows, features, targets, cuts)
    specs = [Spec(m.features, m.target, m.depth, PENALTY, m.rate, 2, LEAST_GAIN, _scale(table.rows, extent[m.target][1]))
             for m in models.values()]
    task = _Boosting(list(models.values()), specs, [targets.index(m.target) for m in models.values()],
                     np.array([extent[m.target][0] for m in models.values()]),
                     [np.array([features.index(f) for f in m.features]) for m in models.values()], len(features), patience)
    tests = None if test is None else binned(_known(test, features, targets), features, targets, cuts)
    if max(table.rows, tests.rows if tests else 0) <= growing.HELD_ROWS:
        blocks = block_rdd(table).map(lambda b: (False, b))
        if tests:
            blocks = blocks.union(block_rdd(tests).map(lambda b: (True, b)))
        grown, errors = blocks.coalesce(1).mapPartitions(lambda both: [task.run_held(both)]).collect()[0]
    else:
        held = [Spread(block_rdd(t)).kept() for t in (table, tests) if t]
        grown, errors = task.run(held[0], held[1] if tests else None, ROLL)
        for blocks in held:
            blocks.dropped()
    out = {}
    for k, (name, m) in enumerate(models.items()):
        rounds = None if test is None else spark.createDataFrame(
            [(r, *errors[k][r]) for r in sorted(errors[k]) if r <= len(grown[k])],
            "round int, rows long, mae double, rmse double")
        out[name] = TreeModel(node_table(spark, grown[k], features, cuts), list(m.features), float(task.bases[k]), False,
                              len(grown[k]), m.depth, rounds)
    return out


@dataclass
class _Boosting:
    """The rounds of some models over the same blocks."""

    models: list[Boosting]
    specs: list[Spec]
    target: list[int]            # place of each model's target in a block
    bases: np.ndarray
    places: list[np.ndarray]     # of each model's features in a block
    features: int
    patience: int | None

    def run_held(self, both) -> tuple[list, list]:
        both = list(both)
        tests = [b for is_test, b in both if is_test]
        return self.run(Held(b for is_test, b in both if not is_test), Held(tests) if tests else None, 1)

    def run(self, blocks: Held | Spread, tests: Held | Spread | None, roll: int) -> tuple[list[list[Tree]], list[dict]]:
        """Trees of each model, and its errors on the test rows by round; scores are carried on every ``roll`` rounds."""
        rounds = [m.rounds for m in self.models]
        grown: list[list[Tree]] = [[] for _ in rounds]
        errors: list[dict[int, tuple]] = [{} for _ in rounds]
        state, tested, carried, done = self._begun(blocks), tests and self._begun(tests), 0, 0
        while any(len(g) < r for g, r in zip(grown, rounds)):
            active = [k for k, r in enumerate(rounds) if len(grown[k]) < r]
            salts = [done * len(rounds) + k for k in active]
            started = [Growing(self.specs[k], salt, self.places[k][columns_of(len(self.places[k]), self.models[k].share, salt)])
                       for k, salt in zip(active, salts)]
            rule = _gradients([self.specs[k] for k in active], [self.target[k] for k in active], active,
                              [grown[k][carried:] for k in active], salts, [self.models[k].share for k in active])
            for k, tree in zip(active, grow(state, started, self.features, rule)):
                grown[k].append(tree)
            done += 1
            if done % roll == 0 or not any(len(g) < r for g, r in zip(grown, rounds)):
                if tested is not None:
                    self._add_errors(errors, tested, grown, carried)
                    tested = self._moved(tested, tests, grown, carried, done)
                state, carried = self._moved(state, blocks, grown, carried, done), done
                for k, seen in enumerate(errors):
                    if self.patience is not None and seen and len(grown[k]) < rounds[k]:
                        best = min(seen, key=lambda r: (seen[r][1], r))
                        if len(grown[k]) - best >= self.patience:
                            rounds[k] = best
        state.dropped()
        if tested is not None:
            tested.dropped()
        return [g[:r] for g, r in zip(grown, rounds)], errors

    def _begun(self, blocks):
        bases = self.bases
        return blocks.map(lambda b: replace(b, scores=np.repeat(bases[:, None], b.bins.shape[1], axis=1)))

    def _moved(self, state, blocks, grown, carried: int, done: int):
        """The blocks with the scores of all trees grown so far."""
        again = isinstance(state, Spread) and done % REBASE == 0  # from the written blocks, so that lineage stays short
        trees = [list(g if again else g[carried:]) for g in grown]
        depths = [s.depth for s in self.specs]
        moved = (self._begun(blocks) if again else state).map(lambda b: replace(b, scores=np.stack(
            [_later(b.scores[k], b.bins, own, depths[k]) for k, own in enumerate(trees)]))).kept()
        state.dropped()
        return moved

    def _add_errors(self, errors, tested, grown, carried: int) -> None:
        """Errors of the test rows after each of the trees that were not carried on yet."""
        more, depths, target = [g[carried:] for g in grown], [s.depth for s in self.specs], self.target

        def sums(blocks):
            for b in blocks:
                for k, trees in enumerate(more):
                    scores = b.scores[k]
                    for r, tree in enumerate(trees, carried + 1):
                        scores = scores + tree.value[tree.reached(b.bins, depths[k])]
                        miss = b.targets[target[k]] - scores
                        yield {(k, r): np.array([len(miss), np.abs(miss).sum(), (miss ** 2).sum()])}

        def merge(a, b):
            return {key: a.get(key, 0) + b.get(key, 0) for key in a.keys() | b.keys()}

        for (k, r), (n, absolute, square) in tested.total(sums, merge, {}).items():  # one per model and round
            errors[k][r] = int(n), float(absolute / n), math.sqrt(square / n)


def _later(scores: np.ndarray, bins: np.ndarray, trees: list[Tree], depth: int) -> np.ndarray:
    for tree in trees:
        scores = scores + tree.value[tree.reached(bins, depth)]
    return scores


def _gradients(specs, target, models, pending, salts, shares):
    def rule(block: Block, i: int):
        spec = specs[i]
        scores = _later(block.scores[models[i]], block.bins, pending[i], spec.depth)
        gradient = np.rint((block.targets[target[i]] - scores) * spec.scale)
        return gradient, (uniform(block.keys, salts[i]) < shares[i]).astype(np.float64)
    return rule


def fit_forest(train: DataFrame, features: list[str], target: str, trees: int = 200, depth: int = 20,
               least_rows: int = 5) -> TreeModel:
    """A random forest: Poisson draws of the rows for each tree, all features at each split.

    A node of fewer than ``least_rows`` drawn rows is not split.
    """
    spark = train.sparkSession
    rows = _known(train, features, [target])
    cuts, extent = feature_cuts(rows, features), _extent(rows, [target])
    table = binned(rows, features, [target], cuts)
    base, span = extent[target]
    spec = Spec(features, target, depth, 0.0, 1.0, least_rows, 0.0, _scale(table.rows * 4, span))
    blocks, columns = block_rdd(table), np.arange(len(features))

    def rule(salts):
        return lambda block, i: (np.rint((block.targets[0] - base) * spec.scale), poisson(block.keys, salts[i]))

    if table.rows <= growing.HELD_ROWS:
        # The table goes to all tasks, and the trees are dealt to them.
        shared = spark.sparkContext.broadcast(blocks.collect())

        def own(numbers):
            salts = list(numbers)
            return zip(salts, grow(Held(shared.value), [Growing(spec, k, columns) for k in salts], len(features), rule(salts)))

        tasks = min(trees, spark.sparkContext.defaultParallelism)
        grown = [t for _, t in sorted(spark.sparkContext.parallelize(range(trees), tasks).mapPartitions(own).collect(),
                                      key=lambda pair: pair[0])]
    else:
        state = Spread(blocks).kept()
        grown = grow(state, [Growing(spec, k, columns) for k in range(trees)], len(features), rule(range(trees)))
        state.dropped()
    shifted = [replace(t, value=t.value + base) for t in grown]
    return TreeModel(node_table(spark, shifted, features, cuts), list(features), 0.0, True, trees, depth)


def node_table(spark: SparkSession, trees: list[Tree], features: list[str], cuts: list[np.ndarray]) -> DataFrame:
    """The trees as a written table of nodes."""
    names = np.array([*features, None], dtype=object)
    lists = [list() for _ in range(9)]
    for k, t in enumerate(trees):
        inner = t.feature >= 0
        threshold = [float(cuts[f][c]) if f >= 0 else None for f, c in zip(t.feature, t.cut)]
        parts = (np.full(len(t.feature), k), np.arange(len(t.feature)), np.where(inner, names[t.feature], None), threshold,
                 t.left, t.right, t.value, np.where(inner, t.gain, None), t.cover)
        for held, part in zip(lists, parts):
            held.extend(part if isinstance(part, list) else part.tolist())
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
    fields = [f.split()[0] for f in NODES.split(", ")]
    table = pa.Table.from_arrays([pa.array(c, k) for c, k in zip(lists, kinds)], names=fields)
    return stage(spark.createDataFrame(table, NODES), "nodes")


def importances(model: TreeModel, kind: str = "gain") -> DataFrame:
    """(feature, importance), one row per feature; they add up to one where the model has a split.

    ``gain``: mean gain of a feature's splits; ``total_gain``: their sum per
    tree, as forests weigh them; ``splits``: how many there are.
    """
    value = {"gain": F.avg("gain"), "splits": F.count("gain").cast("double")}
    splits = model.nodes.where("feature is not null")
    if kind == "total_gain":
        per_tree = splits.groupBy("tree", "feature").agg(F.sum("gain").alias("gain"))
        whole = per_tree.groupBy("tree").agg(F.sum("gain").alias("whole"))
        found = per_tree.join(whole, "tree").groupBy("feature").agg(F.sum(F.col("gain") / F.col("whole")).alias("v"))
    else:
        found = splits.groupBy("feature").agg(value[kind].alias("v"))
    every = model.nodes.sparkSession.createDataFrame([(f,) for f in model.features], "feature string")
    total = one_row(found.agg(F.sum("v").alias("sum")))
    return every.join(found, "feature", "left").select(
        "feature", F.coalesce(F.col("v") / total["sum"], F.lit(0.0)).alias("importance"))


def _arrays(model: TreeModel) -> DataFrame:
    """One row: the trees as arrays in order, features by their place in the model's list."""
    places = F.create_map(*[x for i, f in enumerate(model.features) for x in (F.lit(f), F.lit(i))])
    nodes = model.nodes.select("tree", "node", F.coalesce(places[F.col("feature")], F.lit(0)).alias("f"),
                               F.coalesce("threshold", F.lit(0.0)).alias("t"), "left", "right", "value")
    trees = nodes.groupBy("tree").agg(F.array_sort(F.collect_list(F.struct("node", "f", "t", "left", "right", "value"))).alias("n"))
    each = trees.select("tree", *[F.col("n").getField(c).alias(c) for c in ("f", "t", "left", "right", "value")])
    return each.agg(F.array_sort(F.collect_list(F.struct("tree", "f", "t", "left", "right", "value"))).alias("trees"))


def prediction(model: TreeModel, trees: Column) -> Column:
    """The walk through all trees as one expression, from root to leaf in ``depth`` steps."""
    x = F.array(*[F.col(f).cast("double") for f in model.features])
    steps = F.array_repeat(F.lit(0), max(1, model.depth))

    def leaf(tree: Column) -> Column:
        return F.aggregate(steps, F.lit(0), lambda at, _: F.when(
            F.get(x, F.get(tree["f"], at)) > F.get(tree["t"], at), F.get(tree["right"], at)).otherwise(F.get(tree["left"], at)))

    total = F.aggregate(trees, F.lit(model.base), lambda sum_, tree: sum_ + F.get(tree["value"], leaf(tree)))
    known = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in model.features])
    return F.when(known, total / F.lit(float(max(1, model.trees))) if model.average else total)


def predict(model: TreeModel, df: DataFrame, name: str) -> DataFrame:
    """``df`` with the prediction as ``name``; NULL where a feature is missing.

    Models up to ``MODEL_BYTES`` go to all tasks as arrays in one value and are
    walked inside the projection; larger ones are joined level by level.
    """
    if model.nodes.count() * NODE_BYTES > MODEL_BYTES:
        return predict_by_joins(model, df, name)
    trees = stage(_arrays(model), "trees")
    held = df.withColumn("_trees", one_row(trees)["trees"])
    return held.withColumn(name, prediction(model, F.col("_trees"))).drop("_trees")


def predict_by_joins(model: TreeModel, df: DataFrame, name: str) -> DataFrame:
    """The same walk over the node table: one join per level on (tree, node)."""
    known = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in model.features])
    rows = stage(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    values = F.map_from_arrays(F.array(*map(F.lit, model.features)),
                               F.array(*[F.col(f).cast("double") for f in model.features]))
    at = rows.where(known).select("_row", values.alias("_x"), F.explode(F.sequence(F.lit(0), F.lit(model.trees - 1))).alias("tree"),
                                  F.lit(0).alias("node"))
    for _ in range(model.depth):
        nodes = model.nodes.select("tree", "node", "feature", "threshold", "left", "right")
        beyond = F.coalesce(F.col("_x")[F.col("feature")] > F.col("threshold"), F.lit(False))
        at = at.join(nodes, ["tree", "node"]).select(
            "_row", "_x", "tree", F.when(beyond, F.col("right")).otherwise(F.col("left")).alias("node"))
    found = at.join(model.nodes.select("tree", "node", "value"), ["tree", "node"]).groupBy("_row").agg(
        F.array_sort(F.collect_list(F.struct("tree", "value"))).alias("_values"))  # one per tree
    total = F.aggregate("_values", F.lit(model.base), lambda sum_, v: sum_ + v["value"])
    if model.average:
        total = total / F.lit(float(max(1, model.trees)))
    return rows.join(found, "_row", "left").withColumn(name, total).drop("_row", "_values")


def save(model: TreeModel, path: str) -> None:
    spark = model.nodes.sparkSession
    model.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    about = [(model.features, model.base, model.average, model.trees, model.depth)]
    spark.createDataFrame(about, "features array<string>, base double, average boolean, trees int, depth int").write.mode(
        "overwrite").parquet(f"{path}/about")


def load(spark: SparkSession, path: str) -> TreeModel:
    about = spark.read.parquet(f"{path}/about").first()
    return TreeModel(spark.read.schema(NODES).parquet(f"{path}/nodes"), list(about.features), about.base, about.average,
                     about.trees, about.depth)
