"""A recurrent network over the last hours of a series: two LSTM layers, two dense ones, trained by Adam on absolute errors.

A step takes the next ``BATCH`` sequences of every task, in an order drawn anew
each epoch, sums the gradients over all tasks and moves the weights once; what
travels is one set of weights out and one of gradients back. Blocks of
sequences lie, as for the trees, in one task (``Held``) where the table is
small, counted before, or in an RDD (``Spread``); with one task both do the
same. After each epoch the error on the validation sequences decides: training
ends ``patience`` epochs after the best, whose weights are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkgrid.constants import SEQUENCE_ROWS
from sparkgrid.operators.features import sequences, time_split
from sparkgrid.operators.growing import Held, Spread, uniform
from sparkgrid.session import ship, stage

UNITS = (64, 32)             # of the two recurrent layers
DENSE = 16
DROP = 0.2
BATCH = 128
EPOCHS, PATIENCE = 30, 5
RATE, MOMENTUM, SPREAD_DECAY, TINY = 0.001, 0.9, 0.999, 1e-7
SEED = 42
TASK_ROWS = 16_384           # sequences of a task
HELD_BYTES = 128 << 20       # of sequences that are trained on in one task

Weights = dict[str, np.ndarray]


def begun(features: int, units: tuple[int, int] = UNITS, dense: int = DENSE, seed: int = SEED) -> Weights:
    """First weights: even draws within the usual bounds, orthogonal recurrent ones, forget gates open."""
    rng = np.random.default_rng(seed)

    def even(rows: int, columns: int) -> np.ndarray:
        bound = math.sqrt(6 / (rows + columns))
        return rng.uniform(-bound, bound, (rows, columns))

    out: Weights = {}
    width = features
    for k, u in enumerate(units):
        turned, _ = np.linalg.qr(rng.normal(size=(4 * u, u)))
        out[f"in{k}"], out[f"loop{k}"], out[f"bias{k}"] = even(width, 4 * u), turned.T.copy(), np.zeros(4 * u)
        out[f"bias{k}"][u:2 * u] = 1.0
        width = u
    out["dense"], out["dense_bias"] = even(width, dense), np.zeros(dense)
    out["last"], out["last_bias"] = even(dense, 1), np.zeros(1)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _layer(x: np.ndarray, w: Weights, k: int) -> tuple[np.ndarray, list]:
    """Outputs of all steps (rows, steps, units), and what the way back needs. Gates: in, forget, cell, out."""
    loop, u = w[f"loop{k}"], w[f"loop{k}"].shape[0]
    given = x @ w[f"in{k}"] + w[f"bias{k}"]
    h = c = np.zeros((len(x), u))
    out, kept = [], []
    for t in range(x.shape[1]):
        z = given[:, t] + h @ loop
        gates = _sigmoid(z)
        i, f, o = gates[:, :u], gates[:, u:2 * u], gates[:, 3 * u:]
        g = np.tanh(z[:, 2 * u:3 * u])
        before, state = h, c
        c = f * state + i * g
        shown = np.tanh(c)
        h = o * shown
        out.append(h)
        kept.append((before, state, i, f, g, o, shown))
    return np.stack(out, axis=1), kept


def _layer_back(grad: np.ndarray, x: np.ndarray, kept: list, w: Weights, k: int, out: Weights) -> np.ndarray:
    """Adds the gradients of a layer to ``out``; returns that of its input. ``grad`` is by step."""
    loop = w[f"loop{k}"]
    gradient_z = np.zeros((len(x), x.shape[1], loop.shape[1]))
    dh = dc = np.zeros((len(x), loop.shape[0]))
    d_loop = np.zeros_like(loop)
    for t in range(x.shape[1] - 1, -1, -1):
        before, state, i, f, g, o, shown = kept[t]
        dh = dh + grad[:, t]
        dc = dc + dh * o * (1 - shown ** 2)
        dz = np.concatenate([dc * g * i * (1 - i), dc * state * f * (1 - f), dc * i * (1 - g ** 2),
                             dh * shown * o * (1 - o)], axis=1)
        gradient_z[:, t] = dz
        d_loop += before.T @ dz
        dh, dc = dz @ loop.T, dc * f
    flat = gradient_z.reshape(-1, loop.shape[1])
    out[f"in{k}"] = x.reshape(-1, x.shape[2]).T @ flat
    out[f"loop{k}"], out[f"bias{k}"] = d_loop, flat.sum(axis=0)
    return gradient_z @ w[f"in{k}"].T


def answers(x: np.ndarray, w: Weights) -> np.ndarray:
    """The network's answer to each sequence."""
    first, _ = _layer(x, w, 0)
    second, _ = _layer(first, w, 1)
    return (np.maximum(second[:, -1] @ w["dense"] + w["dense_bias"], 0) @ w["last"] + w["last_bias"])[:, 0]


def gradients(x: np.ndarray, y: np.ndarray, w: Weights, drops: tuple[np.ndarray, np.ndarray] | None) -> tuple[float, Weights]:
    """Sum of absolute errors of the sequences and its gradient; ``drops`` scale the outputs of the recurrent layers."""
    out: Weights = {}
    first, kept0 = _layer(x, w, 0)
    shown = first if drops is None else first * drops[0]
    second, kept1 = _layer(shown, w, 1)
    last = second[:, -1] if drops is None else second[:, -1] * drops[1]
    mixed = last @ w["dense"] + w["dense_bias"]
    dense = np.maximum(mixed, 0)
    miss = (dense @ w["last"] + w["last_bias"])[:, 0] - y
    d = np.sign(miss)[:, None]
    out["last"], out["last_bias"] = dense.T @ d, d.sum(axis=0)
    d = (d @ w["last"].T) * (mixed > 0)
    out["dense"], out["dense_bias"] = last.T @ d, d.sum(axis=0)
    d = d @ w["dense"].T
    by_step = np.zeros_like(second)
    by_step[:, -1] = d if drops is None else d * drops[1]
    d = _layer_back(by_step, shown, kept1, w, 1, out)
    _layer_back(d if drops is None else d * drops[0], x, kept0, w, 0, out)
    return float(np.abs(miss).sum()), out


@dataclass
class Sequences:
    """The sequences of one task."""

    x: np.ndarray            # rows x steps x features
    y: np.ndarray
    keys: np.ndarray

    def batch(self, epoch: int, step: int) -> np.ndarray:
        """The rows of a step, in the order of the epoch."""
        order = np.argsort(uniform(self.keys, epoch), kind="stable")
        return order[step * BATCH:(step + 1) * BATCH]


def _joined(parts: Iterable[Sequences]) -> list[Sequences]:
    parts = list(parts)
    return [Sequences(*(np.concatenate([getattr(p, n) for p in parts]) for n in ("x", "y", "keys")))] if parts else []


def _drops(rng: np.random.Generator, w: Weights, rows: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    u0, u1 = w["loop0"].shape[0], w["loop1"].shape[0]
    return tuple((rng.random(shape) >= DROP) / (1 - DROP) for shape in ((rows, steps, u0), (rows, u1)))


def train(blocks: Held | Spread, tests: Held | Spread, longest: int, weights: Weights, epochs: int = EPOCHS,
          patience: int = PATIENCE) -> tuple[Weights, list[tuple[int, float, float]]]:
    """(best weights, (epoch, error in training, error in validation) of each epoch); ``longest``: most rows of a task."""
    steps = math.ceil(longest / BATCH)
    momentum, spread = ({n: np.zeros_like(v) for n, v in weights.items()} for _ in range(2))
    best, history, moves = (math.inf, weights), [], 0
    for epoch in range(1, epochs + 1):
        lost = seen = 0.0
        for step in range(steps):
            loss, rows, total = blocks.total(_step(weights, epoch, step), _added, (0.0, 0, {}))
            if not rows:
                continue
            moves, lost, seen = moves + 1, lost + loss, seen + rows
            weights = dict(weights)
            for n, g in total.items():
                g = g / rows
                momentum[n] = MOMENTUM * momentum[n] + (1 - MOMENTUM) * g
                spread[n] = SPREAD_DECAY * spread[n] + (1 - SPREAD_DECAY) * g * g
                way = momentum[n] / (1 - MOMENTUM ** moves)
                weights[n] = weights[n] - RATE * way / (np.sqrt(spread[n] / (1 - SPREAD_DECAY ** moves)) + TINY)
        miss, rows, _ = tests.total(_misses(weights), _added, (0.0, 0, {}))
        error = miss / rows if rows else lost / max(seen, 1)
        history.append((epoch, lost / max(seen, 1), error))
        if error < best[0]:
            best, since = (error, weights), 0
        else:
            since += 1
            if since >= patience:
                break
    return best[1], history


def _step(weights: Weights, epoch: int, step: int):
    def partial(parts):
        for s in parts:
            rows = s.batch(epoch, step)
            if len(rows):
                rng = np.random.default_rng([SEED, epoch, step, int(s.keys[rows[0]] % np.uint64(1 << 32))])
                loss, out = gradients(s.x[rows], s.y[rows], weights, _drops(rng, weights, len(rows), s.x.shape[1]))
                yield loss, len(rows), out
    return partial


def _misses(weights: Weights):
    def partial(parts):
        for s in parts:
            for start in range(0, len(s.y), 4096):
                part = slice(start, start + 4096)
                yield float(np.abs(answers(s.x[part], weights) - s.y[part]).sum()), len(s.y[part]), {}
    return partial


def _added(a, b):
    return a[0] + b[0], a[1] + b[1], {n: a[2].get(n, 0) + b[2].get(n, 0) for n in a[2].keys() | b[2].keys()}


@dataclass
class RecurrentModel:
    weights: Weights
    features: list[str]
    steps: int
    low: dict[str, float]    # of the training rows, of features and target
    high: dict[str, float]
    target: str
    epochs: list[tuple[int, float, float]]


def _scaled(df: DataFrame, columns: list[str], low: dict, high: dict) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(low[c])) / F.lit((high[c] - low[c]) or 1.0) for c in columns})


def _packed(df: DataFrame, steps: int, width: int) -> DataFrame:
    """(rows, x, y, keys): a written table of blocks of the sequences (sequence, target)."""
    ship(df.sparkSession)

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().astype(np.float32)
                yield pa.RecordBatch.from_pydict({
                    "rows": pa.array([batch.num_rows], pa.int32()), "x": [x.tobytes()],
                    "y": [batch.column("y").to_numpy().astype(np.float64).tobytes()],
                    "keys": [batch.column("keys").to_numpy().tobytes()]})

    flat = df.select(F.flatten("sequence").alias("x"), F.col("target").cast("double").alias("y"))
    keyed = flat.withColumn("keys", F.xxhash64("x", "y"))
    return stage(keyed.mapInArrow(packed, "rows int, x binary, y binary, keys binary"), "sequences")


def _blocks(table: DataFrame, steps: int, width: int):
    def unpacked(r) -> Sequences:
        return Sequences(np.frombuffer(r.x, np.float32).reshape(r.rows, steps, width), np.frombuffer(r.y, np.float64),
                         np.frombuffer(r.keys, np.uint64))
    return table.rdd.map(unpacked)


def fit_recurrent(train_rows: DataFrame, features: list[str], target: str, steps: int = SEQUENCE_ROWS, ts: str = "ts",
                  keys: Iterable[str] = (), epochs: int = EPOCHS, patience: int = PATIENCE) -> RecurrentModel:
    """Train on the sequences of the rows; the last tenth of each series validates. Rows must be complete."""
    keys, columns = list(keys), list(dict.fromkeys([*features, target]))
    found = train_rows.agg(*[f(c).cast("double").alias(f"{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max))]).first()
    if found[0] is None:
        raise ValueError("no training rows")
    low, high = ({c: found[f"{n}_{c}"] for c in columns} for n in ("low", "high"))
    scaled = _scaled(train_rows.select(*keys, ts, *columns), columns, low, high)
    every = stage(sequences(scaled, features, target, steps, ts, keys), "sequences")
    split = time_split(every, 0.9, ts, keys)
    tables = [_packed(split.where(F.col("split") == s), steps, len(features)) for s in ("train", "test")]
    rows = [t.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0] for t in tables]
    weights = begun(len(features))
    both = [_blocks(t, steps, len(features)) for t in tables]
    if sum(rows) * steps * len(features) * 4 <= HELD_BYTES:
        tagged = both[0].map(lambda s: (False, s)).union(both[1].map(lambda s: (True, s)))

        def run(parts):
            parts = list(parts)
            mine = [Held(_joined(s for is_test, s in parts if is_test == kind)) for kind in (False, True)]
            yield train(mine[0], mine[1], rows[0], weights, epochs, patience)

        fitted, history = tagged.coalesce(1).mapPartitions(run).collect()[0]
    else:
        held = []
        for rdd, n in zip(both, rows):
            held.append(Spread(rdd.repartition(max(1, math.ceil(n / TASK_ROWS))).mapPartitions(_joined)).kept())
        longest = held[0].rdd.map(lambda s: len(s.y)).max()
        fitted, history = train(held[0], held[1], longest, weights, epochs, patience)
        for blocks in held:
            blocks.dropped()
    return RecurrentModel(fitted, list(features), steps, low, high, target, history)


def predict(model: RecurrentModel, df: DataFrame, name: str, ts: str = "ts", keys: Iterable[str] = ()) -> DataFrame:
    """(keys…, ts, target, ``name``) of the rows that have a whole sequence before them, in units of the target."""
    keys = list(keys)
    ship(df.sparkSession)
    rows = df.select(*keys, ts, *model.features, F.col(model.target).alias("_actual"))
    scaled = _scaled(rows, model.features, model.low, model.high)
    found = sequences(scaled, model.features, "_actual", model.steps, ts, keys)
    given = found.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate([*keys, ts])], "target",
                         F.flatten("sequence").alias("x"))
    fields = [f for f in given.schema if f.name != "x"]
    out = T.StructType([*fields, T.StructField("answer", T.DoubleType())])
    schema = to_arrow_schema(out)
    weights, steps, width = model.weights, model.steps, len(model.features)

    def answered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().astype(np.float32).reshape(-1, steps, width)
            parts = [answers(x[a:a + 4096], weights) for a in range(0, len(x), 4096)]
            columns = [batch.column(f.name).cast(schema.field(f.name).type) for f in fields]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(parts) if parts else np.zeros(0))], schema=schema)

    low, span = model.low[model.target], (model.high[model.target] - model.low[model.target]) or 1.0
    made = given.mapInArrow(answered, out)
    return made.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate([*keys, ts])], F.col("target").alias(model.target),
                       (F.col("answer") * span + low).alias(name))


def save(model: RecurrentModel, spark: SparkSession, path: str) -> None:
    rows = [(n, list(v.shape), v.ravel().tolist()) for n, v in model.weights.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, numbers array<double>").write.mode("overwrite").parquet(f"{path}/weights")
    about = [(model.features, model.steps, model.low, model.high, model.target)]
    spark.createDataFrame(about, "features array<string>, steps int, low map<string,double>, high map<string,double>, "
                          "target string").write.mode("overwrite").parquet(f"{path}/about")


def load(spark: SparkSession, path: str) -> RecurrentModel:
    weights = {r.name: np.array(r.numbers).reshape(r.shape) for r in spark.read.parquet(f"{path}/weights").collect()}
    about = spark.read.parquet(f"{path}/about").first()
    return RecurrentModel(weights, list(about.features), about.steps, dict(about.low), dict(about.high), about.target, [])
