"""Growing regression trees level by level on binned rows.

Features are quantised once, by exact quantiles, into at most ``BINS`` bins and
packed into blocks of rows. For every level the tasks walk their rows to the
nodes in question and sum (gradient, weight, rows) by (node, feature, bin);
sums are merged between tasks and the driver picks the splits. What it holds is
nodes x features x bins numbers, whatever the number of rows, and levels with
more nodes are cut into passes of at most ``PASS_CELLS`` of them. Of two
siblings only the one with fewer rows is summed; the other is the parent less
that.

Gradients are whole numbers (the target's unit over a power of two), so that
sums are exact and a tree does not depend on how rows are dealt to tasks.

Blocks lie in one of two places, and the same code grows the same trees on
both. ``Spread`` blocks are an RDD, with a job per level: planning a DataFrame
query for each would take longer than the job. ``Held`` blocks are those of a
table of no more than ``HELD_ROWS`` rows, a few megabytes, counted before: what
one task sums is then the total, so that it can go on to the next level without
a job. Everything else (bins, table of rows, scoring) is DataFrame code.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgrid.operators.quantiles import exact_quantiles
from sparkgrid.session import ship, stage

BINS = 256
BLOCK_ROWS = 8192
TASK_ROWS = 262_144          # rows per task of a job over spread blocks
HELD_ROWS = 65_536           # largest table that is grown on in one task
PASS_CELLS = 4 << 20         # sums per pass
HELD_CELLS = 8 << 20         # sums of parents that are held for their children
LEAF = -1


@dataclass
class Tree:
    """Nodes as flat arrays; node 0 is the root, leaves have feature ``LEAF`` and point to themselves."""

    feature: np.ndarray
    cut: np.ndarray          # a row goes left if its bin is at most this
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    cover: np.ndarray        # weight of the training rows in the node

    def reached(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """Node of each row of ``bins`` (features x rows) after ``depth`` steps."""
        node = np.zeros(bins.shape[1], np.int32)
        rows = np.arange(bins.shape[1])
        for _ in range(depth):
            beyond = bins[self.feature[node], rows] > self.cut[node]
            node = np.where(beyond, self.right[node], self.left[node])
        return node


@dataclass
class Spec:
    """What the trees of one model are grown by."""

    features: list[str]
    target: str
    depth: int
    penalty: float = 0.0       # added to the weight of a node in gains and values
    rate: float = 1.0          # factor of the leaf values
    least_rows: int = 2        # a node of fewer rows is not split
    least_gain: float = 0.0    # gains up to this are none
    scale: float = 1.0         # whole gradient per unit of the target


@dataclass
class Binned:
    """Blocks of binned rows, and the cuts of each feature."""

    blocks: DataFrame
    features: list[str]
    targets: list[str]
    cuts: list[np.ndarray]
    rows: int


def feature_cuts(rows: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Rising upper bounds of the bins of each feature; values above the last fall into one more bin."""
    steps = [i / bins for i in range(1, bins)]
    found = exact_quantiles(rows, {f: (F.col(f).cast("double"), steps) for f in features})
    cuts: dict[str, set[float]] = {f: set() for f in features}
    for r in found.select("name", "q").collect():  # at most features x bins rows
        cuts[r.name].add(r.q)
    return [np.array(sorted(cuts[f])) for f in features]


def binned(rows: DataFrame, features: list[str], targets: list[str], cuts: list[np.ndarray]) -> Binned:
    """The rows as a written table of blocks."""
    ship(rows.sparkSession)
    columns = {**{f"f{i}": c for i, c in enumerate(features)}, **{f"t{i}": c for i, c in enumerate(targets)}}
    values = {name: F.col(c).cast("double") for name, c in columns.items()}
    numbers = rows.select(*[v.alias(name) for name, v in values.items()], F.xxhash64(*values.values()).alias("key"))

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                bins = np.empty((len(features), part.num_rows), np.uint8)
                for i, edges in enumerate(cuts):
                    bins[i] = np.searchsorted(edges, part.column(f"f{i}").to_numpy(zero_copy_only=False), side="left")
                values = np.stack([part.column(f"t{i}").to_numpy(zero_copy_only=False) for i in range(len(targets))])
                yield pa.RecordBatch.from_pydict({
                    "rows": pa.array([part.num_rows], pa.int32()), "bins": [bins.tobytes()],
                    "targets": [values.astype(np.float64).tobytes()],
                    "keys": [part.column("key").to_numpy().tobytes()]})

    blocks = stage(numbers.mapInArrow(packed, "rows int, bins binary, targets binary, keys binary"), "blocks")
    size = blocks.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    return Binned(blocks, list(features), list(targets), cuts, size)


@dataclass
class Block:
    bins: np.ndarray         # features x rows
    targets: np.ndarray      # targets x rows
    keys: np.ndarray
    scores: np.ndarray | None = None   # of each model so far


def block_rdd(table: Binned) -> RDD:
    """The blocks of a written table, from which lost ones are read again."""
    n, m = len(table.features), len(table.targets)

    def unpacked(r) -> Block:
        return Block(np.frombuffer(r.bins, np.uint8).reshape(n, r.rows),
                     np.frombuffer(r.targets, np.float64).reshape(m, r.rows),
                     np.frombuffer(r.keys, np.uint64))

    rdd = table.blocks.rdd.map(unpacked)
    tasks = max(1, math.ceil(table.rows / TASK_ROWS))
    return rdd.coalesce(tasks) if tasks < rdd.getNumPartitions() else rdd


class Held:
    """Blocks in the memory of one task."""

    def __init__(self, blocks: Iterable[Block]):
        self.blocks = list(blocks)

    def map(self, function: Callable) -> Held:
        return Held(map(function, self.blocks))

    def kept(self) -> Held:
        return self

    def dropped(self) -> None:
        pass

    def total(self, partial: Callable, merge: Callable, nothing):
        return reduce(merge, partial(self.blocks), nothing)


class Spread:
    """Blocks in an RDD."""

    def __init__(self, rdd: RDD):
        self.rdd = rdd

    def map(self, function: Callable) -> Spread:
        return Spread(self.rdd.map(function))

    def kept(self) -> Spread:
        """In memory or on the executors' disks from now on."""
        self.rdd.persist(StorageLevel.MEMORY_AND_DISK).count()
        return self

    def dropped(self) -> None:
        if self.rdd.is_cached:
            self.rdd.unpersist()

    def total(self, partial: Callable, merge: Callable, nothing):
        """What ``partial`` makes of the blocks of each task, merged; between tasks first if there are many."""
        parts = self.rdd.mapPartitions(lambda blocks: [reduce(merge, partial(blocks), nothing)])
        return parts.treeReduce(merge) if parts.getNumPartitions() > 8 else reduce(merge, parts.collect(), nothing)


def mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    """64 bits of each row for one draw."""
    with np.errstate(over="ignore"):
        h = keys.view(np.uint64) + np.uint64(salt * 2 + 1) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    """A number below 1 for each row and draw."""
    return (mixed(keys, salt) >> np.uint64(11)).astype(np.float64) / (1 << 53)


POISSON_STEPS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def poisson(keys: np.ndarray, salt: int) -> np.ndarray:
    """How often each row is drawn, with mean 1."""
    return np.searchsorted(POISSON_STEPS, uniform(keys, salt), side="right").astype(np.float64)


class Growing:
    """A tree under construction: its nodes, and those of the level in hand."""

    def __init__(self, spec: Spec, salt: int, columns: np.ndarray):
        self.spec, self.salt, self.columns = spec, salt, columns
        self.nodes: list[list] = []        # feature, cut, left, right, value, gain, cover
        self.open: list[Open] = []
        self.level = 0

    def tree(self) -> Tree:
        columns = list(zip(*self.nodes)) if self.nodes else [[LEAF], [0], [0], [0], [0.0], [0.0], [0.0]]
        kinds = (np.int16, np.int16, np.int32, np.int32, np.float64, np.float64, np.float64)
        return Tree(*[np.array(c, k) for c, k in zip(columns, kinds)])

    def add(self, gradient: float, weight: float) -> int:
        node, spec = len(self.nodes), self.spec
        value = gradient / spec.scale / (weight + spec.penalty) * spec.rate if weight + spec.penalty else 0.0
        self.nodes.append([LEAF, 0, node, node, value, 0.0, weight])
        return node


Sums = tuple[np.ndarray, np.ndarray]     # sorted cells; (gradient, weight, rows) of each
NOTHING: Sums = (np.zeros(0, np.int64), np.zeros((3, 0)))


def merged(a: Sums, b: Sums) -> Sums:
    if not len(a[0]):
        return b
    if len(a[0]) == len(b[0]) and (a[0] == b[0]).all():
        return a[0], a[1] + b[1]
    cells, at = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    sums = np.empty((3, len(cells)))
    for k in range(3):
        sums[k] = np.bincount(at, np.concatenate([a[1][k], b[1][k]]), len(cells))
    return cells, sums


def cell_sums(bins: np.ndarray, slot: np.ndarray, columns: np.ndarray, slots: int, gradient: np.ndarray,
              weight: np.ndarray) -> Sums:
    """Sums by (slot, feature, bin) of the rows of ``bins`` in slots."""
    n = len(bins)
    cells, sums = [], []
    dense = slots * BINS <= 8 * len(slot) + 1024
    for c in columns:
        key = slot.astype(np.int64) * BINS + bins[c]
        if dense:
            rows = np.bincount(key, minlength=slots * BINS)
            found = np.flatnonzero(rows)
            g, w = np.bincount(key, gradient, slots * BINS)[found], np.bincount(key, weight, slots * BINS)[found]
            rows = rows[found]
        else:
            found, at = np.unique(key, return_inverse=True)
            rows, g, w = np.bincount(at), np.bincount(at, gradient), np.bincount(at, weight)
        cells.append((found // BINS * n + c) * BINS + found % BINS)
        sums.append(np.stack([g, w, rows]))
    every, values = np.concatenate(cells), np.concatenate(sums, axis=1)
    order = np.argsort(every, kind="stable")
    return every[order], values[:, order]


def level_sums(state: Held | Spread, growing: list[Growing], wanted: list[dict[int, int]], slots: int,
               gradients: Callable) -> Sums:
    """Sums of the rows in the wanted nodes ({node: slot} per tree) over all blocks.

    ``gradients(block, index of the tree)`` gives the whole gradients and the weights of a block's rows.
    """
    picked = [(i, g.tree(), g.level, g.columns, w) for i, (g, w) in enumerate(zip(growing, wanted)) if w]

    def partial(blocks):
        for block in blocks:
            for i, tree, level, columns, nodes in picked:
                gradient, weight = gradients(block, i)
                place = np.full(len(tree.feature), -1, np.int64)
                place[list(nodes)] = list(nodes.values())
                slot = place[tree.reached(block.bins, level)]
                rows = np.flatnonzero((slot >= 0) & (weight > 0))
                if len(rows):
                    yield cell_sums(block.bins[:, rows], slot[rows], columns, slots, (gradient * weight)[rows], weight[rows])

    return state.total(partial, merged, NOTHING)


def best_splits(sums: Sums, features: int, specs: list[Spec], totals: np.ndarray) -> dict[int, tuple]:
    """{slot: (gain, feature, bin, gradient, weight, rows of the left side)} of the slots that have a split.

    Ties go to the first feature and the lowest bin.
    """
    cells, (g, w, c) = sums
    if not len(cells):
        return {}
    slot, feature = cells // (features * BINS), cells // BINS % features
    first = np.flatnonzero(np.concatenate([[True], (cells[1:] // BINS) != (cells[:-1] // BINS)]))
    start = np.repeat(first, np.diff(np.append(first, len(cells))))

    def left(x):
        run = np.cumsum(x)
        return run - (run[start] - x[start])

    gl, wl, cl = left(g), left(w), left(c)
    gt, wt, ct = totals[:, slot]
    gr, wr, cr = gt - gl, wt - wl, ct - cl
    penalty = np.array([s.penalty for s in specs])[slot]
    unit = np.array([s.scale for s in specs])[slot] ** 2
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (gl * gl / (wl + penalty) + gr * gr / (wr + penalty) - gt * gt / (wt + penalty)) / unit
    least = np.array([s.least_gain for s in specs])[slot] + 1e-12 * gt * gt / (wt + penalty) / unit
    gain = np.where((cr >= 1) & (wr > 0) & (wl > 0) & (gain > least), gain, -np.inf)
    at = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
    best = np.maximum.reduceat(gain, at)
    hits = np.flatnonzero((gain == np.repeat(best, np.diff(np.append(at, len(cells))))) & (gain > -np.inf))
    _, chosen = np.unique(slot[hits], return_index=True)
    return {int(slot[k]): (float(gain[k]), int(feature[k]), int(cells[k] % BINS), float(gl[k]), float(wl[k]), float(cl[k]))
            for k in hits[chosen]}


def slot_totals(sums: Sums, features: int, slots: int) -> np.ndarray:
    """(gradient, weight, rows) of each slot, from the first feature that it has cells of."""
    cells, values = sums
    totals = np.zeros((3, slots))
    if len(cells):
        slot, feature = cells // (features * BINS), cells // BINS % features
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        lead = np.repeat(feature[first], np.diff(np.append(first, len(cells))))
        own = feature == lead
        for k in range(3):
            totals[k] = np.bincount(slot[own], values[k][own], slots)
    return totals


@dataclass
class Open:
    """A node whose sums are to be counted, and the sibling that then follows from the parent's."""

    node: int | None = None          # None: the root, of which nothing is known yet
    rows: float = math.inf
    sibling: int | None = None
    parent: int | None = None


def grow(state: Held | Spread, growing: list[Growing], features: int, gradients: Callable) -> list[Tree]:
    """Grow all trees to their depth, one level of all of them at a time."""
    held: dict[tuple, Sums] = {}     # (tree, parent) -> sums of a node that was split
    for g in growing:
        g.open = [Open()]
    for level in range(max(1, *(g.spec.depth for g in growing))):
        todo = deque((i, entry) for i, g in enumerate(growing) for entry in g.open)
        for g in growing:
            g.level, g.open = level, []
        kept: dict[tuple, Sums] = {}
        while todo:
            now, cells = [], 0
            while todo and (not now or cells < PASS_CELLS):
                now.append(todo.popleft())
                cells += int(min(BINS, now[-1][1].rows)) * features
            wanted: list[dict[int, int]] = [{} for _ in growing]
            for s, (i, entry) in enumerate(now):
                wanted[i][entry.node or 0] = s
            cells_, sums = level_sums(state, growing, wanted, len(now), gradients)
            bounds = np.searchsorted(cells_, np.arange(len(now) + 1) * features * BINS)
            slots: list[tuple] = []          # (tree, node, its sums)
            for s, (i, entry) in enumerate(now):
                part = slice(bounds[s], bounds[s + 1])
                own = cells_[part] - s * features * BINS, sums[:, part]
                slots.append((i, entry.node, own))
                if entry.sibling is not None:
                    above, rest = held[i, entry.parent][0], held[i, entry.parent][1].copy()
                    rest[:, np.searchsorted(above, own[0])] -= own[1]
                    some = rest[2] > 0
                    slots.append((i, entry.sibling, (above[some], rest[:, some])))
            _split(growing, slots, features, level, kept)
        held = kept
    return [g.tree() for g in growing]


def _split(growing: list[Growing], slots: list[tuple], features: int, level: int, kept: dict) -> None:
    """Split the nodes of the slots where that gains, and open their children."""
    width = features * BINS
    cells = np.concatenate([own[0] + s * width for s, (_, _, own) in enumerate(slots)])
    values = np.concatenate([own[1] for _, _, own in slots], axis=1)
    totals = slot_totals((cells, values), features, len(slots))
    splits = best_splits((cells, values), features, [growing[i].spec for i, _, _ in slots], totals)
    room = HELD_CELLS - sum(len(c) for c, _ in kept.values())
    for s, (i, node, own) in enumerate(slots):
        g = growing[i]
        if node is None:
            node = g.add(totals[0, s], totals[1, s])
        least = g.spec.least_rows
        if s not in splits or level >= g.spec.depth or totals[2, s] < least:
            continue
        gain, feature, cut, gl, wl, cl = splits[s]
        gr, wr, cr = totals[0, s] - gl, totals[1, s] - wl, totals[2, s] - cl
        a, b = g.add(gl, wl), g.add(gr, wr)
        g.nodes[node][:4] = [feature, cut, a, b]
        g.nodes[node][5] = gain
        if level + 1 >= g.spec.depth:
            continue
        small, large = sorted([(cl, a), (cr, b)])
        if large[0] < least:
            continue
        if small[0] >= least and len(own[0]) > room:      # no room for the parent's sums: count both
            g.open += [Open(n, rows) for rows, n in (small, large)]
        elif small[0] >= least or len(own[0]) <= room:
            g.open.append(Open(small[1], small[0], large[1], node))
            kept[i, node] = own
            room -= len(own[0])
        else:
            g.open.append(Open(large[1], large[0]))
