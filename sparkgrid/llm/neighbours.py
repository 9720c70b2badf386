"""Nearest neighbours by hierarchical navigable small-world graphs, one per shard.

1. Equal vectors become one node with their smallest ids: of equal vectors no
   search for ``k`` neighbours can return more than ``k`` and its own row. The
   rank that picks them is applied in each task before the shuffle, so that a
   vector which a third of all rows hold costs a few rows a task.
2. Nodes are dealt to shards by hash, about ``SHARD_ROWS`` in each, and each
   shard becomes a graph. A node's level is drawn from its place in the shard;
   its links lie in one flat array of slots, ``2 * LINKS`` for the ground level
   and ``LINKS`` for each level above, padded with -1. Links are chosen among
   the nodes found by a beam search, leaving out those nearer to a link than to
   the node, so that clusters stay connected. The index is a table, a row per
   node, and can be written and searched again.
3. A search sends the queries to every shard; a task puts its graph together
   from the rows and lets the queries stream by. Each shard hands on its best
   ``k + 1``, and a rank over all shards, again applied before the shuffle,
   keeps ``k`` besides the query's own row. Distances are taken on the vectors
   as given, in double precision.

The search is approximate within a shard: ``SEARCH_WIDTH`` is the beam; a shard
of no more nodes than that is scanned. The tests and the README give the recall
against brute force.

Defined cases: vectors that are NULL, empty, zero or hold NULL or non-finite
components take no part, as queries or candidates; vectors of another dimension
are never near; repeated rows are candidates of their own, and of rows equal to
a query one counts as the query itself; rows without an id can be found, after
those with one at the same distance; ties go to the smaller id; fewer than k
candidates are all returned; an empty table gives an empty result; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkgrid.llm.common import ship
from sparkgrid.session import join_small, stage

K = 10
LINKS = 16
BUILD_WIDTH = 64
SEARCH_WIDTH = 128
SHARD_ROWS = 8192
SEED = 11

INDEX = T.StructType([
    T.StructField("dimension", T.IntegerType()), T.StructField("shard", T.LongType()),
    T.StructField("node", T.IntegerType()), T.StructField("level", T.IntegerType()),
    T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("vector", T.ArrayType(T.DoubleType())),
    T.StructField("links", T.ArrayType(T.IntegerType()))])
FOUND = T.StructType([
    T.StructField("query", T.LongType()), T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()),
    T.StructField("score", T.DoubleType()), T.StructField("own", T.BooleanType())])


class Graph:
    """A navigable graph over the rows of ``vectors``; nodes are added in order."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, links: int = LINKS):
        self.vectors, self.levels, self.links = vectors, levels.astype(np.int32), links
        widths = 2 * links + self.levels.astype(np.int64) * links
        self.start = np.concatenate([[0], np.cumsum(widths)])
        self.flat = np.full(self.start[-1], -1, np.int32)
        self.seen = np.zeros(len(vectors), np.int64)
        self.stamp, self.entry = 0, -1

    def slots(self, node: int, level: int) -> tuple[int, int]:
        """Where the links of a node on a level lie in the flat array, and how many fit."""
        if level == 0:
            return self.start[node], 2 * self.links
        return self.start[node] + (level + 1) * self.links, self.links

    def near(self, node: int, level: int) -> np.ndarray:
        start, width = self.slots(node, level)
        links = self.flat[start:start + width]
        return links[links >= 0]

    def squared(self, query: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        difference = self.vectors[nodes] - query
        return np.einsum("ij,ij->i", difference, difference)

    def descend(self, query: np.ndarray, node: int, top: int, bottom: int) -> int:
        """The node that greedy steps reach from ``node`` on the levels top … bottom."""
        best = self.squared(query, np.array([node]))[0]
        for level in range(top, bottom - 1, -1):
            while True:
                near = self.near(node, level)
                if not len(near):
                    break
                distances = self.squared(query, near)
                at = int(distances.argmin())
                if distances[at] >= best:
                    break
                best, node = distances[at], int(near[at])
        return node

    def beam(self, query: np.ndarray, node: int, level: int, width: int) -> list[tuple[float, int]]:
        """The nearest ``width`` nodes that a best-first search meets, nearest first."""
        self.stamp += 1
        stamp, seen, flat, start = self.stamp, self.seen, self.flat, self.start
        offset, count = (0, 2 * self.links) if level == 0 else ((level + 1) * self.links, self.links)
        first = float(self.squared(query, np.array([node]))[0])
        seen[node] = stamp
        open_, found = [(first, node)], [(-first, node)]
        while open_:
            distance, node = heappop(open_)
            if len(found) >= width and distance > -found[0][0]:
                break
            at = start[node] + offset
            near = flat[at:at + count]
            near = near[(near >= 0) & (seen[near] != stamp)]
            if not len(near):
                continue
            seen[near] = stamp
            distances = self.squared(query, near)
            if len(found) >= width:
                close = distances < -found[0][0]
                near, distances = near[close], distances[close]
            for d, n in zip(distances.tolist(), near.tolist()):
                if len(found) < width:
                    heappush(found, (-d, n))
                    heappush(open_, (d, n))
                elif d < -found[0][0]:
                    heapreplace(found, (-d, n))
                    heappush(open_, (d, n))
        return sorted((-d, n) for d, n in found)

    def choose(self, distances: np.ndarray, nodes: np.ndarray, most: int) -> np.ndarray:
        """Of nodes by rising distance those that are nearer to the origin than to a chosen one, then the nearest others."""
        points = self.vectors[nodes]
        norms = np.einsum("ij,ij->i", points, points)
        apart = norms[:, None] + norms[None, :] - 2 * (points @ points.T)
        chosen, left = [], np.ones(len(nodes), bool)
        while len(chosen) < most and left.any():
            at = int(left.argmax())
            chosen.append(at)
            left[at] = False
            left &= apart[at] > distances
        if len(chosen) < most:
            taken = set(chosen)
            chosen += [i for i in range(len(nodes)) if i not in taken][:most - len(chosen)]
        return nodes[chosen]

    def link(self, node: int, other: int, level: int) -> None:
        """Add a link from ``node`` to ``other``; full nodes choose anew."""
        start, width = self.slots(node, level)
        own = self.flat[start:start + width]
        free = np.flatnonzero(own < 0)
        if len(free):
            own[free[0]] = other
            return
        nodes = np.append(own, np.int32(other))
        distances = self.squared(self.vectors[node], nodes)
        order = np.argsort(distances, kind="stable")
        kept = self.choose(distances[order], nodes[order], width)
        own[:] = -1
        own[:len(kept)] = kept

    def add(self, node: int, width: int) -> None:
        query, level = self.vectors[node], int(self.levels[node])
        if self.entry < 0:
            self.entry = node
            return
        top = int(self.levels[self.entry])
        at = self.descend(query, self.entry, top, level + 1) if top > level else self.entry
        for current in range(min(top, level), -1, -1):
            found = self.beam(query, at, current, width)
            at = found[0][1]
            distances, nodes = np.array([d for d, _ in found]), np.array([n for _, n in found], np.int32)
            chosen = self.choose(distances, nodes, self.links)
            start, _ = self.slots(node, current)
            self.flat[start:start + len(chosen)] = chosen
            for other in chosen.tolist():
                self.link(other, node, current)
        if level > top:
            self.entry = node

    def search(self, query: np.ndarray, k: int, width: int) -> list[tuple[float, int]]:
        """(squared distance, node) of about the nearest ``k`` nodes, nearest first."""
        if len(self.vectors) <= width:
            distances = self.squared(query, np.arange(len(self.vectors)))
            order = np.argsort(distances, kind="stable")[:k]
            return list(zip(distances[order].tolist(), order.tolist()))
        at = self.descend(query, self.entry, int(self.levels[self.entry]), 1)
        return self.beam(query, at, 0, max(width, k))[:k]


def drawn_levels(n: int, links: int = LINKS) -> np.ndarray:
    """Levels of the nodes of a shard: each next level holds one in ``links`` nodes."""
    draws = 1 - np.random.default_rng(SEED).random(n)
    return np.floor(-np.log(draws) / math.log(links)).astype(np.int32)


def built(vectors: np.ndarray, links: int = LINKS, width: int = BUILD_WIDTH) -> Graph:
    graph = Graph(vectors, drawn_levels(len(vectors), links), links)
    for node in range(len(vectors)):
        graph.add(node, width)
    return graph


def matrix(column: pa.ListArray, kind=np.float64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def _stretches(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Parts of sorted batches in which the keys stay the same."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.any([v[1:] != v[:-1] for v in values], axis=0)
        bounds = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(bounds, bounds[1:]):
            yield tuple(int(v[a]) for v in values), batch.slice(a, b - a)


def _graphs(batches: Iterable[pa.RecordBatch], schema: pa.Schema, links: int, width: int) -> Iterator[pa.RecordBatch]:
    def index(key: tuple, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = np.concatenate([matrix(p.column("vector")) for p in parts])
        graph = built(vectors, links, width)
        ids = pa.concat_arrays([p.column("ids") for p in parts])
        for a in range(0, len(vectors), 1024):
            b = min(a + 1024, len(vectors))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(b - a, key[0], np.int32)), pa.array(np.full(b - a, key[1], np.int64)),
                pa.array(np.arange(a, b, dtype=np.int32)), pa.array(graph.levels[a:b]),
                ids.slice(a, b - a).cast(schema.field("ids").type),
                pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * vectors.shape[1]),
                                         pa.array(vectors[a:b].reshape(-1))),
                pa.ListArray.from_arrays(pa.array((graph.start[a:b + 1] - graph.start[a]).astype(np.int32)),
                                         pa.array(graph.flat[graph.start[a]:graph.start[b]])),
            ], schema=schema)

    current, parts = None, []
    for key, part in _stretches(batches, ["dimension", "shard"]):
        if key != current and parts:
            yield from index(current, parts)
            parts = []
        current = key
        parts.append(part)
    if parts:
        yield from index(current, parts)


def restored(parts: list[pa.RecordBatch], links: int) -> tuple[Graph, list[list]]:
    """A graph and the ids of its nodes from rows of the index in order of the nodes."""
    levels = np.concatenate([p.column("level").to_numpy() for p in parts])
    graph = Graph(np.concatenate([matrix(p.column("vector")) for p in parts]), levels, links)
    graph.flat = np.concatenate([p.column("links").flatten().to_numpy() for p in parts])
    graph.entry = int(levels.argmax())  # the first node of the highest level
    return graph, [ids for p in parts for ids in p.column("ids").to_pylist()]


def _searched(batches: Iterable[pa.RecordBatch], schema: pa.Schema, k: int, links: int,
              width: int) -> Iterator[pa.RecordBatch]:
    current, parts, graph, ids = None, [], None, []
    for (dimension, shard, query), part in _stretches(batches, ["dimension", "shard", "kind"]):
        if (dimension, shard) != current:
            current, parts, graph = (dimension, shard), [], None
        if not query:
            parts.append(part)
            continue
        if graph is None:
            if not parts:
                continue  # no candidates of this dimension
            graph, ids = restored(parts, links)
            parts = []
        rows = []
        for number, query_id, vector in zip(part.column("query").to_pylist(), part.column("query_id").to_pylist(),
                                            matrix(part.column("vector"))):
            best = []
            for distance, node in graph.search(vector, k + 1, width):
                own = bool((graph.vectors[node] == vector).all())
                best += [(number, query_id, i, math.sqrt(distance), own and i == query_id) for i in ids[node]]
            best.sort(key=lambda r: (r[3], r[2] is None, r[2] or 0))
            rows += best[:k + 1]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def usable(vector: str) -> Column:
    """Whether a vector takes part: known, finite and not zero throughout."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _vectors(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    rows = df.select(F.col(f"`{id_column}`").cast("long").alias("id"),
                     F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    return rows.where(usable("vector"))


def build_index(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", k: int = K,
                shard_rows: int = SHARD_ROWS, links: int = LINKS, width: int = BUILD_WIDTH) -> DataFrame:
    """The index table (``INDEX``) of all usable vectors, for searches of up to ``k`` neighbours."""
    spark = df.sparkSession
    ship(spark)
    ranked = _vectors(df, id_column, vector).withColumn("_rank", F.row_number().over(
        Window.partitionBy("vector").orderBy(F.asc_nulls_last("id"))))
    nodes = stage(ranked.where(F.col("_rank") <= k + 1).groupBy("vector").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rank", "id"))), lambda r: r["id"]).alias("ids")).select(
        F.size("vector").alias("dimension"), F.xxhash64("vector").alias("hash"), "vector", "ids"), "nodes")
    sizes = nodes.groupBy("dimension").agg(F.ceil(F.count("*") / shard_rows).alias("shards"))
    dealt = join_small(nodes, sizes, ["dimension"]).withColumn("shard", F.pmod("hash", "shards"))
    schema = to_arrow_schema(INDEX)
    return _by_shard(dealt.select("dimension", "shard", "hash", "vector", "ids"), "hash").mapInArrow(
        lambda b: _graphs(b, schema, links, width), INDEX)


def _by_shard(df: DataFrame, *order) -> DataFrame:
    """Shards dealt evenly to as many tasks as there are shuffle partitions, each shard together and in order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.pmod(F.col("shard") + F.col("dimension"), F.lit(n)).cast("int")
    return df.repartitionById(n, place).sortWithinPartitions("dimension", "shard", *order)


def search(index: DataFrame, queries: DataFrame, id_column: str = "vec_id", vector: str = "embedding", k: int = K,
           links: int = LINKS, width: int = SEARCH_WIDTH) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query row, itself left out.

    ``index`` is read more than once: give a written table.
    """
    ship(queries.sparkSession)
    asked = stage(_vectors(queries, id_column, vector).select(
        F.monotonically_increasing_id().alias("query"), F.col("id").alias("query_id"), "vector",
        F.size("vector").alias("dimension")), "queries")
    shards = index.select("dimension", "shard").distinct()
    sent = join_small(asked, shards, ["dimension"]).select(
        "dimension", "shard", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("node"),
        F.lit(None).cast("int").alias("level"), F.lit(None).cast("array<bigint>").alias("ids"), "vector",
        F.lit(None).cast("array<int>").alias("links"), "query", "query_id")
    rows = index.select("dimension", "shard", F.lit(0).alias("kind"), "node", "level", "ids", "vector", "links",
                        F.lit(None).cast("long").alias("query"), F.lit(None).cast("long").alias("query_id")).union(sent)
    schema = to_arrow_schema(FOUND)
    found = _by_shard(rows, "kind", "node", "query").mapInArrow(
        lambda b: _searched(b, schema, k, links, width), FOUND)
    order = [F.asc("score"), F.asc_nulls_last("vec_id"), F.desc("own")]
    first = found.withColumn("_place", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
    first = first.where(F.col("_place") <= k + 1)
    # At most one of these rows is the query itself.
    itself = F.row_number().over(Window.partitionBy("query", "own").orderBy("_place")) == 1
    others = first.withColumn("_self", F.col("own") & itself).where(~F.col("_self"))
    ranked = others.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("_place")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
