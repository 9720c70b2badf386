"""Graph search against brute force."""

import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sparkgrid.llm import neighbours
from sparkgrid.llm.queries import QUERIES
from sparkgrid.session import stage

SCHEMA = "vec_id long, embedding array<float>, label int"


def exact(rows, k=10, every=100):
    """[(query_id, [(score, vec_id) …])] by comparing everything, in row order."""
    good = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for at, (i, v) in enumerate(good):
        if i is None or i % every:
            continue
        others = [(math.dist(v, w), j is None, j or 0) for b, (j, w) in enumerate(good) if b != at and len(w) == len(v)]
        out.append((i, [(s, None if none else j) for s, none, j in sorted(others)[:k]]))
    return out


def found(df):
    lists = {}
    for r in df.collect():
        lists.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    return {q: sorted(v) for q, v in lists.items()}


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_query_recall(spark, folder):
    table = pq.read_table(f"{folder}/embeddings.parquet")
    rows = list(zip(table["vec_id"].to_pylist(), table["embedding"].to_pylist()))
    lists, hits, wanted = found(QUERIES["op11_hnsw_search"](spark, folder)), 0, 0
    expected = dict(exact(rows))
    assert set(lists) == set(expected)
    vectors = dict(rows)
    for q, near in expected.items():
        assert [r for r, _, _ in lists[q]] == list(range(1, len(near) + 1))
        for _, score, v in lists[q]:
            assert v != q and score == pytest.approx(math.dist(vectors[q], vectors[v]), rel=1e-12)
        assert lists[q] == sorted(lists[q], key=lambda r: (r[1], r[2]))
        hits += len({v for _, v in near} & {v for _, _, v in lists[q]})
        wanted += len(near)
    assert hits >= 0.9 * wanted


@pytest.mark.parametrize("kind", ["clusters", "uniform", "line"])
def test_graph_recall(kind):
    rng = np.random.default_rng(4)
    n, d = 3000, 32
    points = {"clusters": rng.normal(0, 1, (20, d))[rng.integers(0, 20, n)] + rng.normal(0, 0.2, (n, d)),
              "uniform": rng.normal(0, 1, (n, d)), "line": np.arange(n)[:, None] * np.ones(d)}[kind]
    graph = neighbours.built(points)
    hits = 0
    for q in range(0, n, 30):
        wanted = set(np.argsort(((points - points[q]) ** 2).sum(1), kind="stable")[:10].tolist())
        hits += len(wanted & {i for _, i in graph.search(points[q], 10, neighbours.SEARCH_WIDTH)})
    assert hits >= 0.9 * 10 * len(range(0, n, 30))


def test_index_rows_restore_the_graph(spark):
    rng = np.random.default_rng(5)
    points = rng.normal(0, 1, (700, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, p.tolist(), 0) for i, p in enumerate(points)], SCHEMA)
    rows = neighbours.build_index(df, shard_rows=300).collect()
    assert sorted(i for r in rows for i in r.ids) == list(range(700))
    assert len({r.shard for r in rows}) == 3
    for shard in {r.shard for r in rows}:
        own = sorted((r for r in rows if r.shard == shard), key=lambda r: r.node)
        graph = neighbours.built(np.array([r.vector for r in own]))
        assert graph.flat.tolist() == [x for r in own for x in r.links]
        assert all(len(r.links) == (2 + r.level) * neighbours.LINKS for r in own)


def awkward():
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(0, 1, 4).astype(np.float32).tolist()) for i in range(90, 330)]
    same = rows[10][1]                                     # that of id 100
    rows += [(i, list(same)) for i in range(400, 460)]     # a third of all, more copies than are asked for
    rows += [(100, list(same)), (100, rows[3][1]), (200, rows[7][1])]   # repeated rows and ids
    rows += [(None, list(same)), (None, rows[20][1])]
    rows += [(500, None), (600, []), (700, [0.0] * 4), (800, [1.0, None, 2.0, 3.0]), (900, [float("nan")] * 4),
             (1000, [float("inf"), 1.0, 1.0, 1.0])]
    rows += [(1100, [1.0, 2.0]), (1101, [1.0, 2.5]), (1102, [-0.0, 2.5]), (1103, [0.0, 2.5])]
    return rows


@pytest.mark.parametrize("shard_rows", [40, 100_000])
def test_awkward_rows(spark, shard_rows):
    rows = awkward()
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(7).withColumns(
        {c: F.lit("own") for c in ("id", "vector", "shard", "node", "query", "hash", "rank", "score")})
    index = stage(neighbours.build_index(df, shard_rows=shard_rows), "index")
    result = neighbours.search(index, df.where("vec_id % 100 = 0")).collect()
    got = sorted((r.query_id, r.rank, round(r.score, 9), -1 if r.vec_id is None else r.vec_id) for r in result)
    expected = sorted((q, place, round(s, 9), -1 if v is None else v)
                      for q, near in exact([(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
                      for place, (s, v) in enumerate(near, 1))
    assert got == expected


def test_no_vectors(spark):
    df = spark.createDataFrame([(100, None, 1), (200, [0.0, 0.0], 1)], SCHEMA)
    for table in (df, df.limit(0)):
        index = stage(neighbours.build_index(table), "index")
        assert neighbours.search(index, table).count() == 0
    one = spark.createDataFrame([(100, [1.0, 0.0], 1)], SCHEMA)
    assert neighbours.search(stage(neighbours.build_index(one), "index"), one).count() == 0
