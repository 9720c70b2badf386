import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkgrid.llm import mixing, sharding
from tests.llm import data


def test_shards_are_contiguous_and_balanced(spark):
    rows = data.rows()
    found = sharding.assign_shards(data.frame(spark, rows), shards=7).collect()
    assert len(found) == len(rows)
    assert sorted((r.size, r.text_crc32) for r in found) == sorted(
        (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    ordered = sorted(found, key=lambda r: (r.shard, r.slot))
    key = lambda r: (r.doc_id is not None, r.doc_id or 0)
    assert [key(r) for r in ordered] == sorted(key(r) for r in found)
    total, before = sum(r.size for r in found), 0
    for r in ordered:
        assert r.shard == min((2 * before + r.size) * 7 // (2 * total), 6)
        before += r.size
    slots = defaultdict(list)
    for r in ordered:
        slots[r.shard].append(r.slot)
    assert all(s == list(range(len(s))) for s in slots.values())
    assert {(r.law, r.grown_shard) for r in found} == {("bytes", None)}


def test_hot_id_is_split(spark):
    rows = [(7, f"text number {k:04d}", None, None, None) for k in range(400)]
    found = sharding.assign_shards(data.frame(spark, rows), shards=4).groupBy("shard").agg(F.sum("size").alias("s"))
    sizes = [r.s for r in found.collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 2 * 32
    assert sharding.assign_shards(data.frame(spark, [])).isEmpty()


def raked(table, goals, sweeps=500):
    """Dense proportional fitting; ``goals`` per axis."""
    w = table.astype(float)
    for _ in range(sweeps):
        for axis, goal in enumerate(goals):
            other = tuple(k for k in range(w.ndim) if k != axis)
            found = w.sum(axis=other)
            scale = np.divide(goal, found, out=np.zeros_like(found), where=found > 0)
            w *= scale.reshape([-1 if k == axis else 1 for k in range(w.ndim)])
    return w


def test_raking_against_dense_arrays(spark):
    rng = np.random.default_rng(2)
    table = rng.integers(1, 500, (3, 2, 4))
    cells = spark.createDataFrame(
        [(f"s{i}", f"l{j}", f"t{k}", int(table[i, j, k])) for i in range(3) for j in range(2) for k in range(4)],
        "source string, lang string, topic string, tokens long")
    shares = [np.array([0.5, 0.3, 0.2]), np.array([0.6, 0.4]), np.array([0.1, 0.2, 0.3, 0.4])]
    targets = {m: spark.createDataFrame([(f"{m[0]}{k}", float(s)) for k, s in enumerate(share)] + [("absent", 3.0)],
                                        f"{m} string, share double")
               for m, share in zip(("source", "lang", "topic"), shares)}
    found = mixing.rake(cells, targets, tolerance=1e-12)
    expected = raked(table, [s * table.sum() for s in shares])
    for r in found.collect():
        i, j, k = int(r.source[1:]), int(r.lang[1:]), int(r.topic[1:])
        assert r.weight == pytest.approx(expected[i, j, k], rel=1e-6)
    for budget in (0.2, 0.6, 0.95):
        p = mixing.probabilities(found, budget)
        row = p.agg(F.sum(F.col("tokens") * F.col("probability")).alias("kept"), F.max("probability").alias("most"),
                    F.sum("tokens").alias("all")).first()
        assert row.kept == pytest.approx(budget * row["all"], rel=1e-6) and row.most <= 1


def test_mix_keeps_every_row_and_its_shares(spark):
    df = data.with_clashes(data.frame(spark, data.rows()))
    found = mixing.mix(df.drop("topic", "weight"), budget=0.5)
    assert found.count() == df.count()
    assert found.where("probability is null or sampled is null or topic is null").isEmpty()
    assert {r.source for r in found.select("source").distinct().collect()} == {"hot", "cold", "(none)"}
    twins = found.groupBy("doc_id", "text").agg(F.countDistinct("sampled").alias("n")).where("n > 1")
    assert twins.isEmpty()
    sampled = mixing.sampled_documents(df, budget=0.5)
    assert sampled.columns == df.columns and 0 < sampled.count() < df.count()


def test_mix_meets_its_budget(spark):
    rows = [(k, f"word {k} " * (1 + k % 7), ("en", "fr")[k % 5 == 0], ("hot", "a", "b")[k % 7 % 3], 1)
            for k in range(6000)]
    row = mixing.mix(data.frame(spark, rows), budget=0.4).agg(
        F.sum("n_tokens").alias("all"), F.sum(F.when(F.col("sampled"), F.col("n_tokens"))).alias("kept")).first()
    assert row.kept / row["all"] == pytest.approx(0.4, abs=0.03)


def test_mix_of_nothing(spark):
    assert mixing.mix(data.frame(spark, [])).isEmpty()
    blank = data.frame(spark, [(1, None, None, None, None), (2, "", "", "", 0)])
    assert [r.probability for r in mixing.mix(blank).collect()] == [1.0, 1.0]
    assert mixing.sampled_documents(blank).count() == 2


def test_sample_meets_all_margins_though_cells_are_full(spark):
    """One document per cell; expected tokens of the sample against the goals, from dense tables."""
    rng = np.random.default_rng(5)
    table, budget = rng.integers(200, 500, (3, 2, 4)), 0.7
    table[0, 0], table[2, 1, 3], table[1, 0, 0] = 4000, 20, 30
    kinds = {"legal": "License", "prose": "word", "tabular": "a | b", "technical": "http://x"}
    starts = {0: "legal", 1: "prose", 2: "tabular", 3: "technical"}
    rows = []
    for (i, j, k), n in np.ndenumerate(table):
        start = kinds[starts[k]]
        rows.append((len(rows), start + " w" * (int(n) - len(start.split())), f"l{j}", f"s{i}", 1))
    found = mixing.mix(data.frame(spark, rows), budget=budget).cache()
    assert found.where("probability = 1").count() > 0
    names = {"source": [f"s{i}" for i in range(3)], "lang": [f"l{j}" for j in range(2)], "topic": list(kinds)}
    full = 0
    for axis, m in enumerate(mixing.MARGINS):
        held = table.sum(axis=tuple(a for a in range(3) if a != axis)).astype(float)
        share, whole = held ** mixing.TEMPER, np.zeros(len(held), bool)
        while True:  # a category that has less than its goal is whole, the others share the rest
            goal = np.where(whole, held, (budget * table.sum() - held[whole].sum()) * share / share[~whole].sum())
            if (goal <= held).all():
                break
            whole |= goal > held
        full += whole.sum()
        sums = {r[0]: r.s for r in found.groupBy(m).agg(F.sum(F.col("n_tokens") * F.col("probability")).alias("s")).collect()}
        assert [sums[n] for n in names[m]] == pytest.approx(list(goal), abs=1e-5 * table.sum())
    assert full == 3
