"""The subsequence kernel against an enumeration of all subsequences, and awkward rows of sharding and pipeline."""

from collections import Counter
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkgrid.llm import sharding, string_kernel as sk
from tests.llm import data


def subsequences(window):
    """Weight of each sequence of four letters: places in order, from the first ``WINDOW`` on, spanning at most ``SPAN``."""
    found = Counter()
    letters = [int(c) for c in window]
    for first in range(sk.WINDOW):
        for rest in combinations(range(first + 1, len(letters)), sk.ORDER - 1):
            places = (first, *rest)
            if places[-1] - first < sk.SPAN and all(letters[p] != sk.BREAK for p in places):
                found[tuple(letters[p] for p in places)] += sk.DECAY ** (places[-1] - first - sk.ORDER + 1)
    return found


def test_kernel_equals_enumeration():
    rng = np.random.default_rng(4)
    windows = rng.integers(0, 5, (25, sk.WINDOW + sk.SPAN - 1)).astype(np.uint8)
    windows[3, 9:] = sk.BREAK
    plain = [subsequences(w) for w in windows]
    marks = sk.Landmarks(windows[:12])
    expected = np.array([[sum(v * b[u] for u, v in a.items()) for b in plain[:12]] for a in plain])
    np.testing.assert_allclose(marks.kernel(windows), expected, rtol=1e-4, atol=1e-4)
    # Among landmarks the projection keeps the kernel.
    near = marks.project(windows[:12]).astype(float)
    np.testing.assert_allclose(near @ near.T, expected[:12], rtol=1e-2, atol=0.05 * expected[:12].max() ** 0.5)


def test_inserted_characters_keep_most_of_the_kernel():
    codes = sk.letter_codes("abcdefghijklmnopqrstuvwxyz")

    def window(text):
        code, starts, _ = sk.encode([text], codes)
        return sk.windows_at(code, np.array([0]))[0]

    def alike(a, b):
        x, y = subsequences(window(a)), subsequences(window(b))
        cross = sum(v * y[u] for u, v in x.items())
        return cross / (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5

    assert alike("worthless fool", "w.o.r.t.h.l.e.s.s fool") == pytest.approx(1.0)   # signs are left out
    assert alike("worthless fool", "worxthless fool") > 0.4 > 0.1 > alike("worthless fool", "pleasant evening")


def test_shards_of_rows_with_clashing_columns(spark):
    rows = data.rows()
    df = data.frame(spark, rows).withColumns({c: F.lit("own") for c in (
        "size", "shard", "slot", "law", "part", "total", "before", "position", "rows_before", "text_crc32", "grown_shard")})
    plain = sharding.assign_shards(data.frame(spark, rows)).collect()
    found = sharding.assign_shards(df).select("doc_id", "size", "text_crc32", "shard", "slot").collect()
    assert len(found) == len(rows) and {r.shard for r in found} <= set(range(40))
    assert sorted((r.size, r.text_crc32) for r in found) == sorted((r["size"], r.text_crc32) for r in plain)
    for shard in {r.shard for r in found}:
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_pipeline_handles_awkward_rows(spark, tmp_path):
    """NULLs, empty and very long texts, repeated rows and ids, and columns with the names of helpers."""
    rows = data.rows(n=20)
    docs = data.with_clashes(data.frame(spark, rows))
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 9 == 0, 1).otherwise(0).alias("toxic")).distinct()
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    columns, kept = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        kept = spark.read.parquet(f"{tmp_path}/{k}")
        assert kept.count() <= len(rows), name
    assert 0 < kept.count() and set(kept.columns) >= {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_pipeline_of_no_rows(spark, tmp_path):
    docs = data.frame(spark, data.rows(n=3)).limit(0)
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert docs.count() == 0


def test_a_stage_drops_what_the_one_before_staged(spark, tmp_path):
    docs = data.frame(spark, data.rows(n=5))
    docs.select("doc_id", F.lit(0).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    folders = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[1:4]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        folders += [Path(f.removeprefix("file:")) for f in corpus_pipeline._staged]
        assert [f.exists() for f in folders] == [False] * k + [True]
