"""The pipeline, stage by stage, against plain Python."""

import hashlib
import re

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from sparkgrid.llm import mixing, toxicity
from sparkgrid.llm.pieces import read_ranks
from tests.llm import data
from tests.llm.test_dedup import shingle_set
from tests.llm.test_shards_and_mixing import raked

FOLDER = "/root/testdata/sf0.001"


def plain_topic(text):
    if not text.strip(" "):
        return "empty"
    if any(s in text for s in ("License", "Copyright", "licensed under", "All rights reserved")):
        return "legal"
    if " | " in text:
        return "tabular"
    return "technical" if any(s in text for s in (' = "', "http://", "https://", "@")) else "prose"


def plain_probabilities(docs):
    """Probability of each document, from dense tables."""
    values = [(d.source or mixing.NONE, d.lang or mixing.NONE, plain_topic(d.text or "")) for d in docs]
    words = [len([w for w in re.split(r"[\x20\x09-\x0D]+", d.text or "") if w]) for d in docs]
    axes = [sorted({v[k] for v in values}) for k in range(3)]
    table = np.zeros([len(a) for a in axes])
    for v, n in zip(values, words):
        table[tuple(a.index(x) for a, x in zip(axes, v))] += n
    goals = []
    for k in range(3):
        found = table.sum(axis=tuple(j for j in range(3) if j != k))
        share = np.where(found > 0, found ** mixing.TEMPER, 0)
        goals.append(share / share.sum() * table.sum())
    ratio = np.divide(raked(table, goals, mixing.SWEEPS), table, out=np.zeros_like(table), where=table > 0)

    def factor(weights, held, goal):
        """What scales ``weights`` so that cells of ``held`` tokens, each kept at most whole, hold ``goal`` tokens."""
        low, high = 0.0, 1e12
        for _ in range(300):
            middle = (low + high) / 2
            kept = np.minimum(held, weights * middle).sum()
            low, high = (middle, high) if kept < goal else (low, middle)
        return high

    # Goals of the sample: a category that holds less than its share of the budget is kept whole.
    ratio, whole = ratio * mixing.BUDGET, table.sum()
    wanted = []
    for k in range(3):
        found = table.sum(axis=tuple(j for j in range(3) if j != k))
        scale = factor(goals[k], found, mixing.BUDGET * whole * (1 - 1e-13))
        wanted.append(np.minimum(found, goals[k] * scale))
    for _ in range(mixing.SWEEPS):
        for k in range(3):
            for c, goal in enumerate(wanted[k]):
                at = tuple(c if j == k else slice(None) for j in range(3))
                if (ratio[at] * table[at]).sum() > 0:
                    ratio[at] *= factor(ratio[at] * table[at], table[at], goal * (1 - 1e-13))
    p = np.where(table > 0, np.minimum(1, ratio), 1.0)
    return [p[tuple(a.index(x) for a, x in zip(axes, v))] for v in values]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents that go in, and what each stage leaves."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], FOLDER).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return [df.collect() for df in out], out


def test_stages_return_documents(stages):
    _, frames = stages
    for df in frames[1:-1]:
        assert df.schema.simpleString() == frames[0].schema.simpleString()


def test_toxic_documents_go(spark, stages):
    rows, frames = stages
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = toxicity.fit(frames[0], labels.where(~toxicity.held_out()))
    scores = model.scores([r.text or "" for r in rows[0]])
    assert {r.doc_id for r in rows[1]} == {r.doc_id for r, s in zip(rows[0], scores) if s < toxicity.THRESHOLD}


def test_exact_copies_go(stages):
    rows, _ = stages
    last = {}
    for r in rows[1]:
        key = data.ascii_lower(r.text)
        last[key] = max(last.get(key, -1), r.doc_id)
    assert {r.doc_id for r in rows[2]} == set(last.values())


def test_near_copies_go(stages):
    rows, _ = stages
    ordered = sorted(rows[2], key=lambda r: r.doc_id)
    sets = [shingle_set(r.text) for r in ordered]
    home = list(range(len(sets)))

    def find(i):
        while home[i] != i:
            i = home[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                home[y] = x
    assert {r.doc_id for r in rows[3]} == {r.doc_id for i, r in enumerate(ordered) if find(i) == i}


def test_sample_follows_the_probabilities(stages):
    rows, frames = stages
    draw = F.pmod(F.xxhash64(F.lit(mixing.SEED), "doc_id", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))),
                  F.lit(1 << 40)) / (1 << 40)
    draws = {r.doc_id: r.draw for r in frames[3].select("doc_id", draw.alias("draw")).collect()}
    p = {r.doc_id: q for r, q in zip(rows[3], plain_probabilities(rows[3]))}
    sampled = {r.doc_id for r in rows[4]}
    for doc_id, q in p.items():
        if abs(draws[doc_id] - q) > 1e-3:  # the fit stops at a tolerance
            assert (doc_id in sampled) == (draws[doc_id] < q)
    assert sampled <= set(p)


def test_ids_are_those_of_the_library(stages):
    rows, _ = stages
    encoding = tiktoken.Encoding("own", pat_str=public.PATTERN, special_tokens={},
                                 mergeable_ranks=read_ranks(public.path("byte_bpe_50k.tiktoken")))
    expected = set()
    for r in rows[4]:
        ids = encoding.encode_ordinary(r.text or "")
        expected.add((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                      hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows[5]} == expected


def test_run_is_the_stages_in_order(spark, stages):
    rows, _ = stages
    found = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, rows[5]))
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "exact dedup", "near dedup", "mixing", "byte-level BPE"]
