from collections import defaultdict
from hashlib import sha256

import pytest

from sparkgrid.llm import exact_dedup, near_dedup
from sparkgrid.llm.components import connected_components
from tests.llm import data


def rank(doc_id):
    return (doc_id is not None, doc_id or 0)


def test_exact_groups(spark):
    rows = data.rows()
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[data.ascii_lower(text)].append(doc_id)
    found = exact_dedup.exact_dedup(data.frame(spark, rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        members = groups[data.ascii_lower(r.text)]
        assert r.keep_id == max(members, key=rank)
        assert r.group_size == len(members)
        assert r.text_sha256 == sha256(data.ascii_lower(r.text).encode()).hexdigest()
    assert sum(r.kept for r in found) == len(groups)
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_exact_long_texts_that_differ_late(spark):
    rows = [(k, "a" * n + end, None, None, None) for k, (n, end) in enumerate(
        (n, end) for n in (31, 32, 33, 40_000) for end in ("x", "y", "X", "x"))]
    found = exact_dedup.exact_dedup(data.frame(spark, rows)).collect()
    assert sorted(r.group_size for r in found) == [1] * 4 + [3] * 12


@pytest.mark.parametrize("module", [exact_dedup, near_dedup])
def test_kept_documents_keep_their_columns(spark, module):
    df = data.with_clashes(data.frame(spark, data.rows()))
    kept = module.kept_documents(df)
    assert kept.columns == df.columns
    assert kept.where("kept <> 'own kept' or uid <> 'own uid'").isEmpty()
    empty = module.kept_documents(df.where("doc_id < -1"))
    assert empty.columns == df.columns and empty.isEmpty()


def test_hot_group(spark):
    rows = [(k, "the same text of some length, over and over again" if k % 3 else f"text {k}", "en", "hot", 1)
            for k in range(600)]
    found = exact_dedup.exact_dedup(data.frame(spark, rows, 8)).where("kept").collect()
    assert len(found) == 201
    near = near_dedup.near_duplicates(data.frame(spark, rows, 8)).where("kept").collect()
    assert len(near) == 201


def shingle_set(text):
    words = data.ascii_lower(text).encode().split()
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[k:k + 5]) for k in range(len(words) - 4))


def brute_force(rows):
    """Component of each row, by comparing all pairs of sets."""
    sets = [shingle_set(r[1]) for r in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                label[find(i)] = find(j)
    return sets, [find(i) for i in range(len(rows))]


def test_near_groups_against_all_pairs(spark):
    rows = [r for r in data.rows(seed=3)]
    sets, label = brute_force(rows)
    members = defaultdict(list)
    for row, home in zip(rows, label):
        members[home].append(row[0])
    expected = defaultdict(list)
    for row, home, s in zip(rows, label, sets):
        ids = [m for m in members[home] if m is not None]
        expected[row[0]].append((len(s), min(ids) if ids else None))
    found = near_dedup.near_duplicates(data.frame(spark, rows)).collect()
    got = defaultdict(list)
    for r in found:
        got[r.id].append((r.n_shingles, r.component_id))
    key = lambda x: (x[0], x[1] is None, x[1] or 0)
    assert {k: sorted(v, key=key) for k, v in got.items()} == {k: sorted(v, key=key) for k, v in expected.items()}
    assert sum(r.kept for r in found) == len(members)


def test_chain_of_near_copies(spark):
    """Neighbours are similar, the ends are not: one component through the chain."""
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[8 * k:8 * k + 120]), None, None, None) for k in range(30)]
    _, label = brute_force(rows)
    assert len(set(label)) == 1
    found = near_dedup.near_duplicates(data.frame(spark, rows)).collect()
    assert {r.component_id for r in found} == {0}
    assert [r.id for r in found if r.kept] == [0]


def test_hash_sets_match_word_sets():
    for r in data.rows(seed=5):
        assert len(near_dedup.shingles(near_dedup.words_of(r[1] or ""))) == len(shingle_set(r[1]))


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 200), (200, 300), (500, 500), (7, 3)]
    found = {r.vertex: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(41)}, 100: 100, 200: 100, 300: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_empty_tables(spark):
    empty = data.frame(spark, [])
    assert exact_dedup.exact_dedup(empty).isEmpty()
    assert near_dedup.near_duplicates(empty).isEmpty()
