"""Spelling variants against plain Python: all words, and near words by all single edits."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparkgrid.llm import spelling
from sparkgrid.llm.queries import QUERIES
from tests.llm import data


def plain_counts(rows, misspell=True):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = data.ascii_lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if misspell and h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def plain_near(words):
    """Near words by a table of words with one place left out."""
    holes, near = defaultdict(set), {w: set() for w in words}
    for w in words:
        for i in range(len(w) if len(w) < 1000 else 0):  # longer ones have no near word in these tests
            holes[w[:i] + "\0" + w[i + 1:]].add(w)
            shorter = w[:i] + w[i + 1:]
            if shorter in near:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    return near


def plain_variants(words):
    near, form = plain_near(words), {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {(w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_plain_python(spark, folder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    found = QUERIES["op13_spelling_variants"](spark, folder).select(*COLUMNS).collect()
    assert len(found) == len(set(found))
    assert set(map(tuple, found)) == plain_variants(plain_counts(rows))


def crowded(rng):
    """Words of few letters, so that lists are long and edits meet at every place; counts of all sizes, chains of forms."""
    words = {}
    while len(words) < 1500:
        w = "".join(rng.choice("ab") for _ in range(rng.randint(7, 10)))
        words[w] = rng.choice([2, 2, 3, 20, 21, 300, 5000])
    stem = "consider"
    for i in range(9):
        for c in "abcdefghijklmnopqrstuvwxyzàÿ":
            words[stem[:i] + c + stem[i + 1:]] = words[stem[:i] + c + stem[i:]] = rng.choice([2, 30])
    return words | {"considered": 10**6, "considere": 10**4, "considred": 7, "ééééééé": 2}


@pytest.mark.parametrize("most", [1, 4, 32])
def test_long_lists_lose_no_pair(spark, monkeypatch, most):
    monkeypatch.setattr(spelling, "LIST", most)
    words = crowded(random.Random(3))
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    found = spelling.spelling_variants(df).select(*COLUMNS).collect()
    assert len(found) == len(words) and set(map(tuple, found)) == plain_variants(words)


def test_awkward_documents(spark, monkeypatch):
    rows = data.rows()
    rows += [(k, f"Overture overture OVERTURE overturé x{k}", None, None, 0) for k in range(300)]
    rows += [(2000, "unbroken" * 200_000, None, None, 0), (2001, "unbroken" * 200_000, None, None, 0)]
    df = data.with_clashes(data.frame(spark, rows)).withColumns({c: F.lit("own") for c in ("word", "n", "long", "chunk")})
    expected = plain_counts([(r[0], r[1]) for r in rows])
    for held in (spelling.HELD_CHARS, 1000):
        monkeypatch.setattr(spelling, "HELD_CHARS", held)
        found = spelling.word_counts(df, misspell=True).collect()
        assert {r.word: r.n for r in found} == expected and len(found) == len(expected)
    variants = spelling.spelling_variants(spelling.word_counts(df, misspell=True)).select(*COLUMNS).collect()
    assert set(map(tuple, variants)) == plain_variants(expected)


def test_empty_table(spark):
    df = data.frame(spark, [(1, None, None, None, None), (2, "", None, None, None)])
    assert spelling.spelling_variants(spelling.word_counts(df)).count() == 0
    assert spelling.spelling_variants(spelling.word_counts(df.limit(0))).count() == 0
