import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as public
import pytest
import regex
import tiktoken
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkgrid.llm import distinct_bpe, simple8b, token_counts, token_files
from sparkgrid.llm.pieces import Ragged, cut, read_ranks
from tests.llm import data

JSON, WORDS, RANKS = (public.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_50k.tiktoken"))
ODD = " \n\t\r\x0b  aB'st1²½٣é́　\x1c\x85Ⅷ中🙂.,-_$ſKİ"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


def texts_by_id(rows):
    return sorted(((r[0] is not None, r[0] or 0, r[1] or "") for r in rows))


def test_counts_match_the_library(spark, tokenizer):
    rows = data.rows()
    counted = token_counts.count_tokens(data.with_clashes(data.frame(spark, rows)), JSON, limit=100)
    found = sorted((r.row.doc_id is not None, r.row.doc_id or 0, r.row.text or "", r.n_bytes, r.n_tokens, r.over_limit)
                   for r in counted.collect())
    expected = [len(tokenizer.encode(t, add_special_tokens=False)) for *_, t in texts_by_id(rows)]
    assert [r[4] for r in found] == expected
    assert [r[3] for r in found] == [len(t.encode()) for *_, t in texts_by_id(rows)]
    assert [r[5] for r in found] == [n > 100 for n in expected]
    assert token_counts.count_tokens(data.frame(spark, []), JSON).isEmpty()


def test_cache_may_overflow(tokenizer):
    lengths = token_counts.PieceLengths(JSON, {"and": 1}, limit=20)
    texts = [" ".join(f"w{k * j} and" for k in range(30)) for j in range(5)]
    assert [lengths.count(t) for t in texts] == [len(tokenizer.encode(t)) for t in texts]
    assert len(lengths.cache) <= 40


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(text=st.text(alphabet=ODD, max_size=40))
def test_pieces_are_independent(encoding, text):
    first, *rest = cut(text)
    ids = encoding.encode_ordinary(first)
    for p in rest:
        ids += encoding.encode_ordinary(" " + p)
    assert ids == encoding.encode_ordinary(text)


def test_byte_bpe_round_trip(spark, encoding):
    rows = data.rows()
    df = data.with_clashes(data.frame(spark, rows))
    ids = distinct_bpe.encode_documents(df, RANKS, public.PATTERN)
    found = sorted((r.id is not None, r.id or 0, r.ids) for r in ids.collect())
    assert found == sorted((a, b, encoding.encode_ordinary(t)) for a, b, t in texts_by_id(rows))
    texts = sorted((r.id is not None, r.id or 0, r.text) for r in distinct_bpe.decode_texts(ids, RANKS).collect())
    assert texts == texts_by_id(rows)
    digests = distinct_bpe.round_trip(ids, RANKS).where("id is not null").collect()
    known = {(i, hashlib.sha256(t.encode()).hexdigest()): encoding.encode_ordinary(t)
             for a, i, t in texts_by_id(rows) if a}
    for r in digests:
        expected = known[r.id, r.decoded_sha256]
        assert r.n_tokens == len(expected)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, expected)).encode()).hexdigest()
    assert distinct_bpe.encode_documents(data.frame(spark, []), RANKS, public.PATTERN).isEmpty()


def test_many_blocks(spark, encoding):
    """A block per document or two: runs meet in buckets across blocks."""
    rows = [(k, data.sentence(random.Random(k), 40), None, None, None) for k in range(50)]
    block = distinct_bpe.Block(regex.compile(public.PATTERN))
    for k, t, *_ in rows[:3]:
        block.add(k, t)
    head, *parts = list(block.rows(5, 8))
    assert head[1:3] == (5, -1) and head[4] == [0, 1, 2]
    counts = [len(regex.findall(public.PATTERN, t)) for _, t, *_ in rows[:3]]
    assert distinct_bpe.unsqueeze(head[5]).tolist() == counts
    assert len(distinct_bpe.unsqueeze(head[6])) == sum(counts)
    assert len({p[2] for p in parts}) == len(parts) <= 8
    wide = spark.createDataFrame(rows, data.SCHEMA).repartition(25)
    found = {r.id: r.ids for r in distinct_bpe.encode_documents(wide, RANKS, public.PATTERN).collect()}
    assert found == {k: encoding.encode_ordinary(t) for k, t, *_ in rows}


def test_token_files(spark, tmp_path):
    rows = data.rows()
    path = str(tmp_path / "tokens")
    token_files.write_tokens(data.with_clashes(data.frame(spark, rows)), WORDS, path, end=2, segment=500)
    found = sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r.start)
    words = Tokenizer.from_file(WORDS)
    key = lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()))
    before = 0
    for r, (doc_id, text, *_) in zip(found, sorted(rows, key=key), strict=True):
        ids = words.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r.id, r.start, r.n_tokens) == (doc_id, before, len(ids))
        assert np.frombuffer(r.tokens, "<u4").tolist() == ids
        before += len(ids)
    files = spark.read.parquet(path)
    assert files.agg(F.max("segment")).first()[0] > 0
    assert files.agg(F.sum(F.octet_length("words"))).first()[0] < 4 * before


def test_token_files_of_nothing(spark):
    assert token_files.token_file_digests(data.frame(spark, []), WORDS).isEmpty()


def test_pieces_of_any_text_match_the_word_tokenizer():
    words = token_files.PieceIds(WORDS, limit=50)
    texts = [r[1] or "" for r in data.rows(seed=9, n=20)][:60]
    values, counts = words.encode(texts)
    expected = [words.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(e) for e in expected]
    assert values.tolist() == [i for e in expected for i in e]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 3), st.integers(0, 50_000), st.integers(0, (1 << 64) - 1)),
                max_size=3000), st.integers(0, 300))
def test_simple8b_round_trip(values, zeros):
    given_values = np.array(values + [0] * zeros + values[:7], np.uint64)
    words, offsets = simple8b.pack(given_values)
    assert (simple8b.unpack(words) == given_values).all()
    for k, at in enumerate(offsets):
        end = offsets[k + 1] if k + 1 < len(offsets) else len(words)
        block = simple8b.unpack(words[at:end])
        assert (block == given_values[k * simple8b.BLOCK:(k + 1) * simple8b.BLOCK]).all()


def test_simple8b_is_dense():
    assert len(simple8b.pack(np.zeros(2400, np.uint64))[0]) <= 2400 // 240 + 8
    assert len(simple8b.pack(np.full(1024, 1 << 14, np.uint64))[0]) == 256


def test_ragged():
    ragged = Ragged()
    for k in range(2000):
        ragged.append(range(k % 7))
    values, lengths = ragged.gather(np.array([6, 0, 3, 13]))
    assert values.tolist() == [0, 1, 2, 3, 4, 5, 0, 1, 2, 0, 1, 2, 3, 4, 5] and lengths.tolist() == [6, 0, 3, 6]
