"""Words by hash, and token files read by block offsets."""

import random

import numpy as np
import public_tokenizers as public
import pytest

from sparkgrid.llm import simple8b, token_files, word_table
from sparkgrid.llm.word_table import WordTable
from tests.llm import data

WORDS = public.path("word_bpe_49k.json")
SIGNS = ["a", "B", "é", "É", "é", "ß", "ſ", "İ", "K", "1", "½", ".", ",", ". ", ", ", " ", "  ", "\n", "\t", "\x1c", "\xa0", "　",
         "'", "'s", "'t", "_", "-", ")", "(", "<|endoftext|>", "中", "🙂", "́", "×", "÷", "...", "word", "The", "x.", " .",
         " ,", "\r\n", "\x85", "​", "$$$", "!?", "don't", "naïve"]


def checked(table, texts):
    found, counts = table.encode(texts)
    expected = [table.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(e) for e in expected]
    assert found.tolist() == [i for e in expected for i in e]


@pytest.mark.parametrize("limit", [0, 2000, 1 << 24])
def test_any_mixture_of_signs(limit):
    rng, table = random.Random(limit), token_files.PieceIds(WORDS, limit)
    for _ in range(12):
        checked(table, ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 30))) for _ in range(150)])


def test_long_words_and_chunks(monkeypatch):
    """Words longer than what is kept, than a chunk, and texts of many chunks."""
    table = token_files.PieceIds(WORDS)
    checked(table, ["x" * 65, "y" * 64, "z" * 5000, " ".join(["many words here"] * 60_000), "k" * (word_table.CHUNK + 3), "", " "])
    assert table.table.bytes() < 1 << 20


def test_hashes_that_collide_are_told_apart(monkeypatch):
    """With a hash of a few bits most words share one; the check keeps them apart."""
    plain = word_table.hashes
    monkeypatch.setattr(word_table, "hashes", lambda *a: (plain(*a)[0] & np.uint64(7), plain(*a)[1]))
    table = WordTable(1 << 20)
    learn = lambda words: [[len(w), *w] for w in words]
    rng = random.Random(2)
    for _ in range(20):
        words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))).encode() for _ in range(200)]
        starts, lengths, ids = table.encode(b" ".join(words) + b" ", learn)
        assert ids.tolist() == [x for w in words for x in learn([w])[0]] and lengths.tolist() == [len(w) + 1 for w in words]
    assert len(table.check) <= 8


def test_words_of_one_letter_differ():
    letters = np.frombuffer(b"a aa aaa aaaa b bb ", np.uint8)
    key, check = word_table.hashes(letters, *word_table.spans(letters))
    assert len(set(key.tolist())) == len(set(check.tolist())) == 6


def test_known_words_keep_their_ids():
    table, calls = WordTable(1 << 20), []

    def learn(words):
        calls.extend(words)
        return [list(w) for w in words]

    rng = random.Random(5)
    vocabulary = [bytes(rng.choice(b"abcdefgh") for _ in range(rng.randint(1, 12))) for _ in range(300)]
    for _ in range(30):
        words = [rng.choice(vocabulary) for _ in range(500)]
        starts, lengths, ids = table.encode(b"  ".join(words) + b" ", learn)
        assert bytes(ids.tolist()) == b"".join(words)
    assert len(calls) == len(set(calls)) == len(set(vocabulary))


def test_documents_by_offsets(spark, tmp_path):
    rows = data.rows()
    path = str(tmp_path / "tokens")
    token_files.write_tokens(data.frame(spark, rows), WORDS, path, end=2, segment=5000)
    every = {}
    for r in token_files.read_tokens(spark, path).collect():
        every.setdefault(r.id, []).append(bytes(r.tokens))
    wanted = [None, 5, 996, 40, 123456, *[r[0] for r in rows if r[1] and len(r[1]) > 20_000]]
    found = {}
    for r in token_files.read_documents(spark, path, spark.createDataFrame([(w,) for w in wanted + wanted], "id long")).collect():
        assert r.n_tokens * 4 == len(r.tokens)
        found.setdefault(r.id, []).append(bytes(r.tokens))
    assert {k: sorted(v) for k, v in found.items()} == {w: sorted(every[w]) for w in set(wanted) if w in every}


def test_some_values_read_their_blocks_only():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 50_000, 10 * simple8b.BLOCK + 77).astype(np.uint64)
    words, offsets = simple8b.pack(values)
    for start, end in ((0, 0), (0, 1), (1023, 1025), (3000, 3100), (len(values) - 5, len(values)), (0, len(values))):
        assert (simple8b.some(words, offsets, start, end) == values[start:end]).all()
    spoilt = words.copy()
    spoilt[:offsets[2]] = 0
    spoilt[offsets[4]:] = 0
    assert (simple8b.some(spoilt, offsets, 2 * simple8b.BLOCK, 4 * simple8b.BLOCK) == values[2 * simple8b.BLOCK:4 * simple8b.BLOCK]).all()
