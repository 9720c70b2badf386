"""Token counts of whole texts without moving any pre-token.

Each task cuts its texts into runs of pre-tokens and looks their lengths up in
two tiers: a broadcast table of frequent runs, and a cache of its worker that
is filled by the tokenizer itself and emptied when it holds ``HELD_BYTES``. Runs
over ``LONGEST`` characters are encoded each time and kept nowhere. The frequent
table comes from a bounded sample (``SAMPLE_DOCS`` documents of up to
``SAMPLE_CHARS`` characters, ``FREQUENT`` entries); it saves time only, a missing
entry is encoded like any other.

Defined cases: NULL text counts as empty and has no tokens; texts that hold an
added token of the vocabulary go through the tokenizer as a whole; very long
texts are counted whole, also without any break; repeated rows are counted
each; columns of ``df`` lie in a struct, so that their names cannot clash; an
empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrid.llm.common import packed, sample_texts, ship, text_or_empty
from sparkgrid.llm.pieces import added_tokens, cut, load_tokenizer

LIMIT = 512
FREQUENT = 50_000
SAMPLE_DOCS = 2_000
SAMPLE_CHARS = 20_000
HELD_BYTES = 96 << 20    # of runs that a worker keeps, with ENTRY_BYTES for each besides its characters
ENTRY_BYTES = 160
LONGEST = 64
MISSES = 4_096


class PieceLengths:
    """Tokens of runs of pre-tokens; lives in a worker."""

    def __init__(self, path: str, frequent: dict[str, int], limit: int = HELD_BYTES):
        self.tokenizer, self.added = load_tokenizer(path), added_tokens(path)
        self.frequent, self.cache, self.limit, self.held = frequent, {}, limit, 0

    def encode(self, pieces: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def learn(self, pieces: list[str]) -> dict[str, int]:
        """Lengths of runs with a space before them; the short ones stay known."""
        if self.held > self.limit:
            self.cache, self.held = {}, 0
        found = {}
        for start in range(0, len(pieces), MISSES):
            part = pieces[start:start + MISSES]
            found.update(zip(part, self.encode([" " + p for p in part])))
        kept = {p: n for p, n in found.items() if len(p) <= LONGEST}
        self.cache.update(kept)
        self.held += sum(map(len, kept)) + ENTRY_BYTES * len(kept)
        return found

    def count(self, text: str) -> int:
        if any(token in text for token in self.added):
            return self.encode([text])[0]
        first, *rest = cut(text)
        total = self.encode([first])[0] if first else 0
        frequent, cache = self.frequent, self.cache
        lengths = [frequent.get(p) or cache.get(p, 0) for p in rest]
        if 0 in lengths:
            missing = [p for p, n in zip(rest, lengths) if not n]
            found = self.learn(list(dict.fromkeys(missing)))
            total += sum(found[p] for p in missing)
        return total + sum(lengths)


_loaded: dict[tuple, PieceLengths] = {}


def frequent_pieces(df: DataFrame, path: str, text: str = "text", id_column: str = "doc_id") -> dict[str, int]:
    """Lengths of the most frequent runs of a bounded sample of documents."""
    texts = sample_texts(df, SAMPLE_DOCS, SAMPLE_CHARS, text, id_column)
    counts = Counter(p for body in texts for p in cut(body)[1:])
    common = [p for p, _ in counts.most_common(FREQUENT)]
    return {p: n for p, n in PieceLengths(path, {}).learn(common).items() if len(p) <= LONGEST}


def token_count(df: DataFrame, path: str, text: str = "text", id_column: str = "doc_id") -> Column:
    """Number of tokens of a text, as a column for ``df``."""
    spark = df.sparkSession
    ship(spark)
    frequent = spark.sparkContext.broadcast(frequent_pieces(df, path, text, id_column))
    key = (path, uuid.uuid4().hex)  # a worker may serve several tables

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        if key not in _loaded:
            _loaded.clear()
            _loaded[key] = PieceLengths(path, frequent.value)
        return pd.Series([_loaded[key].count(t) for t in texts], dtype="int64")

    return count(text_or_empty(text))


def count_tokens(df: DataFrame, path: str, limit: int = LIMIT, text: str = "text",
                 id_column: str = "doc_id") -> DataFrame:
    """(row, n_bytes, n_tokens, over_limit): ``row`` holds the columns of ``df``."""
    counted = df.select(packed(df), F.octet_length(text_or_empty(text)).cast("long").alias("n_bytes"),
                        token_count(df, path, text, id_column).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
