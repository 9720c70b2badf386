"""Toxicity of whole texts: a subsequence-kernel support vector machine over sentence windows.

Training runs in one task on a bounded sample of labelled documents (``MAX_POSITIVE``,
``MAX_NEGATIVE``, texts up to ``MAX_CHARS``), cut into sentences that carry the
label of their document. Only some sentences of a toxic document are toxic, so
the machine is trained in rounds: each sentence is represented by the window
that the last round scored highest, and the best few sentences of a document
enter the next. The kernel is approximated on landmark windows. A logistic
model on the sentence scores of documents that were held back from the
machine turns them into a probability.

Scoring reads every character of every text, in Arrow batches; the model is a
table of under a megabyte whatever the size of the corpus.

Defined cases: NULL text counts as empty; an empty text scores like a text
whose windows are all as clean as can be; documents without id or label do not
train; of several labels of an id toxic wins, of several texts the greatest
trains, and each row is scored for itself; without labelled documents of both
classes the score of every text is the share of toxic ones (0.5 without any);
very long texts are scored whole, in blocks, but do not train (``MAX_CHARS``);
columns of ``df`` lie in a struct, so that their names cannot clash; an empty
table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrid.llm import string_kernel as sk
from sparkgrid.llm.common import packed, released, ship, text_or_empty
from sparkgrid.session import join_small

MAX_POSITIVE = 2_500
MAX_NEGATIVE = 6_000
MAX_CHARS = 20_000
ROUNDS = 3
LANDMARKS = 320
PENALTY = 20.0
TOP_SENTENCES = 3
HELD_BACK = 4             # every so many-th document trains the logistic model only
THRESHOLD = 0.3
BLOCK_CHARS = 1 << 18


@dataclass
class ToxicityModel:
    codes: np.ndarray
    numbers: np.ndarray          # of the features that have a weight
    weights: np.ndarray
    constant: float
    logistic: np.ndarray | None
    share: float

    @cached_property
    def table(self) -> np.ndarray:
        """The weights of all features, for lookups; made where texts are scored."""
        out = np.zeros(sk.SIZE ** sk.ORDER, np.float32)
        out[self.numbers] = self.weights
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability that a text is toxic, for each text."""
        if self.logistic is None:
            return np.full(len(texts), self.share)
        out, block, chars = [], [], 0
        for t in texts:
            block.append(t)
            chars += len(t)
            if chars >= BLOCK_CHARS:
                out.append(self._score(block))
                block, chars = [], 0
        if block:
            out.append(self._score(block))
        return np.concatenate(out) if out else np.zeros(0)

    def _score(self, texts: list[str]) -> np.ndarray:
        x = document_features(texts, self.codes, self.table, self.constant)
        z = x @ self.logistic[:-1] + self.logistic[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def document_features(texts: list[str], codes: np.ndarray, table: np.ndarray, constant: float) -> np.ndarray:
    """Three best sentence scores, how many are positive, and how many sentences there are."""
    code, starts, owner = sk.encode(texts, codes)
    best = sk.sentence_best(sk.window_scores(code, table), starts) + constant
    order = np.lexsort((-best, owner))
    best, owner = best[order], owner[order]
    first = np.searchsorted(owner, np.arange(len(texts)))
    count = np.bincount(owner, minlength=len(texts))
    out = np.empty((len(texts), 5))
    for k in range(3):
        out[:, k] = np.clip(best[first + np.minimum(k, count - 1)], -4, 4)
    out[:, 3] = np.log1p(np.bincount(owner, weights=best > 0, minlength=len(texts)))
    out[:, 4] = np.log1p(count)
    return out


def training_sample(docs: DataFrame, labels: DataFrame, text: str = "text", id_column: str = "doc_id",
                    label: str = "toxic") -> DataFrame:
    """(id, text, toxic) of a bounded sample, the same for the same rows in whatever order.

    Of several labels of an id toxic wins; of several texts the greatest is taken.
    """
    known = labels.select(F.col(id_column).alias("id"), F.col(label).cast("int").alias("toxic")).where(
        "id is not null and toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    bodies = docs.select(F.col(f"`{id_column}`").alias("id"), text_or_empty(text).alias("text")).where(
        F.char_length("text") <= MAX_CHARS)
    parts = []
    for value, most in ((1, MAX_POSITIVE), (0, MAX_NEGATIVE)):
        chosen = known.where(F.col("toxic") == value).orderBy(F.xxhash64("id"), "id").limit(most)
        parts.append(chosen)
    return join_small(bodies, parts[0].union(parts[1]), ["id"]).groupBy("id", "toxic").agg(F.max("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id_column: str = "doc_id",
        label: str = "toxic") -> ToxicityModel:
    """Train in one task on the bounded sample; the driver only sees the weights."""
    ship(docs.sparkSession)
    found = labels.agg(F.avg(F.col(label).cast("double"))).first()[0]
    share = 0.5 if found is None else float(found)

    def train(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, toxic = [], []
        for batch in batches:
            texts += batch["text"].tolist()
            toxic += batch["toxic"].tolist()
        model = pickle.dumps(fit_sample(texts, np.array(toxic, dtype=np.int64), share))
        texts.clear()
        yield pd.DataFrame({"model": [model]})
        released()

    sample = training_sample(docs, labels, text, id_column, label)
    ordered = sample.repartition(1).sortWithinPartitions("id").select("text", "toxic")
    row = ordered.mapInPandas(train, "model binary").first()
    return pickle.loads(row.model) if row else fit_sample([], np.zeros(0, np.int64), share)


def fit_sample(texts: list[str], toxic: np.ndarray, share: float, seed: int = 7) -> ToxicityModel:
    """``share``: toxic documents among all labelled ones; the sample may hold more of them."""
    held = np.arange(len(texts)) % HELD_BACK == 0
    if min(np.bincount(toxic[held], minlength=2).min(), np.bincount(toxic[~held], minlength=2).min()) < 2:
        return ToxicityModel(np.zeros(1, np.uint8), np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0, None, share)
    letters: Counter[str] = Counter()
    for text in texts:
        letters.update(text.lower())
    ranked = sorted((c for c in letters if c.isalpha()), key=lambda c: (-letters[c], c))
    codes = sk.letter_codes("".join(ranked))

    rng = np.random.default_rng(seed)
    trained = [(t, 1 if y else -1) for t, y, h in zip(texts, toxic, held) if not h]
    table, constant = _contrast(trained, codes), 0.0
    for _ in range(ROUNDS):
        windows, sign = _witnesses(trained, codes, table)
        marks = np.concatenate([
            rng.permutation(np.flatnonzero(sign > 0))[:LANDMARKS * 2 // 3],
            rng.permutation(np.flatnonzero(sign < 0))[:LANDMARKS // 3]])
        landmarks = sk.Landmarks(windows[marks])
        weight = np.where(sign > 0, 0.5 / max((sign > 0).sum(), 1), 0.5 / max((sign < 0).sum(), 1)) * len(sign)
        coefficients, constant = sk.support_vector_machine(landmarks.project(windows), sign, weight, PENALTY)
        table = landmarks.table(coefficients)
        del landmarks

    x = document_features([t for t, h in zip(texts, held) if h], codes, table, constant)
    target = toxic[held] == 1
    found = target.mean()
    weight = np.where(target, share / found, (1 - share) / (1 - found))
    numbers = np.flatnonzero(table).astype(np.int32)
    return ToxicityModel(codes, numbers, table[numbers], float(constant),
                         sk.logistic_regression(x, target.astype(float), weight), share)


def _groups(trained: list[tuple[str, int]]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Texts and signs, some million characters at a time."""
    texts, signs, chars = [], [], 0
    for text, sign in trained:
        texts.append(text)
        signs.append(sign)
        chars += len(text)
        if chars >= BLOCK_CHARS:
            yield texts, np.array(signs)
            texts, signs, chars = [], [], 0
    if texts:
        yield texts, np.array(signs)


def _contrast(trained: list[tuple[str, int]], codes: np.ndarray) -> np.ndarray:
    """First weights: smoothed log ratio of the shares of toxic and clean texts that hold the letters in a row."""
    size = sk.SIZE ** sk.ORDER
    share = np.mean([sign > 0 for _, sign in trained])
    toxic = np.full(size, 3 * share, np.float32)
    clean = np.full(size, 3 * (1 - share), np.float32)
    for texts, signs in _groups(trained):
        code, starts, owner = sk.encode(texts, codes)
        runs = np.lib.stride_tricks.sliding_window_view(code, sk.ORDER)
        number = np.zeros(len(runs), np.int64)
        for k in range(sk.ORDER):
            number = number * sk.SIZE + runs[:, k]
        doc = owner[np.searchsorted(starts, np.arange(len(runs)), side="right") - 1]
        whole = (runs != sk.BREAK).all(axis=1)
        pairs = np.unique(doc[whole].astype(np.int64) * size + number[whole])
        positive = signs[pairs // size] > 0
        np.add.at(toxic, pairs[positive] % size, np.float32(1))
        np.add.at(clean, pairs[~positive] % size, np.float32(1))
    toxic /= clean
    return np.log(toxic, out=toxic) - np.float32(np.log(share / (1 - share)))


def _witnesses(trained: list[tuple[str, int]], codes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best windows of the best sentences of each text, and the sign of the text."""
    windows, sign = [], []
    for texts, signs in _groups(trained):
        code, starts, owner = sk.encode(texts, codes)
        scores = sk.window_scores(code, table)
        best = sk.sentence_best(scores, starts)
        order = np.lexsort((-best, owner))
        rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        chosen = np.sort(order[rank < TOP_SENTENCES])
        ends = np.append(starts[1:], len(code))
        places = np.array([starts[i] + int(np.argmax(scores[starts[i]:max(ends[i], starts[i] + 1)])) for i in chosen])
        windows.append(sk.windows_at(code, np.minimum(places, len(code) - 1)))
        sign.append(signs[owner[chosen]])
    return np.concatenate(windows), np.concatenate(sign)


def score(df: DataFrame, model: ToxicityModel, text: str = "text") -> Column:
    """Probability that the text is toxic, as a column for ``df``."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.scores(texts.tolist()))
        released()

    return toxicity(text_or_empty(text))


def held_out(id_column: str = "doc_id") -> Column:
    """Documents whose labels are set aside for testing."""
    key = F.encode(F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("")), "UTF-8")
    return F.crc32(key) % 4 == 2


def score_documents(df: DataFrame, labels: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(row, held_out, score, predicted): ``row`` holds the columns of ``df``."""
    model = fit(df, labels.where(~held_out(id_column)), text, id_column)
    scored = df.select(packed(df), held_out(id_column).alias("held_out"), score(df, model, text).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def clean_documents(df: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are not predicted toxic, with the columns of ``df`` only."""
    return score_documents(df, labels).where("predicted = 0").select("row.*")
