"""Quality rules: distance of a document's make-up from that of its language.

A first pass sums, over all documents that pass the base rules, histograms of
character classes and of common words per language; each task hands on one
row per language and bin. The second pass measures the Jensen-Shannon distance
(root of the divergence in bits, 0 to 1) between a document's histograms and
its language's. Documents that are too short for a histogram are not judged
by it.

Defined cases: NULL text has no words; NULL and unlisted languages share one
reference; without any reference nothing is judged but the base rules;
repeated rows get the same verdict; very long texts are read whole, and count
in the references by all their words; columns of ``df`` lie in a struct, so that
their names cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgrid.llm.common import packed, ship, text_or_empty

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
REPEAT_PERCENT = 50

# The most common words of each language with a reference.
COMMON_WORDS = {
    "en": "the of and to in is that it was for on are with as he be by at this from".split(),
    "fr": "de la le et les des en un une du que est pour dans qui par sur pas au plus".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo".split(),
}
VOCABULARY = sorted({w for words in COMMON_WORDS.values() for w in words})
CLASSES = ["lower", "upper", "digit", "space", "line", "stop", "symbol", "other"]
OTHER_LANGUAGE = "other"

MIN_CHARS_JUDGED = 300
MIN_WORDS_JUDGED = 100
MAX_CLASS_DISTANCE = 0.26
MAX_WORD_DISTANCE = 0.30


def _class_table() -> np.ndarray:
    table = np.full(0x3000, CLASSES.index("other"), np.uint8)
    for point in range(0x3000):
        c = chr(point)
        name = ("lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else
                "line" if c == "\n" else "space" if c.isspace() else "stop" if c in ".,;:!?'\"()-" else
                "symbol" if c in "#*$%&|<>=+_/\\@^~`{}[]" else "lower" if c.isalpha() else None)
        if name:
            table[point] = CLASSES.index(name)
    return table


@dataclass
class Profile:
    """What the rules need of one text."""
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    classes: np.ndarray
    words: np.ndarray

    @property
    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > REPEAT_PERCENT * self.n_words


class Profiler:
    def __init__(self):
        self.table = _class_table()
        self.vocabulary = [w.encode() for w in VOCABULARY]

    def profile(self, text: str) -> Profile:
        words = text.encode("utf-8").split()
        number: dict[bytes, int] = {}
        codes = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        lines = [x for x in text.split("\n") if x.strip(WHITE)]
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        classes = np.bincount(self.table[np.minimum(points, len(self.table) - 1)], minlength=len(CLASSES))
        counts = np.bincount(codes, minlength=len(number)) if len(words) else np.zeros(0, np.int64)
        common = np.zeros(len(self.vocabulary) + 1, np.int64)
        for k, w in enumerate(self.vocabulary):
            at = number.get(w)
            if at is not None:
                common[k] = counts[at]
        common[-1] = len(words) - common.sum()
        return Profile(len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)),
                       len(lines) - len(set(lines)), repeated_words(codes, len(number)), classes, common)


def repeated_words(codes: np.ndarray, distinct: int) -> int:
    """Words that lie in a window of three words found twice or more; ``codes`` number the words."""
    n = len(codes)
    if n < 4 or distinct == n:
        return 0
    pairs, size = codes[:-1] * distinct + codes[1:], distinct * distinct
    if distinct > 1 << 20:
        pairs, size = np.unique(pairs, return_inverse=True)[1], n
    order = np.argsort(windows := pairs[:-1] * distinct + codes[2:], kind="stable")
    ordered = windows[order]
    same = ordered[1:] == ordered[:-1]
    repeated = np.zeros(n - 2, bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k:n - 2 + k] |= repeated
    return int(covered.sum())


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms; 0 if one is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2

    def divergence(x):
        held = x > 0
        return float((x[held] * np.log2(x[held] / m[held])).sum())

    return float(np.sqrt(max((divergence(p) + divergence(q)) / 2, 0.0)))


def language(name: str = "lang"):
    """Language with a reference of its own, else one name for all others."""
    return F.when(F.col(name).isin(*COMMON_WORDS), F.col(name)).otherwise(OTHER_LANGUAGE)


def references(df: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """(character classes, common words) of each language, over all documents that pass the base rules."""
    ship(df.sparkSession)

    def sums(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        profiler, total = Profiler(), {}
        for batch in batches:
            for key, body in zip(batch["lang"], batch["text"]):
                found = profiler.profile(body)
                if not found.base_failed:
                    row = np.concatenate((found.classes, found.words))
                    total[key] = total.get(key, 0) + row
        yield pd.DataFrame([(key, k, int(c)) for key, row in total.items() for k, c in enumerate(row)],
                           columns=["lang", "bin", "count"])

    rows = df.select(language(lang).alias("lang"), text_or_empty(text).alias("text")).mapInPandas(
        sums, "lang string, bin int, count long").groupBy("lang", "bin").agg(F.sum("count").alias("count")).collect()
    out = {}
    for r in rows:  # at most one row per listed language and bin
        classes, words = out.setdefault(r.lang, (np.zeros(len(CLASSES)), np.zeros(len(VOCABULARY) + 1)))
        if r.bin < len(CLASSES):
            classes[r.bin] = r["count"]
        else:
            words[r.bin - len(CLASSES)] = r["count"]
    return out


RULES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
         "class_distance double, word_distance double, kept boolean")


def judge(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(row, n_words … kept): ``row`` holds the columns of ``df``."""
    shared = df.sparkSession.sparkContext.broadcast(references(df, text, lang))

    @F.pandas_udf(RULES)
    def rules(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        profiler, known = Profiler(), shared.value
        for langs, texts in batches:
            rows = []
            for key, body in zip(langs, texts):
                p = profiler.profile(body)
                classes, words = known.get(key, (np.zeros(0), np.zeros(0)))
                by_class = distance(p.classes, classes) if len(body) >= MIN_CHARS_JUDGED and len(classes) else 0.0
                by_word = distance(p.words, words) if p.n_words >= MIN_WORDS_JUDGED and len(words) else 0.0
                kept = not p.base_failed and by_class <= MAX_CLASS_DISTANCE and by_word <= MAX_WORD_DISTANCE
                rows.append((p.n_words, p.word_chars, p.n_symbols, p.n_dup_lines, p.n_repeat_words, p.base_failed,
                             by_class, by_word, kept))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RULES.split(", ")])

    return df.select(packed(df), rules(language(lang), text_or_empty(text)).alias("rules")).select("row", "rules.*")
