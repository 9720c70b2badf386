"""Spelling variants: words one edit apart, each with the much more frequent word it is a form of.

1. ``word_counts``: tasks cut whole texts into runs of letters, count them in
   bounded tables and hand on (word, count); Spark sums.
2. Asymmetric q-chunks. Of two words one edit apart let the shorter (of equal
   ones either) contribute two disjoint chunks, its halves. The edit lies in
   one half, so the other stays: the front half where it was, the back half
   shifted by the difference of the lengths, which is 0 or 1. So of all
   positional grams of the other word only those at these places are posted
   against the chunks: a word posts its halves under its own length, and under
   the length below the grams that halves of such a word would be.
3. A list holds the words that share a chunk, its place and the length. Lists
   of up to ``LIST`` words are paired inside a window, in which each word looks
   back on the chunk words before it, and verified by Levenshtein distance.
   The members of a longer list are posted anew by a chunk more: the half that
   was free is halved again, and again one of its halves must stay. Where one
   place is left free a list cannot hold more chunk words than there are
   letters, so it is paired whatever its length. No list is cut, and the rows
   per level grow with the words.
4. The form of a word is its most frequent near word, if that has at least
   ``RATIO`` times its count. Counts rise tenfold along forms, so pointer
   doubling finds the roots in a handful of joins.

Defined cases: NULL and empty texts have no words; a NULL id counts as an empty
string in the hash that misspells; very long texts are cut like all others, and
a text without a break is one run; repeated rows count again; ties go to the
smallest word in code-point order; an empty table gives an empty result; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkgrid.llm.common import ship
from sparkgrid.session import stage

SHORTEST = 7                # code points
FEWEST = 2                  # occurrences
RATIO = 10
LIST = 32                   # members up to which a list is paired
HELD_CHARS = 16 << 20       # characters of words that a task counts before it hands them on
RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % SHORTEST)
MISSPELL = 31


def _counted(batches: Iterable[pa.RecordBatch], misspell: bool) -> Iterator[pa.RecordBatch]:
    counts: dict[str, int] = {}
    held = 0

    def handed_on() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(counts, pa.string()),
                                           "n": pa.array(counts.values(), pa.int64())})

    for batch in batches:
        for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text")):
            own: dict[str, int] = {}
            # Bytes are lowered in A-Z only.
            for run in RUN.findall(text.as_py().encode("utf-8", "replace").lower().decode("utf-8")):
                own[run] = own.get(run, 0) + 1
            start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for run, n in own.items():
                if misspell:
                    h = zlib.crc32(run.encode(), start)
                    if h % MISSPELL == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1:]
                        if len(run) < SHORTEST:
                            continue
                known = counts.get(run)
                if known is None:
                    counts[run] = n
                    held += len(run) + 64
                else:
                    counts[run] = known + n
            if held > HELD_CHARS:
                yield handed_on()
                counts, held = {}, 0
    if counts:
        yield handed_on()


def word_counts(df: DataFrame, text: str = "text", id_column: str = "doc_id", misspell: bool = False) -> DataFrame:
    """(word, n): words of at least ``SHORTEST`` code points and ``FEWEST`` occurrences in all texts.

    ``misspell`` takes a letter out of every 31st (document, word) by hash, to plant variants.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    found = rows.where("text is not null").mapInArrow(lambda b: _counted(b, misspell), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= FEWEST)


def _posted(words: DataFrame) -> DataFrame:
    """(word, n, length, long, low, high): the two free halves of each word under its own length and the one below.

    ``low`` and ``high`` bound the free places of the chunk word.
    """
    rows = words.select("word", "n", F.char_length("word").alias("_own"), F.explode(F.array(
        F.lit(False), F.lit(True))).alias("long"))
    length = F.col("_own") - F.col("long").cast("int")
    return _halved(rows.select("word", "n", length.alias("length"), "long", F.lit(0).alias("low"),
                               length.alias("high")))


def _halved(rows: DataFrame) -> DataFrame:
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    halves = F.array(F.struct(F.col("low").alias("low"), middle.alias("high")),
                     F.struct(middle.alias("low"), F.col("high").alias("high")))
    return rows.withColumn("_half", F.explode(halves)).select(
        "word", "n", "length", "long", F.col("_half.low").alias("low"), F.col("_half.high").alias("high"))


def _chunk() -> Column:
    """What stands before and behind the free places, with these places: the key of a list."""
    word, behind = F.col("word"), F.col("length") - F.col("high")
    own = F.char_length(word)
    return F.concat_ws("|", "length", "low", F.substring(word, F.lit(1), F.col("low")),
                       F.substring(word, own - behind + 1, behind))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): both directions of all pairs of ``words`` (word, n) exactly one edit apart, once each."""
    posted, pairs = _posted(words), None
    longest = words.agg(F.coalesce(F.max(F.char_length("word")), F.lit(0))).first()[0]
    free = longest - longest // 2  # most free places that a row of this level has
    while True:
        key = Window.partitionBy("chunk")
        sized = posted.withColumn("chunk", _chunk()).withColumn(
            "paired", (F.count("*").over(key) <= LIST) | (F.col("high") - F.col("low") <= 1))
        before = F.collect_list(F.when(F.col("paired") & ~F.col("long"), F.struct("word", "n"))).over(
            key.orderBy("long", "word").rowsBetween(Window.unboundedPreceding, -1))
        near = F.filter(before, lambda other: F.levenshtein(other["word"], F.col("word"), 1) == 1)
        rows = stage(sized.select("word", "n", "length", "long", "low", "high", "paired", near.alias("near")).where(
            (F.size("near") > 0) | ~F.col("paired")), "chunks")
        found = rows.where("paired").select("word", "n", F.explode("near").alias("_near")).select(
            "word", "n", F.col("_near.word").alias("near"), F.col("_near.n").alias("near_n"))
        pairs = found if pairs is None else pairs.union(found)
        if free <= 1 or rows.where(~F.col("paired")).isEmpty():
            break
        free -= free // 2
        posted = _halved(rows.where(~F.col("paired")))
    both = pairs.select("word", "n", F.explode(F.array(
        F.struct(F.col("word").alias("a"), F.col("n").alias("an"), F.col("near").alias("b"), F.col("near_n").alias("bn")),
        F.struct(F.col("near").alias("a"), F.col("near_n").alias("an"), F.col("word").alias("b"), F.col("n").alias("bn")),
    )).alias("p")).select("p.*")
    return both.groupBy("a", "b").agg(F.first("an").alias("n"), F.first("bn").alias("near_n")).select(
        F.col("a").alias("word"), "n", F.col("b").alias("near"), "near_n")


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``words`` (word, n) with n_near, form, form_n and root."""
    words = stage(words.select("word", "n"), "words")
    near = near_words(words)
    best = near.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    joined = words.join(best, "word", "left")
    form_n = -F.col("best.less")
    taken = form_n >= F.col("n") * ratio
    forms = stage(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                F.when(taken, F.col("best.form")).alias("form"),
                                F.when(taken, form_n).alias("form_n")), "forms")
    return forms.join(_roots(forms), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form, by pointer doubling."""
    roots = stage(forms.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        above = roots.select(F.col("word").alias("root"), F.col("root").alias("above"))
        moved = stage(roots.join(above, "root", "left").select(
            "word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return roots
