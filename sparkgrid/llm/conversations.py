"""Cheapest repair of the turn order of conversations, by depth-first branch-and-bound.

A conversation is sound if the initials of its roles read ``(s?(ua)+)?``: at
most one system turn, then user and assistant in turns. Each turn is kept (0),
given the other of the two roles (1) or deleted (2); empty user or assistant
turns can be inserted (5). Blank and repeated turns must go, and a turn that
breaks off costs 5 more unless it goes.

1. Faults and the order of turns are found by Spark: one exchange by
   conversation serves the window that finds repeated turns and the sort.
2. Each task reads its turns as a stream. ``cheapest`` takes up to ``SEGMENT``
   turns: an explicit stack of partial repairs, of which the cheapest next step
   is tried first; the least that the turns to come must cost; the incumbent
   (cost, audit); and a table of the best way to each (turn, role before), by
   which worse prefixes are given up. It ends when the stack is empty, which
   proves the incumbent optimal.
3. A longer conversation is a chain of segments. Each is solved from each role
   it can start after to each role it can end after, and the four best ways so
   far go on, with the running hash of their turns. Of two ways of equal cost
   over the same turns neither audit begins the other, so that comparing them
   early is safe. Memory is a segment, the audits and four hash states,
   whatever the length. The hash and the audit of one conversation are one
   sequence each, hence one task reads it, as a stream.

Defined cases: NULL conversation ids are one conversation; NULL turns come
first and count for no gap; NULL roles and texts are one space; an empty role
fits nowhere; rows of equal turn go by role and text, and rows that are equal
throughout are repeats of the first; a conversation of empty or very long
texts is one like any other; an empty table gives an empty result; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkgrid.llm.common import ship

SEGMENT = 48                      # turns that one search covers
REROLE, DELETE, INSERT, BROKEN = 1, 2, 5, 5
WHITE = " \t\n\v\f\r"
NAMES = {"u": "user", "a": "assistant"}
AFTER = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}  # "" is the start
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}  # role of an inserted turn
SOUND_PAIRS = {"su", "ua", "au"}
END = "end"

Way = tuple[int, str]             # cost, audit


def reachable(turns: list[tuple], entry: str) -> set[str]:
    """Roles that some repair of the turns can end after."""
    states = {entry}
    for initial, gone, _ in turns:
        before = states | {NEXT[s] for s in states}
        states |= {NEXT[s] for s in before} | {NEXT[NEXT[s]] for s in before} if not gone else before
        states |= {AFTER[s][initial] for s in before if not gone and initial in AFTER[s]}
    return states


def cheapest(turns: list[tuple], entry: str, closing: bool) -> dict[str, Way]:
    """Cheapest ways through ``turns`` (initial, must go, breaks off) after the role ``entry``, by the role they end after.

    ``closing`` leaves one way, to a sound end. Ties go to the least audit.
    """
    n = len(turns)
    rest = [0] * (n + 1)  # the least that the turns from here on cost
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + (DELETE if turns[i][1] else min(DELETE, BROKEN) if turns[i][2] else 0)
    ends = {END} if closing else reachable(turns, entry)
    incumbent: dict[str, Way] = {}
    best: list[dict[str, Way]] = [{} for _ in range(n + 1)]
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if len(incumbent) == len(ends) and all(
                cost + rest[i] > c or cost + rest[i] == c and audit > a[:len(audit)] for c, a in incumbent.values()):
            continue
        known = best[i].get(state)
        if known is not None and known <= (cost, audit):
            continue
        best[i][state] = cost, audit
        if i == n:
            while closing and state not in ("", "a"):
                state, cost, audit = NEXT[state], cost + INSERT, audit + "I"
            end = END if closing else state
            if end not in incumbent or (cost, audit) < incumbent[end]:
                incumbent[end] = cost, audit
            continue
        initial, gone, broken = turns[i]
        stay = BROKEN if broken else 0
        steps = []
        for before, price, letters in ((state, 0, ""), (NEXT[state], INSERT, "I")):
            if not gone:
                if initial in AFTER[before]:
                    steps.append((price + stay, letters + "K", AFTER[before][initial]))
                if initial != NEXT[before]:
                    steps.append((price + stay + REROLE, letters + "R", NEXT[before]))
            if not letters:
                steps.append((DELETE, "D", state))
            elif gone:
                steps.append((price + DELETE, "ID", before))  # the next segment may need the insertion here
        for price, letters, after in sorted(steps, reverse=True):
            stack.append((i + 1, after, cost + price, audit + letters))
    return incumbent


def repaired(turns: Iterable[tuple[str, str]], audit: str, state: str = "") -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that the audit leaves of (role, text)."""
    following = iter(turns)
    for edit in audit:
        if edit == "I":
            role, text = NAMES[NEXT[state]], ""
        else:
            role, text = next(following)
            if edit == "D":
                continue
            if edit == "R":
                role = NAMES[NEXT[state]]
        state = AFTER[state][role[:1]]
        yield edit, role, text


class Chain:
    """The best ways through one conversation so far, by the role they end after."""

    def __init__(self):
        self.ways = {"": (0, "", hashlib.sha256(), False)}
        self.turns: list[tuple] = []      # role, text, must go, breaks off

    def add(self, turn: tuple) -> None:
        if len(self.turns) == SEGMENT:
            self.advance(False)
        self.turns.append(turn)

    def advance(self, closing: bool) -> None:
        codes = [(role[:1], gone, broken) for role, _, gone, broken in self.turns]
        chosen: dict[str, tuple] = {}
        for entry, (cost, audit, *_) in self.ways.items():
            for end, (more, letters) in cheapest(codes, entry, closing).items():
                way = (cost + more, audit + letters, entry, letters)
                if end not in chosen or way < chosen[end]:
                    chosen[end] = way
        texts, after = [t[:2] for t in self.turns], {}
        for end, (cost, audit, entry, letters) in chosen.items():
            digest, begun = self.ways[entry][2].copy(), self.ways[entry][3]
            for _, role, text in repaired(texts, letters, entry):
                digest.update((("\n" if begun else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                begun = True
            after[end] = cost, audit, digest, begun
        self.ways, self.turns = after, []

    def close(self) -> tuple[int, str, str]:
        self.advance(True)
        cost, audit, digest, _ = self.ways[END]
        return cost, audit, digest.hexdigest()


class Counts:
    """Gaps and faults of one conversation."""

    def __init__(self):
        self.first = self.last = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before: str | None = None

    def add(self, turn: int | None, role: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        if turn is not None:
            if self.first is None:
                self.first = turn
            if turn != self.last:
                self.distinct += 1
            self.last = turn
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        if self.before is not None:
            self.illegal += self.before + role[:1] not in SOUND_PAIRS
        self.before = role[:1]

    def values(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal


def faults(text: str, repeat: bool) -> tuple[bool, bool, bool]:
    """Blank, duplicate, truncated: the first that holds."""
    bare = text.rstrip(WHITE)
    if not bare:
        return True, False, False
    return (False, True, False) if repeat else (False, False, bare[-1] not in ".!?")


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 1024, size: int = 8 << 20):
    """Rows as record batches of bounded size."""
    held, bytes_held = [], 0
    for row in rows:
        held.append(row)
        bytes_held += sum(len(v) for v in row if isinstance(v, str))
        if len(held) == most or bytes_held >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, bytes_held = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _reports(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    current, counts, chain, begun = None, Counts(), Chain(), False
    for conv, turn, role, text, present, repeat in _rows(batches):
        if begun and conv != current:
            yield (current, *counts.values(), *chain.close())
            counts, chain = Counts(), Chain()
        current, begun = conv, True
        if present:
            found = faults(text, repeat)
            counts.add(turn, role, *found)
            chain.add((role, text, found[0] or found[1], found[2]))
    if begun:
        yield (current, *counts.values(), *chain.close())


def ordered_turns(df: DataFrame, conv: str, turn: str, role: str, text: str, present: Column | None) -> DataFrame:
    """(conv, turn, role, text, present, repeat), each conversation in one partition and in order."""
    def known(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))

    rows = df.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"),
                     known(role).alias("role"), known(text).alias("text"),
                     (F.lit(True) if present is None else present).alias("present"))
    equal = Window.partitionBy("conv", "present", "role", "text").orderBy(F.asc_nulls_first("turn"))
    marked = rows.repartition("conv").withColumn("repeat", F.row_number().over(equal) > 1)
    return marked.sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text")


def repair_report(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                  present: Column | None = None) -> DataFrame:
    """One row per conversation: gaps, faults, cost and edits of the cheapest repair, hash of the repaired turns.

    Rows for which ``present`` is false only make their conversation known.
    """
    ship(df.sparkSession)
    kind = df.schema[conv].dataType
    out = T.StructType([T.StructField(conv, kind)] + [
        T.StructField(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [
        T.StructField(n, T.StringType()) for n in ("audit", "repaired_sha256")])
    schema = to_arrow_schema(out)
    return ordered_turns(df, conv, turn, role, text, present).mapInArrow(
        lambda batches: _batches(_reports(batches), schema), out)


def repaired_turns(df: DataFrame, report: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                   text: str = "text", present: Column | None = None) -> DataFrame:
    """The repaired conversations: conversation, place from 0, edit (K, R or I), role and text of each turn.

    ``report`` holds the audits; each leads the rows of its conversation, so
    that turns are edited as they stream by.
    """
    ship(df.sparkSession)
    rows = ordered_turns(df, conv, turn, role, text, present).where("present").select(
        "conv", F.lit(1).alias("kind"), "turn", "role", "text")
    audits = report.select(F.col(conv).alias("conv"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"),
                           F.lit("").alias("role"), F.col("audit").alias("text"))
    both = rows.union(audits).repartition("conv").sortWithinPartitions(
        "conv", "kind", F.asc_nulls_first("turn"), "role", "text")
    out = T.StructType([T.StructField(conv, df.schema[conv].dataType), T.StructField("place", T.LongType()),
                        *[T.StructField(n, T.StringType()) for n in ("edit", "role", "text")]])
    schema = to_arrow_schema(out)
    return both.mapInArrow(lambda batches: _batches(_edited(batches), schema), out)


def _edited(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    rows = _rows(batches)
    row = next(rows, None)
    while row is not None:
        conv, audit, following = row[0], row[4], None

        def turns():
            nonlocal following
            for following in rows:
                if following[1] == 0:
                    return
                yield following[3], following[4]
            following = None

        source = turns()
        for place, (edit, role, text) in enumerate(repaired(source, audit)):
            yield conv, place, edit, role, text
        for _ in source:  # up to the next audit
            pass
        row = following


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``df`` with ``present``, damaged by a hash of conversation and turn.

    Of 20 remainders 0 drops the turn, 1 empties its text, 2 takes its full
    stops, 3 repeats it and 4 makes it the user's. NULLs count as one space.
    """
    def known(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))

    key = F.concat(known(conv), F.lit(":"), known(turn))
    kind = F.crc32(F.encode(key, "UTF-8")) % 20
    body = F.when(F.col("_kind") == 1, F.lit("")).when(
        F.col("_kind") == 2, F.regexp_replace(known(text), "[.!?]", "")).otherwise(known(text))
    rows = df.select(conv, turn, role, text, kind.alias("_kind"))
    rows = rows.select(conv, turn, F.when(F.col("_kind") == 4, F.lit("user")).otherwise(known(role)).alias(role),
                       body.alias(text), (F.col("_kind") != 0).alias("present"), "_kind")
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("_copy", F.explode(copies)).drop("_copy", "_kind")
