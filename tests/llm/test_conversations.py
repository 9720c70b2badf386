"""Conversation repair against an exhaustive search and a plain dynamic programme."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sparkgrid.llm import conversations
from sparkgrid.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
SOUND = re.compile(r"(s?(ua)+)?")
PRICE = {"K": 0, "R": 1, "D": 2, "I": 5}


def exhaustive(turns):
    """Least (cost, audit) over all edits, with up to two insertions in each place."""
    best = None

    def price(audit):
        cost, i = 0, 0
        for e in audit:
            cost += PRICE[e]
            if e != "I":
                cost += 5 if e != "D" and turns[i][2] else 0
                i += 1
        return cost

    choices = [["D"] if gone else ["K", "Ru", "Ra", "D"] for _, gone, _ in turns]
    gaps = ["", "u", "a", "ua", "au"]
    for edits in itertools.product(*choices):
        for inserted in itertools.product(gaps, repeat=len(turns) + 1):
            roles, audit = inserted[0], "I" * len(inserted[0])
            for (initial, _, _), e, more in zip(turns, edits, inserted[1:]):
                roles += {"K": initial, "D": ""}.get(e, e[1:]) + more
                audit += e[0] + "I" * len(more)
            if SOUND.fullmatch(roles):
                way = price(audit), audit
                best = way if best is None else min(best, way)
    return best


def programme(turns):
    """Least (cost, audit) by all states after each turn; a second, independent way for long conversations."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    ways = {"": (0, "")}

    def insert(ways):
        out = dict(ways)
        for _ in range(2):
            for s, (c, a) in list(out.items()):
                for r in "ua":
                    if (s, r) in step:
                        t, w = step[s, r], (c + 5, a + "I")
                        out[t] = min(out.get(t, w), w)
        return out

    for initial, gone, broken in turns:
        after = {}
        for s, (c, a) in insert(ways).items():
            options = [(c + 2, a + "D", s)]
            if not gone:
                extra = 5 if broken else 0
                options += [(c + extra, a + "K", step[s, initial])] if (s, initial) in step else []
                options += [(c + 1 + extra, a + "R", step[s, r]) for r in "ua" if (s, r) in step]
            for cost, audit, t in options:
                after[t] = min(after.get(t, (cost, audit)), (cost, audit))
        ways = after
    return min(w for s, w in insert(ways).items() if s in ("", "a"))


def random_turns(rng, n):
    return [(rng.choice("suuaaax"), rng.random() < 0.15, rng.random() < 0.15) for _ in range(n)]


def chained(turns):
    chain = conversations.Chain()
    for initial, gone, broken in turns:
        chain.add(({"s": "system", "u": "user", "a": "assistant", "x": "x"}[initial], "t", gone, broken))
    return chain.close()[:2]


def test_search_equals_all_repairs():
    rng = random.Random(5)
    for k in range(120):
        turns = random_turns(rng, k % 4)
        assert chained(turns) == exhaustive(turns), turns


def test_long_chains_equal_the_programme(monkeypatch):
    rng = random.Random(6)
    for n in (1, 2, 5, 9, 30, 48, 49, 96, 97, 200, 400):
        for _ in range(3):
            turns = random_turns(rng, n)
            assert chained(turns) == programme(turns), turns
    monkeypatch.setattr(conversations, "SEGMENT", 3)
    for _ in range(300):
        turns = random_turns(rng, rng.randint(0, 14))
        assert chained(turns) == programme(turns), turns


def plain(rows):
    """The contract, from (conv, turn, role, text) rows."""
    kept = {}
    for conv, turn, role, text in rows:
        turns = kept.setdefault(conv, [])
        show = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        turns += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, turns in kept.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        seen, codes, counts = set(), [], [0, 0, 0]
        for _, role, text in turns:
            inked = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 0 if not inked else 1 if (role, text) in seen else 2 if inked[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            codes.append((role[:1], fault in (0, 1), fault == 2))
        known = [t[0] for t in turns if t[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(codes, codes[1:]))
        cost, audit = programme(codes)
        lines, state, at = [], "", iter(turns)
        for e in audit:
            turn = next(at) if e != "I" else (None, None, "")
            if e != "D":
                role = turn[1] if e == "K" else "assistant" if state == "u" else "user"
                lines.append(f"{role}:{turn[2]}")
                state = role[0]
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", FOLDER])
def test_query_equals_plain_python(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    found = QUERIES["op12_conversation_repair"](spark, folder).collect()
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in found} == plain(rows)
    assert len(found) == len({r[0] for r in rows})


def awkward():
    rng = random.Random(8)
    rows = []
    for conv in [None, *range(40)]:
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([turn, turn, None, 3]), rng.choice(["user", "assistant", "system", None, "", "bot"]),
                         rng.choice(["Yes.", "No!", "\t \n", "", None, "cut off", "long " * 50_000 + ".", "Why?"])))
    rows += [(99, t, "user" if t % 2 else "assistant", f"Turn {t}.") for t in range(700)]
    rows += [(98, None, "user", "Twice."), (98, None, "user", "Twice."), (97, -5, "assistant", "Later."), (97, 9, "user", "x")]
    return rows


def test_awkward_rows(spark):
    rows = awkward()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    clashing = df.withColumns({n: F.lit("own") for n in ("conv", "kind", "present", "repeat", "audit", "place")})
    expected = plain(rows)
    harmed = conversations.damaged(clashing)
    report = conversations.repair_report(harmed, present=F.col("present"))
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in report.collect()} == expected
    turns = conversations.repaired_turns(harmed, report, present=F.col("present")).collect()
    for conv, row in expected.items():
        own = sorted((r for r in turns if r.conv_id == conv), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(len(own)))
        assert SOUND.fullmatch("".join(r.role[0] for r in own))
        assert "".join(r.edit for r in own) == row[6].replace("D", "")
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in own).encode()).hexdigest() == row[7]


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    report = conversations.repair_report(conversations.damaged(df), present=F.col("present"))
    assert report.count() == 0 and conversations.repaired_turns(df, report).count() == 0
