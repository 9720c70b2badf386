"""Secret scans: fixed patterns, and a linear-chain conditional random field that finds more.

The patterns give the base spans. The field tags tokens as begin, inside or
outside of a secret. Its features are the shape of a token, the words and
shapes around it, and properties of the file. It is trained in one task on
bounded samples: of all documents, up to ``SAMPLE_HITS`` with base spans of
each kind and ``SAMPLE_CLEAN`` without any, of each up to ``SAMPLE_CHARS``
characters around its first span. The patterns supply the tags, and because
they would teach nothing but themselves, every text with a hit is also learnt
twice with names, joints and half of the values replaced (``masked``), and some
clean ones with secrets put between their words (``planted``). It is decoded by
Viterbi over all tokens of the text. The scores of a token are sums of table
rows; Viterbi then runs where tags other than outside can win at all: a bound
on what any run of such tags gains over outside (``Field.open_runs``) proves
the rest to be outside. Tagged spans that touch no base span are added as kind
``crf``.

Defined cases: NULL text counts as empty and has no spans; a corpus without
base spans trains on planted secrets only; NULL ids do not train; repeated rows
get the same spans; very long texts are scanned whole, tokens over
``LONG_TOKEN`` characters by their first ones; columns of ``df`` lie in a
struct, so that their names cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgrid.llm.common import packed, ship, text_or_empty
from sparkgrid.session import join_small, stage

# Fixed by the definition of the base spans.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LENGTH, ACCESS_LENGTH = 6, 20
KINDS = ["assign", "access", "hex", "crf"]

SAMPLE_HITS = 2_000     # documents of each kind of base span
SAMPLE_CLEAN = 6_000
SAMPLE_CHARS = 20_000
TRAIN_TOKENS = 200_000  # in parts of PART tokens; parts that stand for others count as often
PART = 40
HELD_BYTES = 24 << 20   # of known tokens that a worker keeps
STEPS_AROUND = (-3, -2, -1, 1, 2)
MIN_LENGTH = 6
MIN_SEEN = 3
STEPS = 120
RIDGE = 0.5
SEED = 8
OUTSIDE, BEGIN, INSIDE = range(3)

KEY_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey", "akia", "credential", "private", "bearer")
TOKEN = re.compile(r"[A-Za-z0-9+/_.-]+|[=:]|[^\sA-Za-z0-9+/_.=:-]+")
HEX_ONLY = re.compile("[0-9a-f]+")
KEYS = re.compile("|".join(KEY_WORDS))
LONG_TOKEN = 200        # characters of a token that are looked at for its entropy and key words

Span = tuple[int, int, int]  # start, number of the kind, end


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, in order of start and kind."""
    found = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    lower = text.lower()
    if any(k in lower for k in KEY_WORDS[:6]):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LENGTH]
    return sorted(found)


def value_spans(text: str) -> list[tuple[int, int]]:
    """The secret parts of the base spans, as the training tags need them."""
    values = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LENGTH]
    return values + [(s, e) for s, kind, e in base_spans(text) if kind]


class _Kinds(dict):
    """Kind of each character, for ``str.translate``."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        k = "d" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c if c in "+/_.=:-\"'" else "x"
        self[code] = k
        return k


_KINDS = _Kinds()
_RUNS = re.compile(r"(.)\1+")


def shape(token: str) -> str:
    """Kinds of characters in their order, runs shortened: 'Ab12-' is 'Aad-'."""
    return _RUNS.sub(r"\1", token[:40].translate(_KINDS))[:8]


def _letters(token: str) -> float:
    """Bits a character, from the counts of the token's own characters."""
    return _entropy(tuple(sorted(map(token.count, set(token)))))


@lru_cache(1 << 16)
def _entropy(counts: tuple[int, ...]) -> float:
    n = sum(counts)
    return -sum(c / n * math.log2(c / n) for c in counts)


def file_features(text: str) -> list[str]:
    sample = len(text) or 1
    digits = sum(map(text.count, "0123456789")) / sample
    return [f"file digits {min(int(digits * 50), 5)}", f"file assigns {min(text.count('=') + text.count(':'), 3)}"]


def own_signs(w: str) -> tuple:
    """What the features of a token itself depend on."""
    length = len(w)
    return (shape(w), min(length // 4, 10), int(_letters(w) * 2) if 5 < length <= LONG_TOKEN else 0,
            HEX_ONLY.fullmatch(w) is not None, min(length // 8, 5), w.isupper(), w[:4] == "AKIA", length >= 16)


def own_features(w: str) -> list[str]:
    form, quarter, bits, is_hex, eighth, upper, access, long = own_signs(w)
    return ["bias", f"shape {form}", f"length {quarter}", f"bits {bits}", f"hex {is_hex} {eighth}",
            f"upper {upper} {access} {long}", f"digits {'d' in form}"]


def seen_as(w: str) -> str:
    """A token as its neighbours see it: key word, short word or shape."""
    near = w[:LONG_TOKEN].lower()
    key = KEYS.search(near)
    return key[0] if key else near if len(near) < 4 else shape(w)


def token_features(words: list[str], common: list[str], start: int = 0, stop: int | None = None) -> list[list[str]]:
    """Features of the tokens from ``start`` to ``stop``, with neighbours from the whole text."""
    out = []
    for i in range(start, len(words) if stop is None else stop):
        f = own_features(words[i]) + common
        for step in STEPS_AROUND:
            j = i + step
            if 0 <= j < len(words):
                f.append(f"{step} {seen_as(words[j])}")
                if step == -1:
                    f.append(f"{step} {shape(words[j])} {shape(words[i])}")
            else:
                f.append(f"{step} edge")
        out.append(f)
    return out


class _Rows:
    """Score rows by key, in one growing array."""

    def __init__(self, width: int):
        self.number: dict = {}
        self.values = np.zeros((256, width, 3))

    def add(self, key, rows: list) -> int:
        k = self.number[key] = len(self.number)
        if k == len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        self.values[k] = rows
        return k


class Field:
    """Weights of a trained field: of each feature for the three tags, and from tag to tag."""

    def __init__(self, weights: dict[str, tuple[float, float, float]], moves: list[list[float]]):
        self.weights, self.moves = weights, moves
        pairs = [n.split(" ") for n in weights if n.startswith("-1 ") and n.count(" ") == 2]
        self.shapes = {x: k for k, x in enumerate(sorted({x for _, *both in pairs for x in both}), 1)}
        self.pairs = np.zeros((len(self.shapes) + 1, len(self.shapes) + 1, 3))
        for name in pairs:
            self.pairs[self.shapes[name[1]], self.shapes[name[2]]] = weights[" ".join(name)]
        self.edges = np.array([weights.get(f"{step} edge", (0, 0, 0)) for step in STEPS_AROUND], float)
        self._forget()

    def _forget(self) -> None:
        """Start the tables of known tokens, of their own scores and of those lent to neighbours."""
        self.known: dict[str, int] = {}
        self.held = 0
        self.own, self.near = _Rows(1), _Rows(len(STEPS_AROUND))
        self.places = np.zeros((1024, 3), np.int32)  # of each known token: row of own, row of near, number of the shape

    def _place(self, w: str) -> tuple[int, int, int]:
        signs, near = own_signs(w), seen_as(w)
        own, lent = self.own.number.get(signs), self.near.number.get(near)
        if own is None:
            own = self.own.add(signs, [self._sum(own_features(w))])
        if lent is None:
            lent = self.near.add(near, [self._sum([f"{step} {near}"]) for step in STEPS_AROUND])
        return own, lent, self.shapes.get(signs[0], 0)

    def _places(self, words: list[str]) -> np.ndarray:
        known = self.known
        for w in words:
            if w not in known:
                k = known[w] = len(known)
                if k == len(self.places):
                    self.places = np.concatenate([self.places, np.zeros_like(self.places)])
                self.places[k] = self._place(w)
                self.held += len(w) + 100
        return self.places[[known[w] for w in words]]

    def _sum(self, names: list[str]) -> tuple[float, float, float]:
        x = y = z = 0.0
        for n in names:
            found = self.weights.get(n)
            if found is not None:
                x, y, z = x + found[0], y + found[1], z + found[2]
        return x, y, z

    def scores(self, words: list[str], common: list[str]) -> np.ndarray:
        """Scores of the three tags for each token: the sums of the weights of ``token_features``."""
        if self.held > HELD_BYTES:
            self._forget()
        n, places = len(words), self._places(words)
        shapes = places[:, 2]
        e, lent = self.own.values[places[:, 0], 0] + self._sum(common), self.near.values[places[:, 1]]
        for at, step in enumerate(STEPS_AROUND):
            if step < 0:
                e[-step:] += lent[:n + step, at]
                e[:-step] += self.edges[at]
            else:
                e[:max(n - step, 0)] += lent[step:, at]
                e[max(n - step, 0):] += self.edges[at]
        e[1:] += self.pairs[shapes[:-1], shapes[1:]]
        return e

    def open_runs(self, e: np.ndarray) -> list[tuple[int, int]]:
        """Runs of tokens outside of which the best tags are proven to be OUTSIDE.

        A run of other tags gains at most the sum of ``gain`` over its tokens,
        plus ``ends``, against tags of OUTSIDE in its place; a token that no
        run with a positive bound holds is outside.
        """
        m = np.array(self.moves) - self.moves[OUTSIDE][OUTSIDE]
        inner = m[1:, 1:].max()
        ends = max(m[OUTSIDE, 1:].max(), 0.0) + max(m[1:, OUTSIDE].max(), 0.0) - inner
        gain = e[:, 1:].max(axis=1) - e[:, OUTSIDE] + inner
        total = np.concatenate([[0.0], np.cumsum(gain)])
        best = np.maximum.accumulate(total[:0:-1])[::-1] - np.minimum.accumulate(total[:-1])
        around = np.concatenate([[False], best + ends + 1e-6 > 0, [False]])
        starts, stops = np.flatnonzero(around[1:] & ~around[:-1]), np.flatnonzero(around[:-1] & ~around[1:])
        return list(zip(starts.tolist(), stops.tolist()))

    def tags(self, e: np.ndarray) -> list[int]:
        """The most probable tags of a whole text, by Viterbi on its open runs."""
        out = [OUTSIDE] * len(e)
        for a, b in self.open_runs(e):
            # The tokens before and after a run are outside.
            rows, after = e[a:b].tolist(), [0.0, 0.0, 0.0] if b == len(e) else [row[OUTSIDE] for row in self.moves]
            first = [rows[0][t] + self.moves[OUTSIDE][t] for t in range(3)] if a else [*rows[0][:2], -math.inf]
            out[a:b] = self._best(rows, first, after)
        return out

    def _best(self, rows: list[list[float]], first: list[float], after: list[float]) -> list[int]:
        best, back, moves = first, [], self.moves
        for e in rows[1:]:
            step, come = [], []
            for t in range(3):
                a, b, c = best[0] + moves[0][t], best[1] + moves[1][t], best[2] + moves[2][t]
                s, most = (0, a) if a >= b else (1, b)
                s, most = (s, most) if most >= c else (2, c)
                step.append(most + e[t])
                come.append(s)
            best = step
            back.append(come)
        best = [x + y for x, y in zip(best, after)]
        tags = [max(range(3), key=best.__getitem__)]
        for come in reversed(back):
            tags.append(come[tags[-1]])
        return tags[::-1]

    def decode(self, features: list[list[str]]) -> list[int]:
        """The most probable tags (Viterbi)."""
        rows = [list(self._sum(names)) for names in features]
        return self._best(rows, [*rows[0][:2], -math.inf], [0.0, 0.0, 0.0])

    def spans(self, text: str) -> list[tuple[int, int]]:
        words = TOKEN.findall(text) if self.weights else []
        if not words:
            return []
        tags = self.tags(self.scores(words, file_features(text)))
        if not any(tags):
            return []
        found, start = [], None
        for m, tag in zip(TOKEN.finditer(text), tags):
            if tag == BEGIN or (tag == INSIDE and start is None):
                if start is not None:
                    found.append((start, end))
                start = m.start()
            elif tag == OUTSIDE and start is not None:
                found.append((start, end))
                start = None
            end = m.end()
        if start is not None:
            found.append((start, end))
        return [(a, b) for a, b in found if b - a >= MIN_LENGTH]


def tags_of(values: list[tuple[int, int]], tokens: list[re.Match]) -> list[int]:
    """Tags of the tokens of a text whose secrets are ``values``."""
    values, y, last, k = sorted(values), [], None, 0
    for m in tokens:
        while k < len(values) and values[k][1] <= m.start():
            k += 1
        home = next((v for v in values[k:k + 3] if m.start() < v[1] and v[0] < m.end() and m.group() not in "=:"), None)
        y.append(OUTSIDE if home is None else INSIDE if home == last else BEGIN)
        last = home
    return y


ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
JOINTS = (" = ", "=", ": ", " => ", ":", " ", " := ", "='", '": "')


def _ordinary(text: str) -> list[str]:
    """Words of the text for names and values; none that a pattern knows."""
    return [w for w in text.split() if w.isalpha() and len(w) > 2 and not KEYS.search(w.lower())][:2000] or ["note"]


def masked(text: str, rng: random.Random, values: list[tuple[int, int]] | None = None) -> tuple[str, list[tuple[int, int]]]:
    """The text with its secrets under other names, and where they then are.

    What stands before a value on its line is replaced by ordinary words of the
    text, so that names, signs and quotes of the patterns cannot carry the
    decision; half of the values become made-up ones.
    """
    if values is None:
        values = value_spans(text)
    words = _ordinary(text)
    out, spans, at, length = [], [], 0, 0
    for s, e in sorted(values):
        name = ASSIGN.search(text, max(at, s - 60), e)
        begin = name.start() if name and name.end() >= e else s
        if begin < at:
            continue
        kept = text[at:begin]
        # The rest of a compound name goes with it.
        stem = len(kept) - len(kept.rstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_-.\"'"))
        kept = kept[:len(kept) - stem] if begin < s else kept
        lead = "_".join(rng.choice(words).lower() for _ in range(rng.randint(1, 2))) + rng.choice(JOINTS)
        value = text[s:e] if rng.random() < 0.5 else made_up(rng, words)
        out += [kept, lead, value]
        length += len(kept) + len(lead)
        spans.append((length, length + len(value)))
        length += len(value)
        at = e
    out.append(text[at:])
    return "".join(out), spans


def made_up(rng: random.Random, words: list[str]) -> str:
    """A value such as people and services choose: random characters, with or without a prefix, or words put together."""
    kind = rng.randrange(4)
    if kind == 0:
        return "".join(rng.choice(words).capitalize() for _ in range(rng.randint(3, 4)))
    letters = "0123456789abcdef" if kind == 1 else ALNUM + "+/" * (kind == 2)
    body = "".join(rng.choice(letters) for _ in range(rng.randint(14, 40)))
    lead = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 4)))
    return f"{lead}_{body}" if kind == 3 else body


def planted(text: str, rng: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """The text with one or two made-up secrets between its words, and where they are."""
    places = [m.end() for m in re.finditer(r"\w(?=\s)", text)] or [len(text)]
    chosen = sorted(rng.sample(places, min(len(places), rng.randint(1, 2))))
    marked, values, shift = text, [], 0
    for place in chosen:
        marked = f"{marked[:place + shift]} #{marked[place + shift:]}"
        values.append((place + shift + 1, place + shift + 2))
        shift += 2
    words = _ordinary(text)
    out, spans, at, length = [], [], 0, 0
    for s, e in values:
        lead = "_".join(rng.choice(words).lower() for _ in range(rng.randint(1, 2))) + rng.choice(JOINTS)
        value = made_up(rng, words)
        out += [marked[at:s], lead, value]
        length += s - at + len(lead)
        spans.append((length, length + len(value)))
        length += len(value)
        at = e
    return "".join([*out, marked[at:]]), spans


def lessons(texts: list[str]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Texts and where their secrets are: as the patterns have them, masked, and every eighth clean text with planted ones."""
    rng = random.Random(SEED)
    for k, text in enumerate(texts):
        values = value_spans(text)
        yield text, values
        if values:
            yield masked(text, rng, values)
            yield masked(text, rng, values)
        elif k % 8 == 0 and text:
            yield planted(text, rng)


def train(texts: list[str]) -> Field:
    """Maximum likelihood with a ridge, by gradient steps on parts of all lessons of the sample at once.

    Of the parts with tags, and of those without, every so many-th is taken if
    they have more than half of ``TRAIN_TOKENS`` each, and counts as often.
    """
    forbidden = -20.0
    moves = np.zeros((3, 3))
    moves[OUTSIDE, INSIDE] = forbidden
    parts: list[list[tuple[int, int, list[int]]]] = [[], []]
    texts, spans = map(list, zip(*lessons(texts))) if texts else ([], [])
    for at, text in enumerate(texts):
        y = tags_of(spans[at], list(TOKEN.finditer(text)))
        for start in range(0, len(y), PART):
            part = y[start:start + PART]
            part[0] = BEGIN if part[0] == INSIDE else part[0]
            parts[any(part)].append((at, start, part if any(part) else [OUTSIDE] * len(part)))
    sequences, tags, often, seen = [], [], [], Counter()
    chosen = []
    for kind in parts:
        every = -(-sum(len(y) for _, _, y in kind) * 2 // TRAIN_TOKENS) or 1
        chosen += [(*part, every) for part in kind[::every]]
    last, words, common = None, [], []
    for at, start, y, every in sorted(chosen, key=lambda part: part[:2]):
        if at != last:
            last, words, common = at, TOKEN.findall(texts[at]), file_features(texts[at])
        sequences.append(token_features(words, common, start, start + len(y)))
        tags.append(y)
        often.append(every)
        seen.update(name for names in sequences[-1] for name in names)
    if not any(t != OUTSIDE for y in tags for t in y):
        return Field({}, moves.tolist())

    number = {name: k for k, name in enumerate(sorted(n for n, c in seen.items() if c >= MIN_SEEN))}
    n, longest = len(sequences), max(map(len, sequences))
    most = max(len(names) for f in sequences for names in f)
    ids = np.full((n, longest, most), len(number), np.int32)
    gold, real = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for i, (f, y) in enumerate(zip(sequences, tags)):
        gold[i, :len(y)], real[i, :len(y)] = y, True
        for j, names in enumerate(f):
            known = [number[name] for name in names if name in number]
            ids[i, j, :len(known)] = known
    at, rows = np.nonzero(real), real.sum()
    flat, often = ids[at], np.array(often, float)
    del ids, sequences

    weights = np.zeros((len(number) + 1, 3))
    pull_w, pull_m = np.full_like(weights, 1e-8), np.full_like(moves, 1e-8)
    for _ in range(STEPS):
        emit = np.zeros((n, longest, 3))
        emit[at] = sum(weights[flat[:, k]] for k in range(most))
        marginal, pairs = _marginals(emit, moves, real, often)
        wrong = -marginal[at]
        wrong[np.arange(rows), gold[at]] += 1
        wrong *= often[at[0], None]
        grad_w = np.zeros_like(weights)
        for k in range(most):
            for t in range(3):
                grad_w[:, t] += np.bincount(flat[:, k], weights=wrong[:, t], minlength=len(weights))
        grad_w -= RIDGE * weights
        grad_w[-1] = 0
        both = real[:, 1:]
        grad_m = -pairs
        np.add.at(grad_m, (gold[:, :-1][both], gold[:, 1:][both]), np.broadcast_to(often[:, None], both.shape)[both])
        grad_m -= RIDGE * moves
        grad_m[OUTSIDE, INSIDE] = 0
        pull_w += grad_w ** 2
        pull_m += grad_m ** 2
        weights += 0.5 * grad_w / np.sqrt(pull_w)
        moves += 0.5 * grad_m / np.sqrt(pull_m)
    return Field({name: tuple(map(float, weights[k])) for name, k in number.items()}, moves.tolist())


def _marginals(emit: np.ndarray, moves: np.ndarray, real: np.ndarray,
               often: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Tag probabilities of each token, and expected numbers of each pair of tags, by forward-backward sums.

    Sequences count as ``often`` in the numbers of pairs, by default once.
    """
    often = np.ones(len(emit)) if often is None else often
    n, longest, _ = emit.shape
    forward, backward = np.full_like(emit, -1e9), np.zeros_like(emit)
    forward[:, 0] = emit[:, 0]
    forward[:, 0, INSIDE] = -1e9
    for j in range(1, longest):
        step = _log_sum(forward[:, j - 1, :, None] + moves[None], 1) + emit[:, j]
        forward[:, j] = np.where(real[:, j, None], step, forward[:, j - 1])
    for j in range(longest - 2, -1, -1):
        step = _log_sum(moves[None] + (emit[:, j + 1] + backward[:, j + 1])[:, None, :], 2)
        backward[:, j] = np.where(real[:, j + 1, None], step, 0.0)
    whole = _log_sum(forward[:, -1], 1)
    marginal = np.exp(forward + backward - whole[:, None, None])
    pairs = np.zeros((3, 3))
    for j in range(1, longest):
        ok = real[:, j]
        joint = forward[ok, j - 1, :, None] + moves[None] + (emit[ok, j] + backward[ok, j])[:, None, :]
        pairs += np.tensordot(often[ok], np.exp(joint - whole[ok, None, None]), 1)
    return marginal, pairs


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """(base spans, base and added spans)."""
    base = base_spans(text)
    added = [(a, 3, b) for a, b in field.spans(text) if not any(a < e and s < b for s, _, e in base)]
    return base, sorted(base + added)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def excerpt(text: str) -> str:
    """``SAMPLE_CHARS`` characters of a text, with its first base span in them."""
    if len(text) <= SAMPLE_CHARS:
        return text
    first = next(iter(base_spans(text)), (0, 0, 0))[0]
    start = max(first - SAMPLE_CHARS // 2, 0)
    return text[start:start + SAMPLE_CHARS]


def training_sample(df: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(id, text): excerpts of documents with base spans, bounded by kind, and of documents without.

    The same for the same documents whatever the order of rows; of rows with
    one id one is taken, of most kinds.
    """
    @F.pandas_udf("int")
    def kinds(texts: pd.Series) -> pd.Series:
        return pd.Series([sum({1 << kind for _, kind, _ in base_spans(t)}) for t in texts], dtype="int32")

    @F.pandas_udf("string")
    def excerpts(texts: pd.Series) -> pd.Series:
        return pd.Series([excerpt(t) for t in texts], dtype=object)

    bodies = df.select(F.col(f"`{id_column}`").alias("id"), text_or_empty(text).alias("text")).where("id is not null")
    known = stage(bodies.select("id", kinds("text").alias("kinds")).groupBy("id").agg(F.max("kinds").alias("kinds")),
                  "kinds")
    chosen = [known.where("kinds = 0").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_CLEAN)]
    for k in range(3):
        held = known.where(F.col("kinds").bitwiseAND(1 << k) > 0)
        chosen.append(held.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_HITS))
    wanted = stage(chosen[0].union(chosen[1]).union(chosen[2]).union(chosen[3]).select("id").distinct(), "wanted")
    found = join_small(bodies, wanted, ["id"]).select("id", excerpts("text").alias("text"), kinds("text").alias("kinds"))
    return found.groupBy("id").agg(F.max(F.struct("kinds", "text")).alias("x")).select("id", "x.text")


def fit(df: DataFrame, text: str = "text", id_column: str = "doc_id") -> Field:
    """Train in one task on the bounded sample; the driver only sees the weights."""
    ship(df.sparkSession)

    def task(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field = train([t for batch in batches for t in batch["text"]])
        yield pd.DataFrame({"field": [pickle.dumps((field.weights, field.moves))]})

    ordered = training_sample(df, text, id_column).repartition(1).sortWithinPartitions("id").select("text")
    row = ordered.mapInPandas(task, "field binary").first()
    return Field(*pickle.loads(row.field)) if row else train([])


SCAN = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(df: DataFrame, field: Field | None = None, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(row, n_assign, n_access, n_hex, base_sha256, spans): ``row`` holds the columns of ``df``."""
    spark = df.sparkSession
    ship(spark)
    if field is None:
        field = fit(df, text, id_column)
    shared = spark.sparkContext.broadcast(field)

    @F.pandas_udf(SCAN)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for body in batch:
                base, spans = all_spans(body, shared.value)
                counts = Counter(kind for _, kind, _ in base)
                rows.append((counts[0], counts[1], counts[2], hashlib.sha256(written(base).encode()).hexdigest(),
                             written(spans)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCAN.split(", ")])

    return df.select(packed(df), found(text_or_empty(text)).alias("found")).select("row", "found.*")
