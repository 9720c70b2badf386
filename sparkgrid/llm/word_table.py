"""Ids of words found by hashes of their bytes, for whole arrays of words at a time. These helpers run inside tasks.

A word's hash is the sum of a random number per byte, times a power for its
place, so that the hashes of all words of a chunk come from one running sum.
Words are looked up by 64 bits and checked by 32 more of an independent sum;
words that differ in the check are encoded apart. Words over ``LONGEST`` bytes
are not hashed nor kept.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable
from itertools import chain

import numpy as np

from sparkgrid.llm.pieces import gather

CHUNK = 1 << 18
LONGEST = 64
RECENT = 1 << 15         # words that are looked up apart before they are sorted in with the others
ENTRY_BYTES = 24         # of a word, besides its ids

_rng = np.random.default_rng(8)
_FACTORS = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHECKS = _rng.integers(0, 1 << 32, 256, dtype=np.uint32)


class _Powers:
    """Powers of an odd number and of its inverse, modulo a power of two."""

    def __init__(self, base: int, kind, bits: int):
        inverse = pow(base, -1, 1 << bits)
        self.up, self.down = (np.concatenate([[kind(1)], np.cumprod(np.full(CHUNK, b, kind), dtype=kind)])
                              for b in (base, inverse))


_powers: list[_Powers] = []


def powers() -> list[_Powers]:
    if not _powers:
        _powers.extend([_Powers(0x9E3779B97F4A7C15, np.uint64, 64), _Powers(0x85EBCA6B, np.uint32, 32)])
    return _powers


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of bytes that end with a space."""
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    some = ends > starts
    return starts[some], ends[some]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of each word of a chunk of at most ``CHUNK`` bytes."""
    out = []
    for power, factors in zip(powers(), (_FACTORS, _CHECKS)):
        total = np.zeros(len(data) + 1, factors.dtype)
        np.cumsum(factors[data] * power.up[:len(data)], out=total[1:], dtype=factors.dtype)
        out.append((total[ends] - total[starts]) * power.down[starts])
    # Words of one letter sum over several lengths only if the length is part of the hash.
    return out[0] ^ (ends - starts).astype(np.uint64) * np.uint64(0xC4CEB9FE1A85EC53), out[1]


class WordTable:
    """Ids by word; emptied when it holds more than ``limit`` bytes."""

    def __init__(self, limit: int):
        self.limit = limit
        self.forget()

    def forget(self) -> None:
        self.main, self.main_row = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.recent, self.recent_row = self.main, self.main_row
        self.check, self.ids, self.ends = array("I"), array("I"), array("q", [0])

    def bytes(self) -> int:
        return 4 * len(self.ids) + ENTRY_BYTES * len(self.ends)

    def add(self, ids: list[list[int]], checks: np.ndarray) -> np.ndarray:
        """Rows for words, which no hash leads to yet."""
        first = len(self.check)
        self.ids.extend(chain.from_iterable(ids))
        self.ends.frombytes((self.ends[-1] + np.cumsum(list(map(len, ids)), dtype=np.int64)).tobytes())
        self.check.frombytes(checks.astype(np.uint32).tobytes())
        return np.arange(first, len(self.check))

    def keep(self, found: np.ndarray, rows: np.ndarray) -> None:
        """Let new hashes, sorted, lead to rows."""
        at = np.searchsorted(self.recent, found)
        self.recent, self.recent_row = np.insert(self.recent, at, found), np.insert(self.recent_row, at, rows)
        if len(self.recent) > RECENT:
            at = np.searchsorted(self.main, self.recent)
            self.main, self.main_row = np.insert(self.main, at, self.recent), np.insert(self.main_row, at, self.recent_row)
            self.recent, self.recent_row = self.recent[:0], self.recent_row[:0]

    def rows_of(self, wanted: np.ndarray) -> np.ndarray:
        """The row of each hash, or -1."""
        rows = np.full(len(wanted), -1, np.int64)
        for held, of in ((self.main, self.main_row), (self.recent, self.recent_row)):
            if len(held):
                at = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
                hit = held[at] == wanted
                rows[hit] = of[at[hit]]
        return rows

    def encode(self, text: bytes, learn: Callable[[list[bytes]], list[list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start of each word, number of its ids, all ids) of words that each end with a space.

        ``learn`` encodes words that are not known.
        """
        if self.bytes() > self.limit:
            self.forget()
        parts, at = [], 0
        while at < len(text):
            cut = len(text) if len(text) - at <= CHUNK else text.rfind(b" ", at, at + CHUNK) + 1
            if cut <= at:  # a word longer than a chunk
                cut = text.find(b" ", at) + 1
                ids = np.array(learn([text[at:cut - 1]])[0], np.uint32)
                parts.append((np.array([at]), np.array([len(ids)]), ids))
            else:
                starts, lengths, ids = self._chunk(text[at:cut], learn)
                parts.append((starts + at, lengths, ids))
            at = cut
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _chunk(self, text: bytes, learn: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = np.frombuffer(text, np.uint8)
        starts, ends = spans(data)
        key, check = hashes(data, starts, ends)
        wanted, first, place = np.unique(key, return_index=True, return_inverse=True)
        rows = self.rows_of(wanted)
        long = (ends - starts)[first] > LONGEST
        new = np.flatnonzero((rows < 0) & ~long)
        words = [text[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
        added = self.add(learn(words), check[first[new]])
        rows[new] = added
        self.keep(wanted[new], added)

        # From here on rows that serve this chunk only.
        kept, row = len(self.check), rows[place]
        known = np.frombuffer(self.check, np.uint32)[row] == check if kept else np.zeros(len(row), bool)
        apart = np.flatnonzero((row < 0) | ~known)
        if len(apart):
            words = [text[a:b] for a, b in zip(starts[apart].tolist(), ends[apart].tolist())]
            row[apart] = self.add(learn(words), check[apart])
        stops = np.array(self.ends)
        lengths = stops[row + 1] - stops[row]
        ids = gather(np.frombuffer(self.ids, np.uint32), stops[row], lengths) if len(self.ids) else np.zeros(0, np.uint32)
        del self.check[kept:], self.ends[kept + 1:], self.ids[self.ends[kept]:]
        return starts, lengths, ids
