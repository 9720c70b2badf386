"""Simple-8b: integers packed into 64-bit words, a selector in the top four bits of each.

A selector names how many values of how many bits share the 60 other bits. The
first two stand for runs of zeros, the last one is the escape: the word gives
the low 60 bits of one value, and the word after it the high four. Values are
packed greedily; blocks of ``BLOCK`` values are packed each for itself, so all
blocks of a call advance together, and any block can be decoded alone from its
offset. Coding and decoding are loops over words of a block or over selectors,
never over values.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
# Fixed by the format: values per word and bits per value, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 15
LOW = np.uint64((1 << 60) - 1)


def bit_lengths(values: np.ndarray) -> np.ndarray:
    if not len(values) or values.max() < 1 << 53:
        return np.frexp(values.astype(np.float64))[1].astype(np.uint8)
    high = values >> np.uint64(32)
    low = values & np.uint64((1 << 32) - 1)
    return np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1],
                    np.frexp(low.astype(np.float64))[1]).astype(np.uint8)


def best_selectors(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each place the selector that packs most values from there without leaving its block."""
    n = len(values)
    bits = bit_lengths(values)
    least = int(bits.min())
    room = np.minimum(np.repeat(ends, ends - starts) - np.arange(n), 255).astype(np.uint8)
    selector = np.full(n, ESCAPE, np.uint8)
    # The widest of the next ``count`` values, from windows half as long.
    widest, length = bits, 1
    for s in range(ESCAPE, -1, -1):
        count = int(COUNTS[s])
        while length < count <= n:
            step = min(length, count - length)
            widest = np.maximum(widest[:len(widest) - step], widest[step:])
            length += step
        if count > n or least > BITS[s] or s == ESCAPE:
            continue
        fits = (widest <= BITS[s]) & (room[:n - count + 1] >= count)
        selector[:n - count + 1][fits] = s
    return selector


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, offset of each block's first word); the number of values is not stored."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts = np.arange(0, n, BLOCK)
    ends = np.minimum(starts + BLOCK, n)
    selector = best_selectors(values, starts, ends)
    next_place = np.arange(n) + COUNTS[selector]

    # All blocks take one step at a time; the places where words begin come out block by block.
    begins, at, block = [], starts.copy(), np.arange(len(starts))
    while len(at):
        begins.append((block, at))
        at = next_place[at]
        inside = at < ends[block]
        at, block = at[inside], block[inside]
    block = np.concatenate([b for b, _ in begins])
    place = np.sort(np.concatenate([a for _, a in begins]))
    per_block = np.bincount(block, minlength=len(starts))

    chosen = selector[place]
    escaped = (chosen == ESCAPE) & (values[place] > LOW)
    at_word = np.arange(len(place)) + np.concatenate(([0], np.cumsum(escaped)[:-1]))
    words = np.zeros(len(place) + int(escaped.sum()), np.uint64)
    for s in range(16):
        mine = chosen == s
        if not mine.any():
            continue
        word = np.full(int(mine.sum()), np.uint64(s) << np.uint64(60), np.uint64)
        if s == ESCAPE:
            # A single value; its top bits, if any, go to the next word, marked by selector 0 of an empty run.
            word |= values[place[mine]] & LOW
        elif BITS[s]:
            for k in range(COUNTS[s]):
                word |= values[place[mine] + k] << np.uint64(k * BITS[s])
        words[at_word[mine]] = word
    words[at_word[escaped] + 1] = (np.uint64(1) << np.uint64(59)) | (values[place[escaped]] >> np.uint64(60))
    extra = np.bincount(np.searchsorted(starts, place[escaped], side="right") - 1, minlength=len(starts))
    lengths = per_block + extra
    return words, np.cumsum(lengths) - lengths


def unpack(words: np.ndarray) -> np.ndarray:
    """All values of consecutive words, from the first word of a block on."""
    words = np.ascontiguousarray(words, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    tail = (selector == 0) & ((words >> np.uint64(59)) & np.uint64(1) == 1)
    counts = np.where(tail, 0, COUNTS[selector])
    ends = np.cumsum(counts)
    values = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for s in range(2, 16):
        mine = np.flatnonzero((selector == s))
        if not len(mine):
            continue
        first, mask = ends[mine] - counts[mine], np.uint64((1 << int(BITS[s])) - 1)
        for k in range(COUNTS[s]):
            values[first + k] = (words[mine] >> np.uint64(k * BITS[s])) & mask
    escaped = np.flatnonzero(tail)
    values[ends[escaped] - 1] |= (words[escaped] & np.uint64(15)) << np.uint64(60)
    return values


def some(words: np.ndarray, offsets: np.ndarray, start: int, end: int) -> np.ndarray:
    """The values from ``start`` to ``end``, from the words of their blocks alone."""
    if start >= end:
        return np.zeros(0, np.uint64)
    first, last = start // BLOCK, (end - 1) // BLOCK
    stop = offsets[last + 1] if last + 1 < len(offsets) else len(words)
    return unpack(words[offsets[first]:stop])[start - first * BLOCK:end - first * BLOCK]
