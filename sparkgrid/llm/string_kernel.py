"""A gap-weighted subsequence kernel on short windows of letters, with vectorized evaluation.

Texts become letter codes: case, rare letters and runs of white space are
folded, and signs that are neither are left out. A window is represented by all its subsequences
of ``ORDER`` letters that span at most ``SPAN`` places, each weighted by ``DECAY``
for every place skipped; so a letter or space put between two others lowers the
weight of a feature but does not remove it. The kernel of two windows is the
inner product of these weights (Lodhi et al., 2002).

The features of a window are those that start at each of its places, so a
linear decision over landmarks is a sum over places of one table of weights:
whole texts are scored by a few table lookups per character.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

ORDER = 4
SPAN = 7
DECAY = 0.7
WINDOW = 10                      # places at which the features of a window start
# Places of the second to last letter of a subsequence after its first, and its weight.
STEPS = [(after, DECAY ** (after[-1] - ORDER + 1)) for after in combinations(range(1, SPAN), ORDER - 1)]

GAP, LETTERS = 0, 48             # codes: 0 white space, 1..47 letters, 48 break between texts
LEFT_OUT = 255
OTHER_LETTER, BREAK = LETTERS - 1, LETTERS
SIZE = LETTERS + 1
SEPARATOR = "\0" * (WINDOW + SPAN)
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}
PLANE = 0x30000
CHUNK = 1 << 16
BLOCK_ROWS = 2048


def letter_codes(letters: str) -> np.ndarray:
    """Code of each character: the given lower-case letters by rank, other letters share one code."""
    codes = np.full(PLANE, LEFT_OUT, np.uint8)
    for point in range(PLANE):
        if chr(point).isalpha():
            codes[point] = OTHER_LETTER
        elif chr(point).isspace():
            codes[point] = GAP
    for rank, letter in enumerate(letters[:OTHER_LETTER - 1], start=1):
        for form in (letter, letter.upper()):
            if len(form) == 1 and ord(form) < PLANE:
                codes[ord(form)] = rank
    for sign, letter in LOOKALIKES.items():
        codes[ord(sign)] = codes[ord(letter)]
    codes[0] = BREAK
    return codes


def encode(texts: list[str], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all texts in one stream, the place where each sentence starts, and its text's number.

    Each text has at least one sentence. A run of white space is one place. A
    sentence ends with a line, or with . ! ? before white space.
    """
    parts = [t.replace("\0", " ") + SEPARATOR for t in texts]
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    points = np.frombuffer("".join(parts).encode("utf-32-le", "replace"), np.uint32)
    code = codes[np.minimum(points, PLANE - 1)]
    keep = code != LEFT_OUT
    rest = np.flatnonzero(keep)
    again = (code[rest[1:]] == GAP) & (code[rest[:-1]] == GAP)
    keep[rest[1:][again]] = False

    line = points == 10
    stop = (points == 46) | (points == 33) | (points == 63)
    stop[:-1] &= (points[1:] == 32) | (points[1:] == 10)
    opens = np.zeros(len(code) + 1, bool)
    opens[1:] = line | stop
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    opens[starts] = True
    opens[-1] = False
    at = np.flatnonzero(opens)
    owner = np.searchsorted(starts, at, side="right") - 1
    place = np.concatenate(([0], np.cumsum(keep)))
    return code[keep], place[at], owner


def window_scores(code: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each place the sum of the weights of the features that start in the window from there.

    Windows do not start between texts: those places score minus infinity.
    """
    n = len(code)
    running = np.zeros(n + WINDOW + 1)
    padded = np.concatenate((code, np.full(SPAN, BREAK, np.uint8))).astype(np.int32)
    for start in range(0, n, CHUNK):
        part = padded[start:min(start + CHUNK, n) + SPAN]
        m = len(part) - SPAN
        shifted = [part * SIZE ** k for k in range(ORDER - 1, -1, -1)]
        total = np.zeros(m, np.float32)
        for after, weight in STEPS:
            index = shifted[0][:m].copy()
            for letter, step in zip(shifted[1:], after):
                index += letter[step:step + m]
            total += np.float32(weight) * table.take(index)
        running[start + 1:start + m + 1] = total
    np.cumsum(running, out=running)
    scores = running[WINDOW:WINDOW + n] - running[:n]
    scores[code == BREAK] = -np.inf  # such windows reach into the next text
    return scores


def sentence_best(scores: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Highest window score of each sentence; sentences without a place of their own score that of the next place."""
    return np.maximum.reduceat(scores, np.minimum(starts, len(scores) - 1))


def windows_at(code: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The codes of the windows that start at ``places``, one row each."""
    padded = np.concatenate((code, np.full(WINDOW + SPAN, BREAK, np.uint8)))
    return padded[places[:, None] + np.arange(WINDOW + SPAN - 1)[None, :]]


def features(windows: np.ndarray):
    """(feature numbers, weight) of all windows, one set of places after another."""
    w = windows.astype(np.int32)
    for i in range(WINDOW):
        for after, weight in STEPS:
            number, breaks = w[:, i], w[:, i] == BREAK
            for step in after:
                number = number * SIZE + w[:, i + step]
                breaks = breaks | (w[:, i + step] == BREAK)
            yield np.where(breaks, -1, number), weight


class Landmarks:
    """Windows whose kernel values with another window stand for it (Nyström)."""

    def __init__(self, windows: np.ndarray):
        numbers = np.unique(np.concatenate([n for n, _ in features(windows)]))
        self.numbers = numbers[numbers >= 0]
        self.local = np.full(SIZE ** ORDER + 1, len(self.numbers), np.int32)
        self.local[self.numbers] = np.arange(len(self.numbers))
        self.weights = np.zeros((len(self.numbers) + 1, len(windows)), np.float32)
        column = np.arange(len(windows))
        for number, weight in features(windows):
            np.add.at(self.weights, (self.local[number], column), weight)
        self.weights[-1] = 0
        values, vectors = np.linalg.eigh(self.kernel(windows).astype(np.float64))
        usable = values > 1e-6 * values.max()
        self.basis = vectors[:, usable] / np.sqrt(values[usable])

    def kernel(self, windows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(windows), self.weights.shape[1]), np.float32)
        for number, weight in features(windows):
            out += np.float32(weight) * self.weights[self.local[number]]
        return out

    def project(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), self.basis.shape[1]), np.float32)
        for start in range(0, len(windows), BLOCK_ROWS):
            part = slice(start, start + BLOCK_ROWS)
            out[part] = self.kernel(windows[part]) @ self.basis
        return out

    def table(self, coefficients: np.ndarray) -> np.ndarray:
        """Weight of each feature under a linear decision on the projected windows."""
        out = np.zeros(SIZE ** ORDER, np.float32)
        out[self.numbers] = self.weights[:-1] @ (self.basis @ coefficients)
        return out


def support_vector_machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float,
                           steps: int = 25) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps in the primal; ``y`` is -1 or 1.

    Gradient and curvature are summed over blocks of rows, so that no copy of ``x`` is made.
    """
    size = x.shape[1] + 1
    ridge = np.full(size, penalty)
    ridge[-1] = 1e-6
    w = np.zeros(size)
    for _ in range(steps):
        gradient, curve = ridge * w, np.diag(ridge)
        for start in range(0, len(x), BLOCK_ROWS):
            part = slice(start, start + BLOCK_ROWS)
            x1 = np.hstack([x[part], np.ones((len(x[part]), 1), x.dtype)]).astype(np.float64)
            short = 1 - y[part] * (x1 @ w)
            active = short > 0
            xa, wa = x1[active], weight[part][active]
            gradient -= xa.T @ (wa * y[part][active] * short[active])
            curve += (xa * wa[:, None]).T @ xa
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], w[-1]


def logistic_regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0,
                        steps: int = 50) -> np.ndarray:
    """Coefficients, the last of them the constant, by Newton steps."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.full(x1.shape[1], penalty)
    ridge[-1] = 1e-6
    w = np.zeros(x1.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        gradient = ridge * w + x1.T @ (weight * (p - y))
        curve = (x1 * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x1 + np.diag(ridge)
        step = np.linalg.solve(curve, gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w
