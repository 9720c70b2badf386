"""Texts as pieces that a tokenizer treats independently, and ragged arrays of their ids.

The byte-level pattern puts a single space between two other characters at the
start of what follows it, and no match reaches across. Texts are cut there: a
piece is a run of pre-tokens, with its leading space unless it starts the text.
Runs of white space stay inside a piece. These helpers run inside tasks.
"""

from __future__ import annotations

import base64
import json
import os
import re

import numpy as np

# White space other than single spaces and line feeds, by Python's wider definition.
ODD_SPACE = re.compile(
    r"[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|\x20\x20|\n\x20|\x20\n")
SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def cut(text: str) -> list[str]:
    """Pieces of a text without their leading spaces; the first one has none."""
    if ODD_SPACE.search(text):
        return SINGLE_SPACE.split(text)
    return text.split(" ")


class Ragged:
    """Rows of numbers of varying length, in one array; rows are only added."""

    def __init__(self, dtype=np.uint32):
        self.values = np.zeros(1 << 12, dtype)
        self.ends = np.zeros(1 << 10, np.int64)
        self.rows = 0

    def __len__(self) -> int:
        return self.rows

    def append(self, row) -> None:
        start = int(self.ends[self.rows])
        end = start + len(row)
        while end > len(self.values):
            self.values = np.concatenate((self.values, np.zeros_like(self.values)))
        if self.rows + 2 > len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
        self.values[start:end] = row
        self.rows += 1
        self.ends[self.rows] = end

    def row(self, k: int) -> np.ndarray:
        return self.values[self.ends[k]:self.ends[k + 1]]

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chosen rows one after another, and their lengths."""
        starts = self.ends[rows]
        lengths = self.ends[rows + 1] - starts
        return gather(self.values, starts, lengths), lengths


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Slices of ``values`` one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    shift = np.repeat(starts - ends + lengths, lengths)
    return values[np.arange(total) + shift]


def row_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of ``counts`` values."""
    running = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(counts)
    return running[ends] - running[ends - counts]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, from a file of base64 tokens."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def added_tokens(path: str) -> list[str]:
    with open(path, encoding="utf-8") as file:
        return [t["content"] for t in json.load(file).get("added_tokens", [])]
