"""Words of many texts as numpy arrays, at most about ``MOST`` bytes of text at a time.

Short texts share a window. A longer one is cut into several, each with whole words from the windows
beside it, so that runs of words across a cut are seen exactly once: by the window that owns the first
word. Memory follows ``MOST`` and the longest single word, not the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from .words import LOWER, mixed

MOST = 1 << 20
SHORT = 16  # bytes of a word that fit in two 64-bit numbers


@dataclass
class Window:
    data: np.ndarray  # bytes, with one "\n" after each text
    doc: np.ndarray   # number of each word's text
    start: np.ndarray
    end: np.ndarray
    first: int        # words first .. last - 1 are owned
    last: int

    @property
    def own(self) -> np.ndarray:
        out = np.zeros(len(self.start), dtype=bool)
        out[self.first : self.last] = True
        return out


def edges(is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    step = np.diff(is_word.view(np.int8), prepend=0, append=0)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _ahead(data: np.ndarray, word: np.ndarray, at: int, words: int) -> int:
    """A place outside words, at least ``words`` whole words that start after ``at`` before it (or the end)."""
    size = 4096
    while at + size < len(data):
        ends = edges(word[data[at : at + size]])[1]
        ends = ends[ends < size]
        if len(ends) > words + 1:
            return at + int(ends[words + 1])
        size *= 2
    return len(data)


def _back(data: np.ndarray, word: np.ndarray, at: int, words: int) -> int:
    """The start of a word with at least ``words`` words between it and the word around ``at``."""
    size = 4096
    while at - size > 0:
        starts = edges(word[data[at - size : at]])[0]
        starts = starts[starts > 0]
        if len(starts) > words + 1:
            return at - size + int(starts[-words - 2])
        size *= 2
    return 0


def windows(texts: list[bytes], word: np.ndarray, before: int, after: int, most: int = MOST) -> Iterator[Window]:
    """``word``: which byte values belong to words ("\\n" must not); ``before``, ``after``: words seen besides the owned ones."""

    def made(parts: list[bytes], numbers: list[int]) -> Window:
        data = np.frombuffer(b"\n".join([*parts, b""]), dtype=np.uint8)
        ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1)
        start, end = edges(word[data])
        doc = np.asarray(numbers, dtype=np.int64)[np.searchsorted(ends, start, side="right")]
        return Window(data, doc, start, end, 0, len(start))

    held, numbers, size = [], [], 0
    for i, text in enumerate(texts):
        if held and size + len(text) > most:
            yield made(held, numbers)
            held, numbers, size = [], [], 0
        if len(text) <= most:
            held.append(text)
            numbers.append(i)
            size += len(text)
            continue
        data = np.frombuffer(text, dtype=np.uint8)
        for lo in range(0, len(text), most):
            hi = min(lo + most, len(text))
            a = _back(data, word, lo, before) if lo else 0
            part = made([text[a : _ahead(data, word, hi, after)]], [i])
            part.first, part.last = (int(x) for x in np.searchsorted(part.start + a, (lo, hi)))
            yield part
    if held:
        yield made(held, numbers)


def word_hashes(w: Window, low: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes in ``low``."""
    size = w.end - w.start
    place = w.start[:, None] + np.arange(SHORT)
    held = np.where(np.arange(SHORT) < size[:, None], low[np.minimum(place, len(low) - 1)], np.uint8(0))
    both = np.ascontiguousarray(held).view("<u8").reshape(-1, 2)
    with np.errstate(over="ignore"):
        out = mixed(mixed(both[:, 0], 3) ^ (mixed(both[:, 1], 5) + size.astype(np.uint64)), 7)
    for i in np.flatnonzero(size > SHORT):
        digest = hashlib.blake2b(low[w.start[i] : w.end[i]].tobytes(), digest_size=8).digest()
        out[i] = np.frombuffer(digest, dtype="<u8")[0]
    return out


def lower(w: Window) -> np.ndarray:
    return LOWER[w.data]
