"""Word positions, word hashes and shingle hashes of many texts at once, as numpy arrays.

Words are the runs of bytes outside ``0x20, 0x09-0x0D`` of the UTF-8 text with A-Z lower-cased.
"""

from __future__ import annotations

import numpy as np

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Odd multipliers of the polynomial hashes, chosen at random; results do not depend on them.
BASE, STEP = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & int(MASK))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE`` to the powers 0 .. n - 1 and to 0 .. -(n - 1), modulo 2^64."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(1 << 16, n + n // 16)
        _powers, _inverses = (np.full(size, x, dtype=np.uint64) for x in (BASE, pow(BASE, -1, 1 << 64)))
        _powers[0] = _inverses[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(_powers, out=_powers)
            np.multiply.accumulate(_inverses, out=_inverses)
    return _powers[:n], _inverses[:n]


BYTE_VALUES = mixed(np.arange(256, dtype=np.uint64), 7)  # a random number for each byte


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """``h`` with the hash of ``data[a:b]``, bytes or 64-bit hashes, as ``(h[b] - h[a]) * BASE^-a``."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((BYTE_VALUES[data] if data.dtype == np.uint8 else data) * up[:-1], out=out[1:])
    return out


class Words:
    """The words of a batch of texts. ``doc`` numbers the text of each word, ``hash`` is the word's 64-bit hash."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        ends = np.cumsum(sizes)
        low = LOWER[data]
        gap = SPACE[low]
        edge = np.diff(gap.astype(np.int8), prepend=1, append=1)
        self.start, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.data = low
        self.doc = np.searchsorted(ends, self.start, side="right")
        self.n_docs = len(texts)
        sums = prefix_hashes(low)
        with np.errstate(over="ignore"):
            raw = (sums[self.end] - sums[self.start]) * powers(len(data) + 1)[1][self.start]
        self.hash = mixed(raw + (self.end - self.start).astype(np.uint64))
        self.counts = np.bincount(self.doc, minlength=self.n_docs)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])  # of each text's words

    def shingles(self, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of the distinct shingles: ``size`` words, or all words of a shorter text; sorted by both."""
        n = len(self.hash)
        value = np.zeros(n, dtype=np.uint64)
        doc = self.doc
        with np.errstate(over="ignore"):
            long = np.zeros(n, dtype=bool)
            if n >= size:
                total = np.zeros(n - size + 1, dtype=np.uint64)
                for i in range(size):
                    total = mixed(total * np.uint64(STEP) + self.hash[i : n - size + 1 + i], i)
                value[: n - size + 1] = total
                long[: n - size + 1] = doc[: n - size + 1] == doc[size - 1 :]
            few = np.flatnonzero((self.counts > 0) & (self.counts < size))
            first = self.first[few]
            short = np.zeros(len(few), dtype=np.uint64)
            for i in range(size - 1):
                has = self.counts[few] > i
                at = np.minimum(first + i, max(n - 1, 0))
                short = np.where(has, mixed(short * np.uint64(STEP) + self.hash[at], i), short) if n else short
            short = mixed(short, 99)
        docs = np.concatenate([doc[long], few])
        values = np.concatenate([value[long], short])
        order = np.lexsort((values, docs))
        docs, values = docs[order], values[order]
        new = np.ones(len(docs), dtype=bool)
        new[1:] = (docs[1:] != docs[:-1]) | (values[1:] != values[:-1])
        return docs[new], values[new]
