"""Array arithmetic of the stateful operators: one call per key and micro-batch."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from ..functions.numeric import NORM_DENOMINATOR, NORM_NUMERATOR, NORM_SPLIT, NORM_ZERO, SQRT_TWO_PI
from ..operators.book import DEPTHS, SAMPLE_DEPTH, STRONG, WEAK
from ..operators.flow import (
    BUCKET_VOLUME, LOTS, SIGMA_FLAT, SIGMA_LEAST, SIGMA_UNKNOWN, SIGMA_WINDOW, VPIN_NEUTRAL, VPIN_WINDOW,
)

ROWS_AT_ONCE = 10_000
BUCKETS_AT_ONCE = 1_000_000


def norm_cdf(z: np.ndarray) -> np.ndarray:
    x = np.minimum(np.abs(z), NORM_ZERO)
    density = np.exp(-x * x / 2)
    near = density * np.polyval(NORM_NUMERATOR, x) / np.polyval(NORM_DENOMINATOR, x)
    fraction = x + 0.65
    for k in (4, 3, 2, 1):
        fraction = x + k / fraction
    tail = np.where(x < NORM_SPLIT, near, density / fraction / SQRT_TWO_PI)
    tail = np.where(np.abs(z) > NORM_ZERO, 0.0, tail)
    return np.where(z > 0, 1 - tail, tail)


def trailing_windows(history: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """For each value the window of the last ``n`` values up to it, NaN where there are fewer."""
    seen = np.concatenate([history, values])
    padded = np.concatenate([np.full(n - 1, np.nan), seen])
    return np.lib.stride_tricks.sliding_window_view(padded, n)[len(history):]


def sigmas(history: np.ndarray, changes: np.ndarray) -> np.ndarray:
    windows = trailing_windows(history, changes, SIGMA_WINDOW)
    out = np.concatenate([
        np.nanstd(windows[i:i + ROWS_AT_ONCE], axis=1) for i in range(0, len(windows), ROWS_AT_ONCE)])
    known = np.minimum(len(history) + 1 + np.arange(len(changes)), SIGMA_WINDOW)
    flat = np.nanmax(windows, axis=1) == np.nanmin(windows, axis=1)  # a mean of equal values may be off by a rounding
    return np.where(known <= SIGMA_LEAST, SIGMA_UNKNOWN, np.where(flat | (out == 0), SIGMA_FLAT, out))


@dataclass
class Closed:
    bucket: np.ndarray
    imbalance: np.ndarray
    vpin: np.ndarray
    closer: np.ndarray  # index of the closing trade


@dataclass
class Flow:
    """What order flow remembers between batches."""

    volume: int = BUCKET_VOLUME
    window: int = VPIN_WINDOW
    last_price: float | None = None
    bucket: int = 0      # number of the open bucket
    filled: int = 0      # lots in it
    signed: float = 0.0  # signed volume in it
    changes: np.ndarray = field(default_factory=lambda: np.empty(0))
    imbalances: np.ndarray = field(default_factory=lambda: np.empty(0))

    def take(self, price: np.ndarray, full: np.ndarray, rest: np.ndarray) -> Closed:
        """Trades in order, their volume as whole buckets and lots left over -> the buckets they close."""
        none = np.empty(0)
        closed = [Closed(none.astype(int), none, none, none.astype(int)), *self.steps(price, full, rest)]
        return Closed(*[np.concatenate([getattr(c, f) for c in closed]) for f in ("bucket", "imbalance", "vpin", "closer")])

    def steps(self, price: np.ndarray, full: np.ndarray, rest: np.ndarray) -> Iterator[Closed]:
        """``take`` in parts of some ``BUCKETS_AT_ONCE`` buckets, also where one trade fills more than that."""
        start = 0
        if self.last_price is None and len(price):
            self.last_price, start = float(price[0]), 1  # the first trade only sets the price
        price, full, rest = price[start:], full[start:], rest[start:]
        if not len(price):
            return
        changes = np.diff(price, prepend=self.last_price)
        tilt = 2 * norm_cdf(changes / sigmas(self.changes, changes)) - 1
        self.last_price = float(price[-1])
        self.changes = np.concatenate([self.changes, changes])[-SIGMA_WINDOW:]
        # a trade over many buckets counts as several of the same tilt
        parts = np.maximum(1, -(-full // BUCKETS_AT_ONCE))
        trade = np.repeat(np.arange(len(full)), parts)
        last = np.cumsum(parts) - 1
        some = np.full(len(trade), BUCKETS_AT_ONCE)
        some[last] = full - (parts - 1) * BUCKETS_AT_ONCE
        left = np.zeros(len(trade), dtype=np.int64)
        left[last] = rest
        reach = np.cumsum(some + 1)
        # so few at once that their lots add up to less than 63 bits
        most = max(1, min(ROWS_AT_ONCE, (1 << 62) // (self.volume * LOTS)))
        i = 0
        while i < len(trade):
            far = int(np.searchsorted(reach, (reach[i - 1] if i else 0) + 2 * BUCKETS_AT_ONCE, side="right"))
            j = min(max(far, i + 1), i + most)
            closed = self._fill(tilt[trade[i:j]], some[i:j], left[i:j])
            closed.closer = trade[i:j][closed.closer] + start
            yield closed
            i = j

    def _fill(self, tilt: np.ndarray, full: np.ndarray, rest: np.ndarray) -> Closed:
        """Buckets are counted from the open one; no sum of lots leaves ``len(tilt)`` buckets."""
        size = self.volume * LOTS
        lots = self.filled + np.cumsum(rest)
        bucket, filled = np.cumsum(full) + lots // size, lots % size  # after each trade
        borrow = rest > filled
        first, begin = bucket - full - borrow, filled - rest + size * borrow
        last, end = bucket - (filled == 0), np.where(filled == 0, size, filled)
        traded = np.flatnonzero((full > 0) | (rest > 0))
        count = (last - first + 1)[traded]
        trade = np.repeat(traded, count)
        piece_of = np.repeat(first[traded], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        piece = np.where(piece_of == last[trade], end[trade], size) - np.where(piece_of == first[trade], begin[trade], 0)
        total = int(bucket[-1])
        signed = np.bincount(piece_of, weights=piece / LOTS * tilt[trade], minlength=total + 1)
        signed[0] += self.signed
        imbalance = np.abs(signed[:total])
        closer = np.searchsorted(piece_of, np.arange(total), side="right") - 1
        vpin = np.empty(0)
        if total:
            windows = trailing_windows(self.imbalances, imbalance, self.window)
            vpin = np.where(np.isnan(windows[:, 0]), VPIN_NEUTRAL, windows.sum(axis=1) / (self.window * self.volume))
        out = Closed(self.bucket + np.arange(total), imbalance, vpin, trade[closer])
        self.imbalances = np.concatenate([self.imbalances, imbalance])[-self.window:]
        self.bucket += total
        self.filled = int(filled[-1])
        self.signed = float(signed[total])
        return out


def newer(ids: np.ndarray, last: int | None) -> np.ndarray:
    """Which ids are above every id before them (and above ``last``)."""
    floor = np.iinfo(np.int64).min if last is None else last
    before = np.maximum.accumulate(np.concatenate([[floor], ids[:-1]]))
    return ids > before


def table_of(best: list[tuple[np.ndarray, np.ndarray]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Best price (NaN: none) and quantities, filled up with zeros, of many books' sides."""
    top, qty = np.full(len(best), np.nan), np.zeros((len(best), depth))
    for i, (price, q) in enumerate(best):
        if len(price):
            top[i] = price[0]
            qty[i, :len(q)] = q
    return top, qty


def lean(bid: np.ndarray, ask: np.ndarray) -> np.ndarray:
    total = bid + ask
    return np.where(total != 0, (bid - ask) / np.where(total != 0, total, 1), 0.0)


def features(bids: list[tuple[np.ndarray, np.ndarray]], asks: list[tuple[np.ndarray, np.ndarray]],
             depth: int = SAMPLE_DEPTH) -> dict[str, np.ndarray]:
    """Book features of many books, each side as (prices, quantities), best first.

    ``mid_price`` is NaN for a one-sided book.
    """
    (bid, bq), (ask, aq) = table_of(bids, depth), table_of(asks, depth)
    out = {f"obi_L{d}": lean(bq[:, :d].sum(1), aq[:, :d].sum(1)) for d in DEPTHS}
    for name, rate in (("strong", STRONG), ("weak", WEAK)):
        weight = np.exp(-rate * np.arange(depth))
        out[f"obi_weighted_{name}"] = lean(bq @ weight, aq @ weight)
    gap, mid, top = ask - bid, (ask + bid) / 2, bq[:, 0] + aq[:, 0]
    micro = np.where(top != 0, (ask * bq[:, 0] + bid * aq[:, 0]) / np.where(top != 0, top, 1), mid)
    return out | {
        "spread_absolute": gap, "spread_relative": gap / ask,
        "spoofing_divergence": out["obi_L1"] - out[f"obi_L{SAMPLE_DEPTH}"],
        "mid_price": mid, "micro_price": micro, "micro_dev": micro - mid,
    }
