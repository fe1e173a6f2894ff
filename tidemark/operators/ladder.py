"""One side of a book as a sorted array that changes by single levels.

Used inside tasks: by the batch sampler on the levels of one block, by the stream on live state.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np

Best = tuple[np.ndarray, np.ndarray]  # prices and quantities, best first


class Ladder:
    """Prices of a side in order, best first, with their quantities.

    With ``refill`` only the best levels are held, between ``keep`` and twice as many. Levels
    beyond ``floor`` are then known to ``refill`` alone, which gives all levels of the side and
    is asked only when too few of the held ones are left. ``log`` gets every change.
    """

    def __init__(self, bids: bool, refill: Callable[[], dict[float, float]] | None = None, keep: int = 0):
        self.sign = -1.0 if bids else 1.0
        self.keys: list[float] = []
        self.qty: dict[float, float] = {}
        self.refill, self.keep = refill, keep
        self.floor = np.inf  # sort value beyond which levels are not held
        self.log: dict[float, float] | None = None

    def load(self, levels: dict[float, float]) -> None:
        """Replace all levels; with a limit, hold the best."""
        keys = sorted(self.sign * p for p in levels)
        self.floor = np.inf
        if self.refill is not None and len(keys) > self.keep:
            keys = keys[:self.keep]
            self.floor = keys[-1]
        self.keys = keys
        self.qty = {k: levels[self.sign * k] for k in keys}

    def restore(self, levels: dict[float, float], floor: float) -> None:
        """Take up the held levels of an earlier ladder."""
        self.qty = {self.sign * p: q for p, q in levels.items()}
        self.keys = sorted(self.qty)
        self.floor = floor

    def put(self, price: float, qty: float) -> None:
        """Set a level; quantity 0 removes it."""
        if self.log is not None:
            self.log[price] = qty
        key = self.sign * price
        if key > self.floor:
            return
        if qty > 0:
            if key not in self.qty:
                insort(self.keys, key)
            self.qty[key] = qty
            if self.refill is not None and len(self.keys) > 2 * self.keep:
                for k in self.keys[self.keep:]:
                    del self.qty[k]
                del self.keys[self.keep:]
                self.floor = self.keys[-1]
        elif self.qty.pop(key, None) is not None:
            del self.keys[bisect_left(self.keys, key)]

    def best(self, depth: int | None) -> Best:
        if self.floor < np.inf and len(self.keys) < (depth or 0):
            self.load(self.refill())
        keys = self.keys if depth is None else self.keys[:depth]
        return np.array([self.sign * k for k in keys]), np.array([self.qty[k] for k in keys])

    def lasting(self, depth: int, gone: set[float]) -> Best:
        """The best levels, as far as ``depth`` of them are not in ``gone``; levels beyond do not matter while those go."""
        def reach(keys: list[float]) -> int | None:
            left = 0
            for i, k in enumerate(keys):
                left += self.sign * k not in gone
                if left == depth:
                    return i + 1
            return None

        keys, qty, n = self.keys, self.qty, reach(self.keys)
        if n is None and self.floor < np.inf:
            levels = self.refill()
            self.load(levels)
            keys = sorted(self.sign * p for p in levels)
            qty, n = {self.sign * p: q for p, q in levels.items()}, reach(keys)
        keys = keys[:n]
        return np.array([self.sign * k for k in keys]), np.array([qty[k] for k in keys])


def walk(bids: Ladder, asks: Ladder, at: np.ndarray, is_bid: np.ndarray, price: np.ndarray, qty: np.ndarray,
         start: int, last: int, depth: int | None) -> Iterator[tuple[int, int, Best, Best]]:
    """Changes in order (``at``: the first sample that sees them) -> (first sample, number of samples, best bids,
    best asks) for ``start`` to ``last``, a row only where something changed. All changes up to ``last`` are applied."""
    use = at <= last
    at, is_bid, price, qty = (x[use] for x in (at, is_bid, price, qty))
    edges = np.flatnonzero(np.diff(at, prepend=at[0] - 1)) if len(at) else np.empty(0, dtype=int)
    starts = [max(int(a), start) for a in at[edges]]
    best_bids = best_asks = None  # NULL: not known as it is now
    if start <= last and (not starts or starts[0] > start):
        best_bids, best_asks = bids.best(depth), asks.best(depth)
        yield start, (starts[0] if starts else last + 1) - start, best_bids, best_asks
    sides = [bids if b else asks for b in is_bid.tolist()]
    price, qty = price.tolist(), qty.tolist()
    ends = [*edges[1:].tolist(), len(at)]
    of_bids, of_asks = ((np.logical_or.reduceat(x, edges).tolist() if len(edges) else []) for x in (is_bid, ~is_bid))
    for i, (a, b) in enumerate(zip(edges.tolist(), ends)):
        for j in range(a, b):
            sides[j].put(price[j], qty[j])
        best_bids, best_asks = None if of_bids[i] else best_bids, None if of_asks[i] else best_asks
        until = starts[i + 1] if i + 1 < len(starts) else last + 1
        if until > starts[i]:
            best_bids = bids.best(depth) if best_bids is None else best_bids
            best_asks = asks.best(depth) if best_asks is None else best_asks
            yield starts[i], until - starts[i], best_bids, best_asks
