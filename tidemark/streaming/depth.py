"""Depth messages inside a stateful operator: which of them count, and the book they leave in state.

The rules are those of ``operators.epochs``: a snapshot replaces the book, messages that waited for
it are replayed, stale ids don't count.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from ..operators.book import ASK, BID
from ..operators.ladder import Best, Ladder, walk
from .arrays import newer

KEPT_LEVELS = 100  # of a side that travel with the clock; deeper ones stay in the state store

FIELDS = pa.schema([
    ("ts", pa.int64()), ("seq", pa.int64()), ("is_snapshot", pa.bool_()), ("u", pa.int64()),
    *[(c, pa.list_(pa.float64())) for c in ("bp", "bq", "ap", "aq")],
])


def sides_as_doubles(bids: str = "b", asks: str = "a") -> list[Column]:
    """Both sides' [price, qty] texts as arrays of doubles, parsed before Python sees them."""
    def numbers(side: str, i: int) -> Column:
        return F.coalesce(F.transform(side, lambda e: F.get(e, F.lit(i)).cast("double")), F.array().cast("array<double>"))

    return [numbers(s, i).alias(n) for n, s, i in (("bp", bids, 0), ("bq", bids, 1), ("ap", asks, 0), ("aq", asks, 1))]


def packed(rows: pd.DataFrame | pa.Table, schema: pa.Schema = FIELDS) -> bytes:
    sink = pa.BufferOutputStream()
    table = rows if isinstance(rows, pa.Table) else pa.Table.from_pandas(rows[schema.names], schema=schema, preserve_index=False)
    with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(blobs: list[bytes], schema: pa.Schema = FIELDS) -> pd.DataFrame:
    tables = [pa.ipc.open_stream(b).read_all() for b in blobs]
    return pa.concat_tables([schema.empty_table(), *tables]).to_pandas()


class Waiting:
    """Rows kept in state in the batches they came in, each with its newest time."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, schema: pa.Schema = FIELDS):
        self.rows = handle.getListState(name, "newest bigint, rows binary")
        self.schema = schema

    def add(self, rows: pd.DataFrame) -> None:
        if len(rows):
            self.rows.appendValue((int(rows["ts"].max()), packed(rows, self.schema)))

    def all(self) -> pd.DataFrame:
        return unpacked([bytes(b) for _, b in self.rows.get()] if self.rows.exists() else [], self.schema)

    def forget(self, before: int) -> None:
        """Drop the batches that are wholly older."""
        held = [(int(t), bytes(b)) for t, b in self.rows.get()] if self.rows.exists() else []
        kept = [x for x in held if x[0] >= before]
        if len(kept) < len(held):
            self.replace(kept)

    def replace(self, held: list[tuple[int, bytes]]) -> None:
        if held:
            self.rows.put(held)
        elif self.rows.exists():
            self.rows.clear()


@dataclass
class Segment:
    """Messages that count in one epoch, as rows of a table with the time they take effect.

    ``snapshot``, a row as well, opens it; NULL continues the epoch before."""

    snapshot: int | None
    rows: np.ndarray
    ts: np.ndarray


def segments(depth: pd.DataFrame, last: int | None, recent: pd.DataFrame, resync: int) -> tuple[pd.DataFrame, list[Segment], int | None]:
    """Rows in order of (seq, snapshots first) -> the table that epochs point into, the epochs and the last id.

    ``recent``: messages before them that a snapshot may replay. ``last`` is NULL as long as there was no snapshot;
    ``resync`` in microseconds. A snapshot looks only at the messages from the first one on that is young enough."""
    table = pd.concat([recent, depth], ignore_index=True) if len(recent) else depth.reset_index(drop=True)
    snap = table["is_snapshot"].to_numpy(dtype=bool)
    ts, u = table["ts"].to_numpy(), table["u"].to_numpy()
    newest = np.maximum.accumulate(ts) if len(ts) else ts
    out = []
    edges = [len(recent), *np.flatnonzero(snap).tolist(), len(table)]
    for i in range(len(edges) - 1):
        a, b = edges[i], edges[i + 1]
        rows = np.arange(a + 1 if i else a, b)
        at = ts[rows]
        if i:
            since = 0 if last is None else int(np.searchsorted(newest[:a], ts[a] - resync))
            waited = ~snap[since:a] & (u[since:a] > u[a])
            if last is not None:
                waited &= ts[since:a] >= ts[a] - resync
            replayed = since + np.flatnonzero(waited)
            rows, at = np.concatenate([replayed, rows]), np.concatenate([np.maximum(ts[replayed], ts[a]), at])
            last = int(u[a])
        if last is None or (not i and not len(rows)):
            continue
        if len(rows):
            ids = u[rows]
            counts = newer(ids, last)
            rows, at, last = rows[counts], at[counts], max(last, int(ids.max()))
        out.append(Segment(a if i else None, rows, at))
    return table, out, last


class Levels:
    """The entries of all rows of a table, parsed once; those of some rows are picked by number."""

    def __init__(self, table: pd.DataFrame):
        row, self.is_bid, self.price, self.qty = levels_of(table)
        self.first = np.searchsorted(row, np.arange(len(table) + 1))

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``rows``, is bid, price, qty)."""
        size = self.first[rows + 1] - self.first[rows]
        at = np.repeat(self.first[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.repeat(np.arange(len(rows)), size), self.is_bid[at], self.price[at], self.qty[at]


def levels_of(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, is bid, price, qty) of all entries, in the order of the messages and of the entries in them."""
    parts = []
    for bid, prices, qtys in ((True, "bp", "bq"), (False, "ap", "aq")):
        sizes = np.fromiter(map(len, rows[prices].tolist()), np.int64, len(rows))
        if sizes.sum():
            parts.append((np.repeat(np.arange(len(rows)), sizes), np.full(sizes.sum(), bid),
                          np.concatenate(rows[prices].tolist()), np.concatenate(rows[qtys].tolist())))
    if not parts:
        return np.empty(0, np.int64), np.empty(0, bool), np.empty(0), np.empty(0)
    row, is_bid, price, qty = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(row, kind="stable")
    return row[order], is_bid[order], price[order], qty[order]


class LiveBook:
    """Both sides of a symbol's book: all levels in map state, the best ones in one value next to it.

    Only levels that changed are written. The deeper levels are read when so many of the best
    have gone that the wanted depth is not held any more.
    """

    def __init__(self, handle: StatefulProcessorHandle, depth: int, keep: int = KEPT_LEVELS):
        self.depth, self.keep = depth, max(keep, depth)
        self.levels = {s: handle.getMapState(f"levels_{s}", "price double", "qty double") for s in (BID, ASK)}
        numbers = ", ".join(f"{s}{x} array<double>" for s in (BID, ASK) for x in ("p", "q"))
        self.top = handle.getValueState("top", f"{numbers}, b_floor double, a_floor double")

    def load(self) -> None:
        self.replaced = False
        self.sides = {s: Ladder(s == BID, lambda s=s: self._all(s), self.keep) for s in (BID, ASK)}
        if self.top.exists():
            bp, bq, ap, aq, b_floor, a_floor = self.top.get()
            for s, p, q, floor in ((BID, bp, bq, b_floor), (ASK, ap, aq, a_floor)):
                self.sides[s].restore(dict(zip(map(float, p), map(float, q))), float(floor))
        for side in self.sides.values():
            side.log = {}

    def _all(self, s: str) -> dict[float, float]:
        stored = {} if self.replaced else {p: q for (p,), (q,) in self.levels[s].iterator()}
        return {p: q for p, q in (stored | self.sides[s].log).items() if q > 0}

    def restart(self) -> None:
        """Forget all levels: a snapshot follows."""
        self.replaced = True
        for side in self.sides.values():
            side.load({})
            side.log = {}

    def apply(self, is_bid: np.ndarray, price: np.ndarray, qty: np.ndarray) -> None:
        """Changes in order; only the last one of a level is made."""
        for s, of_side in ((BID, is_bid), (ASK, ~is_bid)):
            latest, at = np.unique(price[of_side][::-1], return_index=True)
            for p, q in zip(latest.tolist(), qty[of_side][::-1][at].tolist()):
                self.sides[s].put(p, q)

    def walk(self, at: np.ndarray, is_bid: np.ndarray, price: np.ndarray, qty: np.ndarray, first: int, last: int) -> list[tuple[int, int, Best, Best]]:
        """Changes (``at``: the first sample that sees them) up to ``last`` -> the books of the samples first to last."""
        return list(walk(self.sides[BID], self.sides[ASK], at, is_bid, price, qty, first, last, self.depth))

    def save(self) -> None:
        for s, state in self.levels.items():
            side = self.sides[s]
            if self.replaced:
                state.clear()
            for price, qty in side.log.items():
                if qty > 0:
                    state.updateValue((price,), (qty,))
                elif not self.replaced:
                    state.removeKey((price,))
        held = [self.sides[s] for s in (BID, ASK)]
        values = [x for side in held for x in ([side.sign * k for k in side.keys], [side.qty[k] for k in side.keys])]
        self.top.update((*values, *[float(side.floor) for side in held]))


def in_order(batches: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    return pd.concat(list(batches), ignore_index=True).sort_values(list(by), kind="stable", ignore_index=True)


RUN_ROWS, PIECE_ROWS = 100_000, 5_000  # rows of a sorted run; rows of each run in memory at once


def rows_at_once() -> int:
    return RUN_ROWS


def sorted_chunks(frames: Iterator[pd.DataFrame], by: list[str], schema: pa.Schema, run_rows: int = 0, piece_rows: int = 0) -> Iterator[pd.DataFrame]:
    """All rows in the order of ``by``, in chunks; rows that agree in the first column come in one chunk.

    Up to ``run_rows`` rows are sorted in memory; more become sorted runs in temporary files, of which some
    ``piece_rows`` rows each are held while they are merged."""
    run_rows, piece_rows = run_rows or RUN_ROWS, piece_rows or PIECE_ROWS

    def ordered(parts: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(parts, ignore_index=True).sort_values(by, kind="stable", ignore_index=True)

    held, size = [], 0
    with tempfile.TemporaryDirectory(prefix="tidemark-runs-") as folder:
        runs = []

        def spill() -> None:
            path = f"{folder}/{len(runs)}"
            with pa.ipc.new_file(path, schema) as writer:
                writer.write_table(pa.Table.from_pandas(ordered(held)[schema.names], schema=schema, preserve_index=False), piece_rows)
            runs.append(pa.ipc.open_file(pa.OSFile(path)))

        for frame in frames:
            held.append(frame[schema.names])
            size += len(frame)
            if size >= run_rows:
                spill()
                held, size = [], 0
        if not runs:
            if size:
                yield ordered(held)
            return
        if size:
            spill()
        del held
        key = by[0]
        nothing = schema.empty_table().to_pandas()
        buffers, at, ready, n = [nothing for _ in runs], [0] * len(runs), [], 0

        def more(i: int) -> None:
            if at[i] < runs[i].num_record_batches:
                batch = pa.Table.from_batches([runs[i].get_batch(at[i])]).to_pandas()
                buffers[i] = pd.concat([buffers[i], batch], ignore_index=True) if len(buffers[i]) else batch
                at[i] += 1

        while True:
            for i, b in enumerate(buffers):
                if not len(b):
                    more(i)
            # rows below the last one held of every unfinished run
            ends = {i: buffers[i][key].iloc[-1] for i in range(len(runs)) if at[i] < runs[i].num_record_batches}
            if not ends:
                rest = [*ready, *[b for b in buffers if len(b)]]
                if rest:
                    yield ordered(rest)
                return
            least = min(ends.values())
            moved = False
            for i, b in enumerate(buffers):
                k = int(np.searchsorted(b[key].to_numpy(), least)) if len(b) else 0
                if k:
                    ready.append(b.iloc[:k])
                    buffers[i] = b.iloc[k:].reset_index(drop=True)
                    n, moved = n + k, True
            if not moved:
                for i, end in ends.items():
                    if end == least:
                        more(i)
            if n >= run_rows // 2:
                yield ordered(ready)
                ready, n = [], 0
