"""Rows on their way into and out of a stateful operator, many in one value.

Spark hands a stateful operator its rows one by one, and one task works on a symbol. So rows are sorted and packed
in the tasks that read them, wait in state as they came, and books leave the operator as blocks that any task can
walk through: what they were at the start, and what changed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from ..operators.book import SAMPLE_DEPTH
from ..operators.ladder import Ladder, walk
from ..schemas import BOOK_FEATURES
from .arrays import features
from .depth import packed, rows_at_once, sorted_chunks, unpacked

SECOND = 1_000_000
PACKED_ROWS, PACKED_BYTES = 50_000, 16_000_000  # of all symbols that a task packs at once

BLOCK_SAMPLES, BLOCK_CHANGES = 2_048, 16_384
ASKED, BIDDEN, RESTART = 0, 1, 2  # kinds of changes
BLOCKS = ("symbol string, first bigint, count bigint, bp array<double>, bq array<double>, ap array<double>, aq array<double>, "
          "at array<bigint>, kind array<tinyint>, price array<double>, qty array<double>, vpin array<double>")
SAMPLES = "symbol string, ts timestamp_ntz, " + ", ".join(f"{f} double" for f in BOOK_FEATURES)


class Span(NamedTuple):
    """What is known of a piece without reading it: its times, the first column of its order and how many rows."""

    oldest: int
    newest: int
    least: int
    most: int
    size: int


PACKED = ", ".join(["symbol string", "is_trade boolean", *[f"{f} bigint" for f in Span._fields], "rows binary"])


def span_of(rows: pa.Table | pd.DataFrame, by: list[str]) -> Span:
    """Of rows in order."""
    ts, key = (np.asarray(rows[c]) for c in ("ts", by[0]))
    return Span(int(ts.min()), int(ts.max()), int(key[0]), int(key[-1]), len(rows))


def pack(schema: pa.Schema, by: list[str], is_trade: bool) -> Callable:
    """Rows (``symbol`` and those of ``schema``) -> pieces of one symbol each, in the order of ``by``."""
    def flushed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).sort_by([(c, "ascending") for c in ("symbol", *by)])
        runs = pc.run_end_encode(table["symbol"].combine_chunks())
        table = table.select(schema.names).cast(schema)
        start, out = 0, []
        for symbol, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
            rows = table.slice(start, end - start).combine_chunks()
            out.append((symbol, is_trade, *span_of(rows, by), packed(rows, schema)))
            start = end
        kinds = (pa.string(), pa.bool_(), *[pa.int64()] * len(Span._fields), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["symbol", "is_trade", *Span._fields, "rows"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= PACKED_ROWS or size >= PACKED_BYTES:
                yield from flushed(held)
                held, rows, size = [], 0, 0
        if held:
            yield from flushed(held)

    return pieces


def clocked_pieces(rows: DataFrame, schema: pa.Schema, by: list[str], is_trade: bool, delay: str) -> DataFrame:
    """A feed in pieces, its watermark that of their rows: ``delay`` behind the newest."""
    pieces = rows.select("symbol", *schema.names).mapInArrow(pack(schema, by, is_trade), PACKED)
    return pieces.withColumn("at", F.timestamp_micros("newest")).withWatermark("at", delay)


class Pieces:
    """Pieces kept in state as they came, by number; only those that are due are read."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, schema: pa.Schema, by: list[str]):
        self.rows = handle.getMapState(f"{name}_rows", "n bigint", "rows binary")
        self.spans = handle.getMapState(f"{name}_spans", "n bigint", ", ".join(f"{f} bigint" for f in Span._fields))
        self.schema, self.by = schema, by

    def add(self, pieces: list[tuple[Span, bytes]], late: int) -> None:
        """Rows up to the time ``late`` are lost."""
        n = max(self._held(), default=-1)
        for span, rows in pieces:
            if span.oldest <= late:
                left = unpacked([rows], self.schema)
                left = left[left["ts"] > late]
                if not len(left):
                    continue
                span, rows = span_of(left, self.by), packed(left, self.schema)
            n += 1
            self._put(n, span, rows)

    def _held(self) -> dict[int, Span]:
        return {int(n): Span(*map(int, span)) for (n,), span in self.spans.iterator()}

    def _put(self, n: int, span: Span, rows: bytes) -> None:
        self.rows.updateValue((n,), (rows,))
        self.spans.updateValue((n,), tuple(span))

    def _take(self, n: int, span: Span, upto: int) -> pd.DataFrame:
        t = unpacked([bytes(self.rows.getValue((n,))[0])], self.schema)
        if span.newest > upto:
            due = (t["ts"] <= upto).to_numpy()
            left = t[~due]
            self._put(n, span_of(left, self.by), packed(left, self.schema))
            return t[due]
        self.rows.removeKey((n,))
        self.spans.removeKey((n,))
        return t

    def chunks(self, upto: int) -> Iterator[pd.DataFrame]:
        """Take the rows up to a time out, in order, as ``sorted_chunks`` does.

        Pieces that follow each other are read one after the other. Where very many rows overlap, they are sorted in runs."""
        due = sorted(((n, s) for n, s in self._held().items() if s.oldest <= upto), key=lambda x: x[1].least)
        frames = (self._take(n, span, upto) for n, span in due)
        most = rows_at_once()
        if overlap([s for _, s in due]) > most:
            yield from sorted_chunks(frames, self.by, self.schema)
            return
        held, size = [], 0
        for (_, span), t in zip(due, frames):
            if size >= most // 2:
                rows = self._sorted(held)
                k = int(np.searchsorted(rows[self.by[0]].to_numpy(), span.least))
                if k:
                    yield rows.iloc[:k].reset_index(drop=True)
                held = [rows.iloc[k:]]
                size = len(rows) - k
            held.append(t)
            size += len(t)
        if size:
            yield self._sorted(held)

    def _sorted(self, held: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(held, ignore_index=True).sort_values(self.by, kind="stable", ignore_index=True)


def overlap(spans: list[Span]) -> int:
    """The most rows of pieces that lie over one place of the order."""
    edges = sorted([(s.least, 0, s.size) for s in spans] + [(s.most, 1, -s.size) for s in spans])
    return int(np.cumsum([0, *[size for *_, size in edges]]).max())


def cuts(at: np.ndarray, first: int, last: int) -> Iterator[tuple[int, int, int, int]]:
    """Samples first to last in blocks: (first sample, last one, changes from, to); a sample is not cut."""
    lo = 0
    while first <= last:
        end = min(first + BLOCK_SAMPLES - 1, last)
        hi = int(np.searchsorted(at, end, side="right"))
        if hi - lo > BLOCK_CHANGES:
            end = min(end, max(first, int(at[lo + BLOCK_CHANGES]) - 1))
            hi = int(np.searchsorted(at, end, side="right"))
        yield first, end, lo, hi
        first, lo = end + 1, hi


def walked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks -> a row of features for each of their samples at which the book has two sides."""
    for frame in frames:
        for block in frame.itertuples(index=False):
            samples = [s for s in steps_of(block) if len(s[2][0]) and len(s[3][0])]
            if samples:
                yield rows_of(block, samples)


def steps_of(block) -> Iterator[tuple]:
    """What ``ladder.walk`` gives over a block; at a restart all levels are gone."""
    bids, asks = Ladder(True), Ladder(False)
    bids.load(dict(zip(block.bp.tolist(), block.bq.tolist())))
    asks.load(dict(zip(block.ap.tolist(), block.aq.tolist())))
    first, last, begin = block.first, block.first + block.count - 1, 0

    def stretch(a: int, b: int, until: int) -> Iterator[tuple]:
        return walk(bids, asks, block.at[a:b], block.kind[a:b] == BIDDEN, block.price[a:b], block.qty[a:b], first, until, SAMPLE_DEPTH)

    for i in np.flatnonzero(block.kind == RESTART).tolist():
        opened = int(block.at[i])
        if first < opened:
            yield from stretch(begin, i, opened - 1)
        bids.load({})
        asks.load({})
        first, begin = max(first, opened), i + 1
    yield from stretch(begin, len(block.at), last)


def rows_of(block, samples: list) -> pd.DataFrame:
    found = features([s[2] for s in samples], [s[3] for s in samples])
    count = np.array([s[1] for s in samples], dtype=np.int64)
    first = np.array([s[0] for s in samples], dtype=np.int64)
    at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
    found = {k: np.repeat(v, count) for k, v in found.items()}
    found["vpin"] = block.vpin[at - block.first]
    return pd.DataFrame({"symbol": block.symbol, "ts": (at * SECOND).astype("datetime64[us]"), **{f: found[f] for f in BOOK_FEATURES}})
