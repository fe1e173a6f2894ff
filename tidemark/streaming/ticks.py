"""Stateful streams over trades and depth messages.

State is kept per symbol in the state store. A micro-batch of one symbol is put in order
before it is applied; its size is bounded by the admission limit of the source
(``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``). Historic data goes through the batch
operators, which split symbols; both give the same results on the same input.
"""

from __future__ import annotations

from collections.abc import Iterator

from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.timing import arrival_key, micros, micros_of
from ..operators.book import ASK, BID, SAMPLE_DEPTH
from ..operators.epochs import RESYNC
from ..operators.flow import BUCKET_VOLUME, VPIN_ALERT, VPIN_NEUTRAL, VPIN_WINDOW, bucket_parts
from .arrays import Flow, newer
from .depth import FIELDS, Levels, LiveBook, Segment, Waiting, in_order, segments, sides_as_doubles, sorted_chunks
from .pieces import ASKED, BIDDEN, BLOCKS, RESTART, SAMPLES, SECOND, Pieces, Span, clocked_pieces, cuts, walked

ARRIVALS, DEPTH_ORDER = FIELDS.append(pa.field("is_message", pa.bool_())), ["seq", "is_message"]
BLOCKS_AT_ONCE = 32
BLOCK_COLUMNS = [c.split()[0] for c in BLOCKS.split(", ")]


def stream_ohlc(trades: DataFrame, width: str = "4 hours", delay: str = "10 minutes") -> DataFrame:
    """Tumbling bars, emitted once the watermark has passed their end."""
    order = arrival_key(F.col("ts"), F.col("trade_id"))
    return (
        trades.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
        .groupBy("symbol", F.window("at", width))
        .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
             F.max_by("price", order).alias("close"), F.sum(F.col("qty").cast("double")).alias("volume"))
        .select("symbol", F.col("window.start").cast("timestamp_ntz").alias("ts"),
                "open", "high", "low", "close", "volume")
    )


class FlowStore:
    """Loads and saves the order-flow state of the current key."""

    def __init__(self, handle: StatefulProcessorHandle, volume: int, window: int):
        self.volume, self.window = volume, window
        self.point = handle.getValueState("flow", "last_price double, bucket bigint, filled bigint, signed double")
        self.lists = {n: handle.getListState(n, "x double") for n in ("changes", "imbalances")}

    def load(self) -> Flow:
        flow = Flow(self.volume, self.window)
        if self.point.exists():
            flow.last_price, flow.bucket, flow.filled, flow.signed = self.point.get()
        for name, state in self.lists.items():
            if state.exists():
                setattr(flow, name, np.array([x for (x,) in state.get()], dtype=float))
        return flow

    def save(self, flow: Flow) -> None:
        if flow.last_price is None:
            return
        self.point.update((flow.last_price, int(flow.bucket), int(flow.filled), float(flow.signed)))
        for name, state in self.lists.items():
            values = getattr(flow, name)
            if len(values):
                state.put([(float(x),) for x in values])


class VpinProcessor(StatefulProcessor):
    def __init__(self, volume: int, window: int):
        self.volume, self.window = volume, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.store = FlowStore(handle, self.volume, self.window)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        t = in_order(rows, "ts", "trade_id")
        flow = self.store.load()
        times, ids = t["ts"].to_numpy(), t["trade_id"].to_numpy()
        for closed in flow.steps(t["price"].to_numpy(), t["full"].to_numpy(), t["rest"].to_numpy()):
            yield pd.DataFrame({
                "symbol": key[0], "bucket": closed.bucket, "closed_at": times[closed.closer],
                "closing_trade": ids[closed.closer], "imbalance": closed.imbalance, "vpin": closed.vpin})
        self.store.save(flow)

    def close(self) -> None:
        pass


def stream_vpin(trades: DataFrame, volume: int = BUCKET_VOLUME, window: int = VPIN_WINDOW) -> DataFrame:
    """Toxicity at every bucket close."""
    full, rest = bucket_parts(volume)
    return (
        trades.select("symbol", "trade_id", "ts", "price", full.alias("full"), rest.alias("rest")).groupBy("symbol")
        .transformWithStateInPandas(
            VpinProcessor(volume, window),
            "symbol string, bucket bigint, closed_at timestamp_ntz, closing_trade bigint, "
            "imbalance double, vpin double", "append", "none")
    )


def stream_vpin_alert(toxicity: DataFrame, level: float = VPIN_ALERT) -> DataFrame:
    """The branch of a toxicity stream that warns."""
    return toxicity.filter(F.col("vpin") > level)


class IdProcessor(StatefulProcessor):
    """Passes messages whose id is above all ids before them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "u bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        m = in_order(rows, "arrival")
        ids = m["u"].to_numpy()
        last = self.last.get()[0] if self.last.exists() else None
        kept = m[newer(ids, last)]
        highest = int(ids.max()) if last is None else max(int(ids.max()), last)
        self.last.update((highest,))
        yield kept

    def close(self) -> None:
        pass


def stream_late_drop(messages: DataFrame) -> DataFrame:
    """Drop stale messages by id; lateness in time plays no part."""
    return messages.select("symbol", "arrival", "ts", "u").groupBy("symbol").transformWithStateInPandas(
        IdProcessor(), "symbol string, arrival bigint, ts timestamp_ntz, u bigint", "append", "none")


class BookProcessor(StatefulProcessor):
    """Live book: messages wait until the snapshot is there, then newer ones are applied."""

    def __init__(self, resync: int):
        self.resync = resync

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "u bigint")
        self.recent = Waiting(handle, "recent")
        self.levels = handle.getMapState("levels", "side string, price double", "qty double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        waiting = Recent(self.recent, self.resync)
        changed: dict[tuple[str, float], tuple[int, float]] = {}
        for depth in depth_chunks(rows):
            table, parts, last = segments(depth, last, waiting.before(depth), self.resync)
            seq, levels = table["seq"].to_numpy(dtype=np.int64), Levels(table)
            for part in parts:
                least = None
                if part.snapshot is not None:
                    # the newest row per level is the book: levels that the snapshot lacks are gone with it
                    least = int(seq[part.snapshot])
                    gone = {k: (least, 0.0) for k, (_, q) in changed.items() if q > 0}
                    changed |= gone | {k: (least, 0.0) for k, _ in self.levels.iterator() if k not in changed}
                    self._note(changed, seq, levels, np.array([part.snapshot]), least)
                self._note(changed, seq, levels, part.rows, least)
            waiting.after(depth, last)
        for level, (_, qty) in changed.items():
            if qty > 0:
                self.levels.updateValue(level, (qty,))
            else:
                self.levels.removeKey(level)
        waiting.save()
        if last is not None:
            self.last.update((last,))
        yield pd.DataFrame(
            [(key[0], arrival, s, p, q) for (s, p), (arrival, q) in changed.items()],
            columns=["symbol", "arrival", "side", "price", "qty"])

    @staticmethod
    def _note(changed: dict, seq: np.ndarray, levels: Levels, rows: np.ndarray, least: int | None) -> None:
        """The last entry of each level; a replayed message counts with its snapshot."""
        row, is_bid, price, qty = levels.of(rows)
        arrival = seq[rows][row]
        if least is not None:
            arrival = np.maximum(arrival, least)
        sides = np.where(is_bid, BID, ASK).tolist()
        changed |= zip(zip(sides, price.tolist()), zip(arrival.tolist(), qty.tolist()))

    def close(self) -> None:
        pass


def depth_chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In order of arrival, a snapshot before the message of the same number; memory does not grow with the rows."""
    flagged = (f.assign(is_message=~f["is_snapshot"].to_numpy(dtype=bool)) for f in frames)
    return sorted_chunks(flagged, DEPTH_ORDER, ARRIVALS)


class Recent:
    """The messages that a snapshot may replay, over the chunks of one call; the rest of them is in state."""

    def __init__(self, state: Waiting, resync: int):
        self.state, self.resync = state, resync
        self.stored: pd.DataFrame | None = None
        self.held: list[pd.DataFrame] = []
        self.known, self.newest = False, None

    def before(self, depth: pd.DataFrame) -> pd.DataFrame:
        # without a snapshot nothing that waits matters
        if not depth["is_snapshot"].any():
            return FIELDS.empty_table().to_pandas()
        if self.stored is None:
            self.stored = self.state.all()
        return pd.concat([self.stored, *[h[FIELDS.names] for h in self.held]], ignore_index=True)

    def after(self, depth: pd.DataFrame, last: int | None) -> None:
        newest = int(depth["ts"].max())
        self.newest = newest if self.newest is None else max(self.newest, newest)
        self.held.append(depth[~depth["is_snapshot"].to_numpy(dtype=bool)])
        if last is not None:
            self.known, since = True, self.newest - self.resync
            self.held = [h[h["ts"] >= since] for h in self.held if len(h) and h["ts"].max() >= since]
            if self.stored is not None:
                self.stored = self.stored[self.stored["ts"] >= since]

    def save(self) -> None:
        if self.newest is None:
            return
        for h in self.held:
            self.state.add(h)
        if self.known:
            self.state.forget(self.newest - self.resync)


def depth_rows(messages: DataFrame) -> DataFrame:
    """Messages and snapshots in the form the processors read: entries as arrays of doubles."""
    return messages.select(
        "symbol", micros(F.col("ts")).alias("ts"), F.col("arrival").alias("seq"), "is_snapshot", "u", *sides_as_doubles())


def stream_book(messages: DataFrame, resync: timedelta = RESYNC) -> DataFrame:
    """Level changes of the live book, one row per changed level and micro-batch.

    ``messages`` holds depth messages and, flagged ``is_snapshot``, the snapshots of each
    symbol with their id in ``u``. The newest row per level is the book; quantity 0 = gone.
    """
    return (
        depth_rows(messages).groupBy("symbol")
        .transformWithStateInPandas(
            BookProcessor(micros_of(resync)), "symbol string, arrival bigint, side string, price double, qty double",
            "append", "none")
    )


TRADE_ORDER = ["ts", "seq"]
TRADE_FIELDS = pa.schema([(c, t) for c, t in (
    ("ts", pa.int64()), ("seq", pa.int64()), ("price", pa.float64()), ("full", pa.int64()), ("rest", pa.int64()))])


def changes_of(table: pd.DataFrame, parts: list[Segment], until: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first sample that sees it, kind, price, qty) of all changes that the epochs ``parts`` make up to ``until``, in order."""
    ts = table["ts"].to_numpy(dtype=np.int64)
    rows, at, opening = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, bool)]
    for i, part in enumerate(parts):
        # an epoch ends before the first second that sees the next snapshot
        last = until if i + 1 == len(parts) else -(-int(ts[parts[i + 1].snapshot]) // SECOND) - 1
        own = -(-part.ts // SECOND)
        use = own <= last
        if part.snapshot is not None:
            rows.append([part.snapshot])
            at.append([-(-int(ts[part.snapshot]) // SECOND)])
            opening.append([True])
        rows.append(part.rows[use])
        at.append(own[use])
        opening.append(np.zeros(use.sum(), bool))
    rows, at, opening = (np.concatenate(x) for x in (rows, at, opening))
    place, is_bid, price, qty = Levels(table).of(rows)
    restarts = np.flatnonzero(opening)
    where = np.searchsorted(place, restarts)
    kind = np.where(is_bid, BIDDEN, ASKED).astype(np.int8)
    return tuple(np.insert(x, where, v) for x, v in ((at[place], at[restarts]), (kind, RESTART), (price, 0.0), (qty, 0.0)))


class SampleProcessor(StatefulProcessor):
    """Book and flow state of a symbol, sampled at every full second of event time.

    Rows come in pieces and are held until the watermark has passed them, so it does not matter
    which feed is ahead. A timer per symbol goes off whenever the watermark has moved: then all rows
    up to the last second that it has passed are applied, and each second up to it is in the blocks
    given out, whether anything happened in it or not.
    """

    def __init__(self, volume: int, window: int, resync: int):
        self.volume, self.window, self.resync = volume, window, resync

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.store = FlowStore(handle, self.volume, self.window)
        self.clock = handle.getValueState("clock", "next_second bigint, u bigint")  # NULLs before the first snapshot
        self.seen = handle.getValueState("seen", "watermark bigint")  # of the batch before: what is not newer comes late
        self.toxicity = handle.getValueState("toxicity", "vpin double")
        self.book = LiveBook(handle, SAMPLE_DEPTH)
        self.recent = Waiting(handle, "recent")
        self.depth, self.trades = Pieces(handle, "depth", ARRIVALS, DEPTH_ORDER), Pieces(handle, "trades", TRADE_FIELDS, TRADE_ORDER)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        late = int(self.seen.get()[0]) * 1000 if self.seen.exists() else 0
        for t in rows:
            for pieces, mine in ((self.depth, ~t["is_trade"].to_numpy(dtype=bool)), (self.trades, t["is_trade"].to_numpy(dtype=bool))):
                if mine.any():
                    own = t[mine]
                    spans = own[list(Span._fields)].itertuples(index=False)
                    pieces.add([(Span(*map(int, s)), bytes(r)) for s, r in zip(spans, own["rows"])], late)
        if not self.clock.exists():
            self.clock.update((None, None))
            self._wake(timerValues)
        yield from ()

    def _wake(self, timerValues) -> int:
        """Go on when the watermark moves."""
        watermark = int(timerValues.getCurrentWatermarkInMs())
        self.seen.update((watermark,))
        self.handle.registerTimer(watermark + 1)
        return watermark

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = self._wake(timerValues) // 1000  # the last second all of whose rows are here
        second, last = self.clock.get()
        closes, values = self._flow(upto)
        waiting = Recent(self.recent, self.resync)
        loaded = False
        for until, depth in self._seconds(upto):
            if len(depth):
                table, parts, last = segments(depth, last, waiting.before(depth), self.resync)
                waiting.after(depth, last)
            else:
                table, parts = depth, []
            if last is None:
                continue
            if not loaded:
                self.book.load()
                loaded = True
            if second is None:
                second = -(-int(table["ts"].iloc[parts[0].snapshot]) // SECOND)
            yield from self._blocks(key[0], changes_of(table, parts, until), second, until, closes, values)
            second = max(second, until + 1)
        waiting.save()
        if loaded:
            self.book.save()
            self.clock.update((second, last))

    def _seconds(self, upto: int) -> Iterator[tuple[int, pd.DataFrame]]:
        """Depth rows in order, each chunk with the last second that it completes; at least one, up to ``upto``."""
        rest = None
        for chunk in self.depth.chunks(upto * SECOND):
            if rest is not None:
                both = pd.concat([rest, chunk], ignore_index=True).sort_values(DEPTH_ORDER, kind="stable", ignore_index=True)
                until = -(-int(both["ts"].max()) // SECOND) - 1
                done = (both["ts"] <= until * SECOND).to_numpy()
                if done.any():
                    yield until, both[done]
                rest = both[~done]
            else:
                rest = chunk
        yield upto, FIELDS.empty_table().to_pandas() if rest is None else rest

    def _blocks(self, symbol: str, changes: tuple, first: int, until: int, closes: np.ndarray, values: np.ndarray) -> Iterator[pd.DataFrame]:
        """Samples ``first`` to ``until`` as blocks, some at a time; the book moves on to the last one."""
        at, kind, price, qty = changes
        at = np.maximum.accumulate(np.maximum(at, first))
        held = []
        for begin, end, lo, hi in cuts(at, first, until):
            k, p, q = kind[lo:hi], price[lo:hi], qty[lo:hi]
            restarts = np.flatnonzero(k == RESTART)
            opening = []
            for side, of_side in ((BID, BIDDEN), (ASK, ASKED)):
                if len(restarts) and at[lo + restarts[0]] == begin:  # no sample sees what was before
                    opening += [np.empty(0), np.empty(0)]
                    continue
                before = slice(restarts[0] if len(restarts) else None)
                gone = set(p[before][(k[before] == of_side) & ~(q[before] > 0)].tolist())
                opening += self.book.sides[side].lasting(SAMPLE_DEPTH, gone)
            seconds = np.arange(begin, end + 1) * SECOND
            vpin = values[np.searchsorted(closes, seconds, side="right") - 1]
            held.append((symbol, begin, end - begin + 1, *opening, at[lo:hi], k, p, q, vpin))
            if len(restarts):
                self.book.restart()
                k, p, q = (x[restarts[-1] + 1:] for x in (k, p, q))
            self.book.apply(k == BIDDEN, p, q)
            if len(held) == BLOCKS_AT_ONCE:
                yield pd.DataFrame(held, columns=BLOCK_COLUMNS)
                held = []
        if held:
            yield pd.DataFrame(held, columns=BLOCK_COLUMNS)

    def _flow(self, upto: int) -> tuple[np.ndarray, np.ndarray]:
        """Times at which toxicity changed, and its values; the first is the one known before."""
        before = self.toxicity.get()[0] if self.toxicity.exists() else VPIN_NEUTRAL
        times, values = [np.array([np.iinfo(np.int64).min])], [np.array([before])]
        flow = None
        for t in self.trades.chunks(upto * SECOND):
            flow = flow or self.store.load()
            at = t["ts"].to_numpy()
            for closed in flow.steps(t["price"].to_numpy(), t["full"].to_numpy(), t["rest"].to_numpy()):
                newest = np.flatnonzero(np.diff(closed.closer, append=-1))  # the last bucket that a trade closed
                times.append(at[closed.closer[newest]])
                values.append(closed.vpin[newest])
        if flow is not None:
            self.store.save(flow)
            self.toxicity.update((float(np.concatenate(values)[-1]),))
        return np.concatenate(times), np.concatenate(values)

    def close(self) -> None:
        pass


def stream_sample_1s(depth: DataFrame, trades: DataFrame, volume: int = BUCKET_VOLUME, window: int = VPIN_WINDOW,
                     delay: str = "1 millisecond", resync: timedelta = RESYNC) -> DataFrame:
    """One feature row per symbol and second of event time, as soon as both feeds have passed it by ``delay``.

    ``depth`` holds messages and, flagged ``is_snapshot``, snapshots (see ``stream_book``). The
    watermark is the lesser one of both feeds: rows of a feed that runs ahead wait. A feed whose
    rows come out of order by more than ``delay`` loses the late ones: those that are not newer than
    the watermark before the batch. What is sequential is done per symbol, on packed rows; packing
    and the walk through the books are spread over all tasks.
    """
    full, rest = bucket_parts(volume)
    messages = depth.select("symbol", micros(F.col("ts")).alias("ts"), F.col("arrival").alias("seq"), "is_snapshot", (~F.col("is_snapshot")).alias("is_message"), "u", *sides_as_doubles())
    prices = trades.select("symbol", micros(F.col("ts")).alias("ts"), F.col("trade_id").alias("seq"), "price", full.alias("full"), rest.alias("rest"))
    pieces = clocked_pieces(messages, ARRIVALS, DEPTH_ORDER, False, delay).unionByName(
        clocked_pieces(prices, TRADE_FIELDS, TRADE_ORDER, True, delay))
    blocks = pieces.groupBy("symbol").transformWithStateInPandas(
        SampleProcessor(volume, window, micros_of(resync)), BLOCKS, "append", "eventTime")
    return blocks.repartition("symbol", "first").mapInPandas(walked, SAMPLES)
