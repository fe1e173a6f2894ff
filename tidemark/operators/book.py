"""Order book: replay of updates, books at sample times, imbalance and price features.

A book is a table of levels ``(symbol, side, price, qty)`` or, at a sample time, a row with both
sides as sorted arrays (``bids``, ``asks``, best first). Updates of one symbol may be a third of
all rows, so the stale filter and the carry-forward of levels work on blocks of time or of ids;
the final book is a hash aggregate with map-side partials.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import earlier, ordered
from ..functions.numeric import imbalance
from ..functions.timing import from_micros, micros_of, slot, step
from ..session import materialise
from .blocks import BLOCK, CARRIED, Cut, message_cut, opening, with_lookback
from .ladder import Ladder, walk

# Side names, depths, decay rates, sample depth and the spoofing limit.
BID, ASK = "b", "a"
DEPTHS = (1, 5, 10, 20)
STRONG, WEAK = 0.8, 0.1
SAMPLE_DEPTH = 20
SPOOF_LIMIT = 0.5
ENTRIES_PER_MESSAGE = 1 << 31  # above every array position


def explode_levels(messages: DataFrame, keep: Sequence[str] = ("symbol", "arrival", "ts", "u")) -> DataFrame:
    """Depth messages (``b`` and ``a``: arrays of [price, qty] text) -> one row per entry."""

    side = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("entries")) for s in (BID, ASK)]))
    entry = F.posexplode("_s.entries")
    return (
        messages.select(*keep, side.alias("_s"))
        .select(*keep, "_s.side", entry.alias("pos", "_e"))
        .select(*keep, "side", "pos", F.get("_e", F.lit(0)).cast("double").alias("price"),
                F.get("_e", F.lit(1)).cast("double").alias("qty"))
    )


def stale_update_filter(diffs: DataFrame, snapshot_id: Column | None = None,
                        cut: Cut = message_cut()) -> DataFrame:
    """Drop updates whose id is not above every id seen before them, in arrival order.

    ``snapshot_id`` is the id the book starts from (a column of ``diffs``; none = all new).
    """
    start = snapshot_id if snapshot_id is not None else F.lit(None).cast("long")
    highest = opening(diffs, cut, {"_opened": F.max("u")}, F.max)
    inside = cut.apply(diffs).withColumn("_seen", F.max("u").over(earlier(cut.window())))
    last = F.greatest(F.col("_opened"), F.col("_seen"), start)
    return (
        inside.join(highest, cut.parts)
        .filter(last.isNull() | (F.col("u") > last))
        .select(*diffs.columns)
    )


def sequence_gap_check(diffs: DataFrame, cut: Cut = message_cut()) -> DataFrame:
    """Flag messages whose ``pu`` is not the final id of the message before them."""
    w = cut.window()
    seen = with_lookback(diffs, cut, 1).withColumn("_previous", F.lag("u").over(w))
    return (
        seen.filter(~F.col(CARRIED))
        .withColumn("gap", F.coalesce(F.col("pu") != F.col("_previous"), F.lit(False)))
        .select(*diffs.columns, "gap")
    )


def update_order(arrival: Column, pos: Column) -> Column:
    """(arrival, position in the message) packed in one number."""
    return (arrival.cast("decimal(19,0)") * F.lit(ENTRIES_PER_MESSAGE) + pos).cast("decimal(38,0)")


def apply_book_updates(entries: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Last quantity per price level wins; quantity 0 removes the level."""
    newest = update_order(F.col("arrival"), F.col("pos"))
    return (
        entries.groupBy(*keys, "side", "price")
        .agg(F.max_by("qty", newest).alias("qty"))
        .filter(F.col("qty") > 0)
    )


def snapshot_levels(snapshot: DataFrame) -> DataFrame:
    """Snapshot rows (``last_update_id``, bids, asks as text pairs) -> entries before any message."""
    shaped = snapshot.select(
        "symbol", F.lit(-1).cast("long").alias("arrival"), F.lit(None).cast("timestamp_ntz").alias("ts"),
        F.col("last_update_id").alias("u"), F.col("bids").alias(BID), F.col("asks").alias(ASK))
    return explode_levels(shaped)


def book_replay(snapshot: DataFrame, messages: DataFrame, cut: Cut = message_cut()) -> DataFrame:
    """Book after a snapshot and all later messages that are newer than it.

    Symbols without a snapshot have no book yet, as messages are only buffered for them.
    """
    ids = snapshot.select("symbol", F.col("last_update_id").alias("_snapshot"))
    known = messages.join(ids, "symbol")
    fresh = stale_update_filter(known, F.col("_snapshot"), cut)
    return apply_book_updates(explode_levels(fresh).unionByName(snapshot_levels(snapshot)))


# --- books at sample times ----------------------------------------------------

def best_first(side: str = "side", price: str = "price") -> Column:
    """Sort value that puts the best level first on both sides."""
    return F.when(F.col(side) == BID, -F.col(price)).otherwise(F.col(price))


def book_level_rank(levels: DataFrame, keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """Level number from 1: bids from the highest price down, asks from the lowest up.

    The window holds one side of one book, whose size is the number of live prices.
    """
    w = ordered([*keys, "side"], best_first())
    return levels.withColumn("level", F.row_number().over(w))


def top_n_levels(levels: DataFrame, n: int, keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    return book_level_rank(levels, keys).filter(F.col("level") <= n)


def l2_snapshot(levels: DataFrame, n: int = 10, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Top ``n`` levels per side as sorted arrays of (price, qty)."""
    top = top_n_levels(levels, n, keys)

    def side(s: str) -> Column:
        rows = F.collect_list(F.when(F.col("side") == s, F.struct("level", "price", "qty")))
        return F.transform(F.sort_array(rows), lambda r: F.struct(r["price"].alias("price"), r["qty"].alias("qty")))

    return top.groupBy(*keys).agg(side(BID).alias("bids"), side(ASK).alias("asks"))


# Blocks a level is opened in by one row at most.
BLOCKS_AT_ONCE = 1_000


def books_as_of(entries: DataFrame, period: timedelta = timedelta(seconds=1), block: timedelta = timedelta(minutes=10),
                depth: int | None = SAMPLE_DEPTH, keys: Sequence[str] = ("symbol",),
                lasts: DataFrame | None = None) -> DataFrame:
    """The book at every sample time: the best ``depth`` levels a side as sorted arrays (NULL: all levels).

    Sample k of a key is at k*period, from its first update to its last, or to ``_last`` of
    ``lasts`` (one row per key); books without any level give no row.

    1. keep the last update per level and sample (map-side partials), written once;
    2. open every block with the level states left by earlier blocks; the single shuffle
       of the levels is by (keys, block);
    3. a block's task walks through its samples with both sides as sorted arrays, changed
       by the difference to the sample before. No level is ever expanded over the samples
       it holds at, and nothing is ranked.

    A task holds the levels of one block, whatever the length of the series.
    """
    level = [*keys, "side", "price"]
    per_block = int(block / period)
    newest = update_order(F.col("arrival"), F.col("pos"))
    # first sample at or after the update
    visible = slot(F.col("ts") - step(timedelta(microseconds=1)), period) + 1
    states = materialise(
        entries.groupBy(*level, visible.alias("_at")).agg(F.max_by("qty", newest).alias("qty"))
        .withColumn(BLOCK, F.floor(F.col("_at") / F.lit(per_block))), "level_states")
    if lasts is None:
        lasts = entries.groupBy(*keys).agg(F.max(slot(F.col("ts"), period)).alias("_last"))
    finals = lasts.withColumn("_final", F.floor(F.col("_last") / F.lit(per_block)))
    # state of each level at the end of each block it changed in
    ends = (
        states.groupBy(*level, BLOCK).agg(F.max_by("qty", "_at").alias("qty"))
        .withColumn("_until", F.lead(BLOCK).over(ordered(level, BLOCK)))
    )
    # only the last state of a level, one row, has to ask when its key ends
    lasting = ends.filter(F.col("_until").isNull()).drop("_until").join(
        finals.select(*keys, F.col("_final").alias("_until")), list(keys))
    chunk = F.lit(BLOCKS_AT_ONCE)
    opened = (
        ends.filter(F.col("_until").isNotNull()).unionByName(lasting)
        .filter((F.col("qty") > 0) & (F.col("_until") > F.col(BLOCK)))
        .withColumn("_chunk", F.explode(F.sequence(
            F.floor((F.col(BLOCK) + 1) / chunk), F.floor(F.col("_until") / chunk))))
        .withColumn(BLOCK, F.explode(F.sequence(
            F.greatest(F.col(BLOCK) + 1, F.col("_chunk") * chunk), F.least(F.col("_until"), (F.col("_chunk") + 1) * chunk - 1))))
        .select(*level, (F.col(BLOCK) * per_block).alias("_at"), "qty", BLOCK)
    )
    # a few levels make many samples: a fixed number of tasks, not one that follows the bytes of the levels
    tasks = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        states.withColumn("_order", F.lit(1)).unionByName(opened.withColumn("_order", F.lit(0)))
        .repartition(tasks, *keys, BLOCK)
    )
    # an update after the last sample may fall into the block after the final one
    limits = finals.select(*keys, "_last", F.explode(F.array_distinct(F.array(
        "_final", F.floor((F.col("_last") + 1) / F.lit(per_block))))).alias(BLOCK))
    block_end = (F.col(BLOCK) + 1) * per_block - 1
    bounded = (
        placed.join(limits, [*keys, BLOCK], "left")
        .withColumn("_stop", F.least(block_end, F.coalesce("_last", block_end)))
        .filter(F.col("_at") <= F.col("_stop"))
        .select(*keys, BLOCK, "_at", "_order", "_stop", (F.col("side") == BID).alias("_bid"), "price", "qty")
    )
    types = dict(bounded.dtypes)
    sides = "bids array<struct<price:double,qty:double>>, asks array<struct<price:double,qty:double>>"
    schema = ", ".join(f"{k} {types[k]}" for k in keys)
    walked = bounded.groupBy(*keys, BLOCK).applyInArrow(
        _walker(tuple(keys), depth), f"{schema}, {BLOCK} bigint, _sample bigint, {sides}")
    return walked.select(
        *keys, from_micros(F.col("_sample") * F.lit(micros_of(period))).alias("ts"), "bids", "asks")


def _walker(keys: tuple[str, ...], depth: int | None):
    """The samples of one block from its level states."""
    pair = pa.struct([("price", pa.float64()), ("qty", pa.float64())])

    def side(best: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum([len(p) for p, _ in best])]).astype(np.int32)
        price, qty = (np.concatenate([b[i] for b in best]) if best else np.empty(0) for i in (0, 1))
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(price), pa.array(qty)], fields=list(pair)))

    def walked(rows: pa.Table) -> pa.Table:
        at, order = rows["_at"].to_numpy(), rows["_order"].to_numpy()
        by = np.lexsort((order, at))
        steps = list(walk(
            Ladder(True), Ladder(False), at[by], rows["_bid"].to_numpy(zero_copy_only=False)[by], rows["price"].to_numpy()[by],
            rows["qty"].to_numpy()[by], int(at.min()), rows["_stop"][0].as_py(), depth))
        steps = [s for s in steps if len(s[2][0]) or len(s[3][0])]
        count = np.array([s[1] for s in steps], dtype=np.int64)
        state = pa.array(np.repeat(np.arange(len(steps)), count))
        first = np.array([s[0] for s in steps], dtype=np.int64)
        sample = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        columns = {k: pa.repeat(rows[k][0], len(sample)) for k in (*keys, BLOCK)}
        return pa.table(columns | {"_sample": sample, "bids": side([s[2] for s in steps]).take(state), "asks": side([s[3] for s in steps]).take(state)})

    return walked


def book_as_of(books: DataFrame) -> DataFrame:
    """Books as rows: one per level that is live at the sample, ``level`` 1 being the best of its side."""
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("levels")) for s, c in ((BID, "bids"), (ASK, "asks"))]))
    rest = [c for c in books.columns if c not in ("bids", "asks")]
    return (
        books.select(*rest, sides.alias("_s"))
        .select(*rest, "_s.side", F.posexplode("_s.levels").alias("_pos", "_level"))
        .select(*rest, "side", "_level.price", "_level.qty", (F.col("_pos") + 1).alias("level"))
    )


# --- features of books held as sorted arrays ------------------------------------

def side_volume(side: str, depth: int | None = None, decay: float = 0.0) -> Column:
    """Volume of one side down to ``depth``, each level further from the top counting less."""
    levels = F.col(side) if depth is None else F.slice(side, 1, depth)
    volumes = F.transform(levels, (lambda x, i: x["qty"] * F.exp(F.lit(-decay) * i)) if decay else (lambda x: x["qty"]))
    return F.aggregate(volumes, F.lit(0.0), lambda total, x: total + x)


def book_side_volume(books: DataFrame, depth: int) -> DataFrame:
    return _with_features(books, {"bid_volume": side_volume("bids", depth), "ask_volume": side_volume("asks", depth)})


def obi_columns() -> dict[str, Column]:
    return {f"obi_L{d}": imbalance(side_volume("bids", d), side_volume("asks", d)) for d in DEPTHS}


def weighted_obi_columns() -> dict[str, Column]:
    return {
        name: imbalance(side_volume("bids", None, rate), side_volume("asks", None, rate))
        for name, rate in (("obi_weighted_strong", STRONG), ("obi_weighted_weak", WEAK))
    }


def top_columns() -> dict[str, Column]:
    """Best price and volume on each side."""
    return {
        name: F.get(F.col(side), F.lit(0))[value]
        for name, side, value in (
            ("bid", "bids", "price"), ("ask", "asks", "price"), ("bid_qty", "bids", "qty"), ("ask_qty", "asks", "qty"))
    }


def _with_features(books: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The key columns of the books and features computed from both sides."""
    keys = [c for c in books.columns if c not in ("bids", "asks")]
    return books.select(*keys, *[c.alias(n) for n, c in columns.items()])


def two_sided(books: DataFrame) -> DataFrame:
    return books.filter((F.size("bids") > 0) & (F.size("asks") > 0))


def obi_depth(books: DataFrame) -> DataFrame:
    return _with_features(books, obi_columns())


def obi_weighted(books: DataFrame) -> DataFrame:
    return _with_features(books, weighted_obi_columns())


def with_spread(top: DataFrame) -> DataFrame:
    gap = F.col("ask") - F.col("bid")
    return top.withColumn("spread_absolute", gap).withColumn("spread_relative", F.try_divide(gap, F.col("ask")))


def spread(books: DataFrame) -> DataFrame:
    """Absolute spread, and the same relative to the best ask."""
    return with_spread(_with_features(two_sided(books), top_columns()))


def with_micro_price(top: DataFrame) -> DataFrame:
    """Mid price, and the micro price that leans to the side with less volume."""
    mid = (F.col("bid") + F.col("ask")) / 2
    crossed = F.col("ask") * F.col("bid_qty") + F.col("bid") * F.col("ask_qty")
    return (
        top.withColumn("mid_price", mid)
        .withColumn("micro_price", F.coalesce(
            F.try_divide(crossed, F.col("bid_qty") + F.col("ask_qty")), F.col("mid_price")))
        .withColumn("micro_dev", F.col("micro_price") - F.col("mid_price"))
    )


def mid_micro_price(books: DataFrame) -> DataFrame:
    return with_micro_price(_with_features(two_sided(books), top_columns()))


def spoof_divergence(books: DataFrame) -> DataFrame:
    """Imbalance at the top minus imbalance in depth; flagged when far apart."""
    both = obi_depth(books).drop("obi_L5", "obi_L10")
    return both.withColumn("spoofing_divergence", F.col("obi_L1") - F.col("obi_L20")).withColumn(
        "spoof_flag", F.abs("spoofing_divergence") > SPOOF_LIMIT)


def book_features(books: DataFrame) -> DataFrame:
    """All book features per book; one-sided books are skipped."""
    top = _with_features(two_sided(books), {**obi_columns(), **weighted_obi_columns(), **top_columns()})
    return (
        with_micro_price(with_spread(top))
        .withColumn("spoofing_divergence", F.col("obi_L1") - F.col("obi_L20"))
        .drop("bid", "ask", "bid_qty", "ask_qty")
    )
