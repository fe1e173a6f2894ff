"""Which depth messages count between two snapshots of a book.

A snapshot replaces the whole book of its symbol: an epoch runs from it to the next. In an epoch
count, in order of arrival, the messages whose id is above the snapshot's and above all ids before
them. Messages that arrived while the snapshot was on its way (before it, with a newer id) are
replayed when it takes effect: all of them for the first snapshot of a symbol, those of the last
``resync`` for later ones. Before the first snapshot there is no book. Optionally a message whose
``pu`` is not the id of the message before it ends the epoch: then there is no book until the next
snapshot.

Snapshots are rows (``symbol``, ``arrival``, ``ts``, ``last_update_id``, ``bids``, ``asks``), placed by
``arrival`` before the message of the same number. Times must not fall along ``arrival``. There are few
snapshots next to messages, so they are windowed by symbol; messages stay in blocks, and each block
gets the list of the epochs that concern it.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import ordered
from ..functions.timing import micros, micros_of, slot, step
from ..session import materialise
from .blocks import Cut, message_cut
from .book import ASK, BID, explode_levels, sequence_gap_check, stale_update_filter

RESYNC = timedelta(seconds=10)
#: A second is over when every feed has passed it by so much; the resolution of a stream's watermark.
MARGIN = timedelta(milliseconds=1)


@dataclass(frozen=True)
class Epochs:
    """``entries``: levels set or removed, with their ``epoch``; ``spans``: when each epoch holds."""

    entries: DataFrame  # symbol, epoch, arrival, ts, u, side, pos, price, qty
    spans: DataFrame    # symbol, epoch, opened_at, closed_at (NULL: still open)

    def last_samples(self, period: timedelta, until: Column) -> DataFrame:
        """Per (symbol, epoch) the number of the last sample that belongs to it, up to ``until``."""
        before_next = slot(F.col("closed_at") - step(timedelta(microseconds=1)), period)
        return self.spans.withColumn("_until", until).filter(F.col("_until").isNotNull()).select(
            "symbol", "epoch", F.least(before_next, slot(F.col("_until"), period)).alias("_last"))


def numbered(snapshots: DataFrame) -> DataFrame:
    """Snapshots with their ``epoch`` from 1 and the place and time of the next one."""
    w = ordered(["symbol"], "arrival", "last_update_id")
    return snapshots.select(
        "symbol", F.row_number().over(w).alias("epoch"), F.col("arrival").alias("opened"), F.col("ts").alias("opened_at"),
        F.lead("arrival").over(w).alias("closed"), F.lead("ts").over(w).alias("closed_at"), "last_update_id", "bids", "asks")


def _latest(rows: DataFrame, at: str, epochs: DataFrame, by: str, name: str) -> DataFrame:
    """``rows`` with the highest epoch of the symbol whose ``by`` is not above ``at`` (NULL: none). Blocks and epochs, never
    messages, are windowed by symbol; no block meets all epochs."""
    held = F.struct(*rows.columns)
    marks = epochs.select("symbol", F.col(by).alias("_at"), "epoch").withColumn("_row", F.lit(None).cast(rows.select(held.alias("r")).schema["r"].dataType))
    asked = rows.select("symbol", F.col(at).alias("_at"), F.lit(None).cast("int").alias("epoch"), held.alias("_row"))
    w = ordered(["symbol"], "_at", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return marks.unionByName(asked).withColumn(name, F.max("epoch").over(w)).filter("_row IS NOT NULL").select("_row.*", name)


def in_epochs(messages: DataFrame, epochs: DataFrame, cut: Cut, resync: timedelta = RESYNC) -> DataFrame:
    """Messages, once for each epoch they may count in, with ``epoch`` and the ``last_update_id`` it starts from.

    A replayed message takes effect with its snapshot.
    """
    bounds = cut.apply(messages).groupBy(*cut.parts).agg(
        F.min("arrival").alias("_lo"), F.max("arrival").alias("_hi"), F.max("u").alias("_top"), F.max("ts").alias("_newest"))
    own = (F.col("opened") <= F.col("_hi")) & (F.col("closed").isNull() | (F.col("closed") > F.col("_lo")))
    waited = (F.col("epoch") == 1) | (F.col("_newest") >= F.col("opened_at") - step(resync))
    replayed = (F.col("opened") > F.col("_lo")) & (F.col("last_update_id") < F.col("_top")) & waited
    fields = ("epoch", "opened", "opened_at", "closed", "last_update_id")
    # own and replayed epochs lie between the one open at the first message and the last that may still ask for these
    near = bounds.withColumn("_reach", F.col("_newest") + step(resync))
    for at, by, found in (("_lo", "opened", "_first"), ("_hi", "opened", "_own"), ("_reach", "opened_at", "_replayed")):
        near = _latest(near, at, epochs, by, found)
    first = F.coalesce("_first", F.lit(1))
    near = near.withColumn("epoch", F.explode(F.sequence(first, F.greatest(first, "_own", "_replayed"))))
    concerned = materialise(
        near.join(epochs.select("symbol", *fields), ["symbol", "epoch"]).filter(own | replayed).groupBy(*cut.parts).agg(
            F.collect_list(F.struct(*fields)).alias("_epochs")), "concerned")

    def counts(e: Column) -> Column:
        within = (e["opened"] <= F.col("arrival")) & (e["closed"].isNull() | (e["closed"] > F.col("arrival")))
        recent = (e["epoch"] == 1) | (micros(F.col("ts")) >= micros(e["opened_at"]) - F.lit(micros_of(resync)))
        return within | ((e["opened"] > F.col("arrival")) & (F.col("u") > e["last_update_id"]) & recent)

    rows = cut.apply(messages).join(concerned, cut.parts).withColumn("_e", F.explode(F.filter("_epochs", counts)))
    kept = [c for c in messages.columns if c != "ts"]
    return rows.select(*kept, F.greatest("ts", "_e.opened_at").alias("ts"), "_e.epoch", "_e.last_update_id")


def book_epochs(messages: DataFrame, snapshots: DataFrame, cut: Cut = message_cut(), resync: timedelta = RESYNC,
                stop_at_gap: bool = False) -> Epochs:
    """Depth messages and snapshots -> the entries that count, by epoch."""
    epochs = numbered(snapshots)
    keys = ("symbol", "epoch")
    within = Cut(keys, cut.order, cut.number)
    fresh = stale_update_filter(in_epochs(messages, epochs, cut, resync), F.col("last_update_id"), within)
    spans = epochs.select(*keys, "opened_at", "closed_at")
    if stop_at_gap:
        gaps = sequence_gap_check(fresh, within).filter("gap").groupBy(*keys).agg(
            F.min("arrival").alias("_gap"), F.min("ts").alias("_gap_at"))
        fresh = fresh.join(gaps, list(keys), "left").filter("_gap IS NULL OR arrival < _gap").drop("_gap", "_gap_at")
        spans = spans.join(gaps, list(keys), "left").withColumn(
            "closed_at", F.least("closed_at", "_gap_at")).select(*keys, "opened_at", "closed_at")
    kept = (*keys, "arrival", "ts", "u")
    opening = epochs.select(*keys, F.lit(-1).cast("long").alias("arrival"), F.col("opened_at").alias("ts"),
                            F.col("last_update_id").alias("u"), F.col("bids").alias(BID), F.col("asks").alias(ASK))
    return Epochs(explode_levels(fresh, kept).unionByName(explode_levels(opening, kept)), spans)


def feed_end(*feeds: DataFrame, margin: timedelta = MARGIN) -> Column:
    """The time up to which every feed is complete: the least of their newest times, less ``margin``."""
    newest = [f.agg(F.max("ts")).scalar() for f in feeds]
    either = newest[0] if len(newest) == 1 else F.when(
        F.array_contains(F.array(*[n.isNull() for n in newest]), True), None).otherwise(F.least(*newest))
    return either - step(margin)

