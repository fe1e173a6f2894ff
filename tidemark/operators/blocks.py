"""Windows over series too long for one task.

A window partitioned by symbol puts a whole symbol into one task. That is fine for
bars (their number is bounded by the time span over the bar width) but not for trades
or book updates, where one symbol may hold a third of everything. The operators here
cut a series into blocks, partition by (symbol, block), and hand each block what it
needs from before its start:

* the last rows of the preceding blocks, for windows with a fixed look-back;
* the first rows of the following blocks, for windows with a fixed look-ahead;
* opening totals, for running sums and running maxima.

Only per-block summaries are ever windowed by symbol alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions.frames import earlier, ordered, so_far
from ..functions.timing import arrival_key, slot

BLOCK = "_block"
CARRIED = "_carried"


@dataclass(frozen=True)
class Cut:
    """How rows are ordered within ``keys`` and which block a row belongs to.

    ``order`` is a time, a time and an id, or an id.
    ``number`` must not decrease along ``order``.
    """

    keys: tuple[str, ...]
    order: tuple[str, ...]
    number: Callable[[], Column]

    @property
    def parts(self) -> list[str]:
        return [*self.keys, BLOCK]

    def order_key(self) -> Column:
        """The order as one value; (time, id) packed so that ``min_by`` stays a hash aggregate."""
        if len(self.order) == 1:
            return F.col(self.order[0])
        if len(self.order) == 2:
            return arrival_key(*[F.col(c) for c in self.order])
        return F.struct(*self.order)

    def window(self) -> WindowSpec:
        return ordered(self.parts, *self.order)

    def backwards(self) -> WindowSpec:
        return ordered(self.parts, *[F.desc(c) for c in self.order])

    def between_blocks(self) -> WindowSpec:
        return ordered(self.keys, BLOCK)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BLOCK, self.number())


def time_cut(width: timedelta = timedelta(hours=1), keys: Sequence[str] = ("symbol",),
             order: Sequence[str] = ("ts", "trade_id")) -> Cut:
    """Blocks of equal time; ``order`` starts with the time column."""
    return Cut(tuple(keys), tuple(order), lambda: slot(F.col(order[0]), width))


def id_cut(size: int, column: str, keys: Sequence[str] = ("symbol",)) -> Cut:
    """Blocks of equal id range along an ever-growing id: at most ``size`` rows each,
    however the rows bunch in time."""
    return Cut(tuple(keys), (column,), lambda: F.floor(F.col(column) / F.lit(size)).cast("long"))


def trade_cut(size: int = 1_000_000) -> Cut:
    """Trades in the order of their ids, which grow with time."""
    return id_cut(size, "trade_id")


def message_cut(size: int = 1_000_000) -> Cut:
    """Depth messages in the order they arrived."""
    return id_cut(size, "arrival")


def with_lookback(df: DataFrame, cut: Cut, rows: int) -> DataFrame:
    """Add ``_block`` and copy into each block the ``rows`` rows that precede it.

    Copies have ``_carried`` = true and are to be dropped after the window ran. Exact
    for blocks of any size: where a block is shorter than ``rows``, rows of several
    earlier blocks are carried.
    """
    own = cut.apply(df)
    counts = own.groupBy(*cut.parts).agg(F.count(F.lit(1)).alias("_n"))
    w = cut.between_blocks()
    # Every listed block holds at least one row, so ``rows`` following blocks suffice.
    spans = (
        counts
        .withColumn("_end", F.sum("_n").over(so_far(w)))
        .withColumn("_start", F.col("_end") - F.col("_n"))
        .withColumn("_later", F.collect_list(F.struct(F.col(BLOCK).alias("b"), F.col("_start").alias("s")))
                    .over(w.rowsBetween(1, rows)))
        .withColumn("_to", F.explode(F.filter("_later", lambda t: t["s"] < F.col("_end") + rows)))
        .select(*cut.parts, "_end", "_to")
    )
    tails = (
        own.withColumn("_back", F.row_number().over(cut.backwards()))
        .filter(F.col("_back") <= rows)
    )
    carried = (
        tails.join(spans, cut.parts)
        .filter(F.col("_end") - F.col("_back") >= F.col("_to.s") - rows)
        .select(*df.columns, F.col("_to.b").alias(BLOCK), F.lit(True).alias(CARRIED))
    )
    return own.withColumn(CARRIED, F.lit(False)).unionByName(carried)


def with_lookahead(df: DataFrame, cut: Cut, rows: int) -> DataFrame:
    """Only the copies: the ``rows`` rows that follow each block, ``_block`` being the block they are copied into.

    The mirror image of ``with_lookback``, exact for blocks of any size.
    """
    own = cut.apply(df)
    counts = own.groupBy(*cut.parts).agg(F.count(F.lit(1)).alias("_n"))
    w = cut.between_blocks()
    # Every listed block holds at least one row, so ``rows`` blocks before suffice.
    spans = (
        counts
        .withColumn("_end", F.sum("_n").over(so_far(w)))
        .withColumn("_start", F.col("_end") - F.col("_n"))
        .withColumn("_sooner", F.collect_list(F.struct(F.col(BLOCK).alias("b"), F.col("_end").alias("e")))
                    .over(w.rowsBetween(-rows, -1)))
        .withColumn("_to", F.explode(F.filter("_sooner", lambda t: t["e"] > F.col("_start") - rows)))
        .select(*cut.parts, "_start", "_to")
    )
    heads = (
        own.withColumn("_front", F.row_number().over(cut.window()))
        .filter(F.col("_front") <= rows)
    )
    return (
        heads.join(spans, cut.parts)
        .filter(F.col("_start") + F.col("_front") <= F.col("_to.e") + rows)
        .select(*df.columns, F.col("_to.b").alias(BLOCK), F.lit(True).alias(CARRIED))
    )


def opening(df: DataFrame, cut: Cut, totals: dict[str, Column], combine: Callable) -> DataFrame:
    """Per (keys, block): each total combined over all earlier blocks (NULL at the first)."""
    per_block = cut.apply(df).groupBy(*cut.parts).agg(*[c.alias(n) for n, c in totals.items()])
    before = earlier(cut.between_blocks())
    return per_block.select(*cut.parts, *[combine(n).over(before).alias(n) for n in totals])


def blockwise(df: DataFrame, cut: Cut, rows: int,
              compute: Callable[[DataFrame, WindowSpec], DataFrame], ahead: int = 0) -> DataFrame:
    """Run a computation on neighbouring rows block by block; same rows as over the whole symbol.

    ``compute`` gets the frame and the window to use and must keep every row. Values are
    those of an unbroken window as long as they depend on at most ``rows`` earlier and
    ``ahead`` later rows.
    """
    seen = with_lookback(df, cut, rows)
    if ahead:
        seen = seen.unionByName(with_lookahead(df, cut, ahead))
    return (
        compute(seen, cut.window())
        .filter(~F.col(CARRIED))
        .drop(BLOCK, CARRIED)
    )


def filled(df: DataFrame, columns: Sequence[str], cut: Cut) -> DataFrame:
    """Forward fill across blocks: the last non-null of each earlier block opens the next."""
    first = "_first_"
    seen = {
        first + c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), cut.order_key()))
        for c in columns
    }
    openings = opening(df, cut, seen, lambda n: F.last(n, ignorenulls=True))
    w = so_far(cut.window())
    inside = cut.apply(df).select(
        *cut.parts, *[c for c in df.columns if c not in (*columns, *cut.keys)],
        *[F.last(c, ignorenulls=True).over(w).alias(c) for c in columns])
    return (
        inside.join(openings, cut.parts, "left")
        .select(*[F.coalesce(F.col(c), F.col(first + c)).alias(c) if c in columns else F.col(c)
                  for c in df.columns])
    )
