"""Order flow: trade classification, volume buckets and flow toxicity (VPIN).

Trades are unbounded per symbol, so everything at trade level runs block by block
(see ``blocks``); only bucket-level rows are windowed further, in blocks of buckets.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions.frames import earlier, ordered, so_far, trailing
from ..functions.numeric import norm_cdf
from .blocks import BLOCK, CARRIED, Cut, blockwise, trade_cut, with_lookback
from .timegrid import asof_join

# Look-backs, stand-ins and limits of the flow measures.
SIGMA_WINDOW = 100
SIGMA_LEAST = 10
SIGMA_UNKNOWN = 1.0
SIGMA_FLAT = 0.01
BUCKET_VOLUME = 1000
VPIN_WINDOW = 50
VPIN_NEUTRAL = 0.5
VPIN_ALERT = 0.8
BUCKETS_PER_BLOCK = 100_000
LOTS = 100_000_000  # quantities have eight decimals


def lots(qty: str = "qty") -> Column:
    """Exact quantity as a whole number of 1e-8 units."""
    return (F.col(qty) * F.lit(LOTS)).cast("decimal(38,0)")


def bucket_parts(volume: int, qty: str = "qty") -> tuple[Column, Column]:
    """A quantity as whole buckets and the lots left over (less than a bucket), both longs.

    Quantities that fit in 64 bits of lots, nearly all, stay in long arithmetic.
    """
    size = F.lit(volume * LOTS)
    small = F.col(qty) < F.lit(90_000_000_000)
    short = (F.col(qty) * F.lit(LOTS)).cast("bigint")
    whole = F.call_function("div", lots(qty), size)
    full = F.when(small, F.call_function("div", short, size)).otherwise(whole)
    rest = F.when(small, F.pmod(short, size)).otherwise((lots(qty) % size).cast("bigint"))
    return full, rest


def price_change(w: WindowSpec) -> Column:
    return F.col("price") - F.lag("price").over(w)


def trade_price_change(trades: DataFrame, cut: Cut = trade_cut()) -> DataFrame:
    """Change to the previous trade; the first trade of a symbol has none and is dropped."""
    changed = blockwise(trades, cut, 1, lambda d, w: d.withColumn("price_change", price_change(w)))
    return changed.filter(F.col("price_change").isNotNull())


def with_sigma(d: DataFrame, cut: Cut) -> DataFrame:
    """Add the price change and the population deviation of the last 100 changes, with
    stand-ins for too few changes and for a flat price.

    A sliding frame would visit 100 rows per trade. Here the rows of a block are counted
    off in runs of 100: the last 100 changes are the current run so far plus the rest of
    the run before. Of both parts (count, mean, sum of squared differences from the mean)
    is kept, which grows and merges without the cancellation that sums of squares suffer,
    so each trade costs a constant number of steps. Equal changes give exactly 0.
    """
    n = SIGMA_WINDOW
    w = cut.window()
    run = ordered([*cut.parts, "_run"], *cut.order)
    back = ordered([*cut.parts, "_run"], *[F.desc(c) for c in cut.order])
    change = F.col("price_change")

    def part(frame: WindowSpec) -> Column:
        count = F.count(change).over(frame)
        spread = F.coalesce(F.var_pop(change).over(frame), F.lit(0.0)) * count
        return F.struct(count.alias("n"), F.coalesce(F.avg(change).over(frame), F.lit(0.0)).alias("mean"), spread.alias("m2"))

    counted = (
        d.withColumn("price_change", price_change(w))
        .withColumn("_row", F.row_number().over(w))
        .withColumn("_run", F.floor((F.col("_row") - 1) / n))
        .withColumn("_rest", part(earlier(back)))  # the rows of the run behind this one
        .withColumn("_sofar", part(so_far(run)))
        .withColumn("_old", F.lag("_rest", n).over(w))
    )
    a, b = F.col("_sofar"), F.col("_old")
    old = F.coalesce(b["n"], F.lit(0))
    known = a["n"] + old
    apart = a["mean"] - F.coalesce(b["mean"], F.lit(0.0))
    m2 = a["m2"] + F.when(old > 0, b["m2"] + apart * apart * a["n"] * old / known).otherwise(0.0)
    return counted.withColumn(
        "sigma",
        F.when(known <= SIGMA_LEAST, F.lit(SIGMA_UNKNOWN))
        .when(m2 <= 0, F.lit(SIGMA_FLAT))
        .otherwise(F.sqrt(m2 / known))
    ).drop("_row", "_run", "_rest", "_sofar", "_old")


def trade_sigma(trades: DataFrame, cut: Cut = trade_cut()) -> DataFrame:
    changed = blockwise(trades, cut, SIGMA_WINDOW, lambda d, w: with_sigma(d, cut))
    return changed.filter(F.col("price_change").isNotNull())


def bvc_classify(flow: DataFrame) -> DataFrame:
    """Bulk classification: the probability that a trade was a purchase, and both volumes."""
    z = flow.withColumn("_z", F.col("price_change") / F.when(F.col("sigma") == 0, 1.0).otherwise(F.col("sigma")))
    qty = F.col("qty").cast("double")
    return (
        z.withColumn("buy_prob", norm_cdf(F.col("_z")))
        .withColumn("buy_volume", qty * F.col("buy_prob"))
        .withColumn("sell_volume", qty * (1 - F.col("buy_prob")))
        .drop("_z")
    )


def running_volume(trades: DataFrame, volume: int = BUCKET_VOLUME, cut: Cut = trade_cut()) -> DataFrame:
    """Trades with change, sigma and their place in the running volume of the symbol:
    after the trade ``filled`` lots are in bucket ``bucket``; it brought ``full`` whole
    buckets and ``rest`` lots.

    Volume is carried as (whole buckets, lots of the open one), which adds up in any
    order, so no number grows with the volume but the bucket's own. The symbol's first
    trade is discarded and does not count. One shuffle of the trades: look-back windows,
    running sums and the join of the opening totals all use the (symbol, block)
    partitioning. Lots are summed as longs where a block of 16 million trades cannot
    overflow them, else as decimals.
    """
    size = F.lit(volume * LOTS)
    full, rest = bucket_parts(volume)
    kind = "bigint" if volume * LOTS <= 1 << 38 else "decimal(38,0)"
    between = cut.between_blocks()
    wide = "decimal(38,0)"
    own = cut.apply(trades).withColumn("full", full).withColumn("rest", rest)
    per_block = own.groupBy(*cut.parts).agg(
        F.sum(F.col("full").cast(wide)).alias("_full"), F.sum(F.col("rest").cast(wide)).alias("_rest"),
        F.min_by("full", cut.order_key()).alias("_first_full"), F.min_by("rest", cut.order_key()).alias("_first_rest"))

    def before(total: str, first: str) -> Column:
        return F.sum(total).over(so_far(between)) - F.col(total) - F.first(first).over(so_far(between))

    opened = (
        per_block.withColumn("_before", before("_rest", "_first_rest")).withColumn("_buckets", before("_full", "_first_full"))
        .withColumn("_open", F.pmod("_before", size))
        .select(*cut.parts, F.col("_open").cast("bigint").alias("_open"),
                (F.col("_buckets") + F.call_function("div", F.col("_before") - F.col("_open"), size)).cast("bigint").alias("_bucket"))
    )
    w = cut.window()
    inside = (
        with_sigma(with_lookback(trades, cut, SIGMA_WINDOW), cut)
        .filter(~F.col(CARRIED))
        .withColumn("full", full).withColumn("rest", rest)
        .withColumn("_full", F.sum("full").over(so_far(w)))
        .withColumn("_rest", F.sum(F.col("rest").cast(kind)).over(so_far(w)))
    )
    reached = F.col("_open").cast(kind) + F.col("_rest")
    return (
        inside.join(opened, cut.parts)
        .withColumn("filled", F.pmod(reached, size).cast("bigint"))
        .withColumn("bucket", (F.col("_bucket") + F.col("_full") + F.call_function("div", reached, size)).cast("bigint"))
        .filter(F.col("price_change").isNotNull())
        .select(*trades.columns, "price_change", "sigma", "full", "rest", "bucket", "filled")
    )


BUCKETS_AT_ONCE = 10_000


def volume_buckets(flow: DataFrame, volume: int = BUCKET_VOLUME) -> DataFrame:
    """Split each trade over the fixed-volume buckets it reaches, pro rata.

    ``piece`` is the quantity that falls into ``bucket``. Whole lots keep every trade on
    the right side of a boundary. A trade over very many buckets is expanded in chunks of
    ``BUCKETS_AT_ONCE``, so no single row ever holds more.
    """
    size, chunk = F.lit(volume * LOTS), F.lit(BUCKETS_AT_ONCE)
    borrow = F.col("rest") > F.col("filled")
    placed = (
        flow.filter((F.col("full") > 0) | (F.col("rest") > 0))
        .withColumn("_from", F.col("bucket") - F.col("full") - borrow.cast("int"))
        .withColumn("_begin", F.col("filled") - F.col("rest") + F.when(borrow, size).otherwise(0))
        .withColumn("_to", F.col("bucket") - (F.col("filled") == 0).cast("int"))
        .withColumn("_end", F.when(F.col("filled") == 0, size).otherwise(F.col("filled")))
        .withColumn("_chunk", F.explode(F.sequence(F.floor(F.col("_from") / chunk), F.floor(F.col("_to") / chunk))))
        .withColumn("_at", F.explode(F.sequence(
            F.greatest("_from", F.col("_chunk") * chunk), F.least(F.col("_to"), F.col("_chunk") * chunk + chunk - 1))))
    )
    pieces = placed.withColumn(
        "piece_lots", F.when(F.col("_at") == F.col("_to"), F.col("_end")).otherwise(size)
        - F.when(F.col("_at") == F.col("_from"), F.col("_begin")).otherwise(0))
    return (
        pieces.withColumn("bucket", F.col("_at"))
        .withColumn("piece", F.col("piece_lots") / F.lit(float(LOTS)))
        .drop("_from", "_to", "_begin", "_end", "_chunk", "_at", "full", "rest", "filled")
    )


def vpin_bucket_agg(pieces: DataFrame, volume: int = BUCKET_VOLUME,
                    keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Closed buckets with their signed-volume imbalance and closing time."""
    signed = F.col("piece") * (2 * F.col("buy_prob") - 1)
    return (
        pieces.groupBy(*keys, "bucket")
        .agg(
            F.sum("piece_lots").alias("_lots"),
            F.abs(F.sum(signed)).alias("imbalance"),
            F.max("ts").alias("closed_at"),
            F.max("trade_id").alias("closing_trade"),
        )
        .filter(F.col("_lots") == volume * LOTS)
        .drop("_lots")
    )


def vpin(buckets: DataFrame, volume: int = BUCKET_VOLUME, window: int = VPIN_WINDOW,
         per_block: int = BUCKETS_PER_BLOCK, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Toxicity at each bucket close; neutral until ``window`` buckets are known.

    Buckets are numbered without gaps, so the rows a block needs from the one before it
    are known from the number alone.
    """
    home = F.floor(F.col("bucket") / F.lit(per_block))
    reach = F.floor((F.col("bucket") + window - 1) / F.lit(per_block))
    spread = (
        buckets.withColumn(BLOCK, F.explode(F.sequence(home, reach)))
        .withColumn(CARRIED, F.col(BLOCK) != home)
    )
    frame = trailing(ordered([*keys, BLOCK], "bucket"), window)
    toxicity = F.sum("imbalance").over(frame) / F.lit(float(window * volume))
    return (
        spread.withColumn("vpin", F.when(F.count(F.lit(1)).over(frame) < window, F.lit(VPIN_NEUTRAL))
                          .otherwise(toxicity))
        .filter(~F.col(CARRIED))
        .drop(BLOCK, CARRIED)
    )


def vpin_alert(toxicity: DataFrame, level: float = VPIN_ALERT) -> DataFrame:
    return toxicity.filter(F.col("vpin") > level)


def trade_toxicity(trades: DataFrame, volume: int = BUCKET_VOLUME, window: int = VPIN_WINDOW,
                   cut: Cut = trade_cut()) -> DataFrame:
    """Trades -> VPIN per closed bucket."""
    pieces = volume_buckets(bvc_classify(running_volume(trades, volume, cut)), volume)
    return vpin(vpin_bucket_agg(pieces, volume), volume, window)


def vpin_as_of(instants: DataFrame, toxicity: DataFrame, span: timedelta | None = timedelta(hours=1),
               keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Each instant with the value of the last bucket closed by then, neutral before that."""
    closes = toxicity.select(*keys, F.col("closed_at").alias("ts"), "bucket", "vpin")
    found = asof_join(instants, closes, keys, "ts", span, tie=("bucket",))
    return found.drop("bucket").withColumn("vpin", F.coalesce("vpin", F.lit(VPIN_NEUTRAL)))
