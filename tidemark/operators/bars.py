"""Bars from trades and the technical features on bars.

Windows here are partitioned by symbol. The number of bars per symbol is the time span
over the bar width (ten years of 4 h bars: 22,000 rows) however hot the symbol is, since
``ohlc_sample_by`` has reduced its trades map-side. ``blocks.blockwise`` runs the same
computations block by block where finer bars ask for it.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Mapping, Sequence
from datetime import timedelta

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions.frames import full_avg, full_std, ordered, ratio_change, trailing
from ..functions.timing import arrival_key, floor_to
from .blocks import CARRIED, time_cut, with_lookback
from .timegrid import FOUR_HOURS

# Volatility windows in rows and the guard of ratios.
VOLATILITY_WINDOWS = (6, 24, 72)
EPS = 1e-8


def ohlc_sample_by(trades: DataFrame, width: timedelta = FOUR_HOURS,
                   keys: Sequence[str] = ("symbol",), row_id: str = "trade_id") -> DataFrame:
    """First, highest, lowest, last price and volume per key and time bin."""
    arrival = arrival_key(F.col("ts"), F.col(row_id))
    return (
        trades.groupBy(*keys, floor_to(F.col("ts"), width).alias("ts"))
        .agg(
            F.min_by("price", arrival).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", arrival).alias("close"),
            F.sum(F.col("qty").cast("double")).alias("volume"),
        )
    )


def latest_on(df: DataFrame, keys: Sequence[str], order: tuple[str, str]) -> DataFrame:
    """Newest row per key for tick tables (time, id).

    Column by column rather than as one struct: over fixed-width columns this stays a
    hash aggregate with map-side partials.
    """
    newest = arrival_key(F.col(order[0]), F.col(order[1]))
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*[F.max_by(c, newest).alias(c) for c in rest]).select(*df.columns)


def returns(w: WindowSpec, close: str = "close") -> Column:
    return ratio_change(F.col(close), w)


def log_returns(w: WindowSpec, close: str = "close") -> Column:
    return F.ln(F.try_divide(F.col(close), F.lag(close).over(w)))


def volatility(w: WindowSpec, n: int, ret: str = "returns") -> Column:
    """Sample deviation over ``n`` rows; the windows are row counts whatever the bar width."""
    return full_std(F.col(ret), w, n)


def rsi(w: WindowSpec, n: int = 14, delta: str = "_delta") -> Column:
    """Relative strength with plain means. The first row counts as no move, not as missing."""
    move = F.coalesce(F.col(delta), F.lit(0.0))
    frame = trailing(w, n)
    gain = F.avg(F.greatest(move, F.lit(0.0))).over(frame)
    loss = F.avg(F.greatest(-move, F.lit(0.0))).over(frame)
    strength = gain / (loss + F.lit(EPS))
    return F.when(F.count(F.lit(1)).over(frame) == n, 100 - 100 / (1 + strength))


def true_range(previous: str = "_previous") -> Column:
    return F.greatest(
        F.col("high") - F.col("low"),
        F.abs(F.col("high") - F.col(previous)),
        F.abs(F.col("low") - F.col(previous)))


def with_moves(df: DataFrame, w: WindowSpec) -> DataFrame:
    """Row-to-row quantities the rolling features are built on."""
    return (
        df.withColumn("returns", returns(w))
        .withColumn("log_returns", log_returns(w))
        .withColumn("_previous", F.lag("close").over(w))
        .withColumn("_delta", F.col("close") - F.col("_previous"))
        .withColumn("_range", true_range())
    )


def technical_columns(df: DataFrame, w: WindowSpec) -> DataFrame:
    out = with_moves(df, w)
    rolling = {f"volatility_{n}h": volatility(w, n) for n in VOLATILITY_WINDOWS}
    rolling["rsi_14"] = rsi(w)
    rolling["atr_14"] = full_avg(F.col("_range"), w, 14)
    return out.withColumns(rolling).drop("_previous", "_delta", "_range")


def technical_features(bars: DataFrame, keys: Sequence[str] = ("symbol",), ts: str = "ts") -> DataFrame:
    """Returns, log returns, three volatilities, RSI and ATR: one shuffle, one sort."""
    return technical_columns(bars, ordered(keys, ts))


def moving_avg(df: DataFrame, column: str, n: int, into: str, full: bool,
               keys: Sequence[str] = ("symbol",), ts: str = "ts") -> DataFrame:
    """Rolling mean; ``full`` asks for a complete window, else short windows count too."""
    w = ordered(keys, ts)
    c = F.col(column)
    return df.withColumn(into, full_avg(c, w, n) if full else F.avg(c).over(trailing(w, n)))


def moving_std(df: DataFrame, column: str, n: int, into: str,
               keys: Sequence[str] = ("symbol",), ts: str = "ts") -> DataFrame:
    return df.withColumn(into, full_std(F.col(column), ordered(keys, ts), n))


def rolling_quantiles(df: DataFrame, wanted: Mapping[str, tuple[str, float]], n: int, keys: Sequence[str] = ("symbol",),
                      ts: str = "ts", block: timedelta | None = None) -> DataFrame:
    """Exact interpolated quantiles over the last ``n`` rows; ``wanted``: new column -> (column, share).

    NULL where fewer than ``n`` of those rows have a value. Each column's window is a sorted
    array from which one value leaves and into which one comes per row, found by bisection, so
    no row looks at the whole window. A task holds one key's series, which is bounded for bars;
    longer series are cut into blocks of time (``block``) with the ``n - 1`` rows before them.
    """
    rows = df.withColumns({f"_of_{c}": F.col(c).cast("double") for c, _ in wanted.values()})
    parts = list(keys)
    if block is None:
        rows = rows.withColumn(CARRIED, F.lit(False))
    else:
        cut = time_cut(block, keys, (ts,))
        rows, parts = with_lookback(rows, cut, n - 1), cut.parts
    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    out = ", ".join(f"`{c}` double" for c in wanted)
    return rows.groupBy(*parts).applyInArrow(_quantiles(dict(wanted), n, ts, df.columns), f"{named}, {out}")


def _quantiles(wanted: dict[str, tuple[str, float]], n: int, ts: str, columns: list[str]):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(ts)
        own = pc.invert(rows[CARRIED])
        out = {}
        for column in dict.fromkeys(c for c, _ in wanted.values()):
            shares = {name: q for name, (c, q) in wanted.items() if c == column}
            values = rows[f"_of_{column}"].to_pylist()
            window: list[float] = []
            found = {name: [None] * len(values) for name in shares}
            for i, x in enumerate(values):
                if i >= n and values[i - n] is not None:
                    del window[bisect_left(window, values[i - n])]
                if x is not None:
                    insort(window, x)
                if len(window) == n:
                    for name, q in shares.items():
                        at = q * (n - 1)
                        low = int(at)
                        high = min(low + 1, n - 1)
                        found[name][i] = window[low] + (window[high] - window[low]) * (at - low)
            out |= {name: pa.array(v, pa.float64()) for name, v in found.items()}
        table = rows.select(columns)
        for name in wanted:
            table = table.append_column(name, out[name])
        return table.filter(own)

    return run


def rolling_quantile(df: DataFrame, column: str, q: float, n: int, into: str,
                     keys: Sequence[str] = ("symbol",), ts: str = "ts") -> DataFrame:
    return rolling_quantiles(df, {into: (column, q)}, n, keys, ts)


def src_ohlcv(candles: DataFrame, window_days: int = 730) -> DataFrame:
    """Candle arrays [ms, o, h, l, c, v] -> bars of the last ``window_days`` days."""
    k = F.col("candle")
    names = ("open", "high", "low", "close", "volume")
    bars = candles.select(
        "symbol", F.timestamp_millis(k[0].cast("long")).cast("timestamp_ntz").alias("ts"),
        *[F.nanvl(k[i + 1], F.lit(None).cast("double")).alias(n) for i, n in enumerate(names)])
    newest = bars.agg(F.max("ts")).scalar()
    return bars.filter(F.col("ts") >= newest - F.make_dt_interval(F.lit(window_days)))


def src_macro(bars: DataFrame, symbol: str) -> DataFrame:
    """Close of the second instrument, by time."""
    return bars.filter(F.col("symbol") == symbol).select("ts", F.col("close").alias("BTCDOM"))


def update_window(old: DataFrame, new: DataFrame, days: int = 730,
                  keys: Sequence[str] = ("symbol",), ts: str = "ts") -> DataFrame:
    """Old and new rows together, the new one winning, cut to the last ``days`` days."""
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    rest = [c for c in old.columns if c not in (*keys, ts)]
    merged = (
        both.groupBy(*keys, ts).agg(*[F.max_by(c, "_age").alias(c) for c in rest])
    )
    newest = both.agg(F.max(ts)).scalar()
    return merged.filter(F.col(ts) > newest - F.make_dt_interval(F.lit(days))).select(*old.columns)


def union_candles(*pages: DataFrame) -> DataFrame:
    """Candle pages one after another; pages do not overlap by contract."""
    out = pages[0]
    for page in pages[1:]:
        out = out.unionByName(page)
    return out
