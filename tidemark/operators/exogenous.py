"""Daily series next to the bars: on-chain flows, stablecoins, derivatives, macro, sentiment.

Series are keyed by symbol and hold at most one row per symbol and day (or 8 hours), so
windows over a whole symbol stay small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import full_avg, full_std, ordered, trailing
from ..functions.numeric import clip
from ..functions.timing import floor_to
from .bars import EPS
from .timegrid import FOUR_HOURS, asof_grid, ffill, grid_of, join_left_ts, join_outer_ts, pct_change

# Column names of the series, window and limit of the flow score.
ONCHAIN = ("net_flow", "reserve", "reserve_change", "netflow_ma7", "netflow_volatility")
STABLECOIN = ("stablecoin_mcap", "stablecoin_flow_7d", "stablecoin_trend")
DERIVATIVES = ("open_interest_norm", "oi_change", "funding_rate")
Z_WINDOW = 42
Z_LIMIT = 5.0


def zero_if_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns that are absent become 0.0; NULLs in present ones become 0.0."""
    have = set(df.columns)
    return df.withColumns({
        c: F.coalesce(F.col(c), F.lit(0.0)) if c in have else F.lit(0.0) for c in columns})


def net_flow_z(df: DataFrame, column: str = "net_flow", into: str = "Net_Flow_Z",
               keys: Sequence[str] = ("symbol",), ts: str = "ts") -> DataFrame:
    w = ordered(keys, ts)
    c = F.col(column)
    z = (c - full_avg(c, w, Z_WINDOW)) / (full_std(c, w, Z_WINDOW) + F.lit(EPS))
    return df.withColumn(into, clip(z, -Z_LIMIT, Z_LIMIT))


def onchain_composite(net_flow: DataFrame, reserve: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Net flow and reserve on one time line with three derived columns.

    Times are cut to the day first, so that two series stamped at different times of the
    day meet in one row.
    """
    flow, held = (
        d.withColumn("ts", F.date_trunc("day", "ts").cast("timestamp_ntz")) for d in (net_flow, reserve))
    joined = join_outer_ts(flow, held, keys)
    w = ordered(keys, "ts")
    return (
        pct_change(joined, "reserve", "reserve_change", keys)
        .withColumn("netflow_ma7", full_avg(F.col("net_flow"), w, 7))
        .withColumn("netflow_volatility", full_std(F.col("net_flow"), w, 7))
        .select(*keys, "ts", *ONCHAIN)
    )


def stablecoin_metrics(series: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Daily change columns, partial-window means and the trend between them."""
    w = ordered(keys, "ts")
    cap = F.col("total_mcap")
    return (
        pct_change(series, "total_mcap", "mcap_pct_change", keys)
        .withColumn("mcap_change_1d", cap - F.lag(cap, 1).over(w))
        .withColumn("mcap_change_7d", cap - F.lag(cap, 7).over(w))
        .withColumn("mcap_ma7", F.avg(cap).over(trailing(w, 7)))
        .withColumn("mcap_ma30", F.avg(cap).over(trailing(w, 30)))
        .withColumn("mcap_trend", F.try_divide(F.col("mcap_ma7"), F.col("mcap_ma30")) - 1)
    )


def normalise_scale(df: DataFrame, column: str, unit: float, into: str) -> DataFrame:
    return df.withColumn(into, F.col(column) / F.lit(unit))


def stablecoin_features(series: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    m = stablecoin_metrics(series, keys)
    scaled = (
        m.withColumn("stablecoin_mcap", F.col("total_mcap") / F.lit(1e11))
        .withColumn("stablecoin_flow_7d", F.col("mcap_change_7d") / F.lit(1e10))
        .withColumn("stablecoin_trend", F.col("mcap_trend"))
    )
    return zero_if_missing(scaled.select(*keys, "ts", *STABLECOIN), STABLECOIN)


def open_interest_metrics(oi: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    w = ordered(keys, "ts")
    return pct_change(oi, "open_interest", "oi_change", keys).withColumn(
        "oi_ma7", F.avg("open_interest").over(trailing(w, 7)))


def join_oi_funding(oi: DataFrame, funding: DataFrame | None, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Funding of exactly the same time, 0 where there is none."""
    if funding is None:
        return oi.withColumn("funding_rate", F.lit(0.0))
    return zero_if_missing(oi.join(funding, [*keys, "ts"], "left"), ("funding_rate",))


def derivatives_features(oi: DataFrame, funding: DataFrame | None = None,
                         keys: Sequence[str] = ("symbol",)) -> DataFrame:
    joined = join_oi_funding(open_interest_metrics(oi, keys), funding, keys)
    scaled = normalise_scale(joined, "open_interest", 1e9, "open_interest_norm")
    return zero_if_missing(scaled.select(*keys, "ts", *DERIVATIVES), DERIVATIVES)


def macro_change(macro: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Change rate of the macro series on the 4 h grid. One instrument: one bounded series."""
    held = list(keys) or ["_series"]
    named = macro if keys else macro.withColumn("_series", F.lit(0))
    gridded = asof_grid(named, FOUR_HOURS, held, span=None)
    return pct_change(gridded, "BTCDOM", "BTCDOM_ROC", held).select(*keys, "ts", "BTCDOM_ROC")


def merge_macro(bars: DataFrame, macro: DataFrame | None, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Add ``BTCDOM_ROC``: joined on time, carried forward, 0 before the first value."""
    if macro is None:
        return bars.withColumn("BTCDOM_ROC", F.lit(0.0))
    joined = join_left_ts(bars, macro_change(macro), ["ts"])
    filled = ffill(joined, ["BTCDOM_ROC"], keys, span=None)
    return zero_if_missing(filled, ("BTCDOM_ROC",)).select(*bars.columns, "BTCDOM_ROC")


# --- headlines ---------------------------------------------------------------

def union_news(*feeds: DataFrame) -> DataFrame:
    """Feeds in order of priority, one under the other with their ``source_rank``."""
    ranked = [f.withColumn("source_rank", F.lit(i)) for i, f in enumerate(feeds)]
    out = ranked[0]
    for f in ranked[1:]:
        out = out.unionByName(f)
    return out


def distinct_titles(news: DataFrame, order: Sequence[str] = ("source_rank", "ts", "doc_id")) -> DataFrame:
    """One row per title: first by source priority, then by time.

    An aggregate rather than a window: a title repeated millions of times is reduced
    map-side instead of being sorted in one task.
    """
    rest = [c for c in news.columns if c != "title"]
    return (
        news.groupBy("title").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*[F.col("title") if c == "title" else F.col("_row")[c].alias(c) for c in news.columns])
    )


def sentiment_from_probabilities(df: DataFrame, probabilities: str = "probs") -> DataFrame:
    """Score = p(positive) - p(negative), confidence = highest; no model output -> (0, 0)."""
    p = F.col(probabilities)
    return df.withColumn("sentiment_score", F.coalesce(p[0] - p[1], F.lit(0.0))).withColumn(
        "confidence", F.coalesce(F.array_max(p), F.lit(0.0)))


def filter_confidence(df: DataFrame, least: float = 0.90) -> DataFrame:
    return df.filter(F.col("confidence") >= least)


def agg_sentiment_4h(scored: DataFrame) -> DataFrame:
    """Mean score of every 4 h bin between the first and the last headline; empty bins 0."""
    binned = scored.groupBy(floor_to(F.col("ts"), FOUR_HOURS).alias("ts")).agg(
        F.avg("sentiment_score").alias("FinBERT_Score"))
    return zero_if_missing(grid_of(binned, FOUR_HOURS, ()).join(binned, "ts", "left"), ("FinBERT_Score",))


def sentiment_features(scored: DataFrame, least: float = 0.90) -> DataFrame:
    """Scored headlines (all feeds) -> one score per 4 h."""
    return agg_sentiment_4h(filter_confidence(distinct_titles(scored), least))


