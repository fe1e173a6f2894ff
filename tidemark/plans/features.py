"""The feature table: bars with every other source aligned to them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import exogenous as X
from ..operators.bars import technical_features
from ..operators.timegrid import asof_on_grid, ffill, join_left_ts
from ..schemas import OHLCV


@dataclass(frozen=True)
class Dataset:
    """The inputs of one run. Optional sources may be absent; their features are then 0."""

    bars: DataFrame
    macro: DataFrame | None = None
    onchain: DataFrame | None = None
    sentiment: DataFrame | None = None
    stablecoins: DataFrame | None = None
    derivatives: DataFrame | None = None


def select_features(df: DataFrame, keys: tuple[str, ...] = ("symbol", "ts")) -> list[str]:
    """Every column that is neither a key nor part of the bar itself."""
    return [c for c in df.columns if c not in (*keys, *OHLCV)]


def build_full_features(data: Dataset) -> DataFrame:
    """Technical features, then each source as-of its 4 h grid, defaults, and complete rows only.

    On-chain gaps are kept, so bars after the last on-chain grid point are dropped with the
    warm-up rows; stablecoin, derivatives, sentiment and macro gaps become 0.
    """
    # Sources without a symbol first, by time; then everything that runs along a symbol,
    # for which one shuffle and one sort of the bars are enough.
    df = data.bars
    if data.macro is not None:
        df = join_left_ts(df, X.macro_change(data.macro), ["ts"])
    if data.sentiment is not None:
        df = join_left_ts(df, data.sentiment.select("ts", "FinBERT_Score"), ["ts"])
    series = [s for s in (data.onchain, data.stablecoins, data.derivatives) if s is not None]
    df = technical_features(asof_on_grid(df, series))
    if data.macro is not None:
        df = ffill(df, ["BTCDOM_ROC"], span=None)
    if data.onchain is not None:
        df = X.net_flow_z(df)
    else:
        df = X.zero_if_missing(df, ("Net_Flow_Z",))
    df = X.zero_if_missing(df, ("BTCDOM_ROC", "FinBERT_Score", *X.STABLECOIN, *X.DERIVATIVES))
    return df.na.drop("any")
