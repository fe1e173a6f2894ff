"""Price grids from regime signals: one row per level, for all symbols and times at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip, spaced
from .labels import DOWN, RANGE, UP


@dataclass(frozen=True)
class Budget:
    # Default budget of a price grid.
    capital: float = 1000.0
    allocation: float = 0.8
    least_order: float = 20.0
    least_spacing: float = 0.005
    most_spacing: float = 0.03

    @property
    def available(self) -> float:
        return self.capital * self.allocation

    @property
    def most_orders(self) -> int:
        return int(self.available / self.least_order)


def grid_parameters(signals: DataFrame, b: Budget = Budget(), volatility: str = "volatility_24h") -> DataFrame:
    """Signals (price, regime, volatility) -> grid geometry. The danger regime gets none."""
    regime = F.col("regime")
    flat = regime == RANGE

    def by_regime(in_range, going_up, going_down) -> Column:
        return F.when(flat, F.lit(in_range)).when(regime == UP, F.lit(going_up)).otherwise(F.lit(going_down))

    spacing = clip(F.col(volatility) * 2, b.least_spacing, b.most_spacing)
    reach = F.col("price") * F.col("spacing") * F.col("n_levels") * F.col("range_multiplier")
    return (
        signals.filter(regime.isin(RANGE, UP, DOWN))
        .withColumns({
            "grid_type": by_regime("NEUTRAL", "LONG_BIASED", "SHORT_BIASED"),
            "n_levels": by_regime(*[min(n, b.most_orders) for n in (30, 20, 20)]),
            "spacing": spacing * by_regime(1.0, 1.2, 1.2),
            "range_multiplier": by_regime(1.5, 1.3, 1.3),
            "long_bias": by_regime(0.5, 0.7, 0.3),
            "short_bias": by_regime(0.5, 0.3, 0.7),
        })
        .withColumn("upper_bound", F.col("price") + reach)
        .withColumn("lower_bound", F.col("price") - reach)
    )


def filter_min_order(levels: DataFrame, least: float = Budget.least_order) -> DataFrame:
    return levels.filter(F.col("value_usd") >= least)


def grid_levels(parameters: DataFrame, b: Budget = Budget(), keep_small: bool = False) -> DataFrame:
    """Geometry -> order levels; zero levels give zero rows, and a level priced at or
    below zero is flagged rather than dropped."""
    n = F.col("n_levels")
    levels = (
        parameters.filter(n > 0)
        .withColumn("level", F.explode(F.sequence(F.lit(0), n - 1)))
        .withColumn("level_price", spaced(F.col("lower_bound"), F.col("upper_bound"), F.col("level"), n))
        .withColumn("side", F.when(F.col("level_price") < F.col("price"), "buy").otherwise("sell"))
    )
    bias = F.when(F.col("side") == "buy", F.col("long_bias")).otherwise(F.col("short_bias"))
    sized = (
        levels.withColumn("quantity", F.try_divide(F.lit(b.available), n * F.col("level_price")) * bias * 2)
        .withColumn("value_usd", F.col("quantity") * F.col("level_price"))
        .withColumn("bad_price", F.col("level_price") <= 0)
        .select("symbol", "ts", "level", F.col("level_price").alias("price"), "side", "quantity",
                "value_usd", "bad_price")
    )
    return sized if keep_small else filter_min_order(sized, b.least_order)
