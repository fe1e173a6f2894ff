"""Forward-looking regime labels and the reports on them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions.frames import ordered, ratio_change
from ..functions.timing import age_days
from ..session import materialise
from .bars import rolling_quantiles
from .blocks import Cut, blockwise
from .timegrid import max_ts

# Regime numbers, quantiles and look-back of the adaptive labels.
RANGE, UP, DOWN, DANGER = 0, 1, 2, 3
ADAPTIVE_LOOKBACK = 168


@dataclass(frozen=True)
class Thresholds:
    # Default limits of the label rules.
    forward_window: int = 3
    volatility_low: float = 0.015
    volatility_high: float = 0.05
    trend: float = 0.02


def forward_return(w: WindowSpec, n: int) -> Column:
    return F.try_divide(F.lead("close", n).over(w), F.col("close")) - 1


def forward_volatility(w: WindowSpec, n: int, ret: str = "_ret") -> Column:
    """Deviation of the next ``n`` returns; not defined for the first ``n - 1`` rows."""
    ahead = w.rowsBetween(1, n)
    ready = (F.count(ret).over(ahead) == n) & (F.row_number().over(w) >= n)
    return F.when(ready, F.stddev_samp(ret).over(ahead))


def forward_hl_range(w: WindowSpec, n: int) -> Column:
    """High-low range of the single bar ``n`` rows ahead, relative to the current close."""
    return F.try_divide(F.lead("high", n).over(w) - F.lead("low", n).over(w), F.col("close"))


def forward_columns(df: DataFrame, t: Thresholds, w: WindowSpec) -> DataFrame:
    n = t.forward_window
    return (
        df.withColumn("_ret", ratio_change(F.col("close"), w))
        .withColumns({
            "forward_return": forward_return(w, n),
            "forward_volatility": forward_volatility(w, n),
            "forward_hl_range": forward_hl_range(w, n),
        })
        .drop("_ret")
    )


def with_forward(df: DataFrame, t: Thresholds, keys: Sequence[str], ts: str) -> DataFrame:
    return forward_columns(df, t, ordered(keys, ts))


def with_forward_blockwise(df: DataFrame, cut: Cut, t: Thresholds = Thresholds()) -> DataFrame:
    """The same for fine bars, block by block: a block sees ``forward_window`` rows before and behind it."""
    return blockwise(df, cut, t.forward_window, lambda d, w: forward_columns(d, t, w), ahead=t.forward_window)


def regime_case(t: Thresholds = Thresholds()) -> Column:
    """First matching rule wins; a comparison with NULL does not match."""
    fr, fv, hl = F.col("forward_return"), F.col("forward_volatility"), F.col("forward_hl_range")
    calm_enough = fv < t.volatility_high
    return (
        F.when((fv > t.volatility_high) | (hl > t.volatility_high * 2), DANGER)
        .when((fv < t.volatility_low) & (F.abs(fr) < t.trend), RANGE)
        .when((fr > t.trend) & calm_enough, UP)
        .when((fr < -t.trend) & calm_enough, DOWN)
        .otherwise(RANGE)
    )


def dropna_subset(df: DataFrame, columns: Sequence[str] = ("forward_return",)) -> DataFrame:
    return df.na.drop(subset=list(columns))


def label_regime(df: DataFrame, t: Thresholds = Thresholds(), keys: Sequence[str] = ("symbol",),
                 ts: str = "ts") -> DataFrame:
    return dropna_subset(with_forward(df, t, keys, ts).withColumn("regime", regime_case(t)))


def label_adaptive(df: DataFrame, lookback: int = ADAPTIVE_LOOKBACK, t: Thresholds = Thresholds(),
                   keys: Sequence[str] = ("symbol",), ts: str = "ts") -> DataFrame:
    """Labels with thresholds from the rolling 20th and 80th percentile."""
    wanted = {
        "vol_p20": ("forward_volatility", 0.20), "vol_p80": ("forward_volatility", 0.80),
        "return_p20": ("forward_return", 0.20), "return_p80": ("forward_return", 0.80),
    }
    fr, fv = F.col("forward_return"), F.col("forward_volatility")
    calm = fv < F.col("vol_p80")
    return dropna_subset(
        rolling_quantiles(with_forward(df, t, keys, ts).drop("forward_hl_range"), wanted, lookback, keys, ts)
        .withColumn(
            "regime_adaptive",
            F.when(fv > F.col("vol_p80"), DANGER)
            .when((fr > F.col("return_p80")) & calm, UP)
            .when((fr < F.col("return_p20")) & calm, DOWN)
            .otherwise(RANGE))
    )


def _class_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per class, each next to the number of rows and of classes: one pass over the input.

    The totals come from the counts, which are one row per class.
    """
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    together = counts.agg(F.collect_list(F.struct(column, "n")).alias("_c"), F.sum("n").alias("_total"), F.count(F.lit(1)).alias("_classes"))
    return together.select(F.inline("_c"), "_total", "_classes")


def regime_distribution(df: DataFrame, column: str = "regime") -> DataFrame:
    """Rows and share in percent per class (rounded half to even, 2 places)."""
    counts = _class_counts(df, column)
    return counts.select(column, "n", F.bround(F.col("n") / F.col("_total") * 100, 2).alias("pct")).orderBy(column)


def regime_summary(df: DataFrame, column: str = "regime") -> DataFrame:
    return df.groupBy(column).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("forward_return").alias("avg_return"),
        F.avg("forward_volatility").alias("avg_volatility"),
        F.min("forward_return").alias("max_drawdown"),
        F.max("forward_return").alias("max_upside"),
    )


def distinct_classes(df: DataFrame, column: str = "regime") -> DataFrame:
    return df.select(column).distinct().orderBy(column)


# --- weights -----------------------------------------------------------------

@dataclass(frozen=True)
class Decay:
    # Default decay of the sample weights.
    rate: float = 0.001
    least: float = 0.1
    most: float = 1.0
    recent_days: int = 7


def half_life_rate(days: Column) -> Column:
    """Decay rate per day that halves a weight after ``days`` days."""
    return F.ln(F.lit(2.0)) / days


def age_weight(age: Column, d: Decay, rate: Column | None = None) -> Column:
    rate = F.lit(d.rate) if rate is None else rate
    aged = F.greatest(F.lit(d.most) * F.exp(-rate * age), F.lit(d.least))
    return F.when(age <= d.recent_days, F.greatest(F.lit(d.most), F.lit(d.least))).otherwise(aged)


def temporal_weight(df: DataFrame, d: Decay = Decay(), keys: Sequence[str] = ("symbol",), ts: str = "ts",
                    rate: Column | None = None) -> DataFrame:
    """Add ``age_days`` (to the newest row of the key) and ``weight``.

    The newest time is aggregated and joined back rather than taken over a window, so a
    hot key is never gathered in one task.
    """

    newest = max_ts(df, keys, ts)
    return (
        df.join(newest, list(keys))
        .withColumn("age_days", age_days(F.col("max_ts"), F.col(ts)))
        .withColumn("weight", age_weight(F.col("age_days"), d, rate))
        .drop("max_ts")
    )


def decay_curve(weighted: DataFrame) -> DataFrame:
    """Observed weight by whole days of age."""
    return weighted.groupBy(F.floor("age_days").alias("days_ago")).agg(
        F.avg("weight").alias("weight"), F.count(F.lit(1)).alias("n"))


def weight_stats(weighted: DataFrame, column: str = "weight") -> DataFrame:
    return weighted.agg(
        F.avg(column).alias("mean"), F.min(column).alias("min"), F.max(column).alias("max"))


def class_balance(df: DataFrame, label: str = "regime") -> DataFrame:
    """n / (classes present * n of class); at most one row per class."""
    fair = F.col("_total") / F.col("_classes")
    return _class_counts(df, label).select(label, "n", (fair / F.col("n")).alias("class_weight"))


def join_class_weight(df: DataFrame, weights: DataFrame, label: str = "regime") -> DataFrame:
    """Every row with the weight of its class. ``weights`` has one row per class; whether it is
    small enough to be sent to every task the planner sees at run time."""
    return df.join(weights.select(label, "class_weight"), label)


def balanced_weight(weighted: DataFrame, label: str = "regime") -> DataFrame:
    """Temporal weight times class weight."""
    return join_class_weight(weighted, class_balance(weighted, label), label).withColumn(
        "final_weight", F.col("weight") * F.col("class_weight"))


# --- splits and scores -------------------------------------------------------

def time_rank(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows with the rank ``rn`` of their time among all ``n_times`` distinct times, from 1, over all keys.

    The distinct times are dealt by ranges, written once, and numbered range by range; only
    the number of times in each range, one row per task, reaches the driver. Rows without a
    time are left out.
    """
    spark = df.sparkSession
    times = df.select(ts).filter(F.col(ts).isNotNull()).distinct().repartitionByRange(ts)
    dealt = materialise(times.withColumn("_range", F.spark_partition_id()), "times")
    sizes = sorted((r["_range"], r["count"]) for r in dealt.groupBy("_range").count().collect())
    total, before = 0, []
    for part, n in sizes:
        before.append((part, total))
        total += n
    starts = spark.createDataFrame(before, "_range int, _before bigint")
    ranked = dealt.join(F.broadcast(starts), "_range").select(
        ts, (F.col("_before") + F.row_number().over(ordered(["_range"], ts))).cast("long").alias("rn"),
        F.lit(total).cast("long").alias("n_times"))
    return df.join(ranked, ts)


def split_80_20(df: DataFrame, share: float = 0.8, ts: str = "ts") -> DataFrame:
    """``is_train`` for the rows of the first ``share`` of all times: no key trains on a time that another is tested on."""
    ranked = time_rank(df, ts)
    first = F.floor(F.col("n_times") * F.lit(share))
    return ranked.withColumn("is_train", F.col("rn") <= first).drop("rn", "n_times")


def ts_cv_folds(df: DataFrame, k: int = 3, ts: str = "ts") -> DataFrame:
    """Expanding folds: one row per (row, fold it takes part in) with its role.

    Fold i tests on its own slice of the times and trains on everything before it, over all keys.
    """
    ranked = time_rank(df, ts).withColumn("_test", F.floor(F.col("n_times") / F.lit(k + 1)))
    folds = ranked.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    start = F.col("n_times") - (F.lit(k) - F.col("fold")) * F.col("_test")
    place = F.col("rn") - 1
    role = F.when(place < start, "train").when(place < start + F.col("_test"), "test")
    return folds.withColumn("role", role).filter(F.col("role").isNotNull()).drop("rn", "n_times", "_test")


def confusion_matrix(df: DataFrame, label: str = "regime", prediction: str = "prediction",
                     classes: Sequence[int] = (0, 1, 2, 3)) -> DataFrame:
    counts = df.groupBy(label).pivot(prediction, list(classes)).count()
    return counts.select(
        label, *[F.coalesce(F.col(str(c)), F.lit(0)).cast("long").alias(f"predicted_{c}") for c in classes])


def class_scores(df: DataFrame, label: str = "regime", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class; undefined ratios count as 0."""
    hits = df.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))
    both = F.col("actual") == F.col("predicted")
    cells = hits.select(F.col(label).alias("actual"), F.col(prediction).alias("predicted"), "n")
    per = (
        cells.withColumn("side", F.explode(F.array(
            F.struct(F.col("actual").alias("regime"), F.lit(True).alias("is_actual")),
            F.struct(F.col("predicted").alias("regime"), F.lit(False).alias("is_actual")))))
        .groupBy(F.col("side.regime").alias("regime"))
        .agg(
            F.sum(F.when(both & F.col("side.is_actual"), F.col("n")).otherwise(0)).alias("tp"),
            F.sum(F.when(F.col("side.is_actual"), F.col("n")).otherwise(0)).alias("support"),
            F.sum(F.when(~F.col("side.is_actual"), F.col("n")).otherwise(0)).alias("called"),
        )
    )

    def share(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    return (
        per.withColumn("precision", share(F.col("tp"), F.col("called")))
        .withColumn("recall", share(F.col("tp"), F.col("support")))
        .withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    )


def classification_report(df: DataFrame, label: str = "regime", prediction: str = "prediction") -> DataFrame:
    """Per-class rows followed by accuracy, macro and support-weighted averages, from one pass."""
    scores = class_scores(df, label, prediction)
    measures = ("precision", "recall", "f1")
    n = F.sum("support")

    def row(name: Column, *values: Column, support: Column) -> Column:
        return F.struct(name.alias("name"), *[v.alias(m) for m, v in zip(measures, values, strict=True)], support.alias("support"))

    accuracy = F.sum("tp") / n
    classes = F.collect_list(row(F.col("regime").cast("string"), *[F.col(m) for m in measures], support=F.col("support")))
    summary = F.array(
        row(F.lit("accuracy"), accuracy, accuracy, accuracy, support=n),
        row(F.lit("macro avg"), *[F.avg(m) for m in measures], support=n),
        row(F.lit("weighted avg"), *[F.sum(F.col(m) * F.col("support")) / n for m in measures], support=n))
    return scores.agg(F.concat(classes, summary).alias("_rows")).select(F.inline("_rows"))


def weighted_f1(df: DataFrame, label: str = "regime", prediction: str = "prediction") -> DataFrame:
    """Support-weighted mean F1, the tuning score."""
    return class_scores(df, label, prediction).agg(
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))
