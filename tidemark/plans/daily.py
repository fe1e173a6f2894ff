"""The daily job over all symbols: features, labels, weights, model, signal, price grid."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.grid import Budget, grid_levels, grid_parameters
from ..operators.labels import Decay, Thresholds, classification_report, label_regime, split_80_20, temporal_weight
from ..operators.timegrid import last_row
from .features import Dataset, build_full_features, select_features
from .training import Fitted, Params, ml_predict, ml_proba, ml_retrain_daily

LABEL_COLUMNS = ("forward_return", "forward_volatility", "forward_hl_range", "regime", "age_days", "weight",
                 "is_train")


@dataclass(frozen=True)
class DailyResult:
    fitted: Fitted
    model_path: str
    report: DataFrame
    signals: DataFrame
    levels: DataFrame


def training_set(features: DataFrame, t: Thresholds = Thresholds(), d: Decay = Decay()) -> DataFrame:
    """Feature rows with label, weight and the side of the 80/20 split they are on."""
    return split_80_20(temporal_weight(label_regime(features, t), d))


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in select_features(df) if c not in LABEL_COLUMNS]


def latest_signal(features: DataFrame, fitted: Fitted) -> DataFrame:
    """Newest feature row per symbol with its predicted regime and class probabilities."""
    scored = ml_proba(fitted, last_row(features))
    return scored.select("symbol", "ts", F.col("close").alias("price"), "volatility_24h",
                         F.col("prediction").alias("regime"), *[f"p_{c}" for c in range(4)])


def run(data: Dataset, root: str, candidates: Sequence[Params] | None = None,
        budget: Budget = Budget()) -> DailyResult:
    """Each stage is written under ``root`` and read back by the next, so that a lost
    executor costs one stage at most."""
    spark = data.bars.sparkSession

    def stage(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    features = stage(build_full_features(data), "features")
    labelled = stage(training_set(features), "labelled")
    columns = feature_columns(labelled)
    train = labelled.filter("is_train")
    fitted, path = ml_retrain_daily(train, columns, f"{root}/models", candidates)
    held_out = ml_predict(fitted, labelled.filter("NOT is_train"))
    report = stage(classification_report(held_out), "report")
    signals = stage(latest_signal(features, fitted), "signals")
    levels = stage(grid_levels(grid_parameters(signals, budget), budget), "levels")
    return DailyResult(fitted, path, report, signals, levels)
