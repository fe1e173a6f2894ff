"""Regime labels, weights, splits, scores and price grids."""

from pyspark.sql import functions as F

from tidemark.functions.frames import ordered, ratio_change
from tidemark.operators import bars as B
from tidemark.operators import grid as P
from tidemark.operators import labels as L


from .registry import query
from .sqlviews import rounded as sql, view, exact
from .views import rounded

W = "WINDOW w AS (PARTITION BY symbol ORDER BY ts)"

view("forward_metrics", f"""
SELECT *, lead(close, 3) OVER w / nullif(close, 0) - 1 AS forward_return,
       CASE WHEN count(ret) OVER a = 3 AND row_number() OVER w >= 3 THEN stddev_samp(ret) OVER a END
         AS forward_volatility,
       (lead(high, 3) OVER w - lead(low, 3) OVER w) / nullif(close, 0) AS forward_hl_range
FROM (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS ret FROM bars4h {W})
{W}, a AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)
""")

CASE = """CASE WHEN forward_volatility > 0.05 OR forward_hl_range > 0.1 THEN 3
            WHEN forward_volatility < 0.015 AND abs(forward_return) < 0.02 THEN 0
            WHEN forward_return > 0.02 AND forward_volatility < 0.05 THEN 1
            WHEN forward_return < -0.02 AND forward_volatility < 0.05 THEN 2 ELSE 0 END"""

view("labelled", f"""
SELECT symbol, ts, close, forward_return, forward_volatility, forward_hl_range, CAST({CASE} AS INT) AS regime
FROM forward_metrics WHERE forward_return IS NOT NULL
""")

view("weighted", """
SELECT *, CASE WHEN age_days <= 7 THEN 1.0 ELSE greatest(exp(-0.001 * age_days), 0.1) END AS weight
FROM (SELECT l.*, (epoch_us(max(ts) OVER (PARTITION BY symbol)) - epoch_us(ts)) / 86400e6 AS age_days
      FROM labelled l)
""")

view("class_weights", """
SELECT regime, count(*) AS n,
       (SELECT count(*) / count(DISTINCT regime) FROM labelled) / count(*) AS class_weight
FROM labelled GROUP BY 1
""")

view("guesses", f"SELECT * FROM (SELECT *, lag(regime) OVER w AS prediction FROM labelled {W}) WHERE prediction IS NOT NULL")

view("class_scores", """
SELECT regime, tp, support, called, coalesce(tp / nullif(called, 0), 0) AS "precision",
       coalesce(tp / nullif(support, 0), 0) AS recall,
       coalesce(2.0 * tp / nullif(called + support, 0), 0) AS f1
FROM (SELECT c.regime, (SELECT count(*) FROM guesses g WHERE g.regime = c.regime AND g.prediction = c.regime) AS tp,
             (SELECT count(*) FROM guesses g WHERE g.regime = c.regime) AS support,
             (SELECT count(*) FROM guesses g WHERE g.prediction = c.regime) AS called
      FROM (SELECT regime FROM guesses UNION SELECT prediction FROM guesses) c)
""")

view("signals", """
SELECT symbol, ts, close AS price, regime, volatility_24h
FROM labelled JOIN (SELECT symbol, ts, volatility_24h FROM technical) USING (symbol, ts)
WHERE volatility_24h IS NOT NULL
""")

view("grid_geometry", """
SELECT *, price + price * spacing * n_levels * range_multiplier AS upper_bound,
       price - price * spacing * n_levels * range_multiplier AS lower_bound
FROM (SELECT symbol, ts, price, regime, volatility_24h,
        CASE regime WHEN 0 THEN 'NEUTRAL' WHEN 1 THEN 'LONG_BIASED' ELSE 'SHORT_BIASED' END AS grid_type,
        CAST(CASE regime WHEN 0 THEN least(30, 40) ELSE least(20, 40) END AS INT) AS n_levels,
        least(greatest(2 * volatility_24h, 0.005), 0.03) * CASE regime WHEN 0 THEN 1.0 ELSE 1.2 END AS spacing,
        CASE regime WHEN 0 THEN 1.5 ELSE 1.3 END AS range_multiplier,
        CASE regime WHEN 0 THEN 0.5 WHEN 1 THEN 0.7 ELSE 0.3 END AS long_bias,
        CASE regime WHEN 0 THEN 0.5 WHEN 1 THEN 0.3 ELSE 0.7 END AS short_bias
      FROM signals WHERE regime < 3)
""")

view("grid_orders", """
SELECT symbol, ts, level, lp AS price, side,
       800.0 / n_levels / nullif(lp, 0) * bias * 2 AS quantity,
       800.0 / n_levels / nullif(lp, 0) * bias * 2 * lp AS value_usd, lp <= 0 AS bad_price
FROM (SELECT *, CASE WHEN side = 'buy' THEN long_bias ELSE short_bias END AS bias
      FROM (SELECT *, CASE WHEN lp < price THEN 'buy' ELSE 'sell' END AS side
            FROM (SELECT *, lower_bound + level * (upper_bound - lower_bound) / (n_levels - 1) AS lp
                  FROM (SELECT *, CAST(unnest(range(n_levels)) AS INT) AS level FROM grid_geometry))))
""")


def labelled(v):
    return L.label_regime(v.bars).select(
        "symbol", "ts", "close", "forward_return", "forward_volatility", "forward_hl_range", "regime")


def weighted(v):
    return L.temporal_weight(labelled(v))


def guesses(v):
    """Persistence as the classifier to score: the regime of the bar before."""
    w = ordered(["symbol"], "ts")
    return labelled(v).withColumn("prediction", F.lag("regime").over(w)).filter(F.col("prediction").isNotNull())


def signals(v):
    w = ordered(["symbol"], "ts")
    vol = (v.bars.withColumn("returns", ratio_change(F.col("close"), w))
           .select("symbol", "ts", B.volatility(w, 24).alias("volatility_24h")))
    return (labelled(v).join(vol, ["symbol", "ts"]).filter(F.col("volatility_24h").isNotNull())
            .select("symbol", "ts", F.col("close").alias("price"), "regime", "volatility_24h"))


def _forward(name):
    @query(name, sql("symbol, ts", name, f"SELECT symbol, ts, {name} FROM forward_metrics"))
    def run(v):
        return rounded(L.with_forward(v.bars, L.Thresholds(), ("symbol",), "ts").select("symbol", "ts", name))


for _name in ("forward_return", "forward_volatility", "forward_hl_range"):
    _forward(_name)


@query("regime_case", exact(f"SELECT symbol, ts, CAST({CASE} AS INT) AS regime FROM forward_metrics"))
def regime_case(v):
    """The rules on every bar, also the last ones that have no forward return."""
    metrics = L.with_forward(v.bars, L.Thresholds(), ("symbol",), "ts")
    return metrics.select("symbol", "ts", L.regime_case().alias("regime"))


@query("label_regime", sql("symbol, ts, regime", "close forward_return forward_volatility forward_hl_range",
                           "SELECT * FROM labelled"))
def label_regime(v):
    return rounded(labelled(v))


@query("dropna_subset", sql("symbol, ts", "close forward_return", """
SELECT * FROM forward_metrics WHERE forward_return IS NOT NULL"""))
def dropna_subset(v):
    metrics = L.with_forward(v.bars, L.Thresholds(), ("symbol",), "ts")
    return rounded(L.dropna_subset(metrics).select("symbol", "ts", "close", "forward_return"))


def quantile(column, q, n):
    frame = f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({column}) {frame} = {n} THEN quantile_cont({column}, {q}) {frame} END"


def _adaptive(name, lookback):
    @query(name, sql(
        "symbol, ts, regime_adaptive", "forward_return forward_volatility vol_p20 vol_p80 return_p20 return_p80", f"""
SELECT *, CAST(CASE WHEN forward_volatility > vol_p80 THEN 3
                    WHEN forward_return > return_p80 AND forward_volatility < vol_p80 THEN 1
                    WHEN forward_return < return_p20 AND forward_volatility < vol_p80 THEN 2 ELSE 0 END AS INT)
          AS regime_adaptive
FROM (SELECT *, {quantile('forward_volatility', 0.2, lookback)} AS vol_p20, {quantile('forward_volatility', 0.8, lookback)} AS vol_p80,
             {quantile('forward_return', 0.2, lookback)} AS return_p20, {quantile('forward_return', 0.8, lookback)} AS return_p80
      FROM forward_metrics)
WHERE forward_return IS NOT NULL"""))
    def run(v):
        return rounded(L.label_adaptive(v.bars, lookback).select(
            "symbol", "ts", "regime_adaptive", "forward_return", "forward_volatility",
            "vol_p20", "vol_p80", "return_p20", "return_p80"))


_adaptive("label_adaptive", L.ADAPTIVE_LOOKBACK)
_adaptive("label_adaptive_week", 42)


@query("regime_distribution", sql("regime, n", "pct", """
SELECT regime, count(*) AS n, round_even(100.0 * count(*) / (SELECT count(*) FROM labelled), 2) AS pct
FROM labelled GROUP BY 1 ORDER BY 1""", 2))
def regime_distribution(v):
    return rounded(L.regime_distribution(labelled(v)), 2)


@query("regime_summary", sql("regime, n", "avg_return avg_volatility max_drawdown max_upside", """
SELECT regime, count(*) AS n, avg(forward_return) AS avg_return, avg(forward_volatility) AS avg_volatility,
       min(forward_return) AS max_drawdown, max(forward_return) AS max_upside FROM labelled GROUP BY 1"""))
def regime_summary(v):
    return rounded(L.regime_summary(labelled(v)))


@query("distinct_classes", exact("SELECT DISTINCT regime FROM labelled ORDER BY 1"))
def distinct_classes(v):
    return L.distinct_classes(labelled(v))


@query("temporal_weight", sql("symbol, ts, regime", "age_days weight", "SELECT * FROM weighted"))
def temporal_weight(v):
    return rounded(weighted(v).select("symbol", "ts", "regime", "age_days", "weight"))


@query("half_life_weight", sql("symbol, ts", "weight", """
SELECT symbol, ts, CASE WHEN age_days <= 7 THEN 1.0
                        ELSE greatest(exp(-ln(2) / 20 * age_days), 0.1) END AS weight FROM weighted"""))
def half_life_weight(v):
    """Weights that halve every 20 days."""
    halved = L.temporal_weight(labelled(v), rate=L.half_life_rate(F.lit(20.0)))
    return rounded(halved.select("symbol", "ts", "weight"))


@query("decay_curve", sql("days_ago, n", "weight", """
SELECT CAST(floor(age_days) AS BIGINT) AS days_ago, count(*) AS n, avg(weight) AS weight FROM weighted GROUP BY 1"""))
def decay_curve(v):
    return rounded(L.decay_curve(weighted(v)))


@query("weight_stats", sql("", "mean min max", """
SELECT avg(weight) AS mean, min(weight) AS min, max(weight) AS max FROM weighted"""))
def weight_stats(v):
    return rounded(L.weight_stats(weighted(v)))


@query("class_balance", sql("regime, n", "class_weight", "SELECT * FROM class_weights"))
def class_balance(v):
    return rounded(L.class_balance(labelled(v)))


@query("join_class_weight", sql("symbol, ts, regime", "class_weight", """
SELECT symbol, ts, regime, class_weight FROM labelled JOIN class_weights USING (regime)"""))
def join_class_weight(v):
    rows = labelled(v)
    return rounded(L.join_class_weight(rows, L.class_balance(rows)).select("symbol", "ts", "regime", "class_weight"))


@query("balanced_weight", sql("symbol, ts, regime", "weight class_weight final_weight", """
SELECT symbol, ts, regime, weight, class_weight, weight * class_weight AS final_weight
FROM weighted JOIN class_weights USING (regime)"""))
def balanced_weight(v):
    return rounded(L.balanced_weight(weighted(v)).select(
        "symbol", "ts", "regime", "weight", "class_weight", "final_weight"))


@query("time_rank", exact("""
SELECT symbol, ts, dense_rank() OVER (ORDER BY ts) AS rn, (SELECT count(DISTINCT ts) FROM labelled) AS n_times FROM labelled"""))
def time_rank(v):
    return L.time_rank(labelled(v)).select("symbol", "ts", "rn", "n_times")


@query("split_80_20", exact("""
SELECT symbol, ts, dense_rank() OVER (ORDER BY ts) <= floor(0.8 * (SELECT count(DISTINCT ts) FROM labelled)) AS is_train
FROM labelled"""))
def split_80_20(v):
    return L.split_80_20(labelled(v)).select("symbol", "ts", "is_train")


@query("ts_cv_folds", exact("""
SELECT symbol, ts, CAST(fold AS INT) AS fold, CASE WHEN place < start THEN 'train' ELSE 'test' END AS role
FROM (SELECT *, n - (3 - fold) * (n // 4) AS start
      FROM (SELECT symbol, ts, dense_rank() OVER (ORDER BY ts) - 1 AS place,
                   (SELECT count(DISTINCT ts) FROM labelled) AS n, unnest([0, 1, 2]) AS fold FROM labelled))
WHERE place < start + n // 4"""))
def ts_cv_folds(v):
    return L.ts_cv_folds(labelled(v)).select("symbol", "ts", "fold", "role")


@query("confusion_matrix", exact("""
SELECT regime, count(*) FILTER (prediction = 0) AS predicted_0, count(*) FILTER (prediction = 1) AS predicted_1,
       count(*) FILTER (prediction = 2) AS predicted_2, count(*) FILTER (prediction = 3) AS predicted_3
FROM guesses GROUP BY 1"""))
def confusion_matrix(v):
    return L.confusion_matrix(guesses(v))


@query("classification_report", sql("name, support", "precision recall f1", """
SELECT CAST(regime AS VARCHAR) AS name, "precision", recall, f1, CAST(support AS BIGINT) AS support FROM class_scores
UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support),
                 CAST(sum(support) AS BIGINT) FROM class_scores
UNION ALL SELECT 'macro avg', avg("precision"), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM class_scores
UNION ALL SELECT 'weighted avg', sum("precision" * support) / sum(support), sum(recall * support) / sum(support),
                 sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM class_scores"""))
def classification_report(v):
    return rounded(L.classification_report(guesses(v)))


@query("weighted_f1", sql("", "weighted_f1", """
SELECT sum(f1 * support) / sum(support) AS weighted_f1 FROM class_scores"""))
def weighted_f1(v):
    return rounded(L.weighted_f1(guesses(v)))


@query("grid_parameters", sql(
    "symbol, ts, regime, grid_type, n_levels",
    "price volatility_24h spacing range_multiplier long_bias short_bias upper_bound lower_bound",
    "SELECT * FROM grid_geometry"))
def grid_parameters(v):
    return rounded(P.grid_parameters(signals(v)))


@query("grid_levels", sql("symbol, ts, level, side, bad_price", "price quantity value_usd", """
SELECT * FROM grid_orders WHERE value_usd >= 20"""))
def grid_levels(v):
    return rounded(P.grid_levels(P.grid_parameters(signals(v))))


@query("filter_min_order", exact("""
SELECT symbol, ts, count(*) AS levels FROM grid_orders WHERE value_usd >= 20 GROUP BY 1, 2"""))
def filter_min_order(v):
    every = P.grid_levels(P.grid_parameters(signals(v)), keep_small=True)
    return P.filter_min_order(every).groupBy("symbol", "ts").agg(F.count(F.lit(1)).alias("levels"))
