"""On-chain, stablecoin, derivatives, macro and headline series, and the full feature table."""

from pyspark.sql import functions as F

from tidemark.functions.numeric import softmax
from tidemark.operators import bars as B
from tidemark.operators import exogenous as X
from tidemark.operators import timegrid as G
from tidemark.plans.features import Dataset, build_full_features
from tidemark.plans.scoring import text_sentiment
from tidemark.session import materialise

from .q_bars import FILL, rolled
from .registry import query
from .sqlviews import rounded as sql, view, exact
from .views import rounded

W = "WINDOW w AS (PARTITION BY symbol ORDER BY ts)"


def gridded(source: str, columns: str, keys: str = "symbol") -> str:
    """As-of grid of a daily series in SQL."""
    key, on = (f"{keys}, ", f"g.{keys} = f.{keys} AND ") if keys else ("", "")
    group = f"GROUP BY {keys}" if keys else ""
    cols = ", ".join(f"f.{c}" for c in columns.split())
    return f"""
SELECT g.*, {cols} FROM (
  SELECT {key}unnest(generate_series(time_bucket(INTERVAL '4 hours', lo, TIMESTAMP '1970-01-01'),
                                     time_bucket(INTERVAL '4 hours', hi, TIMESTAMP '1970-01-01'),
                                     INTERVAL 4 HOUR)) AS ts
  FROM (SELECT {key}min(ts) AS lo, max(ts) AS hi FROM {source} {group})) g
ASOF LEFT JOIN {source} f ON {on}f.ts <= g.ts"""


view("onchain", f"""
SELECT symbol, ts, net_flow, reserve, reserve / nullif(lag(reserve) OVER w, 0) - 1 AS reserve_change,
       {rolled('avg', 'net_flow', 7, 'full')} AS netflow_ma7,
       {rolled('stddev_samp', 'net_flow', 7, 'full')} AS netflow_volatility
FROM onchain_joined {W}
""")

view("stablecoins", f"""
SELECT symbol, ts, total_mcap / 1e11 AS stablecoin_mcap,
       coalesce((total_mcap - lag(total_mcap, 7) OVER w) / 1e10, 0) AS stablecoin_flow_7d,
       {rolled('avg', 'total_mcap', 7, 'partial')} / {rolled('avg', 'total_mcap', 30, 'partial')} - 1
         AS stablecoin_trend
FROM mcap_daily {W}
""")

view("derivatives", f"""
SELECT o.symbol, o.ts, open_interest / 1e9 AS open_interest_norm,
       coalesce(open_interest / nullif(lag(open_interest) OVER (PARTITION BY o.symbol ORDER BY o.ts), 0) - 1, 0)
         AS oi_change,
       coalesce((ex1 + ex2) / 2, 0) AS funding_rate
FROM oi_daily o LEFT JOIN funding_8h f ON f.symbol = o.symbol AND f.ts = o.ts
""")

view("macro_roc", f"""
SELECT ts, BTCDOM / nullif(lag(BTCDOM) OVER (ORDER BY ts), 0) - 1 AS roc FROM ({gridded('macro', 'BTCDOM', '')})
""")

view("bars_macro", f"""
SELECT symbol, ts, close, coalesce({FILL.format(c='roc')}, 0) AS "BTCDOM_ROC"
FROM (SELECT b.symbol, b.ts, b.close, m.roc FROM bars4h b LEFT JOIN macro_roc m USING (ts))
""")

view("first_headlines", """
SELECT * FROM scored_headlines
QUALIFY row_number() OVER (PARTITION BY title ORDER BY source_rank, ts, doc_id) = 1
""")

view("sentiment_4h", """
SELECT g.ts, coalesce(a.score, 0) AS "FinBERT_Score" FROM (
  SELECT unnest(generate_series(min(bin), max(bin), INTERVAL 4 HOUR)) AS ts FROM sentiment_bins) g
LEFT JOIN sentiment_bins a ON a.bin = g.ts
""")

view("sentiment_bins", """
SELECT time_bucket(INTERVAL '4 hours', ts, TIMESTAMP '1970-01-01') AS bin, avg(sentiment_score) AS score
FROM first_headlines WHERE confidence >= 0.9 GROUP BY 1
""")

view("onchain_grid", gridded("onchain", "net_flow reserve reserve_change netflow_ma7 netflow_volatility"))
view("stablecoin_grid", gridded("stablecoins", "stablecoin_mcap stablecoin_flow_7d stablecoin_trend"))
view("derivatives_grid", gridded("derivatives", "open_interest_norm oi_change funding_rate"))

FULL = """returns log_returns volatility_6h volatility_24h volatility_72h rsi_14 atr_14
 net_flow reserve reserve_change netflow_ma7 netflow_volatility Net_Flow_Z BTCDOM_ROC FinBERT_Score
 stablecoin_mcap stablecoin_flow_7d stablecoin_trend open_interest_norm oi_change funding_rate""".split()

view("full_features", f"""
SELECT * FROM (
  SELECT t.*, o.* EXCLUDE (symbol, ts),
    CASE WHEN o.z_mean IS NOT NULL AND o.net_flow IS NOT NULL
         THEN least(greatest((o.net_flow - o.z_mean) / (o.z_std + 1e-8), -5.0), 5.0) END AS "Net_Flow_Z",
    m."BTCDOM_ROC", coalesce(s."FinBERT_Score", 0) AS "FinBERT_Score",
    coalesce(c.stablecoin_mcap, 0) AS stablecoin_mcap, coalesce(c.stablecoin_flow_7d, 0) AS stablecoin_flow_7d,
    coalesce(c.stablecoin_trend, 0) AS stablecoin_trend,
    coalesce(d.open_interest_norm, 0) AS open_interest_norm, coalesce(d.oi_change, 0) AS oi_change,
    coalesce(d.funding_rate, 0) AS funding_rate
  FROM technical t
  JOIN (SELECT *, {rolled('avg', 'net_flow', 42, 'full')} AS z_mean,
               {rolled('stddev_samp', 'net_flow', 42, 'full')} AS z_std
        FROM (SELECT b.symbol, b.ts, g.* EXCLUDE (symbol, ts)
              FROM bars4h b LEFT JOIN onchain_grid g USING (symbol, ts))) o USING (symbol, ts)
  JOIN bars_macro m USING (symbol, ts)
  LEFT JOIN sentiment_4h s USING (ts)
  LEFT JOIN stablecoin_grid c USING (symbol, ts)
  LEFT JOIN derivatives_grid d USING (symbol, ts))
WHERE {' AND '.join(f'"{c}" IS NOT NULL' for c in FULL)}
""")


def dataset(v) -> Dataset:
    """All sources. Bars are written once: several features read them, and reading the
    bars again is cheap next to reading the trades again."""
    bars = materialise(v.bars, "bars")
    return Dataset(
        bars=bars, macro=B.src_macro(bars, "view"), onchain=v.onchain, sentiment=X.sentiment_features(v.scored),
        stablecoins=X.stablecoin_features(v.mcap),
        derivatives=X.derivatives_features(v.oi, v.funding))


@query("build_full_features", sql(
    "symbol, ts", "open high low close volume " + " ".join(FULL), "SELECT * FROM full_features"))
def full(v):
    return rounded(build_full_features(dataset(v)))


@query("onchain_composite", sql(
    "symbol, ts", "net_flow reserve reserve_change netflow_ma7 netflow_volatility", "SELECT * FROM onchain"))
def onchain_composite(v):
    return rounded(v.onchain)


@query("stablecoin_features", sql(
    "symbol, ts", "stablecoin_mcap stablecoin_flow_7d stablecoin_trend", "SELECT * FROM stablecoins"))
def stablecoin_features(v):
    return rounded(X.stablecoin_features(v.mcap))


@query("derivatives_features", sql(
    "symbol, ts", "open_interest_norm oi_change funding_rate", "SELECT * FROM derivatives"))
def derivatives_features(v):
    return rounded(X.derivatives_features(v.oi, v.funding))


@query("join_oi_funding", sql("symbol, ts", "open_interest_norm funding_rate", """
SELECT symbol, ts, open_interest_norm, funding_rate FROM derivatives"""))
def join_oi_funding(v):
    joined = X.join_oi_funding(v.oi, v.funding)
    return rounded(X.normalise_scale(joined, "open_interest", 1e9, "open_interest_norm").drop("open_interest"))


@query("normalise_scale", sql("symbol, ts", "mcap_norm", """
SELECT symbol, ts, total_mcap / 1e11 AS mcap_norm FROM mcap_daily"""))
def normalise_scale(v):
    return rounded(X.normalise_scale(v.mcap, "total_mcap", 1e11, "mcap_norm").drop("total_mcap"))


@query("merge_macro", sql("symbol, ts", "close BTCDOM_ROC", "SELECT * FROM bars_macro"))
def merge_macro(v):
    return rounded(X.merge_macro(v.bars.select("symbol", "ts", "close"), v.macro))


@query("default_columns", sql("symbol, ts", "close FinBERT_Score funding_rate", """
SELECT b.symbol, b.ts, b.close, coalesce(s."FinBERT_Score", 0) AS "FinBERT_Score", 0.0 AS funding_rate
FROM bars4h b LEFT JOIN sentiment_4h s USING (ts)"""))
def default_columns(v):
    joined = G.join_left_ts(v.bars.select("symbol", "ts", "close"), X.sentiment_features(v.scored), ["ts"])
    return rounded(X.zero_if_missing(joined, ("FinBERT_Score", "funding_rate")))


@query("union_news", sql("doc_id, source_rank, ts", "sentiment_score", """
SELECT doc_id, source_rank, ts, sentiment_score FROM scored_headlines"""))
def union_news(v):
    feeds = [v.scored.filter(F.col("source_rank") == r).drop("source_rank") for r in (0, 1)]
    return rounded(X.union_news(*feeds).select("doc_id", "source_rank", "ts", "sentiment_score"))


@query("distinct_titles", exact("""
SELECT doc_id, source_rank, ts, title FROM first_headlines"""))
def distinct_titles(v):
    return X.distinct_titles(v.scored).select("doc_id", "source_rank", "ts", "title")


@query("filter_confidence", sql("doc_id, ts", "sentiment_score confidence", """
SELECT * FROM scored_headlines WHERE confidence >= 0.9"""))
def filter_confidence(v):
    return rounded(X.filter_confidence(v.scored).select("doc_id", "ts", "sentiment_score", "confidence"))


@query("agg_sentiment_4h", sql("ts", "FinBERT_Score", """
WITH bins AS (SELECT time_bucket(INTERVAL '4 hours', ts, TIMESTAMP '1970-01-01') AS bin,
                     avg(sentiment_score) AS score FROM scored_headlines GROUP BY 1)
SELECT g.ts, coalesce(b.score, 0) AS "FinBERT_Score"
FROM (SELECT unnest(generate_series(min(bin), max(bin), INTERVAL 4 HOUR)) AS ts FROM bins) g
LEFT JOIN bins b ON b.bin = g.ts"""))
def agg_sentiment_4h(v):
    return rounded(X.agg_sentiment_4h(v.scored))


@query("sentiment_features", sql("ts", "FinBERT_Score", "SELECT * FROM sentiment_4h"))
def sentiment_features(v):
    return rounded(X.sentiment_features(v.scored))


@query("sentiment_softmax", sql("doc_id", "sentiment_score confidence", "SELECT * FROM scored_headlines"))
def sentiment_softmax(v):
    probs = v.headlines.withColumn("probs", softmax(F.col("logits")))
    scored = X.sentiment_from_probabilities(probs)
    return rounded(scored.select("doc_id", "sentiment_score", "confidence"))


@query("text_sentiment", sql("doc_id", "sentiment_score confidence", """
SELECT doc_id, CASE WHEN z IS NULL THEN 0.0 ELSE (exp(w) - exp(l)) / z END AS sentiment_score,
       CASE WHEN z IS NULL THEN 0.0 ELSE greatest(exp(w), exp(l), 1) / z END AS confidence
FROM (SELECT *, CASE WHEN n > 0 THEN exp(w) + exp(l) + 1 END AS z
      FROM (SELECT doc_id, n, 10.0 * (n - len(replace(text, 'e', ''))) / n AS w,
                   10.0 * (n - len(replace(text, 'a', ''))) / n AS l
            FROM (SELECT doc_id, text, len(text) AS n FROM documents)))"""))
def sentiment_of_texts(v):
    """Whole texts scored through the pluggable model hook (here: letter shares as logits)."""
    texts = v.table("documents").select("doc_id", "text")
    return rounded(text_sentiment(texts, letter_shares, "text").select("doc_id", "sentiment_score", "confidence"))


def letter_shares():
    """A stand-in scorer: logits in the order positive, negative, neutral."""
    def score(texts):
        return [[10.0 * t.count("e") / len(t), 10.0 * t.count("a") / len(t), 0.0] if t else None for t in texts]
    return score
