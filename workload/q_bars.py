"""Bars, rolling features, grids and as-of joins."""

from datetime import timedelta

from pyspark.sql import functions as F

from tidemark.functions.frames import ordered
from tidemark.operators import bars as B
from tidemark.operators import blocks
from tidemark.operators import exogenous as X
from tidemark.operators import timegrid as G
from tidemark.plans import features

from .registry import query
from .sqlviews import rounded as sql, view, exact
from .views import rounded

W = "WINDOW w AS (PARTITION BY symbol ORDER BY ts)"


def by_symbol():
    return ordered(["symbol"], "ts")


def rolled(fn: str, col: str, n: int, kind: str) -> str:
    frame = f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    value = f"{fn}({col}) {frame}"
    return value if kind == "partial" else f"CASE WHEN count({col}) {frame} = {n} THEN {value} END"


view("moves", f"""
SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS returns,
       ln(close / nullif(lag(close) OVER w, 0)) AS log_returns,
       coalesce(close - lag(close) OVER w, 0) AS delta,
       greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr,
       row_number() OVER w AS rn
FROM bars4h {W}
""")

view("technical", f"""
SELECT symbol, ts, open, high, low, close, volume, returns, log_returns,
       {rolled('stddev_samp', 'returns', 6, 'full')} AS volatility_6h,
       {rolled('stddev_samp', 'returns', 24, 'full')} AS volatility_24h,
       {rolled('stddev_samp', 'returns', 72, 'full')} AS volatility_72h,
       CASE WHEN rn >= 14 THEN 100 - 100 / (1 + gain / (loss + 1e-8)) END AS rsi_14,
       CASE WHEN rn >= 14 THEN {rolled('avg', 'tr', 14, 'partial')} END AS atr_14
FROM (SELECT *, {rolled('avg', 'greatest(delta, 0)', 14, 'partial')} AS gain,
             {rolled('avg', 'greatest(-delta, 0)', 14, 'partial')} AS loss FROM moves)
""")

view("flow_grid", """
SELECT g.symbol, g.ts, f.net_flow FROM (
  SELECT symbol, unnest(generate_series(time_bucket(INTERVAL '4 hours', lo, TIMESTAMP '1970-01-01'),
                                        time_bucket(INTERVAL '4 hours', hi, TIMESTAMP '1970-01-01'),
                                        INTERVAL 4 HOUR)) AS ts
  FROM (SELECT symbol, min(ts) AS lo, max(ts) AS hi FROM flows_daily GROUP BY 1)) g
ASOF LEFT JOIN flows_daily f ON g.symbol = f.symbol AND f.ts <= g.ts
""")


@query("ohlc_sample_by", sql("symbol, ts", "open high low close volume", "SELECT * FROM bars4h"))
def ohlc_sample_by(v):
    return rounded(v.bars)


@query("ohlc_sample_by_1d", sql("symbol, ts", "open high low close volume", """
SELECT symbol, date_trunc('day', ts) AS ts, arg_min(price, (ts, trade_id)) AS open, max(price) AS high,
       min(price) AS low, arg_max(price, (ts, trade_id)) AS close, sum(CAST(qty AS DOUBLE)) AS volume
FROM trades GROUP BY 1, 2"""))
def ohlc_sample_by_1d(v):
    return rounded(B.ohlc_sample_by(v.trades, timedelta(days=1)))


@query("technical_features", sql(
    "symbol, ts", "close returns log_returns volatility_6h volatility_24h volatility_72h rsi_14 atr_14",
    "SELECT * FROM technical"))
def technical_features(v):
    return rounded(B.technical_features(v.bars).drop("open", "high", "low", "volume"))


@query("technical_features_blockwise", sql(
    "symbol, ts", "close returns log_returns volatility_6h volatility_24h volatility_72h rsi_14 atr_14",
    "SELECT * FROM technical"))
def technical_features_blockwise(v):
    """The same features computed in blocks of five days with carried look-back rows."""
    cut = blocks.time_cut(timedelta(days=5), order=("ts",))
    # 72 returns need 73 closes
    out = blocks.blockwise(v.bars, cut, 73, B.technical_columns)
    return rounded(out.drop("open", "high", "low", "volume"))


@query("pct_change", sql("symbol, ts", "reserve reserve_change", """
SELECT symbol, ts, reserve, pad / nullif(lag(pad) OVER w, 0) - 1 AS reserve_change
FROM (SELECT *, last_value(reserve IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pad
      FROM flows_daily FULL JOIN reserve_daily USING (symbol, ts)) """ + W))
def pct_change(v):
    gaps = v.flows.join(v.reserve, ["symbol", "ts"], "full").select("symbol", "ts", "reserve")
    return rounded(G.pct_change(gaps, "reserve", "reserve_change"))


@query("returns", sql("symbol, ts", "returns", "SELECT symbol, ts, returns FROM moves"))
def returns(v):
    return rounded(v.bars.select("symbol", "ts", B.returns(by_symbol()).alias("returns")))


@query("log_returns", sql("symbol, ts", "log_returns", "SELECT symbol, ts, log_returns FROM moves"))
def log_returns(v):
    return rounded(v.bars.select("symbol", "ts", B.log_returns(by_symbol()).alias("log_returns")))


@query("diff_n", sql("symbol, ts", "d1 d7", f"""
SELECT symbol, ts, close - lag(close, 1) OVER w AS d1, close - lag(close, 7) OVER w AS d7 FROM bars4h {W}"""))
def diff_n(v):
    both = G.diff_n(G.diff_n(v.bars, "close", 1, "d1"), "close", 7, "d7")
    return rounded(both.select("symbol", "ts", "d1", "d7"))


def _volatility(n):
    name = f"volatility_{n}h"

    @query(name, sql("symbol, ts", name, f"SELECT symbol, ts, {name} FROM technical"))
    def run(v):
        moved = v.bars.withColumn("returns", B.returns(by_symbol()))
        return rounded(moved.select("symbol", "ts", B.volatility(by_symbol(), n).alias(name)))


for _n in B.VOLATILITY_WINDOWS:
    _volatility(_n)


@query("rsi_14", sql("symbol, ts", "rsi_14", "SELECT symbol, ts, rsi_14 FROM technical"))
def rsi_14(v):
    return rounded(B.with_moves(v.bars, by_symbol()).select("symbol", "ts", B.rsi(by_symbol()).alias("rsi_14")))


@query("atr_14", sql("symbol, ts", "atr_14", "SELECT symbol, ts, atr_14 FROM technical"))
def atr_14(v):
    return rounded(B.moving_avg(B.with_moves(v.bars, by_symbol()), "_range", 14, "atr_14", True)
                   .select("symbol", "ts", "atr_14"))


@query("net_flow_z", sql("symbol, ts", "net_flow Net_Flow_Z", f"""
SELECT symbol, ts, net_flow, CASE WHEN m IS NOT NULL THEN least(greatest((net_flow - m) / (s + 1e-8), -5.0), 5.0) END
       AS "Net_Flow_Z"
FROM (SELECT *, {rolled('avg', 'net_flow', 42, 'full')} AS m,
             {rolled('stddev_samp', 'net_flow', 42, 'full')} AS s FROM flow_grid)"""))
def net_flow_z(v):
    return rounded(X.net_flow_z(G.asof_grid(v.flows)))


@query("moving_avg_full", sql("symbol, ts", "netflow_ma7 netflow_volatility", f"""
SELECT symbol, ts, {rolled('avg', 'net_flow', 7, 'full')} AS netflow_ma7,
       {rolled('stddev_samp', 'net_flow', 7, 'full')} AS netflow_volatility FROM flows_daily"""))
def moving_avg_full(v):
    both = B.moving_std(B.moving_avg(v.flows, "net_flow", 7, "netflow_ma7", True),
                        "net_flow", 7, "netflow_volatility")
    return rounded(both.drop("net_flow"))


@query("moving_avg_partial", sql("symbol, ts", "mcap_ma7 mcap_ma30", f"""
SELECT symbol, ts, {rolled('avg', 'cap', 7, 'partial')} AS mcap_ma7,
       {rolled('avg', 'cap', 30, 'partial')} AS mcap_ma30
FROM (SELECT symbol, ts, total_mcap / 1e11 AS cap FROM mcap_daily)"""))
def moving_avg_partial(v):
    scaled = X.normalise_scale(v.mcap, "total_mcap", 1e11, "cap")
    both = B.moving_avg(B.moving_avg(scaled, "cap", 7, "mcap_ma7", False), "cap", 30, "mcap_ma30", False)
    return rounded(both.select("symbol", "ts", "mcap_ma7", "mcap_ma30"))


@query("ma_trend", sql("symbol, ts", "mcap_trend", f"""
SELECT symbol, ts, {rolled('avg', 'total_mcap', 7, 'partial')} / {rolled('avg', 'total_mcap', 30, 'partial')} - 1
       AS mcap_trend FROM mcap_daily"""))
def ma_trend(v):
    return rounded(X.stablecoin_metrics(v.mcap).select("symbol", "ts", "mcap_trend"))


@query("rolling_quantile", sql("symbol, ts", "p20 p80", f"""
SELECT symbol, ts, CASE WHEN n = 168 THEN p20 END AS p20, CASE WHEN n = 168 THEN p80 END AS p80 FROM (
  SELECT symbol, ts, count(returns) OVER q AS n, quantile_cont(returns, 0.2) OVER q AS p20,
         quantile_cont(returns, 0.8) OVER q AS p80 FROM moves
  WINDOW q AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 167 PRECEDING AND CURRENT ROW))"""))
def rolling_quantile(v):
    moved = v.bars.withColumn("returns", B.returns(by_symbol()))
    both = B.rolling_quantiles(moved, {"p20": ("returns", 0.2), "p80": ("returns", 0.8)}, 168)
    return rounded(both.select("symbol", "ts", "p20", "p80"))


FILL = "last_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

view("onchain_joined", f"""
SELECT symbol, ts, {FILL.format(c='net_flow')} AS net_flow, {FILL.format(c='reserve')} AS reserve
FROM flows_daily FULL JOIN reserve_daily USING (symbol, ts)
""")


@query("ffill", sql("symbol, ts", "net_flow reserve", "SELECT * FROM onchain_joined"))
def ffill(v):
    gaps = v.flows.join(v.reserve, ["symbol", "ts"], "full")
    return rounded(G.ffill(gaps, ["net_flow", "reserve"], span=timedelta(days=30)))


@query("join_outer_ts", sql("symbol, ts", "net_flow reserve", "SELECT * FROM onchain_joined"))
def join_outer_ts(v):
    return rounded(G.join_outer_ts(v.flows, v.reserve))


@query("join_left_ts", sql("symbol, ts", "close net_flow", """
SELECT b.symbol, b.ts, b.close, f.net_flow FROM bars4h b LEFT JOIN flow_grid f USING (symbol, ts)"""))
def join_left_ts(v):
    joined = G.join_left_ts(v.bars, G.asof_grid(v.flows, span=None))
    return rounded(joined.select("symbol", "ts", "close", "net_flow"))


@query("asof_grid", sql("symbol, ts", "net_flow", "SELECT * FROM flow_grid"))
def asof_grid(v):
    return rounded(G.asof_grid(v.flows, span=timedelta(days=10)))


@query("asof_join", sql("symbol, trade_id, ts", "price net_flow", """
SELECT t.symbol, t.trade_id, t.ts, t.price, f.net_flow
FROM trades t ASOF LEFT JOIN flows_daily f ON t.symbol = f.symbol AND f.ts <= t.ts"""))
def asof_join(v):
    """Latest daily flow at every trade; trades after the last flow keep it."""
    out = G.asof_join(v.trades, v.flows)
    return rounded(out.select("symbol", "trade_id", "ts", "price", "net_flow"))


@query("integrate_ffill", sql("symbol, ts", "close net_flow", f"""
SELECT symbol, ts, close, {FILL.format(c='net_flow')} AS net_flow
FROM (SELECT b.symbol, b.ts, b.close, f.net_flow FROM bars4h b LEFT JOIN flow_grid f USING (symbol, ts))"""))
def integrate_ffill(v):
    return rounded(G.integrate_ffill(v.bars.select("symbol", "ts", "close"), v.flows))


@query("max_ts", exact("SELECT symbol, max(ts) AS max_ts FROM bars4h GROUP BY 1"))
def max_ts(v):
    return G.max_ts(v.bars)


@query("latest_on", sql("symbol, trade_id, ts", "price qty", """
SELECT symbol, trade_id, ts, price, CAST(qty AS DOUBLE) AS qty FROM trades
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, trade_id DESC) = 1"""))
def latest_on(v):
    out = B.latest_on(v.trades, ("symbol",), ("ts", "trade_id"))
    return rounded(out.select("symbol", "trade_id", "ts", "price", F.col("qty").cast("double").alias("qty")))


@query("last_row", sql("symbol, ts", "open high low close volume", """
SELECT * FROM bars4h QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1"""))
def last_row(v):
    return rounded(G.last_row(v.bars).select(*v.bars.columns))


@query("sort_ts", sql("symbol, ts", "close", "SELECT symbol, ts, close FROM bars4h ORDER BY ts, symbol"))
def sort_ts(v):
    return rounded(v.bars.select("symbol", "ts", "close")).orderBy("ts", "symbol")


@query("dropna_any", sql("symbol, ts", "volatility_72h rsi_14 atr_14", """
SELECT symbol, ts, volatility_72h, rsi_14, atr_14 FROM technical
WHERE returns IS NOT NULL AND log_returns IS NOT NULL AND volatility_6h IS NOT NULL
  AND volatility_24h IS NOT NULL AND volatility_72h IS NOT NULL AND rsi_14 IS NOT NULL AND atr_14 IS NOT NULL"""))
def dropna_any(v):
    kept = B.technical_features(v.bars).na.drop("any")
    return rounded(kept.select("symbol", "ts", "volatility_72h", "rsi_14", "atr_14"))


@query("filter_recent_days", sql("symbol, ts", "close", """
SELECT symbol, ts, close FROM bars4h WHERE ts >= (SELECT max(ts) FROM bars4h) - INTERVAL 7 DAY"""))
def filter_recent_days(v):
    return rounded(G.filter_recent_days(v.bars.select("symbol", "ts", "close"), 7))


@query("select_features", sql("symbol, ts", "returns log_returns volatility_6h volatility_24h volatility_72h rsi_14 atr_14",
                              "SELECT * FROM technical"))
def select_features(v):
    wide = B.technical_features(v.bars)
    return rounded(wide.select("symbol", "ts", *features.select_features(wide)))


@query("update_window", sql("symbol, ts", "open high low close volume", """
SELECT * FROM (SELECT symbol, ts, open, high, low, close, volume FROM bars4h
               WHERE ts >= TIMESTAMP '2024-01-15'
               UNION ALL
               SELECT symbol, ts, open, high, low, 2 * close, volume FROM bars4h
               WHERE ts < TIMESTAMP '2024-01-15')
WHERE ts > (SELECT max(ts) FROM bars4h) - INTERVAL 20 DAY"""))
def update_window(v):
    """Old table (all bars, closes doubled) refreshed by the newer half."""
    old = v.bars.withColumn("close", F.col("close") * 2)
    new = v.bars.filter(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz"))
    return rounded(B.update_window(old, new, 20))


@query("src_ohlcv", sql("symbol, ts", "open high low close volume", """
SELECT * FROM bars4h WHERE ts >= (SELECT max(ts) FROM bars4h) - INTERVAL 14 DAY"""))
def src_ohlcv(v):
    return rounded(B.src_ohlcv(v_candles(v), 14))


def v_candles(v):
    """Bars as the candle arrays a provider sends."""
    ms = F.unix_millis(F.col("ts").cast("timestamp")).cast("double")
    return v.bars.select("symbol", F.array(ms, "open", "high", "low", "close", "volume").alias("candle"))


@query("src_macro", sql("ts", "BTCDOM", "SELECT * FROM macro"))
def src_macro(v):
    return rounded(v.macro)


@query("union_candles", sql("symbol, ts", "close", "SELECT symbol, ts, close FROM bars4h"))
def union_candles(v):
    """The bars as two pages that meet without overlap."""
    page = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    return rounded(B.union_candles(v.bars.filter(page), v.bars.filter(~page)).select("symbol", "ts", "close"))


