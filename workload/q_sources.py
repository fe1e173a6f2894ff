"""Payload parsers, file sources and sinks."""

from datetime import timedelta

from pyspark.sql import functions as F

from tidemark.operators import exogenous as X
from tidemark.operators.bars import ohlc_sample_by
from tidemark.session import fresh_path
from tidemark.sources import files, payloads as J

from . import payloads as pages
from .q_book import FEATURES, sampled
from .registry import query
from .sqlviews import rounded as sql, view, exact
from .views import rounded


@query("parse_stablecoin_json", sql("symbol, ts", "total_mcap", """
SELECT symbol, ts, CASE WHEN day(ts) % 10 = 0 THEN 0 ELSE total_mcap END / 1e9 AS total_mcap FROM mcap_daily"""))
def parse_stablecoin_json(v):
    parsed = J.parse_stablecoin_json(pages.stablecoin(v.mcap))
    return rounded(parsed.withColumn("total_mcap", F.col("total_mcap") / 1e9))


@query("parse_open_interest_json", sql("symbol, ts", "open_interest", """
SELECT symbol, ts, CASE WHEN day(ts) % 10 = 0 THEN 0 ELSE open_interest END / 1e9 AS open_interest
FROM oi_daily WHERE ts >= (SELECT max(ts) FROM oi_daily) - INTERVAL 20 DAY"""))
def parse_open_interest_json(v):
    """Cut to the 20 days before the newest day."""
    newest = v.oi.agg(F.max("ts")).scalar()
    parsed = J.parse_open_interest_json(pages.open_interest(v.oi), newest - F.make_dt_interval(F.lit(20)))
    return rounded(parsed.withColumn("open_interest", F.col("open_interest") / 1e9))


@query("parse_funding_json", sql("symbol, ts", "funding_rate", """
SELECT symbol, ts, (ex1 + ex2) / 2 AS funding_rate FROM funding_8h""", 10))
def parse_funding_json(v):
    return rounded(J.parse_funding_json(pages.funding(v.funding_parts)), 10)


@query("parse_netflow_json", sql("symbol, ts", "net_flow", """
SELECT symbol, ts, sum(CASE status WHEN 'F' THEN amount WHEN 'O' THEN -amount ELSE 0 END) AS net_flow
FROM orders_by_asset GROUP BY 1, 2"""))
def parse_netflow_json(v):
    return rounded(J.parse_netflow_json(pages.netflow(v.orders)))


@query("parse_netposition_json", sql("symbol, ts", "net_flow", "SELECT * FROM flows_daily"))
def parse_netposition_json(v):
    return rounded(J.parse_netposition_json(pages.netposition(v.flows)))


@query("parse_news_json", exact("""
SELECT ts, title, CASE WHEN doc_id % 3 = 2 THEN 'unknown' ELSE source END AS source
FROM headlines WHERE doc_id % 7 <> 0"""))
def parse_news_json(v):
    return J.parse_news_json(pages.news(v.headlines))


@query("parse_articles_json", exact("""
SELECT ts, title, source FROM headlines WHERE ts >= (SELECT max(ts) FROM headlines) - INTERVAL 28 DAY"""))
def parse_articles_json(v):
    newest = v.headlines.agg(F.max("ts")).scalar()
    return J.parse_articles_json(pages.articles(v.headlines), newest)


@query("src_read_parquet", sql("day, symbol", "low high open close", """
SELECT date_trunc('day', ts) AS day, symbol, min(price) AS low, max(price) AS high,
       arg_min(price, (ts, trade_id)) AS open, arg_max(price, (ts, trade_id)) AS close
FROM trades GROUP BY 1, 2"""))
def src_read_parquet(v):
    """Daily bars straight from an external parquet file."""
    daily = ohlc_sample_by(v.trades, timedelta(days=1))
    return rounded(daily.select(F.col("ts").alias("day"), "symbol", "low", "high", "open", "close"))


@query("ctas_monthly", sql("symbol, trade_id, ts, year, month", "price", """
SELECT symbol, trade_id, ts, CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month, price FROM trades"""))
def ctas_monthly(v):
    path = fresh_path(v.spark, "trades_monthly")
    table = path.rsplit("/", 1)[1].replace("-", "_")
    files.ctas_monthly(v.trades.select("symbol", "trade_id", "ts", "price"), table, path)
    return rounded(v.spark.table(table).select("symbol", "trade_id", "ts", "year", "month", "price"))


@query("src_parquet_cache", sql("symbol, ts", "close", "SELECT symbol, ts, close FROM bars4h"))
def src_parquet_cache(v):
    """Built and written at the first call, read at the second."""
    path = fresh_path(v.spark, "bars_cache")

    def build():
        return v.bars.select("symbol", "ts", "close")

    files.src_parquet_cache(v.spark, path, build)
    return rounded(files.src_parquet_cache(v.spark, path, lambda: build().limit(0)))


@query("sink_parquet_csv", sql("kind, symbol, ts", "close", """
SELECT kind, symbol, ts, close FROM bars4h, (VALUES ('csv'), ('parquet')) k(kind)"""))
def sink_parquet_csv(v):
    path = fresh_path(v.spark, "bars_out")
    bars = v.bars.select("symbol", "ts", "close")
    files.sink_parquet_csv(bars, path)
    schema = "ts timestamp_ntz, close double, symbol string"
    written = v.spark.read.parquet(f"{path}/parquet").withColumn("kind", F.lit("parquet"))
    copied = v.spark.read.schema(schema).csv(f"{path}/csv", header=True).withColumn("kind", F.lit("csv"))
    return rounded(written.unionByName(copied).select("kind", "symbol", "ts", "close"))


@query("src_csv_series", sql("timestamp", "FinBERT_Score", 'SELECT ts AS "timestamp", "FinBERT_Score" FROM sentiment_4h'))
def src_csv_series(v):
    """The sentiment series written as CSV and read back by schema."""
    path = fresh_path(v.spark, "sentiment_csv")
    X.sentiment_features(v.scored).select(F.col("ts").alias("timestamp"), "FinBERT_Score").write.csv(path, header=True)
    return rounded(files.src_csv_series(v.spark, path))


def _line_sql():
    names = FEATURES.split()
    fields = " || ',' || ".join(f"'{n}=' || format('{{:.6f}}', round(CAST({n} AS DOUBLE), 4) + 0.0)" for n in names)
    return f"""
SELECT 'features_microstructure,symbol=' || symbol || ' ' || {fields} || ' ' || CAST(epoch_us(ts) * 1000 AS VARCHAR) AS line
FROM sampled_features"""


view("feature_lines", _line_sql())


@query("sink_line_protocol", exact("SELECT * FROM feature_lines"))
def sink_line_protocol(v):
    """Sampled features as lines of text, written and read back."""
    path = fresh_path(v.spark, "lines")
    rows = rounded(sampled(v).select("symbol", "ts", *FEATURES.split()), 4)
    files.sink_line_protocol(rows, "features_microstructure", path)
    return v.spark.read.text(path).withColumnRenamed("value", "line")
