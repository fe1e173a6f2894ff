"""Streams run to the end of their input, next to the SQL of their batch forms."""

from pyspark.sql import functions as F

from tidemark.operators import book as K
from tidemark.session import fresh_path
from tidemark.streaming import envelope as E
from tidemark.streaming import ticks as S

from .q_book import FEATURES, snapshot
from .registry import query
from .sqlviews import exact, rounded as sql, view
from .views import BUCKET, Views, rounded, tick_time

class Live(Views):
    """The same inputs as streams: the event file arrives as a stream source."""

    def table(self, name):
        if name != "events":
            return super().table(name)
        path = f"{self.sf_dir}/{name}.parquet"
        schema = self.spark.read.parquet(path).schema
        # as a pattern the path may be one file or a folder of files
        pattern = path.removesuffix("t") + "[t]"
        return self.spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(pattern)

    @property
    def envelopes(self):
        """Trades and depth messages as the JSON envelopes of the live feed."""
        e = self.events
        name = F.col("event_type")
        even = F.col("user_id") % 2 == 0
        step = F.floor(F.col("user_id") / 2) % 60
        price = F.when(even, 100 - step).otherwise(101 + step).cast("double")
        pair = F.concat(F.lit('[["'), price.cast("string"), F.lit('", "'), F.col("k"), F.lit('"]]'))
        depth = F.concat(
            F.lit('{"stream": "'), name, F.lit('@depth@100ms", "data": {"U": '), F.col("event_id"),
            F.lit(', "u": '), F.col("event_id"), F.lit(', "pu": '), F.col("event_id") - 1,
            F.lit(', "b": '), F.when(even, pair).otherwise("[]"),
            F.lit(', "a": '), F.when(even, F.lit("[]")).otherwise(pair), F.lit("}}"))
        trade = F.concat(
            F.lit('{"stream": "'), name, F.lit('@aggTrade", "data": {"p": "'),
            (F.lit(1000.0) + F.lit(0.5) * F.col("value")).cast("string"), F.lit('", "q": "'), F.col("k"), F.lit('"}}'))
        return e.select(F.col("event_id").alias("arrival"), "ts",
                        F.explode(F.array(depth, trade, F.lit('{"stream": 1'))).alias("value"))


def live(v) -> Live:
    return Live(v.spark, v.sf_dir)


@query("stream_envelope", sql("kind, symbol, arrival, side", "price qty", """
SELECT 'trade' AS kind, event_type AS symbol, event_id AS arrival, '' AS side, 1000 + 0.5 * value AS price,
       CAST(json_extract_string(props, '$.k') AS DOUBLE) AS qty FROM events
UNION ALL SELECT 'depth', symbol, arrival, side, price, qty FROM book_diffs"""))
def stream_envelope(v):
    """Envelopes, the damaged ones among them, parted by stream name into trades and depth."""
    opened = E.open_envelopes(live(v).envelopes)
    trades = E.trade_messages(opened).select(
        F.lit("trade").alias("kind"), "symbol", "arrival", F.lit("").alias("side"), "price",
        F.col("qty").cast("double").alias("qty"))
    depth = K.explode_levels(E.depth_messages(opened)).select(
        F.lit("depth").alias("kind"), "symbol", "arrival", "side", "price", "qty")
    return rounded(E.drain(trades.unionByName(depth), "envelope"))


@query("stream_ohlc", sql("symbol, ts", "open high low close volume", """
SELECT * FROM bars4h
WHERE ts + INTERVAL 4 HOUR <= (SELECT max(ts) FROM trades) - INTERVAL 10 MINUTE"""))
def stream_ohlc(v):
    """Bars closed by the watermark (ten minutes behind the newest trade)."""
    return rounded(E.drain(S.stream_ohlc(live(v).trades), "bars"))


@query("stream_vpin", sql("symbol, bucket, closed_at, closing_trade", "imbalance vpin", "SELECT * FROM toxicity"))
def stream_vpin(v):
    return rounded(E.drain(S.stream_vpin(live(v).tape, BUCKET), "vpin"))


@query("stream_vpin_default", sql("symbol, bucket, closed_at, closing_trade", "imbalance vpin", "SELECT * FROM toxicity_default"))
def stream_vpin_default(v):
    """Buckets of 1000 units, 50 of them in the window."""
    return rounded(E.drain(S.stream_vpin(live(v).tape), "vpin"))


@query("stream_vpin_alert", sql("symbol, bucket, closed_at", "vpin", "SELECT * FROM toxicity WHERE vpin > 0.3"))
def stream_vpin_alert(v):
    alerts = S.stream_vpin_alert(S.stream_vpin(live(v).tape, BUCKET), 0.3)
    return rounded(E.drain(alerts.select("symbol", "bucket", "closed_at", "vpin"), "alerts"))


@query("stream_late_drop", exact("SELECT symbol, arrival, ts, u FROM fresh_diffs"))
def stream_late_drop(v):
    return E.drain(S.stream_late_drop(live(v).messages), "fresh")


@query("stream_book", sql("symbol, side", "price qty", "SELECT * FROM replayed"))
def stream_book(v):
    """Snapshot and messages through the live book; the newest row per level is the book."""
    path = fresh_path(v.spark, "snapshots")
    start = snapshot(v).select(
        "symbol", F.lit(True).alias("is_snapshot"), F.lit(-1).cast("long").alias("arrival"), tick_time(F.lit(0)).alias("ts"),
        F.col("last_update_id").alias("u"), F.col("bids").alias("b"), F.col("asks").alias("a"))
    start.write.parquet(path)
    snapshots = v.spark.readStream.schema(start.schema).parquet(path)
    messages = live(v).messages.withColumn("is_snapshot", F.lit(False)).select(*start.columns)
    changes = E.drain(S.stream_book(messages.unionByName(snapshots)), "book")
    newest = changes.groupBy("symbol", "side", "price").agg(F.max_by("qty", "arrival").alias("qty"))
    return rounded(newest.filter(F.col("qty") > 0))


@query("stream_sample_1s", sql("symbol, ts", FEATURES, "SELECT * FROM sampled_features"))
def stream_sample_1s(v):
    """Every second that both feeds have passed: the rows of the batch samples."""
    l = live(v)
    return rounded(E.drain(S.stream_sample_1s(l.depth_feed, l.tape, BUCKET), "samples"))


@query("sink_features_microstructure", sql("symbol, date", "rows mean_vpin", """
SELECT symbol, CAST(ts AS DATE) AS date, count(*) AS rows, avg(vpin) AS mean_vpin FROM sampled_features GROUP BY 1, 2"""))
def sink_features_microstructure(v):
    """Samples appended to a table partitioned by symbol and date."""
    l = live(v)
    path = fresh_path(v.spark, "features_microstructure")
    with E.state_partitions(v.spark):
        rows = S.stream_sample_1s(l.depth_feed, l.tape, BUCKET)
        E.sink_features(rows, path, path + "-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return rounded(v.spark.read.parquet(path).groupBy("symbol", "date").agg(
        F.count(F.lit(1)).cast("double").alias("rows"), F.avg("vpin").alias("mean_vpin")))
