"""The derived inputs as DataFrames (see ``sqlviews`` for the same in SQL)."""

from __future__ import annotations

from datetime import timedelta
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numeric import softmax
from tidemark.functions.timing import from_micros
from tidemark.operators import bars as B
from tidemark.operators import blocks, book, epochs, flow
from tidemark.operators import exogenous as X
from tidemark.plans.sampling import sampled_books
from tidemark.schemas import QTY
from tidemark.session import configure
from tidemark.sources.files import read_table

from .sqlviews import SHIFT_DAYS

CLOCK_START = 1_704_067_200_000_000  # 2024-01-01
TICK = 100_000
BUCKET = 100
TICK_CUT = blocks.trade_cut(2_000)
ARRIVAL_CUT = blocks.message_cut(2_000)
SYMBOL_OF = {
    "1-URGENT": "click", "2-HIGH": "error", "3-MEDIUM": "purchase", "4-NOT SPECIFIED": "signup", "5-LOW": "view",
}


def tick_time(event_id: Column) -> Column:
    return from_micros(F.lit(CLOCK_START) + event_id * TICK)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded (adding 0 turns -0 into 0), so that summation order does not show."""
    return df.select(*[
        (F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


class Views:
    """Lazy inputs over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").withColumn("k", F.get_json_object("props", "$.k"))

    @cached_property
    def trades(self) -> DataFrame:
        return self.events.select(
            F.col("event_type").alias("symbol"), F.col("event_id").alias("trade_id"), "ts",
            (F.lit(1000.0) + F.lit(0.5) * F.col("value")).alias("price"), F.col("k").cast(QTY).alias("qty"))

    @cached_property
    def tape(self) -> DataFrame:
        return self.trades.withColumn("ts", tick_time(F.col("trade_id")))

    @cached_property
    def bars(self) -> DataFrame:
        return B.ohlc_sample_by(self.trades)

    @cached_property
    def macro(self) -> DataFrame:
        return B.src_macro(self.bars, "view")

    @cached_property
    def orders(self) -> DataFrame:
        symbol = F.create_map(*[F.lit(x) for kv in SYMBOL_OF.items() for x in kv])[F.col("o_orderpriority")]
        day = F.date_trunc("day", "o_orderdate").cast("timestamp_ntz")
        return self.table("orders").select(
            symbol.alias("symbol"), (day + F.make_dt_interval(F.lit(SHIFT_DAYS))).alias("ts"),
            F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"))

    @cached_property
    def flows(self) -> DataFrame:
        signed = F.when(F.col("status") == "F", F.col("amount")).otherwise(-F.col("amount"))
        return self.orders.filter(F.col("status").isin("F", "O")).groupBy("symbol", "ts").agg(
            (F.sum(signed) / 1234567.89).alias("net_flow"))

    @cached_property
    def reserve(self) -> DataFrame:
        return self.orders.filter(F.col("status") == "P").groupBy("symbol", "ts").agg(
            (F.sum("amount") / 1234567.89).alias("reserve"))

    @cached_property
    def mcap(self) -> DataFrame:
        return self.orders.groupBy("symbol", "ts").agg((F.lit(123456.789) * F.sum("amount")).alias("total_mcap"))

    @cached_property
    def oi(self) -> DataFrame:
        day = F.date_trunc("day", "ts").cast("timestamp_ntz")
        return self.trades.groupBy("symbol", day.alias("ts")).agg(
            (F.lit(1e7) * F.sum(F.col("price") * F.col("qty").cast("double") / 1000)).alias("open_interest"))

    @cached_property
    def funding_parts(self) -> DataFrame:
        return self.trades.groupBy("symbol", F.window("ts", "8 hours").start.alias("ts")).agg(
            (F.avg("price") / 98765.4321).alias("ex1"), (F.max("price") / 98765.4321).alias("ex2"))

    @cached_property
    def funding(self) -> DataFrame:
        return self.funding_parts.select("symbol", "ts", ((F.col("ex1") + F.col("ex2")) / 2).alias("funding_rate"))

    @cached_property
    def onchain(self) -> DataFrame:
        return X.onchain_composite(self.flows, self.reserve)

    # --- order book -----------------------------------------------------------

    @cached_property
    def messages(self) -> DataFrame:
        """Depth messages of one price each, quoted twice: the later entry must win."""
        even = F.col("user_id") % 2 == 0
        step = F.floor(F.col("user_id") / 2) % 60
        price = F.when(even, 100 - step).otherwise(101 + step).cast("double").cast("string")
        qty = F.col("k").cast("double")
        entries = F.array(F.array(price, (qty + 1).cast("string")), F.array(price, qty.cast("string")))
        none = F.array().cast("array<array<string>>")
        u = F.col("event_id") - F.when(F.col("event_id") % 17 == 0, 30).otherwise(0)
        return self.events.select(
            F.col("event_type").alias("symbol"), F.col("event_id").alias("arrival"),
            tick_time(F.col("event_id")).alias("ts"),
            u.alias("first_id"), u.alias("u"), (F.col("event_id") - 1).alias("pu"),
            F.when(even, entries).otherwise(none).alias("b"), F.when(even, none).otherwise(entries).alias("a"))

    @cached_property
    def fresh(self) -> DataFrame:
        return book.stale_update_filter(self.messages, cut=ARRIVAL_CUT)

    @cached_property
    def entries(self) -> DataFrame:
        return book.explode_levels(self.fresh)

    @cached_property
    def final_book(self) -> DataFrame:
        return book.apply_book_updates(self.entries)

    @cached_property
    def snapshots(self) -> DataFrame:
        """Now and then a whole book, 25 ids behind; half of its prices no message ever touches."""
        step = F.sequence(F.lit(0), F.lit(44))

        def levels(sign: int, best: float) -> Column:
            return F.transform(step, lambda i: F.array(
                (F.lit(best) + F.lit(1.5 * sign) * i).cast("string"), (1 + (F.col("event_id") + 3 * i) % 11).cast("double").cast("string")))

        return self.events.filter(F.col("event_id") % 97 == 5).select(
            F.col("event_type").alias("symbol"), F.col("event_id").alias("arrival"), tick_time(F.col("event_id")).alias("ts"),
            (F.col("event_id") - 25).alias("last_update_id"), levels(-1, 100.0).alias("bids"), levels(1, 101.0).alias("asks"))

    @cached_property
    def depth_feed(self) -> DataFrame:
        """Messages and snapshots as they arrive on one feed."""
        columns = ("symbol", "is_snapshot", "arrival", "ts", "u", "b", "a")
        return self.messages.withColumn("is_snapshot", F.lit(False)).select(*columns).unionByName(
            self.snapshots.withColumn("is_snapshot", F.lit(True)).withColumnsRenamed(
                {"last_update_id": "u", "bids": "b", "asks": "a"}).select(*columns))

    @cached_property
    def books(self) -> DataFrame:
        """Top levels of every book, once a second, from its first snapshot on."""
        return sampled_books(self.messages, self.snapshots, epochs.feed_end(self.messages, self.tape),
                             block=timedelta(minutes=2), cut=ARRIVAL_CUT)

    # --- order flow -----------------------------------------------------------

    @cached_property
    def flow(self) -> DataFrame:
        return flow.bvc_classify(flow.running_volume(self.tape, BUCKET, TICK_CUT))

    @cached_property
    def pieces(self) -> DataFrame:
        return flow.volume_buckets(self.flow, BUCKET)

    @cached_property
    def buckets(self) -> DataFrame:
        return flow.vpin_bucket_agg(self.pieces, BUCKET)

    @cached_property
    def toxicity(self) -> DataFrame:
        return flow.vpin(self.buckets, BUCKET, per_block=200)

    # --- headlines ------------------------------------------------------------

    @cached_property
    def headlines(self) -> DataFrame:
        marks = self.table("labels")
        minute = 60_000_000
        return self.table("documents").join(marks, "doc_id", "left").select(
            "doc_id", F.col("text").alias("title"), "source",
            (F.substring("source", 4, 10).cast("int") % 2).alias("source_rank"),
            from_micros(F.lit(CLOCK_START) + F.col("doc_id") * (37 * minute)).alias("ts"),
            F.array(F.lit(4.0) * F.coalesce("quality", F.lit(0)),
                    F.lit(5.0) * F.coalesce("toxic", F.lit(0)), F.lit(0.0)).alias("logits"))

    @cached_property
    def scored(self) -> DataFrame:
        return X.sentiment_from_probabilities(
            self.headlines.withColumn("probs", softmax(F.col("logits")))).drop("probs", "logits")
