"""Fixed schemas of the tables the operators exchange (all times zone-free, UTC)."""

from pyspark.sql import types as T

QTY = T.DecimalType(38, 8)

BARS = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.DoubleType()),
])

TRADES = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("trade_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("qty", QTY),
])

# ``first_id``, ``u`` and ``pu``: first, final and previous final update id of a message.
DEPTH = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("arrival", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("first_id", T.LongType()),
    T.StructField("u", T.LongType()),
    T.StructField("pu", T.LongType()),
    T.StructField("b", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("a", T.ArrayType(T.ArrayType(T.StringType()))),
])

SENTIMENT = T.StructType([
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("FinBERT_Score", T.DoubleType()),
])

OHLCV = ("open", "high", "low", "close", "volume")
BOOK_FEATURES = (
    "obi_L1", "obi_L5", "obi_L10", "obi_L20", "obi_weighted_strong", "obi_weighted_weak",
    "spread_absolute", "spread_relative", "spoofing_divergence",
    "vpin", "mid_price", "micro_price", "micro_dev",
)
