"""Live messages: reading them, routing them by stream name, and running a stream to its end."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import configure, fresh_path

ENVELOPE = T.StructType([T.StructField("stream", T.StringType()), T.StructField("data", T.VariantType())])

ARROW_BYTES = 16_000_000


def open_envelopes(raw: DataFrame, text: str = "value") -> DataFrame:
    """JSON text ``{"stream": ..., "data": {...}}`` -> stream name and payload.

    The payload stays a variant: field names of depth messages differ only in case
    (``U``, ``u``), which variant paths tell apart.
    """
    parsed = F.try_parse_json(F.col(text))
    rest = [c for c in raw.columns if c != text]
    return raw.select(
        *rest, F.try_variant_get(parsed, "$.stream", "string").alias("stream"),
        F.try_variant_get(parsed, "$.data", "variant").alias("data"),
    ).filter(F.col("stream").isNotNull() & F.col("data").isNotNull())


def symbol_of(stream: Column) -> Column:
    """``ethusdt@aggTrade`` -> ``ethusdt``."""
    return F.split_part(stream, F.lit("@"), F.lit(1))


def channel(messages: DataFrame, name: str) -> DataFrame:
    """Messages of one kind, whatever the symbol."""
    return messages.filter(F.endswith(F.col("stream"), F.lit("@" + name)))


def _field(path: str, kind: str) -> Column:
    return F.try_variant_get("data", f"$.{path}", kind)


def depth_messages(messages: DataFrame, keep: tuple[str, ...] = ("arrival", "ts")) -> DataFrame:
    entries = "array<array<string>>"
    return channel(messages, "depth@100ms").select(
        symbol_of(F.col("stream")).alias("symbol"), *keep,
        _field("U", "bigint").alias("first_id"), _field("u", "bigint").alias("u"),
        _field("pu", "bigint").alias("pu"), _field("b", entries).alias("b"), _field("a", entries).alias("a"))


def trade_messages(messages: DataFrame, keep: tuple[str, ...] = ("arrival", "ts")) -> DataFrame:
    return channel(messages, "aggTrade").select(
        symbol_of(F.col("stream")).alias("symbol"), *keep,
        _field("p", "string").try_cast("double").alias("price"),
        _field("q", "string").try_cast("decimal(38,8)").alias("qty"))


@contextmanager
def state_partitions(spark: SparkSession, n: int | None = None) -> Iterator[None]:
    """Start a stateful stream with ``n`` state partitions (default: one per core).

    Rows may be large, so what Python workers get at once is bounded in bytes, too."""
    settings = {"spark.sql.shuffle.partitions": str(n or spark.sparkContext.defaultParallelism),
                "spark.sql.execution.arrow.maxBytesPerBatch": str(ARROW_BYTES)}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def append_to(stream: DataFrame, path: str, checkpoint: str, by: tuple[str, ...] = ()):
    """Append a stream to a parquet table; exactly once, by the checkpoint."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if by:
        writer = writer.partitionBy(*by)
    return writer.option("path", path)


def drain(stream: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Run a stream over all input there is, then return what it wrote."""
    spark = configure(stream.sparkSession)
    path = fresh_path(spark, name)
    with state_partitions(spark):
        running = append_to(stream, path, path + "-checkpoint", by).trigger(availableNow=True).start()
        running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def sink_features(stream: DataFrame, path: str, checkpoint: str):
    """Feature rows, one folder per symbol and day."""
    dated = stream.withColumn("date", F.to_date("ts"))
    return append_to(dated, path, checkpoint, ("symbol", "date"))
