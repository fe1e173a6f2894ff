"""File sources and sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timing import micros
from ..schemas import SENTIMENT

CACHE_MAX_AGE = timedelta(hours=4)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def modified_at(spark: SparkSession, path: str) -> datetime | None:
    """Modification time of a finished output folder, from whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    fs = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(done):
        return None
    return datetime.fromtimestamp(fs.getFileStatus(done).getModificationTime() / 1000, timezone.utc)


def src_parquet_cache(spark: SparkSession, path: str, build: Callable[[], DataFrame],
                      max_age: timedelta = CACHE_MAX_AGE) -> DataFrame:
    """The table at ``path`` if it is younger than ``max_age``, else built and written anew."""
    written = modified_at(spark, path)
    if written is None or datetime.now(timezone.utc) - written >= max_age:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def sink_parquet_csv(df: DataFrame, path: str, by: Sequence[str] = ("symbol",)) -> None:
    """Write parquet and a CSV copy side by side, one folder per key value.

    Rebalanced by key first: a folder gets few files however many tasks there are, and a
    hot key is still written by several tasks. The input is computed once: the copy is made
    from the parquet files.
    """
    df.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(f"{path}/parquet")
    written = df.sparkSession.read.schema(df.schema).parquet(f"{path}/parquet").select(*df.columns)
    written.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).option("header", True).csv(f"{path}/csv")


def src_csv_series(spark: SparkSession, path: str, schema=SENTIMENT) -> DataFrame:
    """CSV series with a header row; time and value columns by schema, not by inference."""
    return spark.read.schema(schema).csv(path, header=True)


def ctas_monthly(df: DataFrame, table: str, path: str, ts: str = "ts") -> None:
    """Create a table from a select, partitioned by year and month."""
    (
        df.withColumn("year", F.year(ts)).withColumn("month", F.month(ts)).hint("rebalance", "year", "month")
        .write.mode("overwrite").partitionBy("year", "month").option("path", path).saveAsTable(table)
    )


def _field(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind in ("double", "float"):
        text = F.format_string("%.6f", c.cast("double"))
    elif kind in ("tinyint", "smallint", "int", "bigint"):
        text = F.concat(c.cast("string"), F.lit("i"))
    elif kind == "boolean":
        text = c.cast("string")
    else:
        text = F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    return F.when(c.isNotNull(), F.concat(F.lit(f"{name}="), text))


def _escaped(tag: Column) -> Column:
    """Commas, spaces and equal signs end a tag's value unless a backslash goes before them."""
    return F.regexp_replace(tag.cast("string"), r"([,= ])", r"\\$1")


def line_protocol(df: DataFrame, table: str, tag: str = "symbol", ts: str = "ts") -> DataFrame:
    """Rows -> ``table,symbol=S field=v,... time_ns``; the format of a field follows its type.

    A row without a tag is a line without one, a row without a time leaves it to the receiver,
    and a row without any field value, which the format cannot hold, gives no line.
    """
    fields = [_field(n, t) for n, t in df.dtypes if n not in (tag, ts)]
    named = F.concat(F.lit(table), F.coalesce(F.concat(F.lit(f",{tag}="), _escaped(F.col(tag))), F.lit("")))
    time = F.coalesce(F.concat(F.lit(" "), (micros(F.col(ts)) * 1000).cast("string")), F.lit(""))
    values = F.concat_ws(",", *fields)
    return df.select(F.when(values != "", F.concat(named, F.lit(" "), values, time)).alias("line")).filter(F.col("line").isNotNull())


def sink_line_protocol(df: DataFrame, table: str, path: str) -> None:
    line_protocol(df, table).write.mode("overwrite").text(path)
