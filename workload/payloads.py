"""Provider payloads made from the tables: one JSON page per symbol and month (or per
hundred headlines), so that no page grows with the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAD_ENTRY = '{"date": "soon", "totalCirculatingUSD": 5}'


def seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def pages(df: DataFrame, entry: Column, before: str = "[", after: str = "]",
          by: tuple = ("symbol",), page: Column | None = None) -> DataFrame:
    page = F.date_trunc("month", "ts") if page is None else page
    body = F.concat_ws(", ", F.collect_list(entry))
    return (
        df.groupBy(*by, page.alias("_page"))
        .agg(F.concat(F.lit(before), body, F.lit(after)).alias("payload"))
        .select(*by, "payload")
    )


def stablecoin(mcap: DataFrame) -> DataFrame:
    """Objects on even days, plain numbers on odd days, text on every tenth, a bad entry per page."""
    day = F.dayofmonth("ts")
    value = F.col("total_mcap").cast("string")
    shown = (F.when(day % 10 == 0, F.lit('"unknown"'))
             .when(day % 2 == 0, F.concat(F.lit('{"peggedUSD": '), value, F.lit("}"))).otherwise(value))
    entry = F.concat(F.lit('{"date": '), seconds(F.col("ts")), F.lit(', "totalCirculatingUSD": '), shown, F.lit("}"))
    return pages(mcap, entry, f"[{BAD_ENTRY}, ")


def open_interest(oi: DataFrame) -> DataFrame:
    """Every tenth day comes without a value."""
    value = F.when(F.dayofmonth("ts") % 10 == 0, F.lit("")).otherwise(
        F.concat(F.lit(', "v": '), F.col("open_interest").cast("string")))
    return pages(oi, F.concat(F.lit('{"t": '), millis(F.col("ts")), value, F.lit("}")), '{"data": [', "]}")


def funding(parts: DataFrame) -> DataFrame:
    entry = F.concat(F.lit('{"t": '), millis(F.col("ts")), F.lit(', "ex1": '), F.col("ex1").cast("string"),
                     F.lit(', "ex2": '), F.col("ex2").cast("string"), F.lit(', "note": "ok"}'))
    return pages(parts, entry, '{"data": [', "]}")


def netflow(orders: DataFrame) -> DataFrame:
    def side(status: str) -> Column:
        return F.sum(F.when(F.col("status") == status, F.col("amount")).otherwise(0.0))

    daily = orders.groupBy("symbol", "ts").agg(side("F").alias("inflow"), side("O").alias("outflow"))
    entry = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd").alias("datetime"), "inflow", "outflow"))
    return pages(daily, entry, '{"result": {"data": [', "]}}")


def netposition(flows: DataFrame) -> DataFrame:
    entry = F.to_json(F.struct(seconds(F.col("ts")).alias("t"), F.col("net_flow").alias("v")))
    return pages(flows, entry)


def _hundred() -> Column:
    return F.floor(F.col("doc_id") / 100)


def news(headlines: DataFrame) -> DataFrame:
    """Domain at the top, inside ``source``, or missing; every seventh title is empty."""
    third = F.col("doc_id") % 3
    entry = F.to_json(F.struct(
        F.col("doc_id").cast("string").alias("id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"),
        F.when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise(F.col("title")).alias("title"),
        F.when(third == 0, F.col("source")).alias("domain"),
        F.when(third == 1, F.struct(F.col("source").alias("domain"))).alias("source")))
    return pages(headlines, entry, '{"results": [', "]}", (), _hundred())


def articles(headlines: DataFrame) -> DataFrame:
    entry = F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"), "title",
        F.struct(F.col("source").alias("name")).alias("source")))
    return pages(headlines, entry, '{"articles": [', "]}", (), _hundred())
