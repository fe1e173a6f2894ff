"""Parsers of provider payloads: a column of JSON text -> typed rows.

Every parser reads a frame with a text column ``payload`` plus key columns that are
carried through. Unreadable payloads and entries give no rows rather than an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timing import from_millis, from_seconds, naive_utc

MAX_NEWS_DAYS = 28
PERMISSIVE = {"mode": "PERMISSIVE"}


def _entries(df: DataFrame, schema: str, path: str | None, keys: Sequence[str]) -> DataFrame:
    """Payload -> one row per element of the array at ``path`` (or of the payload itself)."""
    array = F.from_json("payload", schema, PERMISSIVE)
    for part in path.split(".") if path else ():
        array = array[part]
    return df.select(*keys, F.explode(array).alias("e"))


def parse_stablecoin_json(df: DataFrame, since: Column | None = None,
                          keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """``[{date (s), totalCirculatingUSD}]``; the value is an object with ``peggedUSD`` or a
    plain number, anything else counts as 0. Entries without a readable date are skipped."""
    entry = F.explode(F.variant_get(F.try_parse_json("payload"), "$", "array<variant>"))
    rows = df.select(*keys, entry.alias("e"))

    def number(path: str) -> Column:
        return F.try_variant_get("e", path, "double")

    value = "$.totalCirculatingUSD"
    is_text = F.schema_of_variant(F.try_variant_get("e", value, "variant")) == "STRING"
    out = rows.select(
        *keys, from_seconds(number("$.date")).alias("ts"),
        F.coalesce(number(f"{value}.peggedUSD"), F.when(~F.coalesce(is_text, F.lit(False)), number(value)),
                   F.lit(0.0)).alias("total_mcap"))
    return _since(out.filter(F.col("ts").isNotNull()), since)


def parse_open_interest_json(df: DataFrame, since: Column | None = None,
                             keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """``{data: [{t (ms), v}]}``; a missing value counts as 0."""
    rows = _entries(df, "data array<struct<t: bigint, v: double>>", "data", keys)
    out = rows.select(*keys, from_millis(F.col("e.t")).alias("ts"),
                      F.coalesce("e.v", F.lit(0.0)).alias("open_interest"))
    return _since(out.filter(F.col("ts").isNotNull()), since)


def parse_funding_json(df: DataFrame, since: Column | None = None,
                       keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """``{data: [{t (ms), exchange: rate, ...}]}`` -> mean rate over the exchanges.

    The time stamp is not a rate and stays out of the mean.
    """
    rows = _entries(df, "data array<map<string, string>>", "data", keys)
    rates = F.filter(
        F.transform(F.map_values(F.map_filter("e", lambda k, v: k != "t")), lambda v: v.try_cast("double")),
        lambda v: v.isNotNull())
    mean = F.try_divide(F.aggregate(rates, F.lit(0.0), lambda acc, v: acc + v), F.size(rates))
    out = rows.select(*keys, from_millis(F.col("e")["t"].try_cast("bigint")).alias("ts"), mean.alias("funding_rate"))
    return _since(out.filter(F.col("ts").isNotNull()), since)


def parse_netflow_json(df: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """``{result: {data: [{datetime, inflow, outflow}]}}`` -> inflow - outflow."""
    schema = "result struct<data: array<struct<datetime: string, inflow: double, outflow: double>>>"
    rows = _entries(df, schema, "result.data", keys)
    return rows.select(*keys, naive_utc(F.col("e.datetime")).alias("ts"),
                       (F.col("e.inflow") - F.col("e.outflow")).alias("net_flow"))


def parse_netposition_json(df: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """``[{t (s), v}]`` -> net flow."""
    rows = _entries(df, "array<struct<t: bigint, v: double>>", None, keys)
    return rows.select(*keys, from_seconds(F.col("e.t")).alias("ts"), F.col("e.v").alias("net_flow"))


def parse_news_json(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``{results: [{published_at, title, domain | source.domain}]}``; titles must not be empty."""
    schema = ("results array<struct<published_at: string, title: string, domain: string, "
              "source: struct<domain: string>>>")
    rows = _entries(df, schema, "results", keys)
    return (
        rows.select(*keys, naive_utc(F.col("e.published_at")).alias("ts"), F.col("e.title").alias("title"),
                    F.coalesce("e.domain", "e.source.domain", F.lit("unknown")).alias("source"))
        .filter(F.length("title") > 0)
    )


def parse_articles_json(df: DataFrame, newest: Column | None = None, days: int = MAX_NEWS_DAYS,
                        keys: Sequence[str] = ()) -> DataFrame:
    """``{articles: [{publishedAt, title, source.name}]}``, at most 28 days back from ``newest``."""
    schema = "articles array<struct<publishedAt: string, title: string, source: struct<name: string>>>"
    rows = _entries(df, schema, "articles", keys)
    out = rows.select(*keys, naive_utc(F.col("e.publishedAt")).alias("ts"), F.col("e.title").alias("title"),
                      F.col("e.source.name").alias("source"))
    if newest is None:
        return out
    return out.filter(F.col("ts") >= newest - F.make_dt_interval(F.lit(min(days, MAX_NEWS_DAYS))))


def _since(df: DataFrame, since: Column | None) -> DataFrame:
    return df if since is None else df.filter(F.col("ts") >= since)


def keyword_query(words: Column) -> Column:
    """Search phrase of a news request."""
    return F.array_join(words, " OR ")


def base_asset(symbol: Column) -> Column:
    """``ETH/USDT`` -> ``ETH``."""
    return F.split_part(symbol, F.lit("/"), F.lit(1))


def cache_name(symbol: Column) -> Column:
    return F.replace(symbol, F.lit("/"), F.lit("_"))
