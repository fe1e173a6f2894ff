"""Scalar functions by family, each over a whole table."""

from datetime import timedelta

from pyspark.sql import functions as F

from tidemark.functions import numeric as N
from tidemark.functions import timing as C
from tidemark.sources import payloads as J

from .registry import query
from .sqlviews import rounded as sql, exact
from .views import rounded


@query("fn_math", sql("event_id, whole", "log decay magnitude widest floored clipped safe spaced top spread", """
SELECT event_id, ln(nullif(value, 0) / 10) AS log, exp(-0.01 * value) AS decay, abs(value - 50) AS magnitude,
       greatest(value, 2 * k, nullif(k, 5)) AS widest, greatest(value, 10) AS floored,
       least(greatest(value - 50, -5), 5) AS clipped, CAST(trunc(value) AS INT) AS whole,
       coalesce(value / nullif(k, 0), 0) AS safe, 100 + 3 * (value - 100) / 9 AS spaced,
       exp(k / 50) / (exp(k / 50) + exp(1) + 1) AS top,
       (exp(k / 50) - exp(1)) / (exp(k / 50) + exp(1) + 1) AS spread
FROM (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)""", 9))
def fn_math(v):
    value, k = F.col("value"), F.col("k").cast("double")
    p = N.softmax(F.array(k / 50, F.lit(1.0), F.lit(0.0)))
    return rounded(v.events.select(
        "event_id", F.ln(F.nullif(value, F.lit(0.0)) / 10).alias("log"), F.exp(F.lit(-0.01) * value).alias("decay"),
        F.abs(value - 50).alias("magnitude"), F.greatest(value, 2 * k, F.nullif(k, F.lit(5.0))).alias("widest"),
        F.greatest(value, F.lit(10.0)).alias("floored"), N.clip(value - 50, -5.0, 5.0).alias("clipped"),
        value.cast("int").alias("whole"), N.ratio_or(value, k).alias("safe"),
        N.spaced(F.lit(100.0), value, F.lit(3), F.lit(10)).alias("spaced"),
        p[0].alias("top"), (p[0] - p[1]).alias("spread")), 9)


@query("fn_round", sql("event_id", "half_even", """
SELECT event_id, round_even(value * 100 / 8, 1) AS half_even FROM events"""))
def fn_round(v):
    return rounded(v.events.select("event_id", F.bround(F.col("value") * 100 / 8, 1).alias("half_even")))


@query("fn_date", sql(
    "event_id, from_ms, from_s, floored, ceiled, naive, before, slot", "age", """
SELECT event_id, date_trunc('millisecond', ts) AS from_ms, date_trunc('second', ts) AS from_s,
       time_bucket(INTERVAL '4 hours', ts, TIMESTAMP '1970-01-01') AS floored,
       time_bucket(INTERVAL '4 hours', ts + INTERVAL '14399999999 microseconds', TIMESTAMP '1970-01-01') AS ceiled,
       date_trunc('second', ts) - INTERVAL 2 HOUR AS naive, ts - INTERVAL 30 DAY AS before,
       CAST(floor(epoch_us(ts) / 60000000.0) AS BIGINT) AS slot,
       (epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) / 86400e6 AS age
FROM events"""))
def fn_date(v):
    ts = F.col("ts")
    stamp = ts.cast("timestamp")
    four = timedelta(hours=4)
    newest = v.events.agg(F.max("ts")).scalar()
    return rounded(v.events.select(
        "event_id", C.from_millis(F.unix_millis(stamp)).alias("from_ms"),
        C.from_seconds(F.unix_seconds(stamp)).alias("from_s"), C.floor_to(ts, four).alias("floored"),
        C.ceil_to(ts, four).alias("ceiled"),
        C.naive_utc(F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).alias("naive"),
        C.days_before(ts, 30).alias("before"), C.slot(ts, timedelta(minutes=1)).alias("slot"),
        C.age_days(newest, ts).alias("age")))


@query("fn_string", sql("event_id, base, file, upper, lower, query, text", "price", """
SELECT event_id, event_type AS base, event_type || '_USDT' AS file, upper(event_type) AS upper,
       lower(upper(event_type)) AS lower, event_type || ' OR coin' AS query,
       event_type || '=' || format('{:.6f}', value) AS text, value AS price FROM events"""))
def fn_string(v):
    symbol = F.concat(F.col("event_type"), F.lit("/USDT"))
    return rounded(v.events.select(
        "event_id", J.base_asset(symbol).alias("base"), J.cache_name(symbol).alias("file"),
        F.upper("event_type").alias("upper"), F.lower(F.upper("event_type")).alias("lower"),
        J.keyword_query(F.array("event_type", F.lit("coin"))).alias("query"),
        F.concat_ws("=", "event_type", F.format_string("%.6f", "value")).alias("text"),
        F.col("value").cast("string").cast("double").alias("price")))


@query("fn_array", sql("doc_id, first_two, last_sorted, words, second", "total", """
SELECT doc_id, array_to_string(list_slice(w, 1, 2), '|') AS first_two, list_sort(w)[-1] AS last_sorted,
       CAST(len(w) AS INT) AS words, coalesce(w[2], '') AS second,
       CAST(list_sum([len(x) for x in w]) AS DOUBLE) AS total
FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)"""))
def fn_array(v):
    """Array functions over the words of each whole text."""
    words = v.table("documents").select("doc_id", F.split("text", " ").alias("w"))
    return rounded(words.select(
        "doc_id", F.array_join(F.slice("w", 1, 2), "|").alias("first_two"),
        F.element_at(F.sort_array("w"), -1).alias("last_sorted"), F.size("w").alias("words"),
        F.coalesce(F.get("w", F.lit(1)), F.lit("")).alias("second"),
        F.aggregate("w", F.lit(0.0), lambda acc, x: acc + F.length(x)).alias("total")))


@query("fn_posexplode", exact("""
SELECT doc_id, pos, word FROM (
  SELECT doc_id, unnest(w) AS word, CAST(unnest(range(len(w))) AS INT) AS pos
  FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents))"""))
def fn_posexplode(v):
    """Elements with their index."""
    words = v.table("documents").select("doc_id", F.split("text", " ").alias("w"))
    return words.select("doc_id", F.posexplode("w").alias("pos", "word"))


@query("fn_json", sql("event_id", "known missing nested", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS known, 0.0 AS missing,
       CASE WHEN event_id % 2 = 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) ELSE event_id END AS nested
FROM events"""))
def fn_json(v):
    """Nested get with default; a field that is an object or a number."""
    mixed = F.concat(F.lit('{"m": '), F.when(F.col("event_id") % 2 == 0, F.col("props"))
                     .otherwise(F.col("event_id").cast("string")), F.lit("}"))
    parsed = v.events.withColumn("j", F.try_parse_json(mixed)).withColumn("p", F.try_parse_json("props"))
    return rounded(parsed.select(
        "event_id", F.coalesce(F.try_variant_get("p", "$.k", "double"), F.lit(0.0)).alias("known"),
        F.coalesce(F.try_variant_get("p", "$.none", "double"), F.lit(0.0)).alias("missing"),
        F.coalesce(F.try_variant_get("j", "$.m.k", "double"), F.try_variant_get("j", "$.m", "double"),
                   F.lit(0.0)).alias("nested")))


@query("fn_conditional", exact("""
SELECT event_id, CASE WHEN value > 50 THEN 'high' WHEN value > 10 THEN 'mid' ELSE 'low' END AS band,
       CAST(coalesce(CASE WHEN user_id % 2 = 0 THEN user_id END, 0) AS BIGINT) AS even_user FROM events"""))
def fn_conditional(v):
    kept = F.when(F.col("user_id") % 2 == 0, F.col("user_id"))
    return v.events.select(
        "event_id", F.when(F.col("value") > 50, "high").when(F.col("value") > 10, "mid").otherwise("low").alias("band"),
        kept.alias("even_user")).na.fill(0, ["even_user"])
