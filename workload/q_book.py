"""Order book: updates, replay, books at sample times and their features."""

from datetime import timedelta

from pyspark.sql import functions as F

from tidemark.operators import book as K
from tidemark.plans.sampling import sample_1s

from .registry import query
from .sqlviews import rounded as sql, view, exact
from .views import ARRIVAL_CUT, BUCKET, TICK_CUT, rounded

view("start_book", """
SELECT symbol, CAST(1000 AS BIGINT) AS last_update_id, side, price, qty FROM (
  SELECT symbol, side, price, arg_max(qty, arrival) AS qty FROM book_diffs WHERE arrival <= 1000 GROUP BY 1, 2, 3)
WHERE qty > 0
""")

view("replayed", """
SELECT symbol, side, price, arg_max(qty, arrival) AS qty FROM (
  SELECT symbol, side, price, qty, -1 AS arrival FROM start_book
  UNION ALL
  SELECT symbol, side, price, qty, arrival FROM (
    SELECT *, max(u) OVER (PARTITION BY symbol ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
    FROM book_diffs WHERE symbol IN (SELECT symbol FROM start_book))
  WHERE u > greatest(1000, coalesce(seen, 1000)))
GROUP BY 1, 2, 3 HAVING arg_max(qty, arrival) > 0
""")


def volume(side, depth=None, decay=None):
    inside = f"side = '{side}'" + (f" AND level <= {depth}" if depth else "")
    amount = f"qty * exp(-{decay} * (level - 1))" if decay else "qty"
    return f"coalesce(sum({amount}) FILTER ({inside}), 0)"


def ratio(depth=None, decay=None):
    b, a = volume("b", depth, decay), volume("a", depth, decay)
    return f"coalesce(({b} - {a}) / nullif({b} + {a}, 0), 0)"


view("feature_rows", f"""
SELECT symbol, ts, obi_L1, obi_L5, obi_L10, obi_L20, strong AS obi_weighted_strong, weak AS obi_weighted_weak,
       bid, ask, ask - bid AS spread_absolute, (ask - bid) / ask AS spread_relative,
       obi_L1 - obi_L20 AS spoofing_divergence, (bid + ask) / 2 AS mid_price,
       (ask * bq + bid * aq) / (bq + aq) AS micro_price,
       (ask * bq + bid * aq) / (bq + aq) - (bid + ask) / 2 AS micro_dev
FROM (SELECT symbol, ts, {ratio(1)} AS obi_L1, {ratio(5)} AS obi_L5, {ratio(10)} AS obi_L10, {ratio(20)} AS obi_L20,
             {ratio(None, 0.8)} AS strong, {ratio(None, 0.1)} AS weak,
             max(price) FILTER (side = 'b') AS bid, min(price) FILTER (side = 'a') AS ask,
             max(qty) FILTER (side = 'b' AND level = 1) AS bq, max(qty) FILTER (side = 'a' AND level = 1) AS aq
      FROM ranked_1s GROUP BY 1, 2)
""")

TWO_SIDED = "bid IS NOT NULL AND ask IS NOT NULL"
FEATURES = """obi_L1 obi_L5 obi_L10 obi_L20 obi_weighted_strong obi_weighted_weak spread_absolute spread_relative
 spoofing_divergence mid_price micro_price micro_dev vpin"""

view("sampled_features", f"""
SELECT f.*, coalesce(x.vpin, 0.5) AS vpin FROM feature_rows f
ASOF LEFT JOIN (SELECT symbol, closed_at, arg_max(vpin, bucket) AS vpin FROM toxicity GROUP BY 1, 2) x
  ON x.symbol = f.symbol AND x.closed_at <= f.ts
WHERE {TWO_SIDED}
""")


def snapshot(v):
    """A snapshot as the exchange would answer it: the book after message 1000."""
    early = v.messages.filter(F.col("arrival") <= 1000)
    levels = K.apply_book_updates(K.explode_levels(early))

    def side(s):
        pair = F.array(F.col("price").cast("string"), F.col("qty").cast("string"))
        return F.collect_list(F.when(F.col("side") == s, pair))

    return levels.groupBy("symbol").agg(side("b").alias("bids"), side("a").alias("asks")).withColumn(
        "last_update_id", F.lit(1000).cast("long"))


def sampled(v):
    return sample_1s(v.messages, v.snapshots, v.tape, block=timedelta(minutes=2), volume=BUCKET, cut=TICK_CUT, arrivals=ARRIVAL_CUT)


@query("explode_levels", sql("symbol, arrival, side", "price qty", """
SELECT symbol, arrival, side, price, qty FROM book_diffs
UNION ALL SELECT symbol, arrival, side, price, qty + 1 FROM book_diffs"""))
def explode_levels(v):
    return rounded(K.explode_levels(v.messages).select("symbol", "arrival", "side", "price", "qty"))


@query("stale_update_filter", exact("SELECT symbol, arrival, u FROM fresh_diffs"))
def stale_update_filter(v):
    return v.fresh.select("symbol", "arrival", "u")


@query("sequence_gap_check", exact("""
SELECT symbol, arrival, coalesce(arrival - 1 <> lag(u) OVER (PARTITION BY symbol ORDER BY arrival), false) AS gap
FROM book_diffs"""))
def sequence_gap_check(v):
    return K.sequence_gap_check(v.messages, ARRIVAL_CUT).select("symbol", "arrival", "gap")


@query("apply_book_updates", sql("symbol, side", "price qty", "SELECT * FROM final_book"))
def apply_book_updates(v):
    return rounded(v.final_book)


@query("book_replay", sql("symbol, side", "price qty", "SELECT * FROM replayed"))
def book_replay(v):
    return rounded(K.book_replay(snapshot(v), v.messages, ARRIVAL_CUT))


@query("l2_snapshot", exact("""
SELECT symbol,
  array_to_string(list(CAST(price AS VARCHAR) || 'x' || CAST(qty AS VARCHAR) ORDER BY price DESC) FILTER (side = 'b'), ' ') AS bids,
  array_to_string(list(CAST(price AS VARCHAR) || 'x' || CAST(qty AS VARCHAR) ORDER BY price) FILTER (side = 'a'), ' ') AS asks
FROM (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY CASE WHEN side = 'b' THEN -price ELSE price END) AS level
      FROM final_book) WHERE level <= 10 GROUP BY 1"""))
def l2_snapshot(v):
    def shown(side):
        text = F.transform(F.col(side), lambda r: F.concat(r["price"].cast("string"), F.lit("x"), r["qty"].cast("string")))
        return F.array_join(text, " ").alias(side)

    return K.l2_snapshot(v.final_book, 10).select("symbol", shown("bids"), shown("asks"))


@query("book_level_rank", exact("""
SELECT symbol, side, CAST(price AS BIGINT) AS price,
       CAST(row_number() OVER (PARTITION BY symbol, side ORDER BY CASE WHEN side = 'b' THEN -price ELSE price END) AS INT) AS level
FROM final_book"""))
def book_level_rank(v):
    return K.book_level_rank(v.final_book, ("symbol",)).select(
        "symbol", "side", F.col("price").cast("long").alias("price"), "level")


@query("top_n_levels", sql("symbol, side", "price qty", """
SELECT * FROM final_book
QUALIFY row_number() OVER (PARTITION BY symbol, side ORDER BY CASE WHEN side = 'b' THEN -price ELSE price END) <= 5"""))
def top_n_levels(v):
    return rounded(K.top_n_levels(v.final_book, 5, ("symbol",)).select("symbol", "side", "price", "qty"))


@query("book_as_of", sql("symbol, ts, side", "price qty", "SELECT * FROM ranked_1s"))
def book_as_of(v):
    return rounded(K.book_as_of(v.books).select("symbol", "ts", "side", "price", "qty"))


@query("book_side_volume", sql("symbol, ts", "bid_volume ask_volume", f"""
SELECT symbol, ts, {volume('b', 5)} AS bid_volume, {volume('a', 5)} AS ask_volume FROM ranked_1s GROUP BY 1, 2"""))
def book_side_volume(v):
    return rounded(K.book_side_volume(v.books, 5))


@query("obi_depth", sql("symbol, ts", "obi_L1 obi_L5 obi_L10 obi_L20", "SELECT * FROM feature_rows"))
def obi_depth(v):
    return rounded(K.obi_depth(v.books))


@query("obi_weighted", sql("symbol, ts", "obi_weighted_strong obi_weighted_weak", "SELECT * FROM feature_rows"))
def obi_weighted(v):
    return rounded(K.obi_weighted(v.books))


@query("spread", sql("symbol, ts", "spread_absolute spread_relative", f"SELECT * FROM feature_rows WHERE {TWO_SIDED}"))
def spread(v):
    return rounded(K.spread(v.books).select("symbol", "ts", "spread_absolute", "spread_relative"))


@query("spoof_divergence", sql("symbol, ts, spoof_flag", "spoofing_divergence", """
SELECT *, abs(spoofing_divergence) > 0.5 AS spoof_flag FROM feature_rows"""))
def spoof_divergence(v):
    return rounded(K.spoof_divergence(v.books).drop("obi_L1", "obi_L20"))


@query("mid_micro_price", sql("symbol, ts", "mid_price micro_price micro_dev",
                              f"SELECT * FROM feature_rows WHERE {TWO_SIDED}"))
def mid_micro_price(v):
    return rounded(K.mid_micro_price(v.books).select("symbol", "ts", "mid_price", "micro_price", "micro_dev"))


@query("sample_1s", sql("symbol, ts", FEATURES, "SELECT * FROM sampled_features"))
def sampled_features(v):
    """One row of book and flow features per symbol and second."""
    return rounded(sampled(v))
