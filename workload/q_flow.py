"""Trade flow: changes, deviations, classification, volume buckets, toxicity."""

from datetime import timedelta

from pyspark.sql import functions as F

from tidemark.functions.numeric import NORM_DENOMINATOR, NORM_NUMERATOR
from tidemark.functions.numeric import norm_cdf as phi
from tidemark.operators import flow as T
from tidemark.operators.timegrid import grid_of

from .registry import query
from .sqlviews import rounded as sql, view
from .views import BUCKET, TICK_CUT, rounded


def horner(coefficients, x):
    text = repr(coefficients[0])
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c!r})"
    return text


TAIL = f"""CASE WHEN abs(z) > 37 THEN 0.0
       WHEN abs(z) < 7.07106781186547
       THEN exp(-z * z / 2) * {horner(NORM_NUMERATOR, 'abs(z)')} / {horner(NORM_DENOMINATOR, 'abs(z)')}
       ELSE exp(-z * z / 2) / (abs(z) + 1 / (abs(z) + 2 / (abs(z) + 3 / (abs(z) + 4 / (abs(z) + 0.65)))))
            / 2.506628274631 END"""

view("changes", """
SELECT * FROM (SELECT *, price - lag(price) OVER (PARTITION BY symbol ORDER BY ts, trade_id) AS price_change
               FROM tape) WHERE price_change IS NOT NULL
""")

view("sigmas", """
SELECT *, CASE WHEN count(*) OVER h <= 10 THEN 1.0 WHEN stddev_pop(price_change) OVER h = 0 THEN 0.01
               ELSE stddev_pop(price_change) OVER h END AS sigma
FROM changes WINDOW h AS (PARTITION BY symbol ORDER BY ts, trade_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)
""")

view("classified", f"""
SELECT *, CASE WHEN z > 0 THEN 1 - tail ELSE tail END AS buy_prob
FROM (SELECT *, {TAIL} AS tail FROM (SELECT *, price_change / sigma AS z FROM sigmas))
""")

view("filled_volume", """
SELECT *, sum(qty) OVER (PARTITION BY symbol ORDER BY ts, trade_id
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi FROM classified
""")

def bucket_views(suffix: str, volume: int) -> None:
    """Pieces, closed buckets and toxicity for buckets of ``volume``."""
    view(f"bucket_pieces{suffix}", f"""
SELECT symbol, trade_id, ts, buy_prob, bucket,
       least(hi, (bucket + 1) * {volume}) - greatest(hi - qty, bucket * {volume}) AS piece
FROM (SELECT *, unnest(range(CAST(floor((hi - qty) / {volume}) AS BIGINT),
                             CAST(floor(hi / {volume}) AS BIGINT) + 1)) AS bucket
      FROM (SELECT symbol, trade_id, ts, buy_prob, CAST(qty AS BIGINT) AS qty, CAST(hi AS BIGINT) AS hi
            FROM filled_volume))
WHERE least(hi, (bucket + 1) * {volume}) > greatest(hi - qty, bucket * {volume})
""")
    view(f"closed_buckets{suffix}", f"""
SELECT symbol, bucket, abs(sum(piece * (2 * buy_prob - 1))) AS imbalance, max(ts) AS closed_at,
       max(trade_id) AS closing_trade
FROM bucket_pieces{suffix} GROUP BY 1, 2 HAVING sum(piece) = {volume}
""")
    view(f"toxicity{suffix}", f"""
SELECT *, CASE WHEN count(*) OVER h < 50 THEN 0.5 ELSE sum(imbalance) OVER h / (50 * {volume}) END AS vpin
FROM closed_buckets{suffix} WINDOW h AS (PARTITION BY symbol ORDER BY bucket ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)
""")


bucket_views("", BUCKET)
bucket_views("_default", T.BUCKET_VOLUME)

view("tape_seconds", """
SELECT symbol, unnest(generate_series(date_trunc('second', min(ts)), date_trunc('second', max(ts)),
                                      INTERVAL 1 SECOND)) AS ts FROM tape GROUP BY symbol
""")


@query("trade_price_change", sql("symbol, trade_id", "price price_change", "SELECT * FROM changes"))
def trade_price_change(v):
    return rounded(T.trade_price_change(v.tape, TICK_CUT).select("symbol", "trade_id", "price", "price_change"))


@query("trade_sigma", sql("symbol, trade_id", "price_change sigma", "SELECT * FROM sigmas"))
def trade_sigma(v):
    return rounded(T.trade_sigma(v.tape, TICK_CUT).select("symbol", "trade_id", "price_change", "sigma"))


@query("bvc_classify", sql("symbol, trade_id", "buy_prob buy_volume sell_volume", """
SELECT symbol, trade_id, buy_prob, CAST(qty AS DOUBLE) * buy_prob AS buy_volume,
       CAST(qty AS DOUBLE) * (1 - buy_prob) AS sell_volume FROM classified"""))
def bvc_classify(v):
    classified = T.bvc_classify(T.trade_sigma(v.tape, TICK_CUT))
    return rounded(classified.select("symbol", "trade_id", "buy_prob", "buy_volume", "sell_volume"))


@query("norm_cdf", sql("symbol, trade_id", "p", f"""
SELECT symbol, trade_id, CASE WHEN z > 0 THEN 1 - tail ELSE tail END AS p
FROM (SELECT *, {TAIL} AS tail FROM (SELECT symbol, trade_id, (price - 1025) / 4.0 AS z FROM tape))""", 12))
def norm_cdf(v):
    return rounded(v.tape.select("symbol", "trade_id", phi((F.col("price") - 1025) / 4.0).alias("p")), 12)


@query("running_volume", sql("symbol, trade_id", "cum_qty", """
SELECT symbol, trade_id, CAST(hi AS DOUBLE) AS cum_qty FROM filled_volume"""))
def running_volume(v):
    running = T.running_volume(v.tape, BUCKET, TICK_CUT)
    total = F.col("bucket") * BUCKET + F.col("filled") / T.LOTS
    return rounded(running.select("symbol", "trade_id", total.alias("cum_qty")))


@query("volume_buckets", sql("symbol, trade_id, bucket", "piece buy_prob", "SELECT * FROM bucket_pieces"))
def volume_buckets(v):
    return rounded(v.pieces.select("symbol", "trade_id", "bucket", "piece", "buy_prob"))


@query("vpin_bucket_agg", sql("symbol, bucket, closed_at, closing_trade", "imbalance", "SELECT * FROM closed_buckets"))
def vpin_bucket_agg(v):
    return rounded(v.buckets.select("symbol", "bucket", "closed_at", "closing_trade", "imbalance"))


@query("vpin", sql("symbol, bucket, closed_at", "vpin", "SELECT * FROM toxicity"))
def vpin(v):
    return rounded(v.toxicity.select("symbol", "bucket", "closed_at", "vpin"))


@query("vpin_alert", sql("symbol, bucket, closed_at", "vpin", "SELECT * FROM toxicity WHERE vpin > 0.3"))
def vpin_alert(v):
    return rounded(T.vpin_alert(v.toxicity, 0.3).select("symbol", "bucket", "closed_at", "vpin"))


@query("vpin_default", sql("symbol, bucket, closed_at", "vpin", "SELECT * FROM toxicity_default"))
def vpin_default(v):
    """Buckets of 1000 units, 50 of them in the window."""
    return rounded(T.trade_toxicity(v.tape, cut=TICK_CUT).select("symbol", "bucket", "closed_at", "vpin"))


@query("vpin_alert_default", sql("symbol, bucket, closed_at", "vpin", "SELECT * FROM toxicity_default WHERE vpin > 0.8"))
def vpin_alert_default(v):
    """The level of 0.8 on buckets of 1000 units; calm trades give no row."""
    return rounded(T.vpin_alert(T.trade_toxicity(v.tape, cut=TICK_CUT)).select("symbol", "bucket", "closed_at", "vpin"))


@query("vpin_as_of", sql("symbol, ts", "vpin", """
SELECT s.symbol, s.ts, coalesce(x.vpin, 0.5) AS vpin FROM tape_seconds s
ASOF LEFT JOIN (SELECT symbol, closed_at, arg_max(vpin, bucket) AS vpin FROM toxicity GROUP BY 1, 2) x
  ON x.symbol = s.symbol AND x.closed_at <= s.ts"""))
def vpin_as_of(v):
    seconds = grid_of(v.tape, timedelta(seconds=1))
    return rounded(T.vpin_as_of(seconds, v.toxicity, timedelta(minutes=5)))
