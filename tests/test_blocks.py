"""Block-wise results must not depend on where a series is cut."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from compare import of_spark
from tidemark.functions.frames import ordered, trailing
from tidemark.operators import blocks
from tidemark.operators import timegrid as G

START = datetime(2024, 1, 1)
SCHEMA = "symbol string, trade_id bigint, ts timestamp_ntz, price double"


@pytest.fixture(scope="module")
def ticks(spark):
    """One hot symbol with bursts and silences, one with a few rows far apart."""
    rows, clock = [], 0
    for i in range(400):
        clock += 0 if i % 7 else (1 if i % 50 else 900)
        rows.append(("hot", i, START + timedelta(seconds=clock), float((i * 37) % 101)))
    rows += [("cold", 1000 + i, START + timedelta(seconds=700 * i), float(i * i)) for i in range(9)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def sums(d, w):
    frame = trailing(w, 20)
    return d.withColumn("total", F.sum("price").over(frame)).withColumn("n", F.count("price").over(frame))


@pytest.mark.parametrize("seconds", [1, 10, 300, 100_000])
def test_lookback_equals_unbroken_window(ticks, seconds):
    cut = blocks.time_cut(timedelta(seconds=seconds))
    whole = sums(ticks, ordered(["symbol"], "ts", "trade_id"))
    assert of_spark(blocks.blockwise(ticks, cut, 19, sums)) == of_spark(whole)


@pytest.mark.parametrize("seconds", [1, 60, 100_000])
def test_opening_totals(ticks, seconds):
    cut = blocks.time_cut(timedelta(seconds=seconds))
    openings = blocks.opening(ticks, cut, {"_before": F.sum("price")}, F.sum)
    inside = cut.apply(ticks).withColumn("_in", F.sum("price").over(
        cut.window().rowsBetween(Window.unboundedPreceding, 0)))
    total = inside.join(openings, cut.parts).select(
        "trade_id", (F.coalesce("_before", F.lit(0.0)) + F.col("_in")).alias("run"))
    whole = ticks.select("trade_id", F.sum("price").over(
        ordered(["symbol"], "ts", "trade_id").rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    assert of_spark(total) == of_spark(whole)


@pytest.mark.parametrize("span", [None, timedelta(seconds=30), timedelta(minutes=20), timedelta(days=1)])
def test_ffill(ticks, span):
    gaps = ticks.withColumn("price", F.when(F.col("trade_id") % 11 == 3, F.col("price")))
    order = ("ts", "trade_id")
    out = G.ffill(gaps, ["price"], order=order, span=span)
    assert of_spark(out) == of_spark(G.ffill(gaps, ["price"], order=order, span=None))


@pytest.mark.parametrize("rows", [7, 60, 10_000])
@pytest.mark.parametrize("span", [timedelta(seconds=5), timedelta(minutes=3), timedelta(days=1)])
def test_asof_join(ticks, span, rows):
    right = ticks.filter("trade_id % 13 = 0").select(
        "symbol", "ts", F.col("trade_id").alias("rid"), F.when(F.col("trade_id") % 2 == 0, F.col("price")).alias("rv"))
    left = ticks.filter("trade_id % 13 != 0").select("symbol", "ts", "trade_id")
    out = G.asof_join(left, right, span=span, tie=("rid",), rows_per_piece=rows)
    rows = {r.trade_id: r for r in out.collect()}
    assert len(rows) == left.count()
    rights = sorted(((r.symbol, r.ts, r.rid, r.rv) for r in right.collect()), key=lambda r: r[:3])
    for r in left.collect():
        best = [x for x in rights if x[0] == r.symbol and x[1] <= r.ts]
        expected = best[-1][2:] if best else (None, None)
        assert (rows[r.trade_id].rid, rows[r.trade_id].rv) == expected


@pytest.mark.parametrize("hot", ["left", "right", "left, one time", "right, one time"])
def test_asof_join_splits_hot_spans(spark, hot):
    """95 % of the rows in one span, on either side, spread or all at one time: no task gets more than a few pieces' rows."""
    def rows(n, crowded):
        spread = [("s", START + timedelta(hours=7 * i), i) for i in range(n // 20)]
        times = [0] * n if "one time" in hot else [i * 7919 % 86_400_000 for i in range(n)]
        many = [("s", START + timedelta(days=1, hours=12 if "one time" in hot else 0, milliseconds=t), 10_000 + i) for i, t in enumerate(times)]
        return spread + (many if crowded else many[::40])

    n, piece = 4_000, 300
    left = spark.createDataFrame(rows(n, hot.startswith("left")), "symbol string, ts timestamp_ntz, i bigint")
    right = spark.createDataFrame(rows(n, hot.startswith("right")), "symbol string, ts timestamp_ntz, j bigint")
    out = {r.i: r.j for r in G.asof_join(left, right, tie=("j",), rows_per_piece=piece).collect()}
    rights = sorted((r.ts, r.j) for r in right.collect())
    keys = [t for t, _ in rights]
    from bisect import bisect_right

    assert len(out) == left.count()
    for r in left.collect():
        at = bisect_right(keys, r.ts)
        assert out[r.i] == (rights[at - 1][1] if at else None)
    l = left.select("symbol", "ts", F.struct("i").alias("_left"), F.lit(1).alias("_side")).withColumn("_span", G.slot(F.col("ts"), G.ONE_DAY))
    r = right.select("symbol", "ts", F.struct("j").alias("_right"), F.struct("j").alias("_tie"), F.lit(0).alias("_side")).withColumn("_span", G.slot(F.col("ts"), G.ONE_DAY))
    parts = ["symbol", "_span"]
    sizes = [d.groupBy(*parts, "_piece").count().agg(F.max("count")).first()[0] for d in G.dealt(l, r, parts, "ts", piece)]
    assert max(sizes) < 2 * piece


@pytest.mark.parametrize("seconds", [1, 10, 300, 100_000])
def test_lookahead_equals_unbroken_window(ticks, seconds):
    def ahead(d, w):
        return d.withColumn("later", F.lead("price", 9).over(w)).withColumn("total", F.sum("price").over(w.rowsBetween(-3, 9)))

    cut = blocks.time_cut(timedelta(seconds=seconds))
    out = blocks.blockwise(ticks, cut, 3, ahead, ahead=9)
    assert of_spark(out) == of_spark(ahead(ticks, ordered(["symbol"], "ts", "trade_id")))


@pytest.mark.parametrize("minutes", [1, 7, 10_000])
def test_forward_metrics_on_fine_bars(spark, minutes):
    """Block by block as over the whole symbol, at the ends of blocks and of the series."""
    import random

    from tidemark.operators import labels

    draw, rows = random.Random(2), []
    for s, n in (("a", 90), ("b", 2), ("c", 5)):
        price = 100.0
        for i in range(n):
            price *= 1 + draw.gauss(0, 0.01)
            rows.append((s, START + timedelta(seconds=15 * i + 600 * (i // 30)), price, price * 1.01, price * 0.99))
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double, high double, low double").repartition(4)
    plain = labels.with_forward(bars, labels.Thresholds(), ("symbol",), "ts")
    out = labels.with_forward_blockwise(bars, blocks.time_cut(timedelta(minutes=minutes), order=("ts",)))

    def nearby(df):
        return of_spark(df.select("symbol", "ts", *[F.round(c, 12).alias(c) for c in ("forward_return", "forward_volatility", "forward_hl_range")]))

    assert nearby(out) == nearby(plain)


@pytest.mark.parametrize("days", [1, 30, None])
def test_rolling_quantiles(spark, days):
    """The sorted window against sorting each window anew, across blocks, with gaps and repeated values."""
    import random

    from tidemark.operators.bars import rolling_quantiles

    draw, rows, n = random.Random(4), [], 12
    for s, size in (("a", 150), ("b", 11), ("c", 12)):
        rows += [(s, START + timedelta(hours=4 * i), draw.choice([None, 1.0, 2.0, 2.0, draw.random(), -draw.random()]) if s == "a" else draw.random()) for i in range(size)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double").repartition(3)
    out = rolling_quantiles(df, {"low": ("x", 0.2), "mid": ("x", 0.5)}, n, block=timedelta(days=days) if days else None).orderBy("symbol", "ts").collect()
    assert len(out) == len(rows)
    for s in "abc":
        values = [x for t, _, x in rows if t == s]
        for i, r in enumerate([r for r in out if r.symbol == s]):
            window = values[max(0, i - n + 1):i + 1]
            full = len(window) == n and None not in window
            for q, got in ((0.2, r.low), (0.5, r.mid)):
                if not full:
                    assert got is None
                else:
                    ordered_ = sorted(window)
                    at = q * (n - 1)
                    assert got == pytest.approx(ordered_[int(at)] + (ordered_[min(int(at) + 1, n - 1)] - ordered_[int(at)]) * (at % 1))


def test_grid_copies_whole_rows_and_ends_at_the_last_point(spark):
    rows = [("a", datetime(2024, 1, 1, 1), 1.0), ("a", datetime(2024, 1, 1, 9), None),
            ("a", datetime(2024, 1, 1, 21), 3.0)]
    series = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, v double")
    got = [(r.ts.hour, r.v) for r in G.asof_grid(series).orderBy("ts").collect()]
    assert got == [(0, None), (4, 1.0), (8, 1.0), (12, None), (16, None), (20, None)]


def test_long_grids_are_expanded_in_chunks(spark):
    bounds = spark.createDataFrame(
        [("a", START, START + timedelta(seconds=25_000))], "symbol string, lo timestamp_ntz, hi timestamp_ntz")
    grid = G.span_grid(bounds, timedelta(seconds=1))
    assert grid.count() == 25_001 == grid.distinct().count()
    assert grid.agg(F.min("ts"), F.max("ts")).first() == (START, START + timedelta(seconds=25_000))


def test_series_on_the_grid_equal_grids_joined(spark):
    def times(*hours):
        return [("a", START + timedelta(hours=h), float(h)) for h in hours]

    schema = "symbol string, ts timestamp_ntz, {} double"
    bars = spark.createDataFrame(times(0, 4, 8, 9, 16, 20, 28) + [("b", START, 1.0)], schema.format("close"))
    x = spark.createDataFrame(times(1, 6, 22) + [("a", START + timedelta(hours=7), None)], schema.format("x"))
    y = spark.createDataFrame(times(4, 17), schema.format("y"))
    joined = bars
    for series in (x, y):
        joined = G.join_left_ts(joined, G.asof_grid(series))
    assert of_spark(G.asof_on_grid(bars, [x, y])) == of_spark(joined)


def test_event_table_may_be_a_folder(spark, tmp_path):
    from workload import q_streaming
    from workload.views import Views

    source = "/root/testdata/sf0.001/events.parquet"
    spark.read.parquet(source).repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    rows = q_streaming.live(Views(spark, str(tmp_path))).events
    from tidemark.streaming.envelope import drain

    assert drain(rows.select("event_id"), "ids").count() == spark.read.parquet(source).count()
