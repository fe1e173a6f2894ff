"""Operators against plain sequential Python on small inputs, and hand-computed values."""

import math
import random
from datetime import datetime, timedelta
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import of_spark
from tidemark.functions.numeric import norm_cdf, spaced
from tidemark.operators import bars as B
from tidemark.operators import blocks, book, flow, grid, labels
from tidemark.streaming import arrays

START = datetime(2024, 1, 1)
TRADES = "symbol string, trade_id bigint, ts timestamp_ntz, price double, qty decimal(38,8)"


def phi(z):
    return math.erfc(-z / math.sqrt(2)) / 2


def make_trades(n, seed=7, moves=None):
    draw = random.Random(seed)
    price, rows = 1000.0, []
    for i in range(n):
        price += moves(i, draw) if moves else draw.choice([-0.5, 0.0, 0.25, 1.0])
        qty = Decimal(draw.choice(["0.5", "3.25", "40", "17.12345678", "250"]))
        rows.append(("s", i, START + timedelta(milliseconds=130 * i), price, qty))
    return rows


def sequential_vpin(rows, volume, window):
    """Trade by trade: (bucket, imbalance, vpin, closing trade)."""
    changes, last, fill, buy, sell, history, out = [], None, Decimal(0), 0.0, 0.0, [], []
    for _, trade, _, price, qty in rows:
        if last is None:
            last = price
            continue
        changes.append(price - last)
        last, recent = price, changes[-100:]
        sigma = (np.std(recent) or 0.01) if len(recent) > 10 else 1.0
        p, left = phi(changes[-1] / sigma), qty
        while left > 0:
            part = min(left, volume - fill)
            buy, sell, fill, left = buy + float(part) * p, sell + float(part) * (1 - p), fill + part, left - part
            if fill == volume:
                history.append(abs(buy - sell))
                vpin = sum(history[-window:]) / (window * volume) if len(history) >= window else 0.5
                out.append((len(history) - 1, history[-1], vpin, trade))
                fill, buy, sell = Decimal(0), 0.0, 0.0
    return out


@pytest.mark.parametrize("seconds", [1, 7, 3600])
@pytest.mark.parametrize("flat", [False, True])
def test_vpin_equals_sequential_processing(spark, seconds, flat):
    rows = make_trades(400, moves=(lambda i, d: 0.0 if i < 200 else 1.5) if flat else None)
    trades = spark.createDataFrame(rows, TRADES).repartition(4)
    cut = blocks.time_cut(timedelta(seconds=seconds))
    pieces = flow.volume_buckets(flow.bvc_classify(flow.running_volume(trades, 100, cut)), 100)
    got = flow.vpin(flow.vpin_bucket_agg(pieces, 100), 100, 10, per_block=16).orderBy("bucket").collect()
    expected = sequential_vpin(rows, 100, 10)
    assert [(r.bucket, r.closing_trade) for r in got] == [(b, t) for b, _, _, t in expected]
    assert [r.imbalance for r in got] == pytest.approx([i for _, i, _, _ in expected], abs=1e-8)
    assert [r.vpin for r in got] == pytest.approx([v for _, _, v, _ in expected], abs=1e-10)


def test_streaming_arrays_equal_sequential_processing():
    rows = make_trades(500, seed=3)
    state, got = arrays.Flow(100, 10), []
    for a in range(0, 500, 77):
        part = rows[a:a + 77]
        lots, size = np.array([int(r[4] * arrays.LOTS) for r in part]), 100 * arrays.LOTS
        closed = state.take(np.array([r[3] for r in part]), lots // size, lots % size)
        got += [(int(b), i, v, part[c][1]) for b, i, v, c in
                zip(closed.bucket, closed.imbalance, closed.vpin, closed.closer)]
    expected = sequential_vpin(rows, 100, 10)
    assert [(g[0], g[3]) for g in got] == [(e[0], e[3]) for e in expected]
    assert [g[1:3] for g in got] == [pytest.approx(e[1:3], abs=1e-8) for e in expected]


def test_panic_is_more_toxic_than_calm(spark):
    rows = make_trades(1000, 42, lambda i, d: d.gauss(0, 0.5) if i < 500 else d.gauss(-5, 2))
    out = flow.trade_toxicity(spark.createDataFrame(rows, TRADES), 100, 10).orderBy("bucket").collect()
    calm = [r.vpin for r in out if r.closing_trade < 500]
    assert sum(calm[20:]) / len(calm[20:]) < out[-1].vpin


def test_pieces_fill_buckets_exactly(spark):
    trades = spark.createDataFrame(make_trades(300), TRADES)
    pieces = flow.volume_buckets(flow.bvc_classify(flow.running_volume(trades, 50)), 50)
    lots = [r.n for r in pieces.groupBy("bucket").agg(F.sum("piece_lots").alias("n")).orderBy("bucket").collect()]
    assert set(lots[:-1]) == {50 * flow.LOTS} and 0 < lots[-1] <= 50 * flow.LOTS
    total = sum(r[4] for r in make_trades(300)[1:])
    assert sum(lots) == int(total * flow.LOTS)


def test_norm_cdf(spark):
    zs = [-40.0, -8.5, -7.08, -7.06, -1.96, -0.1, 0.0, 0.5, 3.0, 7.1, 38.0]
    rows = spark.createDataFrame([(z,) for z in zs] + [(None,)], "z double")
    got = [r[0] for r in rows.select(norm_cdf(F.col("z"))).collect()]
    assert got[-1] is None
    assert got[:-1] == pytest.approx([phi(z) for z in zs], abs=1e-14)
    assert arrays.norm_cdf(np.array(zs)) == pytest.approx([phi(z) for z in zs], abs=1e-14)


# --- order book ---------------------------------------------------------------

FAKE_BULL = [("b", 3000.0, 100.0), ("b", 2999.0, 10.0), ("b", 2998.0, 10.0), ("b", 2997.0, 10.0),
             ("b", 2996.0, 10.0), ("a", 3001.0, 10.0), ("a", 3002.0, 1000.0), ("a", 3003.0, 1000.0),
             ("a", 3004.0, 1000.0), ("a", 3005.0, 1000.0)]


def books(spark, levels):
    rows = [("s", START, *r) for r in levels]
    return book.l2_snapshot(spark.createDataFrame(
        rows, "symbol string, ts timestamp_ntz, side string, price double, qty double"), 20, ("symbol", "ts"))


def sides(levels):
    """Both sides as (prices, quantities), best first."""
    out = [sorted(((p, q) for s, p, q in levels if s == side), reverse=side == "b") for side in ("b", "a")]
    return [[(np.array([p for p, _ in x]), np.array([q for _, q in x]))] for x in out]


def test_features_of_a_fake_bull_book(spark):
    r = book.book_features(books(spark, FAKE_BULL)).first()
    assert r.obi_L1 == pytest.approx(90 / 110)
    assert r.obi_L5 == pytest.approx((140 - 4010) / 4150)
    assert r.spread_absolute == 1 and r.spread_relative == pytest.approx(1 / 3001)
    assert r.spoofing_divergence == pytest.approx(1.750712, abs=1e-6)
    same = arrays.features(*sides(FAKE_BULL))
    assert {k: r[k] for k in same} == pytest.approx({k: v[0] for k, v in same.items()})


def test_micro_price_leans_to_the_thin_side(spark):
    r = book.mid_micro_price(books(spark, [("b", 100.0, 100.0), ("a", 101.0, 10.0)])).first()
    assert r.mid_price == 100.5 and r.micro_price == pytest.approx((101 * 100 + 100 * 10) / 110)


def test_one_sided_books_give_no_features(spark):
    only_bids = books(spark, [("b", 100.0, 1.0)])
    assert book.book_features(only_bids).count() == 0
    assert book.obi_depth(only_bids).first().obi_L5 == 1.0


MESSAGES = ("symbol string, arrival bigint, ts timestamp_ntz, u bigint, "
            "b array<array<string>>, a array<array<string>>")


def random_messages(n, seed=5):
    draw, rows = random.Random(seed), []
    for i in range(n):
        def side(low):
            return [[str(float(low + draw.randint(0, 5))), str(float(draw.choice([0, 0, 1, 2, 5])))]
                    for _ in range(draw.randint(0, 3))]
        rows.append(("s", i, START + timedelta(milliseconds=draw.randint(0, 40) + 300 * i),
                     i - draw.choice([0, 0, 0, 2]), side(90), side(100)))
    return rows


def sequential_books(rows, last=None, start=None):
    """Book after each message, in arrival order."""
    current = dict(start or {})
    for _, _, ts, u, bids, asks in rows:
        if last is None or u > last:
            last = u
            for side, entries in (("b", bids), ("a", asks)):
                for price, qty in entries:
                    if float(qty):
                        current[side, float(price)] = float(qty)
                    else:
                        current.pop((side, float(price)), None)
            yield ts, dict(current)


def as_book(rows):
    return {(r.side, r.price): r.qty for r in rows}


@pytest.mark.parametrize("size", [1, 13, 1000])
def test_replay_from_a_snapshot(spark, size):
    rows = random_messages(120)
    start = {("b", 90.0): 7.0, ("a", 105.0): 3.0}
    snapshot = spark.createDataFrame(
        [("s", 30, [["90", "7"]], [["105", "3"]])],
        "symbol string, last_update_id bigint, bids array<array<string>>, asks array<array<string>>")
    messages = spark.createDataFrame(rows + [("other", 1, START, 1, [["1", "1"]], [])], MESSAGES)
    got = book.book_replay(snapshot, messages, blocks.id_cut(size, "arrival")).collect()
    assert as_book(got) == list(sequential_books(rows, 30, start))[-1][1]


@pytest.mark.parametrize("seconds", [1, 5, 600])
def test_books_at_sample_times(spark, seconds):
    rows = random_messages(150)
    messages = spark.createDataFrame(rows, MESSAGES).repartition(3)
    entries = book.explode_levels(book.stale_update_filter(messages, cut=blocks.id_cut(20, "arrival")))
    out = book.book_as_of(book.books_as_of(entries, timedelta(seconds=1), timedelta(seconds=seconds), None)).collect()
    history = list(sequential_books(rows))
    last = START + timedelta(seconds=int((max(r.ts for r in entries.collect()) - START).total_seconds()))
    second, expected = START, {}
    while second <= last:
        seen = [b for ts, b in history if ts <= second]
        if seen and seen[-1]:
            expected[second] = seen[-1]
        second += timedelta(seconds=1)
    got = {}
    for r in out:
        got.setdefault(r.ts, {})[r.side, r.price] = r.qty
    assert got == expected


@pytest.mark.parametrize("depth", [1, 2, 4])
@pytest.mark.parametrize("seconds", [3, 600])
def test_top_levels_are_the_first_of_all(spark, seconds, depth):
    """Updates are rare here, so many levels live all through a block."""
    rows = [r[:2] + (START + timedelta(milliseconds=1700 * i),) + r[3:] for i, r in enumerate(random_messages(80, 9))]
    entries = book.explode_levels(spark.createDataFrame(rows, MESSAGES))
    block = timedelta(seconds=seconds)
    every = book.book_as_of(book.books_as_of(entries, block=block, depth=None))
    cut = book.book_as_of(book.books_as_of(entries, block=block, depth=depth))
    assert of_spark(cut) == of_spark(every.filter(F.col("level") <= depth))
    ranked = book.book_level_rank(every.drop("level"))
    assert of_spark(every) == of_spark(ranked.select(*every.columns))


def test_a_quiet_level_is_opened_in_every_block(spark, monkeypatch):
    """Blocks of one sample, expanded in chunks of three: the only change is at the start."""
    monkeypatch.setattr(book, "BLOCKS_AT_ONCE", 3)
    rows = [("s", 0, START, 1, [["90", "2"]], [["91", "1"]]), ("s", 1, START + timedelta(seconds=20), 2, [["90", "3"]], [])]
    entries = book.explode_levels(spark.createDataFrame(rows, MESSAGES))
    out = book.books_as_of(entries, block=timedelta(seconds=1)).orderBy("ts").collect()
    assert [r.ts for r in out] == [START + timedelta(seconds=i) for i in range(21)]
    assert [r.bids[0].qty for r in out] == [2.0] * 20 + [3.0] and {r.asks[0].price for r in out} == {91.0}


def test_updates_beyond_a_million_in_one_message(spark):
    """The position in a message counts below the arrival, however long the message is; ids may pass 10^18."""
    at = 1_800_000_000_000_000_000
    rows = [("s", "b", 90.0, at, 1_500_000, 2.0), ("s", "b", 90.0, at, 7, 5.0), ("s", "b", 91.0, at + 1, 0, 1.0), ("s", "b", 91.0, at, 3_000_000, 9.0)]
    entries = spark.createDataFrame(rows, "symbol string, side string, price double, arrival bigint, pos int, qty double")
    assert as_book(book.apply_book_updates(entries).collect()) == {("b", 90.0): 2.0, ("b", 91.0): 1.0}


def test_trade_ids_beyond_ten_to_the_18th(spark):
    rows = [(s, 1_800_000_000_000_000_000 + i, t, p, q) for s, i, t, p, q in make_trades(300)]
    trades = spark.createDataFrame(rows, TRADES)
    bar = B.ohlc_sample_by(trades).first()
    assert (bar.open, bar.close) == (rows[0][3], rows[-1][3])
    got = [(r.bucket, r.closing_trade) for r in flow.trade_toxicity(trades, 100, 10).orderBy("bucket").collect()]
    assert got == [(b, t) for b, _, _, t in sequential_vpin(rows, 100, 10)]


# --- volume without limit, deviations without cancellation ------------------------

def giant_trades(n, units):
    draw, price, rows = random.Random(2), 1000.0, []
    for i in range(n):
        price += draw.choice([-0.5, 0.0, 0.25, 1.0])
        qty = Decimal(draw.choice(["0", "0.00000001", units, units + ".12345678", "17.5"]))
        rows.append(("s", i, START + timedelta(milliseconds=130 * i), price, qty))
    return rows


def exact_buckets(rows, volume):
    """(bucket, closing trade, sum of the pieces per trade) in exact arithmetic."""
    total, out = Decimal(0), []
    for _, trade, _, _, qty in rows[1:]:
        before, total = total, total + qty
        out += [(int(b), trade) for b in range(int(before // volume), int(total // volume))]
    return out


@pytest.mark.parametrize("block", [1, 50, 1000])
@pytest.mark.parametrize("units, volume", [("5000000000", 2_000_000_000), ("123456789012", 10_000_000_000), ("900", 7)])
def test_any_volume(spark, units, volume, block):
    """200 trades of 5e9 units overflow 64 bits of lots in sum, one of 1.2e11 units alone."""
    rows = giant_trades(200, units)
    trades = spark.createDataFrame(rows, TRADES).repartition(3)
    out = flow.trade_toxicity(trades, volume, 10, blocks.trade_cut(block)).orderBy("bucket").collect()
    assert [(r.bucket, r.closing_trade) for r in out] == exact_buckets(rows, volume)
    state, got, size = arrays.Flow(volume, 10), [], volume * arrays.LOTS
    for a in range(0, 200, 61):
        part = rows[a:a + 61]
        lots = [int(r[4] * arrays.LOTS) for r in part]
        closed = state.take(np.array([r[3] for r in part]), np.array([x // size for x in lots]), np.array([x % size for x in lots]))
        got += [(int(b), part[c][1], i, v) for b, c, i, v in zip(closed.bucket, closed.closer, closed.imbalance, closed.vpin)]
    assert [g[:2] for g in got] == exact_buckets(rows, volume)
    assert [r.imbalance for r in out] == pytest.approx([g[2] for g in got], rel=1e-9, abs=1e-9 * volume)
    assert [r.vpin for r in out] == pytest.approx([g[3] for g in got], abs=1e-9)


def test_a_trade_over_many_buckets_comes_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(arrays, "BUCKETS_AT_ONCE", 7)
    monkeypatch.setattr(flow, "BUCKETS_AT_ONCE", 11)
    rows = make_trades(3) + [("s", 3, START + timedelta(seconds=9), 1003.0, Decimal("5321.5")), ("s", 4, START + timedelta(seconds=10), 1002.0, Decimal("60"))]
    expected = [(b, t) for b, _, _, t in sequential_vpin(rows, 10, 5)]
    out = flow.trade_toxicity(spark.createDataFrame(rows, TRADES), 10, 5).orderBy("bucket").collect()
    assert [(r.bucket, r.closing_trade) for r in out] == expected
    lots, size = np.array([int(r[4] * arrays.LOTS) for r in rows]), 10 * arrays.LOTS
    steps = list(arrays.Flow(10, 5).steps(np.array([r[3] for r in rows]), lots // size, lots % size))
    assert len(steps) > 20 and max(len(c.bucket) for c in steps) <= 15
    assert [(int(b), rows[c][1]) for x in steps for b, c in zip(x.bucket, x.closer)] == expected


@pytest.mark.parametrize("block", [3, 70, 1000])
def test_deviation_of_small_noise_on_a_large_drift(spark, block):
    """Changes of 100 with noise of 1e-7: squares of changes would lose the noise altogether."""
    draw, price, rows = random.Random(8), 1000.0, []
    for i in range(400):
        price += 100 + draw.gauss(0, 1e-7)
        rows.append(("s", i, START + timedelta(milliseconds=i), price, Decimal(1)))
    got = {r.trade_id: r.sigma for r in flow.trade_sigma(spark.createDataFrame(rows, TRADES), blocks.trade_cut(block)).collect()}
    changes = np.diff([r[3] for r in rows])
    streamed = arrays.sigmas(np.empty(0), changes)
    for i in range(1, 400):
        window = changes[max(0, i - 100):i]
        two_pass = 1.0 if len(window) <= 10 else math.sqrt(float(np.mean((window - window.mean()) ** 2))) or 0.01
        assert got[i] == pytest.approx(two_pass, rel=1e-6) and streamed[i - 1] == pytest.approx(two_pass, rel=1e-6)


def test_equal_changes_are_flat(spark):
    """Steps of 0.1 are no binary fractions: batch and stream agree on which stretches are flat."""
    price, rows = 0.0, []
    for i in range(300):
        price = round(price + 0.1, 10) if i < 150 else price
        rows.append(("s", i, START + timedelta(milliseconds=i), price, Decimal(1)))
    got = [r.sigma for r in flow.trade_sigma(spark.createDataFrame(rows, TRADES), blocks.trade_cut(40)).orderBy("trade_id").collect()]
    streamed = arrays.sigmas(np.empty(0), np.diff([r[3] for r in rows]))
    assert got == pytest.approx(streamed.tolist(), rel=1e-6) and got[-1] == 0.01


# --- bars, labels, weights, grids ---------------------------------------------

def test_features_on_bars_equal_pandas(spark):
    import pandas as pd

    draw = random.Random(1)
    close = [100 * math.exp(sum(draw.gauss(0, 0.01) for _ in range(3)) + 0.001 * i) for i in range(120)]
    rows = [("s", START + timedelta(hours=4 * i), c, c * 1.01, c * 0.99, c, 1.0) for i, c in enumerate(close)]
    bars = spark.createDataFrame(
        rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    got = labels.with_forward(B.technical_features(bars), labels.Thresholds(), ("symbol",), "ts").orderBy("ts").toPandas()
    c = pd.Series(close)
    ret, delta = c.pct_change(), c.diff()
    spread = pd.concat([c * 0.02, (c * 1.01 - c.shift()).abs(), (c * 0.99 - c.shift()).abs()], axis=1).max(axis=1)
    up, down = delta.where(delta > 0, 0).rolling(14).mean(), (-delta.where(delta < 0, 0)).rolling(14).mean()
    expected = {
        "volatility_24h": ret.rolling(24).std(), "atr_14": spread.rolling(14).mean(),
        "rsi_14": 100 - 100 / (1 + up / (down + 1e-8)),
        "forward_return": c.shift(-3) / c - 1, "forward_volatility": ret.shift(-3).rolling(3).std(),
    }
    for name, series in expected.items():
        assert got[name].isna().tolist() == series.isna().tolist(), name
        np.testing.assert_allclose(got[name].dropna(), series.dropna(), atol=1e-9)


def test_regimes_of_four_markets(spark):
    """Flat, rising, falling and wild stretches are labelled as such."""
    draw, price, rows = random.Random(42), 1000.0, []
    moves = [lambda: draw.gauss(0, 0.001), lambda: 0.012, lambda: -0.012, lambda: draw.gauss(0, 0.12)]
    for i in range(800):
        price *= 1 + moves[(i // 50) % 4]()
        rows.append(("s", START + timedelta(hours=4 * i), price, price * 1.01, price * 0.99))
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double, high double, low double")
    out = labels.label_regime(bars).orderBy("ts").collect()
    assert len(out) == 797 and {r.regime for r in out} == {0, 1, 2, 3}
    middle = [out[i].regime for i in range(5, 45)]
    assert middle.count(0) > 30
    assert [out[i].regime for i in range(55, 95)].count(1) > 35
    assert [out[i].regime for i in range(105, 145)].count(2) > 35


def test_missing_volatility_is_no_danger(spark):
    rows = [(None, 0.0, None), (0.5, 0.06, 0.0), (0.0, None, 0.2), (0.03, 0.02, 0.0), (-0.03, 0.02, 0.0), (0.001, 0.01, 0.0)]
    df = spark.createDataFrame(rows, "forward_return double, forward_volatility double, forward_hl_range double")
    assert [r[0] for r in df.select(labels.regime_case()).collect()] == [0, 3, 3, 1, 2, 0]


def test_weights_stay_in_range_and_halve(spark):
    rows = [("s", START + timedelta(days=d)) for d in (0, 1000, 1300, 1993, 2993, 3000)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz")
    got = {r.age_days: r.weight for r in labels.temporal_weight(df).collect()}
    assert got[0.0] == got[7.0] == 1.0 and got[3000.0] == 0.1
    assert got[1007.0] == pytest.approx(math.exp(-1.007))
    rate = labels.half_life_rate(F.lit(1700.0))
    halved = {r.age_days: r.weight for r in labels.temporal_weight(df, rate=rate).collect()}
    assert halved[1700.0] == pytest.approx(0.5)


@pytest.fixture
def uneven(spark):
    """Three symbols over different stretches of time: cuts by symbol would put training times after test times."""
    spans = {"early": range(0, 15), "late": range(9, 40), "thin": range(2, 40, 9)}
    rows = [(s, START + timedelta(hours=i)) for s, hours in spans.items() for i in hours]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz").repartition(5)


def test_times_are_ranked_over_all_symbols(uneven):
    times = sorted({r.ts for r in uneven.collect()})
    rank = {t: i + 1 for i, t in enumerate(times)}
    for r in labels.time_rank(uneven).collect():
        assert (r.rn, r.n_times) == (rank[r.ts], len(times))


def test_no_window_over_all_times(uneven):
    text = labels.split_80_20(uneven)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in text


def test_no_training_time_after_a_test_time(uneven):
    split = labels.split_80_20(uneven).collect()
    train, test = ([r.ts for r in split if r.is_train == side] for side in (True, False))
    assert max(train) < min(test) and len({*train}) == 32
    folds = labels.ts_cv_folds(uneven, 3).collect()
    for fold in range(3):
        train, test = ({r.ts for r in folds if r.fold == fold and r.role == role} for role in ("train", "test"))
        assert len(test) == 10 and max(train) < min(test) and len(train) == 40 - (3 - fold) * 10


def test_split_of_nothing(uneven):
    assert labels.split_80_20(uneven.limit(0)).count() == 0


def test_grid_of_one_signal(spark):
    df = spark.createDataFrame(
        [("s", START, 100.0, 1, 0.01), ("s", START, 100.0, 3, 0.01)],
        "symbol string, ts timestamp_ntz, price double, regime int, volatility_24h double")
    p = grid.grid_parameters(df)
    r = p.first()
    assert p.count() == 1 and r.n_levels == 20 and r.spacing == pytest.approx(0.024)
    assert r.upper_bound == pytest.approx(100 + 100 * 0.024 * 20 * 1.3)
    levels = grid.grid_levels(p, keep_small=True).orderBy("level").collect()
    steps = np.linspace(r.lower_bound, r.upper_bound, 20)
    assert [x.price for x in levels] == pytest.approx(list(steps))
    for x in levels:
        bias = 0.7 if x.side == "buy" else 0.3
        assert x.quantity == pytest.approx(40 / x.price * bias * 2)
        assert (x.side == "buy") == (x.price < 100)


def test_no_levels_without_budget(spark):
    df = spark.createDataFrame([("s", START, 100.0, 0, 0.01)],
                               "symbol string, ts timestamp_ntz, price double, regime int, volatility_24h double")
    poor = grid.Budget(capital=10.0)
    assert grid.grid_levels(grid.grid_parameters(df, poor), poor).count() == 0


def test_one_spaced_point_is_the_lower_bound(spark):
    assert spark.range(1).select(spaced(F.lit(1.0), F.lit(9.0), F.lit(0), F.lit(1))).first()[0] == 1.0
