"""Streams fed in several micro-batches end where the batch operators end."""

from datetime import datetime, timedelta
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import of_spark
from tidemark.operators import blocks, book, flow
from tidemark.plans.sampling import sample_1s
from tidemark.streaming import envelope as E
from tidemark.streaming import ticks as S
from workload.q_book import snapshot
from workload.views import BUCKET, Views, rounded, tick_time

SF_DIR = "/root/testdata/sf0.001"
PARTS = 7
START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def inputs(spark):
    return Views(spark, SF_DIR)


def arriving(spark, df, order, folder, parts=PARTS):
    """``df`` as a stream of several files, in order of ``order``."""
    highest = df.agg(F.max(order)).first()[0] + 1
    for i in range(parts):
        part = df.filter((F.col(order) >= highest * i // parts) & (F.col(order) < highest * (i + 1) // parts))
        part.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_vpin(spark, inputs, tmp_path):
    stream = arriving(spark, inputs.tape, "trade_id", str(tmp_path / "tape"))
    out = rounded(E.drain(S.stream_vpin(stream, 50, 10), "vpin"))
    batch = rounded(flow.trade_toxicity(inputs.tape, 50, 10).select(*out.columns))
    assert of_spark(out) == of_spark(batch) and out.count() > 100


def test_alerts(spark, inputs, tmp_path):
    stream = arriving(spark, inputs.tape, "trade_id", str(tmp_path / "tape"))
    out = E.drain(S.stream_vpin_alert(S.stream_vpin(stream, 50, 10), 0.3), "alerts")
    batch = flow.vpin_alert(flow.trade_toxicity(inputs.tape, 50, 10), 0.3)
    assert of_spark(out.select("symbol", "bucket")) == of_spark(batch.select("symbol", "bucket"))


def test_late_drop(spark, inputs, tmp_path):
    stream = arriving(spark, inputs.messages, "arrival", str(tmp_path / "messages"))
    out = E.drain(S.stream_late_drop(stream), "fresh")
    assert of_spark(out) == of_spark(inputs.fresh.select("symbol", "arrival", "ts", "u"))


def test_book_waits_for_its_snapshot(spark, inputs, tmp_path):
    """The snapshot (of message 100) arrives in the fourth file: what came before is replayed."""
    early = inputs.messages.filter("arrival <= 100")
    levels = book.apply_book_updates(book.explode_levels(early))

    def side(s):
        return F.collect_list(F.when(F.col("side") == s, F.array(F.col("price").cast("string"), F.col("qty").cast("string"))))

    start = levels.groupBy("symbol").agg(side("b").alias("bids"), side("a").alias("asks")).withColumn(
        "last_update_id", F.lit(100).cast("long"))
    rows = inputs.messages.select("symbol", F.lit(False).alias("is_snapshot"), "arrival", "ts", "u", "b", "a").unionByName(
        start.select("symbol", F.lit(True).alias("is_snapshot"), F.lit(450).cast("long").alias("arrival"), tick_time(F.lit(450)).alias("ts"),
                     F.col("last_update_id").alias("u"), F.col("bids").alias("b"), F.col("asks").alias("a")))
    changes = E.drain(S.stream_book(arriving(spark, rows, "arrival", str(tmp_path / "rows"))), "book")
    newest = changes.groupBy("symbol", "side", "price").agg(F.max_by("qty", "arrival").alias("qty"))
    expected = book.book_replay(start, inputs.messages, blocks.id_cut(50, "arrival"))
    assert of_spark(newest.filter("qty > 0")) == of_spark(expected) and expected.count() > 50


@pytest.mark.parametrize("depth_files, trade_files", [(7, 2), (2, 7)])
def test_samples_do_not_depend_on_which_feed_is_ahead(spark, inputs, tmp_path, depth_files, trade_files):
    """Every row of the batch samples, the last second included, whichever feed runs ahead; snapshots among the messages."""
    messages = arriving(spark, inputs.depth_feed, "arrival", str(tmp_path / "messages"), depth_files)
    trades = arriving(spark, inputs.tape, "trade_id", str(tmp_path / "tape"), trade_files)
    out = rounded(E.drain(S.stream_sample_1s(messages, trades, 50, 10), "samples"))
    batch = rounded(sample_1s(inputs.messages, inputs.snapshots, inputs.tape, volume=50, window=10, block=timedelta(seconds=20)))
    assert of_spark(out) == of_spark(batch) and out.count() > 250
    end = inputs.tape.agg(F.max("ts")).first()[0]
    assert out.agg(F.max("ts")).first()[0] == (end - timedelta(milliseconds=1)).replace(microsecond=0)


def test_a_quiet_symbol_goes_on_by_the_clock(spark, tmp_path):
    """One snapshot and a few messages of one symbol; another one moves the watermark on."""
    def pairs(*levels):
        return [[str(p), str(q)] for p, q in levels]

    schema = "symbol string, is_snapshot boolean, arrival bigint, ts timestamp_ntz, u bigint, b array<array<string>>, a array<array<string>>"
    rows = [
        ("q", False, 0, START, 5, pairs((90, 1)), pairs((95, 1))),  # older than the snapshot
        ("q", False, 1, START + timedelta(seconds=1), 8, pairs((91, 2)), []),  # waits for it
        ("q", True, 2, START + timedelta(seconds=2.5), 7, pairs((90, 3), (80, 1)), pairs((95, 4))),
        ("q", False, 3, START + timedelta(seconds=4), 9, pairs((90, 0)), []),
        ("q", True, 4, START + timedelta(seconds=30.2), 9, pairs((70, 1)), pairs((75, 1))),
    ] + [("busy", i == 0, 10 + i, START + timedelta(seconds=i), i, pairs((50, 1 + i % 3)), pairs((51, 1))) for i in range(41)]
    trades = [(s, i, START + timedelta(seconds=i), 10.0 + i % 2, Decimal(1)) for s in ("q", "busy") for i in range(41)]
    depth = spark.createDataFrame(rows, schema)
    tape = spark.createDataFrame(trades, "symbol string, trade_id bigint, ts timestamp_ntz, price double, qty decimal(38,8)")
    out = E.drain(S.stream_sample_1s(
        arriving(spark, depth, "arrival", str(tmp_path / "d"), 5), arriving(spark, tape, "trade_id", str(tmp_path / "t"), 3), 3, 2), "quiet")
    q = {int((r.ts - START).total_seconds()): r for r in out.filter("symbol = 'q'").collect()}
    assert sorted(q) == list(range(3, 40))  # both feeds end at 40 s, which is not over yet
    assert {(q[i].mid_price, q[i].obi_L1, q[i].obi_L20) for i in (3,)} == {(93.0, (2 - 4) / 6, (6 - 4) / 10)}
    assert {(q[i].mid_price, q[i].obi_L20) for i in range(4, 31)} == {(93.0, (3 - 4) / 7)}
    assert {(q[i].mid_price, q[i].obi_L20) for i in range(31, 40)} == {(72.5, 0.0)}
    assert out.filter("symbol = 'busy'").count() == 40


@pytest.mark.parametrize("keep", [1, 2, 100])
def test_live_levels_beyond_the_held_ones_come_back(monkeypatch, keep):
    """A ladder that holds few levels reads the deeper ones when the best go; only changes are written."""
    import random

    from tidemark.streaming.depth import LiveBook

    class Map(dict):
        reads = writes = 0

        def iterator(self):
            self.reads += 1
            return iter([((p,), (q,)) for (p,), q in self.items()])

        def updateValue(self, k, v):
            self.writes += 1
            self[k] = v[0]

        def removeKey(self, k):
            self.writes += 1
            self.pop(k, None)

    class Value:
        v = None

        def exists(self):
            return self.v is not None

        def get(self):
            return self.v

        def update(self, v):
            self.v = v

    class Handle:
        def __init__(self):
            self.maps = {}

        def getMapState(self, name, *_):
            return self.maps.setdefault(name, Map())

        def getValueState(self, *_):
            return Value()

    handle, draw, plain, changes = Handle(), random.Random(keep), {}, 0
    live = LiveBook(handle, 3, keep)
    for batch in range(60):
        at, bid, price, qty, expected = [], [], [], [], []
        for s in range(batch * 4, batch * 4 + 4):
            for _ in range(draw.randint(0, 4)):
                b, p, q = draw.random() < 0.5, float(draw.randint(1, 30)), float(draw.choice([0, 0, 0, 1, 2]))
                plain[b, p] = q
                for x, y in zip((at, bid, price, qty), (s, b, p, q)):
                    x.append(y)
            expected.append([sorted(((p, q) for (b, p), q in plain.items() if q and b == side), reverse=side)[:3] for side in (True, False)])
        live.load()
        found = live.walk(np.array(at, np.int64), np.array(bid, bool), np.array(price), np.array(qty), batch * 4, batch * 4 + 3)
        changes += len(set(zip(bid, price)))
        live.save()
        got = [[list(zip(*map(np.ndarray.tolist, side))) for side in step[2:]] for step in found for _ in range(step[1])]
        assert got == expected
    maps = handle.maps.values()
    assert sum(m.writes for m in maps) == changes
    if keep == 100:
        assert sum(m.reads for m in maps) == 0


def test_bars_close_with_the_watermark(spark, inputs, tmp_path):
    stream = arriving(spark, inputs.trades, "trade_id", str(tmp_path / "trades"))
    out = rounded(E.drain(S.stream_ohlc(stream, "4 hours", "10 minutes"), "bars"))
    newest = inputs.trades.agg(F.max("ts")).first()[0]
    closed = rounded(inputs.bars.filter(F.col("ts") <= F.lit(newest - timedelta(hours=4, minutes=10))))
    assert of_spark(out) == of_spark(closed)


def test_feature_sink_is_partitioned(spark, inputs, tmp_path):
    messages = arriving(spark, inputs.depth_feed, "arrival", str(tmp_path / "messages"))
    trades = arriving(spark, inputs.tape, "trade_id", str(tmp_path / "tape"))
    path = str(tmp_path / "features")
    with E.state_partitions(spark, 2):
        rows = S.stream_sample_1s(messages, trades, BUCKET)
        E.sink_features(rows, path, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert {p.name for p in (tmp_path / "features").iterdir() if p.name.startswith("symbol=")} == {
        f"symbol={r.symbol}" for r in inputs.snapshots.select("symbol").distinct().collect()}


def test_snapshot_fixture_is_the_early_book(inputs):
    assert snapshot(inputs).count() == 5


@pytest.mark.parametrize("run_rows, piece_rows", [(10, 3), (64, 7), (1000, 5)])
def test_chunks_are_the_sorted_rows(run_rows, piece_rows):
    """However few rows are held: every row once, in stable order, equal first keys in one chunk."""
    import pandas as pd

    from tidemark.streaming import depth as D

    draw = np.random.default_rng(run_rows)
    rows = pd.DataFrame({"ts": draw.integers(0, 90, 400), "seq": draw.integers(0, 4, 400), "price": np.arange(400.0), "full": 0, "rest": 1})
    frames = (rows.iloc[i:i + 9] for i in range(0, 400, 9))
    chunks = list(D.sorted_chunks(frames, ["ts", "seq"], S.TRADE_FIELDS, run_rows, piece_rows))
    pd.testing.assert_frame_equal(pd.concat(chunks, ignore_index=True), rows.sort_values(["ts", "seq"], kind="stable", ignore_index=True), check_dtype=False)
    assert all(a["ts"].max() < b["ts"].min() for a, b in zip(chunks, chunks[1:]))
    assert len(chunks) == 1 or max(map(len, chunks)) < 300
    assert list(D.sorted_chunks(iter(()), ["ts", "seq"], S.TRADE_FIELDS)) == []


def test_one_large_batch_is_applied_in_chunks(spark, inputs, monkeypatch, tmp_path):
    """A feed that comes in one batch, held 60 rows at a time, gives the rows of the batch operators."""
    from tidemark.streaming import depth as D

    monkeypatch.setattr(D, "RUN_ROWS", 60)
    monkeypatch.setattr(D, "PIECE_ROWS", 7)
    out = rounded(E.drain(S.stream_sample_1s(
        arriving(spark, inputs.depth_feed, "arrival", str(tmp_path / "m"), 1), arriving(spark, inputs.tape, "trade_id", str(tmp_path / "t"), 1), 50, 10), "samples"))
    batch = rounded(sample_1s(inputs.messages, inputs.snapshots, inputs.tape, volume=50, window=10, block=timedelta(seconds=20)))
    assert of_spark(out) == of_spark(batch) and out.count() > 250
    start = snapshot(inputs).select("symbol", F.lit(True).alias("is_snapshot"), F.lit(-1).cast("long").alias("arrival"), tick_time(F.lit(0)).alias("ts"),
                                    F.col("last_update_id").alias("u"), F.col("bids").alias("b"), F.col("asks").alias("a"))
    rows = inputs.messages.select("symbol", F.lit(False).alias("is_snapshot"), "arrival", "ts", "u", "b", "a").unionByName(start)
    rows.coalesce(1).write.parquet(str(tmp_path / "b"))  # the snapshot's number is -1
    changes = E.drain(S.stream_book(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "b"))), "book")
    newest = changes.groupBy("symbol", "side", "price").agg(F.max_by("qty", "arrival").alias("qty")).filter("qty > 0")
    expected = book.book_replay(snapshot(inputs), inputs.messages, blocks.id_cut(50, "arrival"))
    assert of_spark(newest) == of_spark(expected)


def test_only_messages_young_enough_are_kept_for_replays():
    import pandas as pd

    from tidemark.streaming import depth as D

    class State:
        kept = []

        def all(self):
            return D.FIELDS.empty_table().to_pandas()

        def add(self, rows):
            self.kept = [*self.kept, rows]

        def forget(self, before):
            pass

    none, last, seen = [np.empty(0)], None, []
    waiting = S.Recent(State(), 1000)
    for i in range(50):
        n = np.arange(i * 100, i * 100 + 100)
        chunk = pd.DataFrame({"ts": n * 10, "seq": n, "is_snapshot": n % 100 == 50, "u": n - 25 * (n % 100 == 50), **{c: none * 100 for c in ("bp", "bq", "ap", "aq")}})
        table, parts, last = D.segments(chunk, last, waiting.before(chunk), 1000)
        seen.append((table, parts))
        waiting.after(chunk, last)
        assert i == 0 or sum(map(len, waiting.held)) <= 101
    waiting.save()
    assert sum(map(len, waiting.state.kept)) <= 101
    table, parts = seen[30]
    opened = [p for p in parts if p.snapshot is not None]
    # the snapshot's id is 25 behind: the 24 messages with newer ids before it are replayed at its time, then the 49 behind it
    assert len(opened) == 1 and len(opened[0].rows) == 24 + 49
    assert (opened[0].ts[:24] == table["ts"][opened[0].snapshot]).all()


def test_packed_feeds_and_small_blocks_give_the_same_samples(spark, inputs, monkeypatch, tmp_path):
    """Pieces of few rows, blocks of few samples, many of which begin at or just before a snapshot."""
    from tidemark.streaming import pieces as P

    for name, value in (("PACKED_ROWS", 300), ("BLOCK_SAMPLES", 3), ("BLOCK_CHANGES", 9)):
        monkeypatch.setattr(P, name, value)
    out = rounded(E.drain(S.stream_sample_1s(
        arriving(spark, inputs.depth_feed, "arrival", str(tmp_path / "m"), 3), arriving(spark, inputs.tape, "trade_id", str(tmp_path / "t"), 2), 50, 10), "samples"))
    batch = rounded(sample_1s(inputs.messages, inputs.snapshots, inputs.tape, volume=50, window=10, block=timedelta(seconds=20)))
    assert of_spark(out) == of_spark(batch) and out.count() > 250


def test_a_task_packs_its_rows_by_symbol():
    """A stateful operator gets few large values; each holds rows of one symbol, in order, none lost."""
    import pyarrow as pa

    from tidemark.streaming import pieces as P
    from tidemark.streaming.depth import unpacked

    draw = np.random.default_rng(1)
    n = 2_000
    names = ["b", None, "a"]
    columns = {"symbol": [names[i] for i in draw.integers(0, 3, n)], "ts": draw.integers(0, 50, n), "seq": draw.permutation(n),
               "price": draw.random(n), "full": np.zeros(n, np.int64), "rest": np.ones(n, np.int64)}
    rows = pa.table(columns)
    pieces = [r for b in P.pack(S.TRADE_FIELDS, S.TRADE_ORDER, True)(iter(rows.to_batches(100))) for r in b.to_pylist()]
    assert [p["symbol"] for p in pieces] == ["a", "b", None]
    for p in pieces:
        got = unpacked([p["rows"]], S.TRADE_FIELDS)
        expected = rows.to_pandas()
        expected = expected[expected["symbol"].isna() if p["symbol"] is None else expected["symbol"] == p["symbol"]]
        assert got.equals(expected.sort_values(["ts", "seq"], ignore_index=True).drop(columns="symbol"))
        assert P.Span(*[p[f] for f in P.Span._fields]) == (got["ts"].min(), got["ts"].max(), got["ts"].min(), got["ts"].max(), len(got))


class Rows:
    """Map state in memory."""

    def __init__(self):
        self.held, self.reads = {}, 0

    def iterator(self):
        return iter([((k,), v) for (k,), v in self.held.items()])

    def updateValue(self, k, v):
        self.held[k] = v

    def removeKey(self, k):
        self.held.pop(k, None)

    def getValue(self, k):
        self.reads += 1
        return self.held[k]


@pytest.mark.parametrize("most", [40, 10_000])
def test_pieces_are_taken_in_order_and_late_rows_are_lost(monkeypatch, most):
    """Whether many rows overlap or few; rows that are not due stay, pieces that are not due are not read."""
    from types import SimpleNamespace

    import pandas as pd

    from tidemark.streaming import depth as D
    from tidemark.streaming import pieces as P

    monkeypatch.setattr(D, "RUN_ROWS", most)
    monkeypatch.setattr(D, "PIECE_ROWS", 5)
    held = P.Pieces(SimpleNamespace(getMapState=lambda *a: Rows()), "t", S.TRADE_FIELDS, S.TRADE_ORDER)
    draw = np.random.default_rng(most)
    rows = pd.DataFrame({"ts": draw.integers(0, 900, 600), "seq": np.arange(600), "price": draw.random(600), "full": 0, "rest": 1})
    parts = [rows.iloc[i:i + 60].sort_values(S.TRADE_ORDER) for i in range(0, 600, 60)]
    parts.append(pd.DataFrame({"ts": [2_000], "seq": [600], "price": [1.0], "full": [0], "rest": [1]}))
    for p in parts:
        held.add([(P.span_of(p, S.TRADE_ORDER), D.packed(p, S.TRADE_FIELDS))], 99)
    everything = pd.concat(parts).sort_values(S.TRADE_ORDER, kind="stable")
    for since, upto in ((99, 400), (400, 1_000)):
        chunks = list(held.chunks(upto))
        pd.testing.assert_frame_equal(pd.concat(chunks, ignore_index=True), everything[(everything["ts"] > since) & (everything["ts"] <= upto)].reset_index(drop=True),
                                      check_dtype=False)
        assert all(a["ts"].max() < b["ts"].min() for a, b in zip(chunks, chunks[1:]))
    assert held.rows.reads == 20 and len(held.rows.held) == len(held.spans.held) == 1


def test_a_block_opens_with_all_levels_that_may_come_up():
    """Levels beyond the held ones are read when enough of those go within a block."""
    from tidemark.operators.ladder import Ladder

    levels = {float(p): 1.0 for p in range(50)}
    for keep in (5, 100):
        side = Ladder(True, lambda: dict(levels), keep)
        side.load(levels)
        assert side.lasting(3, {49.0, 47.0})[0].tolist() == [49, 48, 47, 46, 45]
        assert side.lasting(3, {float(p) for p in range(20, 50)})[0].tolist() == [float(p) for p in range(49, 16, -1)]
        assert len(side.lasting(60, set())[0]) == 50


def test_rows_behind_the_watermark_before_their_batch_are_lost(spark, tmp_path):
    """In the third batch: a message of 5 s comes too late, one of 22 s does not, though both lie behind the newest."""
    schema = "symbol string, is_snapshot boolean, arrival bigint, ts timestamp_ntz, u bigint, b array<array<string>>, a array<array<string>>"

    def at(seconds):
        return START + timedelta(seconds=seconds)

    rows = [("q", True, 0, at(0), 0, [["90", "1"]], [["95", "1"]]), ("q", False, 1, at(10), 1, [], []),
            ("q", False, 10, at(20), 10, [], []), ("q", False, 11, at(30), 11, [], []),
            ("q", False, 20, at(5), 12, [["91", "1"]], []), ("q", False, 21, at(22), 20, [["92", "1"]], []), ("q", False, 22, at(40), 22, [], []),
            ("q", False, 30, at(50), 30, [], [])]
    depth = spark.createDataFrame(rows, schema)
    tape = spark.createDataFrame([("q", n, at(s), 10.0, Decimal(1)) for n, s in ((0, 0), (1, 10), (10, 20), (11, 30), (20, 31), (21, 40), (30, 50))],
                                 "symbol string, trade_id bigint, ts timestamp_ntz, price double, qty decimal(38,8)")
    for df, order, name in ((depth, "arrival", "d"), (tape, "trade_id", "t")):
        for i in range(4):
            df.filter(F.col(order).between(i * 10, i * 10 + 9)).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    streams = [spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n)) for df, n in ((depth, "d"), (tape, "t"))]
    out = {int((r.ts - START).total_seconds()): r.mid_price for r in E.drain(S.stream_sample_1s(*streams, 3, 2), "late").collect()}
    assert sorted(out) == list(range(50))
    assert {out[i] for i in range(22)} == {92.5} and {out[i] for i in range(22, 50)} == {93.5}
