"""Books from snapshots against a plain sequential book."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import blocks, book
from tidemark.operators.epochs import book_epochs, feed_end
from tidemark.plans.sampling import sampled_books

START = datetime(2024, 1, 1)
MESSAGES = "symbol string, arrival bigint, ts timestamp_ntz, u bigint, pu bigint, b array<array<string>>, a array<array<string>>"
SNAPSHOTS = "symbol string, arrival bigint, ts timestamp_ntz, last_update_id bigint, bids array<array<string>>, asks array<array<string>>"


def at(arrival):
    return START + timedelta(milliseconds=270 * arrival + arrival % 3)


def feed(seed=3, n=160):
    draw = random.Random(seed)

    def levels(low, k):
        return [[str(float(low + draw.randint(0, 6))), str(float(draw.choice([0, 0, 1, 2, 5])))] for _ in range(draw.randint(0, k))]

    rows, shots = [], []
    for s in ("x", "y"):
        for i in range(n):
            u = i - draw.choice([0, 0, 0, 3])
            rows.append((s, i, at(i), u, u - draw.choice([1, 1, 1, 2]), levels(90, 2), levels(100, 2)))
        for a in sorted(draw.sample(range(10, n), 5)):
            book = [[[str(p), str(float(draw.randint(1, 4)))] for p in draw.sample(side, 4)] for side in ([88.5, 89.5, 90.0, 91.0, 92.5, 93.0], [100.0, 101.5, 102.0, 103.5, 107.5])]
            shots.append((s, a, at(a), a - draw.choice([1, 4, 30]), *book))
    return rows, shots


def sequential(rows, shots, resync, until, stop_at_gap=False):
    """Samples of each full second: symbol, second -> {(side, price): qty}."""
    out = {}
    for s in {r[0] for r in rows}:
        events = sorted([(x[1], 0, x) for x in shots if x[0] == s] + [(x[1], 1, x) for x in rows if x[0] == s], key=lambda e: e[:2])
        current, last, previous, seen, history, first = None, None, None, [], [], True
        for _, kind, x in events:
            if kind == 0:
                current, last, previous = {("b", float(p)): float(q) for p, q in x[4]} | {("a", float(p)): float(q) for p, q in x[5]}, x[3], None
                todo = [m for m in seen if first or m[2] >= x[2] - resync]
                first = False
            else:
                seen.append(x)
                todo = [x] if last is not None else []
            for _, _, _, u, pu, bids, asks in todo:
                if last is not None and u > last:
                    last = u
                    if stop_at_gap and previous is not None and pu != previous:
                        current = None
                    previous = u
                    if current is None:
                        continue
                    for side, entries in (("b", bids), ("a", asks)):
                        for p, q in entries:
                            current[side, float(p)] = float(q)
            history.append((x[2], None if current is None else {k: q for k, q in current.items() if q}))
        second = START
        while second <= until:
            now = [b for t, b in history if t <= second]
            if now and now[-1]:
                out[s, second] = now[-1]
            second += timedelta(seconds=1)
    return out


def found(books):
    out = {}
    for r in books.collect():
        assert [p.price for p in r.bids] == sorted((p.price for p in r.bids), reverse=True)
        assert [p.price for p in r.asks] == sorted(p.price for p in r.asks)
        out[r.symbol, r.ts] = {("b", p.price): p.qty for p in r.bids} | {("a", p.price): p.qty for p in r.asks}
    return out


@pytest.mark.parametrize("resync", [0.4, 3, 1000])
@pytest.mark.parametrize("size, seconds", [(1000, 600), (9, 4)])
def test_books_from_snapshots(spark, resync, size, seconds):
    rows, shots = feed()
    messages, snapshots = spark.createDataFrame(rows, MESSAGES).repartition(3), spark.createDataFrame(shots, SNAPSHOTS)
    until = feed_end(messages)
    got = found(sampled_books(messages, snapshots, until, block=timedelta(seconds=seconds), depth=None,
                              resync=timedelta(seconds=resync), cut=blocks.message_cut(size)))
    end = at(159) - timedelta(milliseconds=1)
    assert got == sequential(rows, shots, timedelta(seconds=resync), end) and len(got) > 60
    assert any(("b", 88.5) in b for b in got.values())  # a price no message ever names


@pytest.mark.parametrize("size", [1000, 7])
def test_a_gap_ends_the_epoch(spark, size):
    rows, shots = feed(11)
    messages, snapshots = spark.createDataFrame(rows, MESSAGES), spark.createDataFrame(shots, SNAPSHOTS)
    epochs = book_epochs(messages, snapshots, blocks.message_cut(size), timedelta(seconds=3), stop_at_gap=True)
    books = book.books_as_of(epochs.entries, depth=None, keys=("symbol", "epoch"), lasts=epochs.last_samples(timedelta(seconds=1), feed_end(messages)))
    expected = sequential(rows, shots, timedelta(seconds=3), at(159) - timedelta(milliseconds=1), stop_at_gap=True)
    whole = sequential(rows, shots, timedelta(seconds=3), at(159) - timedelta(milliseconds=1))
    assert found(books) == expected and 0 < len(expected) < len(whole)


def test_no_snapshot_no_book(spark):
    rows, shots = feed()
    messages = spark.createDataFrame(rows, MESSAGES)
    none = spark.createDataFrame([], SNAPSHOTS)
    assert sampled_books(messages, none, feed_end(messages)).count() == 0
    only_x = spark.createDataFrame([s for s in shots if s[0] == "x"], SNAPSHOTS)
    assert {r.symbol for r in sampled_books(messages, only_x, feed_end(messages)).select("symbol").distinct().collect()} == {"x"}


def test_the_clock_stops_with_the_slower_feed(spark):
    rows, shots = feed()
    messages, snapshots = spark.createDataFrame(rows, MESSAGES), spark.createDataFrame(shots, SNAPSHOTS)
    early = messages.filter(F.col("arrival") <= 100)
    newest = sampled_books(messages, snapshots, feed_end(messages, early)).agg(F.max("ts")).first()[0]
    assert newest == (at(100) - timedelta(milliseconds=1)).replace(microsecond=0)
    assert sampled_books(messages, snapshots, feed_end(messages, early.limit(0))).count() == 0


def test_no_block_meets_all_epochs(spark):
    """Blocks find their epochs by number: no join is by symbol alone, which would grow with their product."""
    import re

    from tidemark.operators import epochs as E

    rows, shots = feed()
    seen = []
    plain = getattr(E, "materialise", None)

    def noted(df, name):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, name)

    E.materialise = noted
    try:
        found = E.book_epochs(spark.createDataFrame(rows, MESSAGES), spark.createDataFrame(shots, SNAPSHOTS), blocks.id_cut(7, "arrival")).entries
    finally:
        E.materialise = plain
    seen.append(found._jdf.queryExecution().executedPlan().toString())
    assert not any(re.search(r"Join \[symbol#\d+\], \[symbol#\d+\],", plan) for plan in seen)
