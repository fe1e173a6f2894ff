"""The microstructure table: one row of book and flow features per symbol and second."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import Cut, message_cut, trade_cut
from ..operators.book import SAMPLE_DEPTH, book_features, books_as_of
from ..operators.epochs import RESYNC, book_epochs, feed_end
from ..operators.flow import BUCKET_VOLUME, VPIN_WINDOW, trade_toxicity, vpin_as_of
from ..session import materialise


def sampled_books(messages: DataFrame, snapshots: DataFrame, until: Column, period: timedelta = timedelta(seconds=1),
                  block: timedelta = timedelta(minutes=10), depth: int | None = SAMPLE_DEPTH,
                  resync: timedelta = RESYNC, cut: Cut = message_cut()) -> DataFrame:
    """Every symbol's book by the clock, from its first snapshot up to ``until``, whether anything changes or not."""
    epochs = book_epochs(messages, snapshots, cut, resync)
    entries = epochs.entries.filter(F.col("ts") <= until)
    books = books_as_of(entries, period, block, depth, ("symbol", "epoch"), epochs.last_samples(period, until))
    return books.drop("epoch")


def sample_1s(messages: DataFrame, snapshots: DataFrame, trades: DataFrame, period: timedelta = timedelta(seconds=1),
              block: timedelta = timedelta(minutes=10), volume: int = BUCKET_VOLUME, window: int = VPIN_WINDOW,
              resync: timedelta = RESYNC, cut: Cut = trade_cut(), arrivals: Cut = message_cut()) -> DataFrame:
    """Depth messages, snapshots and trades -> sampled features, for every second that both feeds have passed.

    Buckets are few next to trades; they are written once because the as-of lookup reads
    them twice. The spans of the samples come from the snapshots' books.
    """
    toxicity = materialise(trade_toxicity(trades, volume, window, cut), "toxicity")
    books = sampled_books(messages, snapshots, feed_end(messages, trades), period, block, SAMPLE_DEPTH, resync, arrivals)
    features = materialise(book_features(books), "book_features")
    return vpin_as_of(features, toxicity, block)
