"""Importance resampling towards a target text: hashed n-gram gains, scores with Gumbel noise, the best drawn.

A text's features are the runs of 1 to 3 words (bytes 0-9, A-Z lower-cased, a-z and 0x80 up), words joined by one
space, repeats counted. A feature's bucket is its crc32 modulo ``BUCKETS``. The gain of a bucket compares its share in
the target texts with its share in the source; a document's weight is the sum of its features' gains, its score adds
noise that depends on the seed and the id alone, so a draw of the highest scores is a sample without replacement.

Crc sums are formed for whole arrays: that of two joined texts follows from both sums and the second length, so a run
costs a few table lookups whatever its words. Scores are written once. The cutoff of the draw is found by numeric
threshold bisection: exact counts of the rows above several thresholds at a time narrow the range until one score, and
in the same way one id among those of that score, is left. The drawn rows are dealt by ranges of (score, id); a rank is
a row's place in its range plus the rows of the ranges before it.

Defined results: null and empty texts have no features and weight 0. Rows whose id is null get a weight but neither
score nor rank. Repeated rows are drawn one by one; where only some of the rows with the last score and id fit, those
of the least (weight, number of features) are drawn. No target texts: all of them hold no features. No rows give no
rows; other columns play no part.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, documents, materialise, read
from .registry import query
from .windows import Window, lower, windows

BUCKETS, LONGEST = 10_000, 3
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
PROBES = 31  # thresholds counted by one job of the bisection

WORD = np.zeros(256, dtype=bool)
WORD[0x30:0x3A] = WORD[0x41:0x5B] = WORD[0x61:0x7B] = WORD[0x80:] = True

POLYNOMIAL = 0xEDB88320  # of crc32, reflected


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> 1) ^ np.where(table & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    return table


def _shift_tables() -> np.ndarray:
    """``[b, k, v]``: what byte ``k`` of value ``v`` of a sum becomes when 2^b zero bytes follow."""
    one = BYTE
    values = np.arange(256, dtype=np.uint32)
    tables = np.empty((32, 4, 256), dtype=np.uint32)
    for k in range(4):
        x = values << np.uint32(8 * k)
        tables[0, k] = one[x & 0xFF] ^ (x >> 8)
    for b in range(1, 32):
        for k in range(4):
            tables[b, k] = _moved(_moved(values << np.uint32(8 * k), tables[b - 1]), tables[b - 1])
    return tables


def _moved(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][x & 0xFF] ^ table[1][(x >> 8) & 0xFF] ^ table[2][(x >> 16) & 0xFF] ^ table[3][x >> 24]


BYTE = _byte_table()
SHIFT = _shift_tables()


def joined(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Crc sums of first + second, from both sums and the sizes of the second parts."""
    out = first.copy()
    for b in range(int(size.max(initial=0)).bit_length()):
        at = np.flatnonzero(size >> b & 1)
        out[at] = _moved(out[at], SHIFT[b])
    return out ^ second


def word_sums(w: Window, low: np.ndarray, loop: int = 24) -> np.ndarray:
    """Crc32 of each word: byte by byte over all words, longer words one by one."""
    size = w.end - w.start
    out = np.full(len(size), 0xFFFFFFFF, dtype=np.uint32)
    at = np.flatnonzero(size <= loop)
    for i in range(min(loop, int(size.max(initial=0)))):
        at = at[size[at] > i]
        x = out[at]
        out[at] = BYTE[(x ^ low[w.start[at] + i]) & 0xFF] ^ (x >> 8)
    out ^= 0xFFFFFFFF
    for i in np.flatnonzero(size > loop):
        out[i] = zlib.crc32(low[w.start[i] : w.end[i]].tobytes())
    return out


def features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per window: texts of its features, buckets of them, texts of its words."""
    for w in windows(texts, WORD, 0, LONGEST - 1):
        n = len(w.start)
        if not n:
            continue
        sums, size = word_sums(w, lower(w)), w.end - w.start
        spaced = joined(np.full(n, zlib.crc32(b" "), dtype=np.uint32), sums, size)  # of " word"
        docs, buckets, run = [], [], sums
        for k in range(LONGEST):
            if k:
                run = joined(run[:-1], spaced[k:], size[k:] + 1)
            last = min(w.last, n - k)
            if last <= w.first:
                break
            own = slice(w.first, last)
            whole = w.doc[own] == w.doc[w.first + k : last + k]
            docs.append(w.doc[own][whole])
            buckets.append((run[own] % BUCKETS)[whole])
        if docs:
            yield np.concatenate(docs), np.concatenate(buckets).astype(np.int64), w.doc[w.first : w.last]


def _encoded(batch: pa.RecordBatch) -> list[bytes]:
    return [x.encode() for x in batch.column("text").to_pylist()]


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of ``texts`` (``text``, not null) fall into each bucket; one row per bucket and task is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in by_bytes(batches, "text"):
            for _, bucket, _ in features(_encoded(batch)):
                total += np.bincount(bucket, minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    rows = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most BUCKETS rows
    out = np.zeros(BUCKETS, dtype=object)
    for r in rows:
        out[r.bucket] = int(r.n)
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares, floored."""
    s, t = int(source.sum()) + BUCKETS, int(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((int(b) + 1) * s / ((int(a) + 1) * t))) for a, b in zip(source, target, strict=True)], dtype=np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a standard Gumbel number that depends on the seed and the id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weighted(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score`` of every row."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            words, n, weight = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
            for doc, bucket, of_words in features(_encoded(batch)):
                words += np.bincount(of_words, minlength=batch.num_rows)
                n += np.bincount(doc, minlength=batch.num_rows)
                order = np.argsort(doc, kind="stable")
                total = np.concatenate([[0], np.cumsum(gain[bucket[order]])])  # exact, in integers
                at = np.searchsorted(doc[order], np.arange(batch.num_rows + 1))
                weight += total[at[1:]] - total[at[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (words, n, weight))], ["doc_id", "n_words", "n_features", "weight"])

    out = documents(docs).mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    return out.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def threshold(rows: DataFrame, column: str, wanted: int, highest: bool) -> int:
    """The value of ``column`` with fewer than ``wanted`` rows beyond it and at least ``wanted`` rows up to and with it.

    Beyond means above when ``highest``, else below. Each job counts the rows within ``PROBES`` thresholds exactly.
    """
    ends = rows.agg(F.min(column), F.max(column)).first()
    lo, hi = int(ends[0]), int(ends[1])
    while lo < hi:
        probes = sorted({lo + (hi - lo) * (i + 1) // (PROBES + 1) for i in range(PROBES)} | {lo} - {hi})
        # rows at or above p + 1, or at or below p
        counts = rows.agg(*[F.count_if(F.col(column) > p if highest else F.col(column) <= p).alias(f"c{i}") for i, p in enumerate(probes)]).first()
        for p, n in zip(probes, counts, strict=True):
            if (n < wanted) if highest else (n >= wanted):
                hi = p
                break
            lo = p + 1
    return lo


def drawn(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """``scored`` (written; see ``weighted``) with ``rank`` from 1 for the drawn rows, null for the others."""
    fit = scored.where((F.col("n_words") >= least_words) & F.col("score").isNotNull())
    wanted = fit.count() * percent // 100
    none = F.lit(None).cast("long")
    if not wanted:
        return scored.withColumn("rank", none)
    cut = threshold(fit, "score", wanted, True)
    tied = fit.where(F.col("score") == cut)
    left = wanted - fit.where(F.col("score") > cut).count()
    last = threshold(tied, "doc_id", left, False)
    inside = F.coalesce(
        (F.col("n_words") >= least_words) & ((F.col("score") > cut) | ((F.col("score") == cut) & (F.col("doc_id") <= last))), F.lit(False)
    )
    order = [F.desc("score"), F.asc("doc_id"), F.asc("weight"), F.asc("n_features")]
    dealt = materialise(scored.where(inside).repartitionByRange(*order[:2]).withColumn("_range", F.spark_partition_id()), "drawn")
    ranges = {r["_range"]: r["count"] for r in dealt.groupBy("_range").count().collect()}  # one row for each task
    before, total = [], 0
    for k in sorted(ranges):
        before.append((k, total))
        total += ranges[k]
    from pyspark.sql import Window as W

    starts = scored.sparkSession.createDataFrame(before, "_range int, _before long")
    ranked = dealt.join(F.broadcast(starts), "_range").withColumn("rank", (F.col("_before") + F.row_number().over(W.partitionBy("_range").orderBy(*order))).cast("long"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))  # repeated rows of the last id
    return scored.where(~inside).withColumn("rank", none).unionByName(ranked.select(*scored.columns, "rank"))


def resample(docs: DataFrame, target: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Weights, scores and ranks of ``docs`` (``doc_id``, ``text``) drawn towards the texts of ``target``."""
    goal = target.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
    gain = gains(bucket_counts(documents(docs).select("text")), bucket_counts(goal))
    return drawn(materialise(weighted(docs, gain, seed), "weights"), least_words, percent)


@query("op12_importance_resampling")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
