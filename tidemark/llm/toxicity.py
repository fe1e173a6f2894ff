"""Toxicity of texts: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct runs of ``SIZES`` bytes of the text with A-Z lower-cased, hashed into
``BUCKETS``. With ``p`` and ``q`` the smoothed shares of toxic and clean texts that hold a feature,
its value is ``r = log(p / q)`` where it occurs, else 0. Smoothing adds ``2 * SMOOTH`` texts, divided
as the labelled texts are, so what both classes hold alike has the value 0 however uneven they are.
Logistic regression with an L2 penalty is fitted on these values; the product of both is one weight
per bucket.

The log-count ratios take about ``COUNTED`` labelled documents of each class (all, if there are no more), counted
in Spark: one row per bucket reaches the driver. Their ids are chosen by a threshold on a hash and broadcast,
so that no text is shuffled. The regression takes at most ``PER_CLASS`` labelled documents of each class, those
with the least hash of their id. The share of toxic rows among all labelled ones sets the intercept. Every
row is scored on its whole text.

Defined results: null and empty texts have no features and get the score of the intercept. Where
several label rows name a document the highest label counts; null labels and null ids label
nothing. Without labelled rows of both classes every score is the smoothed share of toxic rows
(0 without any labels). Repeated rows of a labelled document count one by one, and are scored one by
one; no rows give no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, documents, read
from .registry import query
from .words import LOWER, mixed, powers, prefix_hashes

SIZES, BUCKETS = (3, 4, 5), 1 << 18
#: Labelled documents of each class in the regression and in the counts.
PER_CLASS, COUNTED = 600, 50_000
#: Labelled texts in which a feature must occur, smoothing, penalty and steps.
LEAST_TEXTS, SMOOTH, PENALTY, STEPS = 2, 1.0, 5.0, 150
FOLDS = 5
SLICE = 1 << 20  # bytes of text that a task looks at together


def features(texts: list[bytes], group: int = 32) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, bucket) of the distinct features, ``group`` texts at a time."""
    for begin in range(0, len(texts), group):
        part = texts[begin : begin + group]
        data = LOWER[np.frombuffer(b"".join(part), dtype=np.uint8)]
        ends = np.cumsum(np.fromiter(map(len, part), dtype=np.int64, count=len(part)))
        doc = np.repeat(np.arange(len(part)), np.diff(ends, prepend=0))
        sums, inverse = prefix_hashes(data), powers(len(data) + 1)[1]
        seen = np.zeros(len(part) * BUCKETS, dtype=bool)
        for size in SIZES:
            n = len(data) - size + 1
            if n <= 0:
                continue
            with np.errstate(over="ignore"):
                value = mixed((sums[size:] - sums[:-size]) * inverse[:n], size) >> np.uint64(46)
            within = doc[:n] == doc[size - 1 :]
            seen[doc[:n][within] * BUCKETS + value[within].astype(np.int64)] = True
        at = np.flatnonzero(seen)
        yield begin + at // BUCKETS, at % BUCKETS


@dataclass
class Model:
    weights: np.ndarray  # one for each bucket
    intercept: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        total = np.zeros(len(texts))
        for doc, bucket in features(texts):
            total += np.bincount(doc, weights=self.weights[bucket], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total + self.intercept, -60, 60)))


def ratios(held: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Log-count ratio of each bucket: ``held[y]`` texts of class ``y`` hold it, of ``texts[y]``."""
    part = texts / texts.sum()
    out = np.log((held[1] + 2 * SMOOTH * part[1]) / texts[1]) - np.log((held[0] + 2 * SMOOTH * part[0]) / texts[0])
    out[held.sum(axis=0) < LEAST_TEXTS] = 0
    return out


def fit(rows: list[tuple[int, np.ndarray]], share: float, held: np.ndarray, texts: np.ndarray) -> Model:
    """A model from (label, buckets) rows and the counts of ``ratios``; ``share`` of all labelled rows are toxic."""
    label = np.array([y for y, _ in rows], dtype=np.float64)
    if not len(label) or label.min() == label.max():
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    lengths = np.array([len(x) for _, x in rows])
    doc, bucket = np.repeat(np.arange(len(rows), dtype=np.int32), lengths), np.concatenate([x for _, x in rows])
    ratio = ratios(held, texts)
    use = ratio[bucket] != 0
    doc, bucket = doc[use], bucket[use]
    value = ratio.astype(np.float32)[bucket]
    # gradient descent with momentum on the mean loss; the curvature is at most a quarter of the mean squared length
    w, b = np.zeros(BUCKETS), 0.0
    step = 1 / (0.25 * ((value.astype(np.float64) ** 2).sum() / len(label) + 1) + PENALTY / len(label))
    v, u = np.zeros(BUCKETS), 0.0
    for _ in range(STEPS):
        z = np.bincount(doc, weights=value * w.astype(np.float32)[bucket], minlength=len(label)) + b
        error = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - label) / len(label)
        g = np.bincount(bucket, weights=value * error.astype(np.float32)[doc], minlength=BUCKETS) + PENALTY * w / len(label)
        v, u = 0.9 * v - step * g, 0.9 * u - step * error.sum()
        w, b = w + v, b + u
    drawn = label.mean()
    b += np.log(share / (1 - share)) - np.log(drawn / (1 - drawn))
    return Model((w * ratio).astype(np.float32), float(b))


def fold(doc_id: str | Column = "doc_id") -> Column:
    """The fold of a document: crc32 of its id as text, modulo ``FOLDS``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id) % FOLDS


def chosen(known: DataFrame, texts: tuple[int, int]) -> DataFrame:
    """The rows of ``known`` that are counted; ``texts[y]`` rows are of class ``y``. Their number, 2 * COUNTED but for chance, bounds a broadcast."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    limits = [(1 << 40) * COUNTED // max(n, COUNTED) for n in texts]
    return known.where(((F.col("toxic") == 0) & (place < limits[0])) | ((F.col("toxic") == 1) & (place < limits[1])))


def counted(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How many texts of class 0 and 1 hold each bucket, and how many there are, over ``doc_id``, ``text``, ``toxic``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, BUCKETS + 1), np.int64)  # the last one counts the texts themselves
        for batch in by_bytes(batches, "text", SLICE):
            label = batch.column("toxic").to_numpy()
            held[:, BUCKETS] += np.bincount(label, minlength=2)
            for doc, bucket in features([x.encode() for x in batch.column("text").to_pylist()]):
                for y in (0, 1):
                    held[y, :BUCKETS] += np.bincount(bucket[label[doc] == y], minlength=BUCKETS)
        at = np.flatnonzero(held.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[0, at]), pa.array(held[1, at])], ["bucket", "clean", "toxic"])

    sums = labelled.mapInArrow(count, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    got = sums.toArrow()  # BUCKETS + 1 rows at most
    held = np.zeros((2, BUCKETS + 1), np.int64)
    held[:, got.column("bucket").to_numpy()] = got.column("clean").to_numpy(), got.column("toxic").to_numpy()
    return held[:, :BUCKETS], held[:, BUCKETS]


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled documents outside fold 0."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold() != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    counts = {r.toxic: r["count"] for r in known.where("toxic IN (0, 1)").groupBy("toxic").count().collect()}  # two rows
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    if not n0 + n1:
        return Model(np.zeros(BUCKETS, np.float32), -60.0)
    # the least hashes of ids first: at most PER_CLASS ids of either class
    drawn = None
    for y in (0, 1):
        some = known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_CLASS)
        drawn = some if drawn is None else drawn.unionByName(some)
    sample = documents(docs).join(F.broadcast(drawn), "doc_id")

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SLICE):
            texts = [x.encode() for x in batch.column("text").to_pylist()]
            out = [b""] * len(texts)
            for doc, bucket in features(texts):
                for i in np.unique(doc):
                    out[i] = bucket[doc == i].astype("<i4").tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(out, pa.binary())], ["doc_id", "toxic", "buckets"])

    # repeated ids could lengthen the sample: one row each
    found = sample.mapInArrow(buckets, "doc_id long, toxic int, buckets binary").groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("buckets").alias("buckets"))
    rows = [(r.toxic, np.frombuffer(r.buckets, "<i4")) for r in found.orderBy("doc_id").collect()]  # bounded: 2 * PER_CLASS rows
    share = n1 / (n0 + n1) if n0 and n1 else (n1 + 0.5) / (n0 + n1 + 1)
    held, texts = counted(documents(docs).join(F.broadcast(chosen(known, (n0, n1))), "doc_id"))
    return fit(rows, share, held, texts)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of each row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SLICE):
            values = model.scores([x.encode() for x in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.float64())], ["doc_id", "score"])

    out = documents(docs).mapInArrow(score, "doc_id long, score double")
    return out.select(
        "doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SLICE):
            yield batch.filter(pa.array(model.scores([(x or "").encode() for x in batch.column("text").to_pylist()]) < 0.5))

    return docs.mapInArrow(keep, docs.schema)


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return scored(docs, train(docs, read(spark, sf_dir, "labels")))
