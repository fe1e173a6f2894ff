"""Quality of texts: a factorisation machine on hashed words, structure statistics and the stored length.

Inputs of a text: its words (runs without white space, A-Z lower-cased) in ``WORDS`` hashed buckets and their shapes
(first and last bytes by kind; marks stay as they are) in ``SHAPES`` buckets, each with the root of its share; and, of
each statistic (shares of upper case, digits, marks, separators, repeated words and lines, word and line lengths, size,
the stored ``n_chars``), the bin it falls into between the quantiles of the training sample. With weight ``w_i`` and a
vector ``v_i`` of ``RANK`` numbers for each input, the margin of a text is

    b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j,

the last sum taken in linear time as half of ``|sum_i x_i v_i|^2 - sum_i x_i^2 |v_i|^2``. Weights and vectors are
fitted together by Adam on the log loss with an L2 penalty.

The fit takes a bounded sample: at most ``PER_CLASS`` labelled rows of each class, those with the least hash of their
id, each as at most ``WORDS + SHAPES`` counts. The share of good rows among all labelled ones sets the intercept. Every
row is scored on its whole text, long ones a window at a time with counts added up.

Defined results: null and empty texts have no words, their statistics are 0; a missing ``n_chars`` has a bin of its own,
a missing column counts as missing values. Where several label rows name a document the lowest label counts; null labels
and null ids label nothing, and labels other than 0 and 1 neither. Without labelled rows of both classes every score is
the smoothed share of good rows (0.5 without any). Repeated rows are scored one by one; no rows give no rows; other
columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, read
from .registry import query
from .windows import MOST, lower, windows, word_hashes
from .words import SPACE, mixed

WORDS, SHAPES, BINS = 1 << 13, 1 << 10, 10
#: Labelled rows of each class in the fit, length of the vectors, and the settings of the descent.
PER_CLASS, RANK = 2000, 6
EPOCHS, BATCH, RATE, PENALTY, SPREAD, SEED = 14, 64, 0.02, 2e-4, 0.05, 11
BIN_VALUE = 0.35  # of a statistic's bin; words and shapes have norm 1 each
GOOD, FOLDS, HELD = 0.7, 4, 2

BLACK = ~SPACE  # bytes of words
#: Kinds of bytes in a shape: lower case, upper case, digit, beyond ASCII; marks are kinds of their own.
KIND = np.arange(256, dtype=np.uint64)
KIND[97:123], KIND[65:91], KIND[48:58], KIND[128:] = 1, 2, 3, 4
MARK = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
STATS = ("size", "upper", "digits", "high", "marks", "odd_marks", "stops", "bars", "controls", "repeats", "marked", "short", "word_size",
         "line_size", "same_lines", "stored", "stored_share")


@dataclass
class Inputs:
    doc: np.ndarray     # text of each entry, ascending
    index: np.ndarray   # bucket of a word, or WORDS + bucket of a shape
    value: np.ndarray
    stats: np.ndarray   # one row for each text; NaN where a value is missing


def _shapes(low_start: np.ndarray, size: np.ndarray, data: np.ndarray) -> np.ndarray:
    kinds = KIND[data]
    last = low_start + size - 1
    out = kinds[low_start] << np.uint64(24)
    for i in range(3):
        out |= np.where(size > i, kinds[np.maximum(last - i, 0)], np.uint64(0)) << np.uint64(8 * i)
    return mixed(out, 23) >> np.uint64(54)


def inputs(texts: list[bytes], stored: np.ndarray) -> Inputs:
    """Of each text; ``stored``: the lengths on record, NaN where there are none."""
    n, width = len(texts), WORDS + SHAPES
    long: dict[int, np.ndarray] = {}
    keys, counts = [], []
    words, repeats, marked, short = (np.zeros(n) for _ in range(4))
    for w in windows(texts, BLACK, 1, 0):
        size = w.end - w.start
        if not len(size):
            continue
        own = slice(w.first, w.last)
        h = word_hashes(w, lower(w))
        same = np.concatenate([[False], (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])])
        doc = w.doc[own]
        words += np.bincount(doc, minlength=n)
        repeats += np.bincount(doc, weights=same[own], minlength=n)
        marked += np.bincount(doc, weights=MARK[w.data[w.end[own] - 1]], minlength=n)
        short += np.bincount(doc, weights=size[own] < 2, minlength=n)
        index = np.concatenate([(h[own] >> np.uint64(51)).astype(np.int64), WORDS + _shapes(w.start[own], size[own], w.data).astype(np.int64)])
        key, count = np.unique(np.concatenate([doc, doc]) * width + index, return_counts=True)
        if len(key) and len(texts[int(doc[0])]) > MOST:
            total = long.setdefault(int(doc[0]), np.zeros(width))
            total[key % width] += count
        else:
            keys.append(key)
            counts.append(count)
    for i, total in long.items():
        at = np.flatnonzero(total)
        keys.append(i * width + at)
        counts.append(total[at])
    key = np.concatenate([*keys, np.empty(0, dtype=np.int64)])
    count = np.concatenate([*counts, np.empty(0)])
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    doc, index = key // width, key % width
    value = np.sqrt(count / np.maximum(words, 1)[doc])  # the squares of a text's words add up to 1, of its shapes too
    return Inputs(doc, index, value, _statistics(texts, stored, words, repeats, marked, short))


def _statistics(texts, stored, words, repeats, marked, short) -> np.ndarray:
    histogram = np.zeros((len(texts), 256))
    lines, distinct = np.zeros(len(texts)), np.zeros(len(texts))
    for i, text in enumerate(texts):
        for at in range(0, len(text), MOST):
            histogram[i] += np.bincount(np.frombuffer(text[at : at + MOST], dtype=np.uint8), minlength=256)
        seen = text.split(b"\n") if text else []
        lines[i], distinct[i] = len(seen), len(set(seen))
    size = histogram.sum(1)
    marks = histogram[:, MARK].sum(1)
    stops = histogram[:, [ord(c) for c in ".,;:?!'\"-"]].sum(1)
    bars = histogram[:, [ord(c) for c in "|<>{}[]=\\/_"]].sum(1)
    letters = histogram[:, 65:91].sum(1) + histogram[:, 97:123].sum(1)
    black = size - histogram[:, SPACE].sum(1)
    control = histogram[:, [*range(9), *range(14, 32), 127]].sum(1)

    def share(part, whole):
        return part / np.maximum(whole, 1)

    characters = size - histogram[:, 128:192].sum(1)
    return np.column_stack([
        np.log1p(size), share(histogram[:, 65:91].sum(1), letters), share(histogram[:, 48:58].sum(1), black), share(histogram[:, 128:].sum(1), black),
        share(marks, black), share(marks - stops, black), share(stops, words), share(bars, words), share(control, size), share(repeats, words),
        share(marked, words), share(short, words), share(black, words), share(size, lines), 1 - share(distinct, lines),
        np.log1p(np.maximum(stored, 0)), stored / np.maximum(characters, 1),
    ])


@dataclass
class Model:
    """Weights and vectors of all inputs, the bins of the statistics behind words and shapes."""

    bias: float
    weights: np.ndarray
    vectors: np.ndarray
    edges: list[np.ndarray]  # of the bins, one array for each statistic

    def entries(self, x: Inputs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, input, value) of all entries, those of the bins among them; ascending by text."""
        n = len(x.stats)
        bins = np.column_stack([
            np.where(np.isnan(column), BINS, np.searchsorted(edge, np.nan_to_num(column), side="right"))
            for column, edge in zip(x.stats.T, self.edges, strict=True)
        ]) + np.arange(len(STATS)) * (BINS + 1) + WORDS + SHAPES
        doc = np.concatenate([x.doc, np.repeat(np.arange(n), len(STATS))])
        order = np.argsort(doc, kind="stable")
        return doc[order], np.concatenate([x.index, bins.ravel()])[order], np.concatenate([x.value, np.full(bins.size, BIN_VALUE)])[order]

    def margins(self, x: Inputs) -> np.ndarray:
        n = len(x.stats)
        if not n:
            return np.empty(0)
        doc, index, value = self.entries(x)
        out = self.bias + np.bincount(doc, weights=value * self.weights[index], minlength=n)
        for v in self.vectors.T:
            part = value * v[index]
            out += (np.bincount(doc, weights=part, minlength=n) ** 2 - np.bincount(doc, weights=part * part, minlength=n)) / 2
        return out

    def scores(self, x: Inputs) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -60, 60)))


N_INPUTS = WORDS + SHAPES + len(STATS) * (BINS + 1)


def constant(share: float) -> Model:
    return Model(float(np.log(share / (1 - share))), np.zeros(N_INPUTS), np.zeros((N_INPUTS, 0)), [np.empty(0)] * len(STATS))


def fit(x: Inputs, label: np.ndarray, share: float) -> Model:
    """A model from the inputs of labelled texts; ``share`` of all labelled rows are good."""
    n = len(label)
    if not n or label.min() == label.max():
        return constant(share)
    edges = []
    for column in x.stats.T:
        known = column[~np.isnan(column)]
        edges.append(np.unique(np.quantile(known, np.arange(1, BINS) / BINS)) if len(known) else np.empty(0))
    random = np.random.default_rng(SEED)
    model = Model(0.0, np.zeros(N_INPUTS), random.normal(0, SPREAD, (N_INPUTS, RANK)), edges)
    doc, index, value = model.entries(x)
    ends = np.searchsorted(doc, np.arange(n + 1))
    both = np.column_stack([model.weights, model.vectors])
    state = [np.zeros_like(both), np.zeros_like(both), 0.0, 0.0]
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = random.permutation(n)
        for start in range(0, n, BATCH):
            rows = order[start : start + BATCH]
            size = ends[rows + 1] - ends[rows]
            at = np.arange(size.sum()) + np.repeat(ends[rows] - (np.cumsum(size) - size), size)
            row, i, v = np.repeat(np.arange(len(rows)), size), index[at], value[at][:, None]
            used, place = np.unique(i, return_inverse=True)
            w = both[used]
            part = v * w[place, 1:]
            begin = np.cumsum(size) - size
            total, square = np.add.reduceat(part, begin), np.add.reduceat(part * part, begin)
            margin = model.bias + np.add.reduceat(v[:, 0] * w[place, 0], begin) + ((total**2 - square) / 2).sum(1)
            error = (1 / (1 + np.exp(-np.clip(margin, -60, 60))) - label[rows]) / len(rows)
            change = np.column_stack([v * error[row][:, None], v * error[row][:, None] * (total[row] - part)])
            g = np.column_stack([np.bincount(place, weights=c, minlength=len(used)) for c in change.T]) + PENALTY * w
            step += 1
            state[0][used] = 0.9 * state[0][used] + 0.1 * g
            state[1][used] = 0.99 * state[1][used] + 0.01 * g * g
            both[used] -= rate * (state[0][used] / (1 - 0.9**step)) / (np.sqrt(state[1][used] / (1 - 0.99**step)) + 1e-8)
            state[2] = 0.9 * state[2] + 0.1 * error.sum()
            state[3] = 0.99 * state[3] + 0.01 * error.sum() ** 2
            model.bias -= rate * (state[2] / (1 - 0.9**step)) / (np.sqrt(state[3] / (1 - 0.99**step)) + 1e-8)
    drawn = label.mean()
    bias = model.bias + np.log(share / (1 - share)) - np.log(drawn / (1 - drawn))
    return Model(float(bias), both[:, 0].copy(), both[:, 1:].copy(), edges)


def fold():
    """Crc32 of the id as text, modulo ``FOLDS``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


def _rows(docs: DataFrame) -> DataFrame:
    stored = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), stored.alias("n_chars"))


def _batch_inputs(batch: pa.RecordBatch) -> Inputs:
    stored = batch.column("n_chars").to_numpy(zero_copy_only=False).astype(np.float64)
    return inputs([x.encode() for x in batch.column("text").to_pylist()], stored)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """A model from the labelled documents outside the held-out fold."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where("doc_id IS NOT NULL AND quality IN (0, 1)").where(fold() != HELD).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    )
    counts = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}  # two rows
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    if not n0 or not n1:
        return constant((n1 + 0.5) / (n0 + n1 + 1))
    drawn = None
    for y in (0, 1):
        some = known.where(F.col("quality") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        drawn = some if drawn is None else drawn.unionByName(some)
    sample = _rows(docs).join(F.broadcast(drawn), "doc_id")  # at most 2 * per_class ids

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            x = _batch_inputs(batch)
            ends = np.searchsorted(x.doc, np.arange(batch.num_rows + 1))
            parts = [slice(a, b) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("quality"), pa.array([x.index[p].astype("<u2").tobytes() for p in parts], pa.binary()),
                pa.array([x.value[p].astype("<f4").tobytes() for p in parts], pa.binary()), pa.array(list(x.stats), pa.list_(pa.float64())),
            ], ["doc_id", "quality", "index", "value", "stats"])

    schema = "doc_id long, quality int, index binary, value binary, stats array<double>"
    # repeated ids could lengthen the sample: one row each
    found = sample.mapInArrow(describe, schema).groupBy("doc_id").agg(F.min(F.struct("quality", "index", "value", "stats")).alias("x"))
    rows = [r.x for r in found.orderBy("doc_id").collect()]  # bounded: 2 * per_class rows of at most WORDS + SHAPES entries
    index = [np.frombuffer(r["index"], "<u2").astype(np.int64) for r in rows]
    x = Inputs(
        np.repeat(np.arange(len(rows)), [len(i) for i in index]), np.concatenate([*index, np.empty(0, np.int64)]),
        np.concatenate([*(np.frombuffer(r.value, "<f4").astype(np.float64) for r in rows), np.empty(0)]),
        np.array([r.stats for r in rows], dtype=np.float64).reshape(-1, len(STATS)),
    )
    return fit(x, np.array([r.quality for r in rows], dtype=np.float64), n1 / (n0 + n1))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of each row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", MOST):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(_batch_inputs(batch)), pa.float64())], ["doc_id", "score"])

    out = _rows(docs).mapInArrow(score, "doc_id long, score double")
    return out.select(
        "doc_id", F.coalesce(fold() == HELD, F.lit(False)).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted")
    )


@query("op13_quality_factorisation")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return scored(docs, train(docs, read(spark, sf_dir, "labels")))
