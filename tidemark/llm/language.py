"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation.

Tokens are words and one end per text. The model predicts a token from the one before it (the end
stands before the first): ``p(w | v) = exp(q_v . r_w + b_w) / Z_v`` over the frequent words, the
end, and ``ENDINGS`` groups of all other words, told apart by their last bytes. The number of frequent words
grows with the square root of the training tokens (``own_rows``), so that their ``Z_v``, each a sum over all
rows, cost a constant per token. ``Z_v`` is summed over all rows by matrix products in Spark, so probabilities are normalised. A word of a group has its
share of the group's add-one counts, where one more count stands for all unseen words.

Training counts all neighbouring pairs of the training texts in Spark. Tasks then take the counted
pairs in matrix products: pairs against shared noise words drawn from the words' own frequencies, with
the noise-contrastive loss. A pair weighs as much as its count; frequent ones are cut into parts for several
products (``dealt``). In each of ``ROUNDS`` all tasks start from the same parameters, and Spark
averages theirs, weighted by their counts. Biases start at the log frequencies.

Memory: the model has ``own_rows`` + ``ENDINGS`` + 1 rows of 200 bytes, 30 MB for 5 billion tokens; counts of the
``KNOWN`` most frequent words, or of those with own rows if they are more, are sent to the tasks (16 bytes each); counts of all other words stay in Spark and are joined. Words
are named by 64-bit hashes.

Defined results: null and empty texts are the end alone. A null ``doc_id`` isn't held out and doesn't
train. Without training texts every count is 0 and the model is uniform over what it has. Rows with
equal ids are scored one by one; no rows give no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, documents, materialise, read
from .registry import query
from .words import Words, mixed

#: Least number of words with own rows, own rows per square root of the training tokens.
FREQUENT, GROWTH = 4096, 2.0
ENDINGS, KNOWN, DIMENSIONS = 256, 1 << 17, 24
FOLDS, HELD_OUT = 7, 2
#: Passes over the counted pairs, pairs and noise words in a product, noise words per pair in the loss, step size.
ROUNDS, PAIRS, NOISE, RATIO, STEP = 2, 4096, 512, 20.0, 0.1
#: Mean counts that one row of a pair holds at most.
HEAVY = 4.0
#: Bytes of text whose words a task holds as arrays at a time, and tokens in a matrix product.
SLICE, TOKENS = 1 << 20, 1 << 15


def own_rows(tokens: int) -> int:
    """How many words have rows of their own after ``tokens`` training tokens."""
    return max(FREQUENT, int(GROWTH * tokens**0.5))


def _endings(words: Words, at: np.ndarray) -> np.ndarray:
    """The group of each word by its last two bytes."""
    last = words.data[words.end[at] - 1].astype(np.uint64)
    before = np.where(words.end[at] - words.start[at] > 1, words.data[np.maximum(words.end[at] - 2, 0)], 0).astype(np.uint64)
    return (mixed(last * np.uint64(256) + before, 21) % np.uint64(ENDINGS)).astype(np.int64)


class Lexicon:
    """Counts of the known words, sorted by hash; ``model`` is a word's number in the model or -1, ``frequent`` the number of
    words with own rows."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, model: np.ndarray, frequent: int):
        self.hashes, self.counts, self.model, self.frequent = hashes, counts, model, frequent

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 if it isn't known."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def tokens(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, token number in the model, place in the lexicon or -1, hash) of all tokens in order, the end of each text last.

        Numbers: frequent words, then ENDINGS groups, then the end.
        """
        words = Words(texts)
        place = self.find(words.hash)
        number = np.where(place >= 0, self.model[np.maximum(place, 0)] if len(self.model) else -1, -1)
        rare = np.flatnonzero(number < 0)
        number[rare] = self.frequent + _endings(words, rare)
        ends = words.first[1:]
        n = len(texts)
        return (
            np.insert(words.doc, ends, np.arange(n)), np.insert(number, ends, self.frequent + ENDINGS),
            np.insert(place, ends, -2), np.insert(words.hash, ends, np.uint64(0)),
        )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts of each slice; the group of a word comes along."""
    for batch in by_bytes(batches, "text", SLICE):
        words = Words([x.encode() for x in batch.column("text").to_pylist()])
        hashes, first, counts = np.unique(words.hash, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(hashes.view(np.int64)), pa.array(counts.astype(np.int64)), pa.array(_endings(words, first).astype(np.int32))], ["word", "n", "ending"]
        )


def _pairs(lexicon: Lexicon):
    end, size = lexicon.frequent + ENDINGS, lexicon.frequent + ENDINGS + 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SLICE):
            _, number, _, _ = lexicon.tokens([x.encode() for x in batch.column("text").to_pylist()])
            before = np.concatenate([[end], number[:-1]])  # an end stands before the next text too
            pairs, counts = np.unique(before * size + number, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts.astype(np.int64))], ["pair", "n"])

    return rows


@dataclass
class Model:
    q: np.ndarray
    r: np.ndarray
    b: np.ndarray

    def normalisers(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """log Z of every context, or of those from ``first`` to before ``last``."""
        q, r = self.q[first:last], self.r.T.astype(np.float64)
        out, rows = np.empty(len(q)), max(1, (1 << 21) // len(self.r))
        for i in range(0, len(q), rows):
            z = q[i : i + rows].astype(np.float64) @ r + self.b
            top = z.max(axis=1)
            out[i : i + rows] = top + np.log(np.exp(z - top[:, None]).sum(axis=1))
        return out

    def flat(self) -> np.ndarray:
        return np.concatenate([self.q, self.r, self.b[:, None]], axis=1).astype(np.float32)

    @classmethod
    def of(cls, flat: np.ndarray) -> Model:
        return cls(flat[:, :DIMENSIONS], flat[:, DIMENSIONS : 2 * DIMENSIONS], flat[:, -1])


def descend(model: Model, context: np.ndarray, word: np.ndarray, weights: np.ndarray, noise: np.ndarray, rng: np.random.Generator) -> None:
    """One pass over weighted pairs with the noise-contrastive loss and Adagrad steps, in single precision as the parameters."""
    q, r, b = model.q, model.r, model.b
    gq, gr, gb = (np.full(len(q), 1e-3, np.float32) for _ in range(3))
    step, cumulated, log_noise = STEP, np.cumsum(noise), np.log(noise * RATIO).astype(np.float32)
    order = rng.permutation(len(context))
    room = np.empty((min(PAIRS, len(order)), NOISE), np.float32)  # of every product in turn
    for i in range(0, len(order), PAIRS):
        at = order[i : i + PAIRS]
        c, w, n = context[at], word[at], weights[at].astype(np.float32)
        k = np.minimum(np.searchsorted(cumulated, rng.random(NOISE) * cumulated[-1]), len(noise) - 1)
        x, rw, rk = q[c], r[w], r[k]
        true = (x * rw).sum(1) + b[w] - log_noise[w]
        up = n / (1 + np.exp(np.clip(true, -30, 30)))
        down = np.matmul(x, rk.T, out=room[: len(at)])
        down += b[k] - log_noise[k]
        np.clip(down, -30, 30, out=down)
        np.negative(down, out=down)
        np.exp(down, out=down)
        down += 1
        np.divide(-(n[:, None] * np.float32(RATIO / NOISE)), down, out=down)
        dx = up[:, None] * rw + down @ rk
        dw, dk = up[:, None] * x, down.T @ x
        for table, grown, rows, grad in ((q, gq, c, dx), (r, gr, np.concatenate([w, k]), np.concatenate([dw, dk]))):
            ids, place = np.unique(rows, return_inverse=True)
            total = np.zeros((len(ids), DIMENSIONS), np.float32)
            np.add.at(total, place, grad)
            total /= len(at) ** 0.5
            grown[ids] += (total * total).mean(1)
            table[ids] += step * total / np.sqrt(grown[ids])[:, None]
        db = np.bincount(w, weights=up, minlength=len(b)) + np.bincount(k, weights=down.sum(0), minlength=len(b))
        db /= len(at) ** 0.5
        gb += db * db
        b += (step * db / np.sqrt(gb)).astype(np.float32)


def dealt(pairs: DataFrame) -> DataFrame:
    """``pairs`` (``pair``, ``n``) as rows (``pair``, ``part``, ``weight``) whose weights are the counts over the mean count.

    A pair of more than ``HEAVY`` mean counts is cut into equal parts, which are dealt to different tasks and products: no
    row outweighs a product, and there is one row more for every ``HEAVY`` pairs at most.
    """
    mean = pairs.agg(F.avg("n")).first()[0] or 1.0
    parts = F.ceil(F.col("n") / (HEAVY * mean)).cast("long")
    rows = pairs.withColumn("parts", parts).select("pair", (F.col("n") / mean / F.col("parts")).alias("weight"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    return rows.repartition("pair", "part")


def train(spark: SparkSession, pairs: DataFrame, frequency: np.ndarray) -> Model:
    """Parameters after ``ROUNDS`` of averaged passes over ``pairs`` (``pair``, ``n``)."""
    pairs = materialise(dealt(pairs), "dealt_pairs")
    size = len(frequency)
    rng = np.random.default_rng(11)
    share = (frequency + 0.5) / (frequency + 0.5).sum()
    model = Model(*(rng.normal(0, 0.1, (size, DIMENSIONS)).astype(np.float32) for _ in range(2)), np.log(share).astype(np.float32))

    def passes(flat: np.ndarray, turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, seen = Model.of(flat.copy()), 0.0
            own = Model(own.q.copy(), own.r.copy(), own.b.copy())
            draw = np.random.default_rng([turn, TaskContext.get().partitionId()])
            for batch in batches:
                code, weight = batch.column("pair").to_numpy(), batch.column("weight").to_numpy()
                if len(code):
                    descend(own, code // size, code % size, weight, share, draw)
                    seen += float(weight.sum())
            if seen:
                out = own.flat() * np.float32(seen)
                yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([seen] * size), pa.array(list(out), pa.list_(pa.float32()))], ["row", "n", "values"])

        return run

    width = 2 * DIMENSIONS + 1
    for turn in range(ROUNDS):
        # each row of the parameters is summed on its own: a row per task and parameter row meets in Spark
        got = pairs.mapInArrow(passes(model.flat(), turn), "row int, n double, values array<float>")
        sums = got.groupBy("row").agg(F.sum("n").alias("n"), *[F.sum(F.col("values")[i].cast("double")).alias(f"v{i}") for i in range(width)])
        rows = sums.orderBy("row").toArrow()  # as many rows as the model has
        if rows.num_rows:
            n = rows.column("n").to_numpy()
            model = Model.of(np.stack([rows.column(f"v{i}").to_numpy() / n for i in range(width)], axis=1).astype(np.float32))
    return model


def normalisers(spark: SparkSession, model: Model) -> np.ndarray:
    """log Z of every context, ranges of contexts in tasks."""
    size, step = len(model.q), 2048

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in batch.column("id").to_pylist():
                z = model.normalisers(first, first + step)
                yield pa.RecordBatch.from_arrays([pa.array(range(first, first + len(z)), pa.int64()), pa.array(z)], ["row", "z"])

    ranges = spark.range(0, size, step, -(-size // step))
    return ranges.mapInArrow(run, "row long, z double").orderBy("row").toArrow().column("z").to_numpy()  # one number per row of the model


def scored(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of each row."""
    spark = docs.sparkSession
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    rows = documents(docs).withColumn("held_out", F.coalesce(fold == HELD_OUT, F.lit(False)))
    training = rows.where("NOT held_out AND doc_id IS NOT NULL").select("text")
    words = training.mapInArrow(_counted, "word long, n long, ending int").groupBy("word").agg(F.sum("n").alias("n"), F.first("ending").alias("ending"))
    words = materialise(words, "word_counts")
    texts = training.count()
    per_group = words.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()  # ENDINGS rows
    n_all = int(sum(r.n for r in per_group)) + texts  # words and ends
    v_all = int(sum(r.v for r in per_group)) + (1 if texts else 0)
    frequent = own_rows(n_all)
    top = words.orderBy(F.desc("n"), "word").limit(max(KNOWN, frequent)).toArrow()  # bounded: KNOWN rows, or those of the model
    hashes = top.column("word").to_numpy().view(np.uint64)
    counts = top.column("n").to_numpy()
    model_of = np.where(np.arange(len(counts)) < frequent, np.arange(len(counts)), -1)
    order = np.argsort(hashes)
    lexicon = Lexicon(hashes[order], counts[order], model_of[order], frequent)
    group_n, group_v = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in per_group:
        group_n[r.ending], group_v[r.ending] = r.n, r.v
    endings = top.column("ending").to_numpy()[:frequent]
    group_n -= np.bincount(endings, weights=counts[:frequent], minlength=ENDINGS)
    group_v -= np.bincount(endings, minlength=ENDINGS)
    frequency = np.concatenate([np.pad(counts[:frequent].astype(float), (0, max(0, frequent - len(counts)))), np.maximum(group_n, 0), [texts]])
    pairs = materialise(training.mapInArrow(_pairs(lexicon), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair_counts")
    model = train(spark, pairs, frequency) if texts else Model(*(np.zeros((len(frequency), DIMENSIONS), np.float32) for _ in range(2)), np.zeros(len(frequency), np.float32))
    normal = normalisers(spark, model)
    group_total = group_n + group_v + 1
    end = frequent + ENDINGS
    below = float(np.log10(n_all + v_all + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SLICE):
            texts_ = [x.encode() for x in batch.column("text").to_pylist()]
            doc, number, place, hash_ = lexicon.tokens(texts_)
            before = np.concatenate([[end], number[:-1]])
            logp = np.empty(len(number))
            for i in range(0, len(number), TOKENS):
                s = slice(i, i + TOKENS)
                logp[s] = np.einsum("ij,ij->i", model.q[before[s]], model.r[number[s]]) + model.b[number[s]] - normal[before[s]]
            logp /= np.log(10)
            rare = (number >= frequent) & (number < end)
            logp[rare] -= np.log10(group_total[number[rare] - frequent])  # the word's own count follows below or in the join
            count = np.where(place >= 0, lexicon.counts[np.maximum(place, 0)] if len(lexicon.counts) else 0, np.where(place == -2, texts, 0)).astype(np.int64)
            logp[rare & (place >= 0)] += np.log10(count[rare & (place >= 0)] + 1)
            settled = place != -1
            base = np.where(settled, np.log10(count + 1), 0.0) - below
            n = len(texts_)
            sums = [np.bincount(doc, weights=v, minlength=n) for v in (np.ones(len(doc)), settled & (count > 0), base, logp)]
            open_ = np.flatnonzero(~settled)
            # one row per text, and one per word of it that isn't known here
            unknown = doc[open_]
            name = hash_[open_]
            sort = np.lexsort((name, unknown))
            unknown, name = unknown[sort], name[sort]
            new = np.flatnonzero(np.concatenate([[True], (unknown[1:] != unknown[:-1]) | (name[1:] != name[:-1])])) if len(unknown) else np.zeros(0, np.int64)
            times = np.diff(np.append(new, len(unknown)))
            firsts = np.searchsorted(unknown[new], np.arange(n + 1))
            names = name[new].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(sums[2]), pa.array(sums[3]),
                 pa.array([names[firsts[i] : firsts[i + 1]] for i in range(n)], pa.list_(pa.int64())), pa.array([times[firsts[i] : firsts[i + 1]] for i in range(n)], pa.list_(pa.int64()))],
                ["doc_id", "held_out", "n_tokens", "n_known", "base", "logp", "words", "times"],
            )

    spec = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, logp double, words array<long>, times array<long>"
    first = materialise(rows.mapInArrow(score, spec).withColumn("row", F.monotonically_increasing_id()), "scored")
    open_words = first.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    seldom = words.select("word", "n")
    joined = open_words.join(seldom, "word")  # words that training never saw add log10(0 + 1) = 0
    added = joined.groupBy("row").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"))
    out = first.join(added, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("logp") + more).alias("score"),
    )


@query("op6_log_bilinear")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(read(spark, sf_dir, "documents"))
