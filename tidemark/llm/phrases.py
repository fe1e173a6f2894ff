"""Collocations: the phrases of 2 to 5 words that hold together best, per language.

Texts (A-Z lower-cased) fall at ``. , ; : ! ?`` and line ends into pieces, pieces at blanks and tabs into words. With
``n`` words in a language and ``f`` the occurrences of a phrase inside pieces (overlaps count), a candidate has
``a = f >= least``. Cut after its first k words into parts with ``l`` and ``r`` occurrences its score is
``floor(1000 a n / (l r))``; the cut with the lowest score counts, the smallest k among equals. A candidate with a longer
candidate around it that occurs as often is dropped. The first ``top`` of each language are returned.

Best-first growth. The frontier holds the frequent words of each language; every phrase that begins with word w scores
at most ``floor(1000 n / f(w))``, as the part after w occurs at least as often as the whole. Words are taken up in
the order of that bound, in bands: first those that hold an eighth of the occurrences of frequent words, then half,
then the rest, but only words whose bound reaches the ``top``-th surviving score so far. When the best bound left is
below it, ties included, the language is settled and its other words are never grown. A band costs three passes:

1. pairs: one more word behind each word of the band;
2. growth: prefixes of 3 to 5 words behind pairs that are frequent;
3. settling: exact counts of the parts after a cut, which may begin with words never grown, and whether all occurrences
   of a phrase have the same neighbour on one side. A longer candidate that occurs as often exists exactly if they have,
   as a phrase of one word more lies between both. Phrases whose last cut already scores too little stay out.

A pass tells wanted phrases by a bit table of bounded size (``Sieve``): it never misses one, and what it lets through
besides is counted exactly, too, and dropped by the count. Counts are summed by the phrase itself, first in the task, so
frequent phrases reach the shuffle once per task and no hash decides a result but one: neighbours are compared by 64 bits.

Defined results: null texts are empty, a null language is ``und``; ids play no part, repeated rows count each time; no
rows or no candidates give no rows; other columns play no part. Texts of any length are read in windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_bytes, materialise, read
from .registry import query
from .windows import Window, lower, windows, word_hashes
from .words import mixed

LONGEST, LEAST, TOP = 5, 100, 2000
SHARES = (1 / 8, 1 / 2, 1.0)  # of the occurrences of frequent words that the bands reach
SALTS = 64
BITS_PER_PHRASE, MOST_BITS, PROBES = 16, 27, 3

BREAK = np.zeros(256, dtype=bool)
BREAK[[ord(c) for c in ".,;:!?"]] = BREAK[0x0A:0x0E] = True
WORD = ~BREAK
WORD[[0x20, 0x09]] = False
STEP = np.uint64(0xD6E8FEB86659FD93)


class Runs:
    """Hashes of the runs of words of a window; those of different languages differ."""

    def __init__(self, w: Window, seeds: np.ndarray):
        self.window, self.low = w, lower(w)
        self.piece = np.cumsum(BREAK[w.data], dtype=np.int32)[w.start]
        with np.errstate(over="ignore"):
            self.word = mixed(word_hashes(w, self.low) ^ seeds[w.doc])
        self.of = {1: self.word}

    def hash(self, k: int) -> np.ndarray:
        """Of the run of ``k`` words from each word on."""
        if k not in self.of:
            shorter = self.hash(k - 1)
            with np.errstate(over="ignore"):
                self.of[k] = mixed(shorter[:-1] * STEP + self.word[k - 1 :], k) if len(shorter) else shorter
        return self.of[k]

    def whole(self, k: int) -> np.ndarray:
        """Which runs of ``k`` words are owned by the window and lie in one piece."""
        n = max(len(self.word) - k + 1, 0)
        return self.window.own[:n] & (self.piece[:n] == self.piece[k - 1 : n + k - 1])

    def spelled(self, at: np.ndarray, k: int) -> pa.Array:
        """The runs of ``k`` words from ``at`` on, joined by one space."""
        word = (at[:, None] + np.arange(k)).ravel()
        start, size = self.window.start[word], (self.window.end - self.window.start)[word]
        to = np.concatenate([[0], np.cumsum(size + 1)])  # a space after each word
        out = np.full(int(to[-1]), 0x20, dtype=np.uint8)
        place = np.arange(int(size.sum()))
        before = np.cumsum(size) - size
        out[place + np.repeat(to[:-1] - before, size)] = self.low[place + np.repeat(start - before, size)]
        keep = np.ones(len(out), dtype=bool)
        ends = to[k::k]
        keep[ends - 1] = False  # but none after the last
        offsets = np.concatenate([[0], ends - np.arange(1, len(at) + 1)]).astype(np.int32)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(out[keep])))


@dataclass
class Sieve:
    """A table of bits that holds all phrases put into it, and lets few others through."""

    bits: np.ndarray

    @staticmethod
    def places(h: np.ndarray, size: int, i: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (h + np.uint64(i) * ((h >> np.uint64(31)) | np.uint64(1))) & np.uint64(64 * size - 1)

    def holds(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), dtype=bool)
        for i in range(PROBES):
            at = self.places(h, len(self.bits), i)
            out &= (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def _languages(batch: pa.RecordBatch) -> tuple[np.ndarray, list[str]]:
    names = batch.column("lang").to_pylist()
    seed = {x: np.frombuffer(hashlib.blake2b(x.encode(), digest_size=8).digest(), "<u8")[0] for x in set(names)}
    return np.array([seed[x] for x in names], dtype=np.uint64), names


def _texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return [x.encode() for x in batch.column(column).to_pylist()]


def sieve(phrases: DataFrame, count: int) -> Sieve:
    """A sieve of ``phrases`` (``lang``, ``phrase``), some ``count`` rows; at most 2^MOST_BITS bits reach the driver."""
    size = 1 << min(max(BITS_PER_PHRASE * count, 1 << 16).bit_length(), MOST_BITS) - 6

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "phrase"):
            if not batch.num_rows:
                continue
            seeds, _ = _languages(batch)
            runs = Runs(next(windows(_texts(batch, "phrase"), WORD, 0, 0, 1 << 62)), seeds)
            doc = runs.window.doc
            length = np.bincount(doc, minlength=batch.num_rows)
            first = np.cumsum(length) - length
            places = np.concatenate([
                Sieve.places(runs.hash(k)[first[length == k]], size, i) for k in range(1, LONGEST + 1) for i in range(PROBES)
            ])
            places.sort()
            slot, at = np.unique(places >> np.uint64(6), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (places & np.uint64(63)), at)
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(bits.view(np.int64))], ["slot", "bits"])

    rows = phrases.select("lang", "phrase").mapInArrow(placed, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size, dtype=np.uint64)
    out[rows["slot"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return Sieve(out)


Choice = Callable[[Runs], Iterator[tuple[int, np.ndarray]]]


def counted(texts: DataFrame, choose: Choice, total: bool = False) -> DataFrame:
    """``lang``, ``phrase``, ``n`` of the runs that ``choose`` names by length and first word.

    With ``total`` a row with an empty phrase holds the number of words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            seeds, names = _languages(batch)
            names = pa.array(names, pa.string())
            for w in windows(_texts(batch, "text"), WORD, 0, LONGEST - 1):
                runs = Runs(w, seeds)
                for k, at in choose(runs):
                    if len(at):
                        _, first, n = np.unique(runs.hash(k)[at], return_index=True, return_counts=True)
                        at = at[first]
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(w.doc[at])), runs.spelled(at, k), pa.array(n)], ["lang", "phrase", "n"])
                if total and w.last > w.first:
                    docs, n = np.unique(w.doc[w.first : w.last], return_counts=True)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(docs)), pa.array([""] * len(docs)), pa.array(n)], ["lang", "phrase", "n"])

    return texts.mapInArrow(count, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def settled(texts: DataFrame, wanted: Sieve) -> DataFrame:
    """``lang``, ``phrase``, ``n`` and ``closed`` of the runs of 2 to ``LONGEST`` words in ``wanted``.

    ``closed``: all occurrences have the same word before them, or all have the same word behind them.
    """
    least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    columns = ["lang", "phrase", "n", "l0", "l1", "r0", "r1"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            seeds, names = _languages(batch)
            names = pa.array(names, pa.string())
            for w in windows(_texts(batch, "text"), WORD, 1, LONGEST):
                runs = Runs(w, seeds)
                word, piece, n = runs.word.view(np.int64), runs.piece, len(runs.word)
                for k in range(2, LONGEST + 1):
                    at = np.flatnonzero(runs.whole(k))
                    at = at[wanted.holds(runs.hash(k)[at])]
                    if not len(at):
                        continue
                    left, right = np.maximum(at - 1, 0), np.minimum(at + k, n - 1)
                    has_left = (at > 0) & (piece[left] == piece[at])
                    has_right = (at + k < n) & (piece[right] == piece[at])
                    h = runs.hash(k)[at]
                    order = np.argsort(h, kind="stable")
                    first = np.flatnonzero(np.concatenate([[True], np.diff(h[order].view(np.int64)) != 0]))
                    sides = []
                    for neighbour, has in ((left, has_left), (right, has_right)):
                        # without a neighbour at one place the least and the greatest differ
                        sides.append(np.minimum.reduceat(np.where(has, word[neighbour], least)[order], first))
                        sides.append(np.maximum.reduceat(np.where(has, word[neighbour], most)[order], first))
                    at = at[order][first]
                    counts = np.diff(np.append(first, len(order)))
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(w.doc[at])), runs.spelled(at, k), *map(pa.array, (counts, *sides))], columns)

    rows = texts.mapInArrow(look, "lang string, phrase string, " + ", ".join(f"{c} long" for c in columns[2:]))
    return rows.groupBy("lang", "phrase").agg(
        F.sum("n").alias("n"), ((F.min("l0") == F.max("l1")) | (F.min("r0") == F.max("r1"))).alias("closed")
    )


def ratio(a: str, n: str, first: str, rest: str) -> Column:
    """``floor(1000 a n / (first rest))`` without a loss."""
    wide = "cast({} as decimal({}, 0))".format
    return F.expr(f"({wide(1000, 4)} * {wide(a, 16)} * {wide(n, 17)}) div ({wide(first, 19)} * {wide(rest, 19)})")


def _part(words: str, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def _best(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language with their ``rank``; a language is first thinned in ``SALTS`` parts."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = salted.withColumn("_at", F.row_number().over(W.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_at") <= top)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).drop("_salt", "_at")


COLUMNS = ["lang", "phrase", "a", "l", "r", "n", "score"]


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score`` of the best phrases of ``docs`` (``text``, ``lang``)."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))

    def every(runs: Runs):
        yield 1, np.flatnonzero(runs.window.own)

    seen = materialise(counted(texts, every, total=True).where((F.col("n") >= least) | (F.col("phrase") == "")), "words")
    totals = seen.where("phrase = ''").select("lang", F.col("n").alias("total"))
    # bands of words by powers of two of their count: the rarest have the best bound
    frontier = materialise(
        seen.where("phrase <> ''").join(totals, "lang").select("lang", "phrase", "n", "total")
        .withColumn("bound", ratio("1", "total", "n", "1")).withColumn("band", F.floor(F.log2("n")).cast("int")), "frontier"
    )
    n_words = frontier.count()
    schema = "lang string, phrase string, a long, l long, r long, n long, score long, rank long"
    best = spark.createDataFrame([], schema)
    if not n_words:
        return best.select("lang", "rank", *COLUMNS[1:])
    known = sieve(frontier, n_words)
    sums = frontier.groupBy("lang", "band").agg(F.sum("n").alias("n"))
    upward = W.partitionBy("lang").orderBy("band")
    part = F.sum("n").over(upward) / F.sum("n").over(W.partitionBy("lang"))
    step = F.when(F.row_number().over(upward) == 1, 0)  # at least one band at first
    for i, share in enumerate(SHARES):
        step = step.when(part <= share + 1e-9, i)
    steps = materialise(sums.select("lang", "band", step.alias("step")), "bands")
    settled_score = spark.createDataFrame([], "lang string, least long")
    for i in range(len(SHARES)):
        band = materialise(
            frontier.join(steps.where(F.col("step") == i), ["lang", "band"])
            .join(settled_score, "lang", "left").where("least IS NULL OR bound >= least")
            .select("lang", "phrase", "n", "total", "least"), "band"
        )
        n_band = band.count()
        if n_band:
            found = _grown(texts, frontier, known, band, n_band, least)
            best = materialise(_best(best.drop("rank").unionByName(found), top), "best")
            settled_score = best.groupBy("lang").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= top).select("lang", "least")
    return best.select("lang", "rank", *COLUMNS[1:])


def _grown(texts: DataFrame, frontier: DataFrame, known: Sieve, band: DataFrame, n_band: int, least: int) -> DataFrame:
    """The surviving phrases that begin with the words of ``band`` and may reach its ``least`` score, with their scores."""
    taken = sieve(band, n_band)

    def pairs(runs: Runs):
        at = np.flatnonzero(runs.whole(2))
        at = at[taken.holds(runs.word[at])]
        yield 2, at[known.holds(runs.word[at + 1])]

    def of_band(found: DataFrame) -> DataFrame:
        """A word or pair may pass its sieve unasked; its phrases belong to another band."""
        heads = band.select("lang", F.col("phrase").alias("_head"))
        head = F.substring_index("phrase", " ", 1).alias("_head")
        return found.where(F.col("n") >= least).select("lang", "phrase", "n", head).join(heads, ["lang", "_head"], "left_semi").drop("_head")

    two = materialise(of_band(counted(texts, pairs)), "pairs")
    frequent = sieve(two, two.count())

    def longer(runs: Runs):
        at = np.flatnonzero(runs.whole(2))
        at = at[frequent.holds(runs.hash(2)[at])]
        for k in range(3, LONGEST + 1):
            at = at[at + k <= len(runs.word)]
            at = at[runs.piece[at] == runs.piece[at + k - 1]]
            at = at[known.holds(runs.word[at + k - 1])]
            yield k, at

    grams = materialise(two.unionByName(of_band(counted(texts, longer))), "grams")
    prefixes = frontier.select("lang", "phrase", "n").unionByName(grams).select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    of_lang = band.groupBy("lang").agg(F.first("total").alias("n"), F.first("least").alias("least"))  # one value in a language
    phrase = (
        grams.select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ", -1).alias("w")).join(of_lang, "lang")
        .withColumn("size", F.size("w"))
    )
    # the last cut is known already: a first word for all others
    last = (
        phrase.withColumn("first", _part("w", F.lit(1), F.col("size") - 1)).withColumn("_last", F.element_at("w", -1))
        .join(prefixes, ["lang", "first"])
        .join(frontier.select("lang", F.col("phrase").alias("_last"), F.col("n").alias("r")), ["lang", "_last"])
        .withColumn("score", ratio("a", "n", "l", "r"))
        .where("least IS NULL OR score >= least").select("lang", "phrase", "w", "size", "a", "n")
    )
    hopeful = materialise(last, "hopeful")
    rests = hopeful.where("size > 2").select("lang", F.explode(F.transform(
        F.sequence(F.lit(2), F.col("size") - 1), lambda k: _part("w", k, F.col("size") - k + 1))).alias("phrase"))
    wanted = materialise(hopeful.select("lang", "phrase").unionByName(rests).distinct(), "wanted")
    exact = materialise(settled(texts, sieve(wanted, wanted.count())).where(F.col("n") >= least), "settled")
    alive = hopeful.join(exact.where("closed").select("lang", "phrase").withColumn("size", F.size(F.split("phrase", " ", -1))).where(F.col("size") < LONGEST).drop("size"), ["lang", "phrase"], "left_anti")
    suffixes = frontier.select("lang", "phrase", "n").unionByName(exact.select("lang", "phrase", "n")).select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    cuts = (
        alive.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
        .withColumn("first", _part("w", F.lit(1), F.col("k"))).withColumn("rest", _part("w", F.col("k") + 1, F.col("size") - F.col("k")))
        .join(prefixes, ["lang", "first"]).join(suffixes, ["lang", "rest"]).withColumn("score", ratio("a", "n", "l", "r"))
    )
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("cut"))
    return lowest.select("lang", "phrase", *[f"cut.{c}" for c in COLUMNS[2:]])


LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: All phrases are counted; a longer phrase that occurs as often has one of one word more within it.
SQL = rf"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, list_filter(string_split_regex(x, '[ \t]+'), lambda w: w <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(coalesce({LOWER_SQL}, ''), '[.,;:!?\n\x0b\x0c\r]')) AS x FROM documents)),
totals AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY 1),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces WHERE len(w) > 0),
runs AS (SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase
         FROM spots, (SELECT unnest([1, 2, 3, 4, 5]) AS size) WHERE i + size - 1 <= len(w)),
f AS (SELECT lang, size, phrase, count(*) AS n FROM runs GROUP BY 1, 2, 3 HAVING count(*) >= {LEAST}),
inner_of AS (
  SELECT lang, n, unnest([array_to_string(string_split(phrase, ' ')[2:], ' '), array_to_string(string_split(phrase, ' ')[:size - 1], ' ')]) AS phrase
  FROM f WHERE size > 2),
alive AS (SELECT * FROM f WHERE size > 1 AND NOT EXISTS (
  SELECT 1 FROM inner_of o WHERE o.lang = f.lang AND o.phrase = f.phrase AND o.n = f.n)),
cuts AS (
  SELECT lang, phrase, n AS a, k, array_to_string(string_split(phrase, ' ')[:k], ' ') AS first,
         array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM alive)),
scored AS (
  SELECT c.lang, c.phrase, c.a, l.n AS l, r.n AS r, t.n, k,
         (1000 * c.a::HUGEINT * t.n::HUGEINT) // (l.n::HUGEINT * r.n::HUGEINT) AS score
  FROM cuts c JOIN totals t USING (lang) JOIN f l ON l.lang = c.lang AND l.phrase = c.first JOIN f r ON r.lang = c.lang AND r.phrase = c.rest),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest) WHERE rank <= {TOP}
"""


@query("op11_phrase_collocations", SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))
