"""Repeated passages by distributed prefix doubling over anchored positions.

Wanted: the bytes covered by a string of ``length`` bytes that also starts elsewhere. Plain doubling
sorts a (position, rank) pair for every byte, several times the input in every round. Here the pairs
are those of *anchors*, and one pair stands for a range of string starts:

* The anchor of a start ``p`` is the leftmost ``GRAM``-byte window of least hash in its string.
  Equal strings have their anchors at the same offset, so only strings with equal anchors can be
  equal, and every start has just one anchor.
* A row is an anchor ``x`` with a range of offsets ``[lo, hi]`` and stands for the starts ``x - hi`` to
  ``x - lo``. Its *core* is what all their strings share, ``[x - lo, x - hi + length)``; its *hull* is what
  they cover together, ``[x - hi, x - lo + length)``.
* Each round gives equal cores and equal hulls equal ranks and sorts the pairs by them. A core that is
  unique settles the row: none of its strings repeats. A hull that is not settles it too: all of them
  do. What is left goes on with ranges of an eighth, that is with longer cores, until a range is one
  start, its core the whole string and past the threshold. Ranges are the same for all anchors, so
  equal strings always meet. Rows with one hull go on as one.

Ranks are named by 64 bits each of a cryptographic hash of core and hull; strings are held equal only
if both agree, 128 bits.

Passages in words: ``drop_repeats`` also takes out runs of ``WORDS`` words that start elsewhere too, which in most texts
are shorter than ``length`` bytes. A text is then the 64-bit hashes of its words side by side and goes through the same rounds,
with words for bytes: positions, offsets and lengths count *units* of ``unit`` bytes, 1 or ``CODE``.

Defined results: null texts are empty; texts below ``length`` bytes lose nothing; equal rows count as
repeats of each other; a null ``doc_id`` stays null; no rows give no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, by_bytes, documents, materialise, read
from .registry import query
from .words import Words, mixed, powers, prefix_hashes

LENGTH, GRAM, FAN = 400, 50, 8
#: Words of a passage ("over 50"), those of an anchor's window, bytes of a word's hash.
WORDS, GRAM_WORDS, CODE = 51, 10, 8
#: Bytes of text whose words are hashed together.
SLICE = 1 << 20
#: Units of a text that are searched for anchors at a time.
CHUNK = 4 << 20


def widths(length: int, gram: int, fan: int = FAN) -> list[int]:
    """Sizes of the ranges in each round: all offsets, then an eighth each, down to one."""
    out = [length - gram + 1]
    while out[-1] > 1:
        out.append(-(-out[-1] // fan))
    return out


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, first start, last start) for every run of starts with one anchor, chunk by chunk."""
    n, span = len(data), length - gram + 1
    held = None  # the run at a chunk's end may go on in the next one
    for begin in range(0, n - length + 1, CHUNK):
        part = data[begin : begin + CHUNK + length - 1]
        sums = prefix_hashes(part)
        with np.errstate(over="ignore"):
            grams = mixed((sums[gram:] - sums[:-gram]) * powers(len(part) + 1)[1][: len(part) - gram + 1])
        m = len(grams)
        # hash above, position below: the least is the leftmost of the least hash
        keyed = (grams & ~np.uint64((1 << 23) - 1)) | np.arange(m, dtype=np.uint64)
        rows = -(-m // span)
        padded = np.full(rows * span, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[:m] = keyed
        square = padded.reshape(rows, span)
        ahead = np.minimum.accumulate(square, axis=1).reshape(-1)
        behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        starts = m - span + 1
        least = np.minimum(behind[:starts], ahead[span - 1 : span - 1 + starts])
        at = (least & np.uint64((1 << 23) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        last = np.append(first[1:], starts) - 1
        runs = np.stack([at[first], first, last]) + begin
        if held is not None:
            if held[0, 0] == runs[0, 0]:
                runs[1, 0] = held[1, 0]
            else:
                yield tuple(held)
        yield tuple(runs[:, :-1])
        held = runs[:, -1:]
    if held is not None:
        yield tuple(held)


def range_of(sizes: list[int], k: int, offset: int) -> tuple[int, int]:
    """The range of round ``k`` that holds ``offset``: its first one, and the one after its last."""
    begin, end = 0, sizes[0]
    for size in sizes[1 : k + 1]:
        begin += (offset - begin) // size * size
        end = min(begin + size, end)
    return begin, end


def _name(piece: bytes, offset: int) -> int:
    """Rank name of a core; cores of other ranges of offsets get other names."""
    return int.from_bytes(hashlib.blake2b(piece, digest_size=8, salt=offset.to_bytes(4, "little")).digest(), "little", signed=True)


def _hull(data: bytes, x: int, lo: int, hi: int, length: int, origin: int, end: int, where: int, unit: int) -> int:
    """Rank name of the hull; one that leaves the text is named by its place, so that it equals no other."""
    if x - hi < origin or x - lo + length > end:
        return _name(b"%d %d" % (where, x), lo)
    return int.from_bytes(hashlib.blake2b(data[(x - hi - origin) * unit : (x - lo + length - origin) * unit], digest_size=16).digest()[8:], "little", signed=True)


def _views(texts: list[str], unit: int) -> list[bytes]:
    """Each text's bytes, or its words' hashes side by side."""
    data = [x.encode() for x in texts]
    if unit == 1:
        return data
    words = Words(data)
    return [words.hash[a:b].tobytes() for a, b in zip(words.first, words.first[1:])]


def _first_round(length: int, gram: int, unit: int):
    kind = np.uint8 if unit == 1 else np.uint64

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = length - gram
        for batch in by_bytes(batches, "text", SLICE):
            key, pos, lo, hi, core, hull = [], [], [], [], [], []
            for k, data in zip(batch.column("key").to_pylist(), _views(batch.column("text").to_pylist(), unit), strict=True):
                for x, a, b in anchors(np.frombuffer(data, dtype=kind), length, gram):
                    for at in x.tolist():
                        core.append(_name(data[at * unit : (at + gram) * unit], 0))
                        hull.append(_hull(data, at, 0, top, length, 0, len(data) // unit, k, unit))
                    key += [k] * len(x)
                    pos += x.tolist()
                    lo += (x - b).tolist()
                    hi += (x - a).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, pa.int64()), pa.array(pos, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(core, pa.int64()), pa.array(hull, pa.int64())],
                ["key", "pos", "lo", "hi", "core", "hull"],
            )

    return rows


def _second_round(length: int, gram: int, unit: int, sizes: list[int]):
    """Cutting out the bytes and naming the next ranges, in one Python worker."""
    cut, named = _contexts(length, gram, unit), _next_round(length, unit, sizes, 1)
    return lambda batches: named(cut(batches))


def _contexts(length: int, gram: int, unit: int):
    """The bytes around the anchors that go on, out of each text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = length - gram
        for batch in by_bytes(batches, "text", SLICE):
            out: list[list] = [[] for _ in range(7)]
            for row, data in zip(batch.select(["key", "at"]).to_pylist(), _views(batch.column("text").to_pylist(), unit), strict=True):
                for at in row["at"]:
                    begin = max(0, at["pos"] - top)
                    values = (row["key"], at["pos"], at["lo"], at["hi"], at["settled"], begin, data[begin * unit : (at["pos"] + length) * unit])
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                    if len(out[0]) >= 1024:
                        yield _context_batch(out)
                        out = [[] for _ in range(7)]
            yield _context_batch(out)

    return rows


CONTEXT = [("key", pa.int64()), ("pos", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("settled", pa.bool_()), ("begin", pa.int64()), ("bytes", pa.binary())]
CONTEXT_SQL = "key long, pos long, lo int, hi int, settled boolean, begin long, bytes binary"


def _context_batch(out: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(out, CONTEXT, strict=True)], [n for n, _ in CONTEXT])


def _next_round(length: int, unit: int, sizes: list[int], k: int):
    """The rows of round ``k`` out of those that went on in the round before; bytes that aren't needed any more go."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            out: list[list] = [[] for _ in range(9)]
            for row in batch.to_pylist():
                x, data, begin = row["pos"], row["bytes"], row["begin"]
                end = begin + len(data) // unit
                first, stop = range_of(sizes, k - 1, row["lo"])
                for a in range(first, stop, sizes[k]):
                    b = min(a + sizes[k], stop) - 1
                    lo, hi = max(a, row["lo"]), min(b, row["hi"])
                    if lo > hi:
                        continue
                    core = _name(data[(x - a - begin) * unit : (x - b + length - begin) * unit], a)
                    cut = max(begin, x - b)
                    values = (row["key"], x, lo, hi, row["settled"], cut, data[(cut - begin) * unit : (x - a + length - begin) * unit], core, _hull(data, x, a, b, length, begin, end, row["key"], unit))
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
            types = [*CONTEXT, ("core", pa.int64()), ("hull", pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(out, types, strict=True)], [n for n, _ in types])

    return rows


def _ranked(rows: DataFrame) -> DataFrame:
    """One row per distinct (core, hull) whose core is not unique: ``repeats`` (the hull is not unique either),
    ``goes_on`` (some row of the core is not settled, and there is another hull to meet), ``witness`` (the row that
    stands for those with this hull)."""
    by_hull = rows.groupBy("core", "hull").agg(
        F.count("*").alias("n"), F.min(F.col("settled").cast("int")).alias("done"), F.min(F.struct("key", "pos")).alias("witness"),
    )
    # a hull that repeats settles its rows
    by_hull = by_hull.withColumn("waits", ((F.col("n") == 1) & (F.col("done") == 0)).cast("int"))
    by_core = by_hull.groupBy("core").agg(F.sum("n").alias("of_core"), F.count("*").alias("hulls"), F.max("waits").alias("waiting")).where("of_core > 1")
    return by_hull.join(by_core, "core").select(
        "core", "hull", (F.col("n") > 1).alias("repeats"), ((F.col("hulls") > 1) & (F.col("waiting") == 1)).alias("goes_on"), "witness"
    )


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, unit: int = 1) -> DataFrame:
    """(``key``, ``spans``: sorted starts and ends, in units) of what to remove. ``texts``: ``key`` (long, one text each) and
    ``text``; it is read twice."""
    stored = Stored(texts.sparkSession)
    # written: the grouping and the join below read it; words have a byte each, and one between them
    ranges = stored.write(texts.where(F.octet_length("text") >= (length if unit == 1 else 2 * length - 1)).mapInArrow(
        _first_round(length, gram, unit), "key long, pos long, lo int, hi int, core long, hull long"
    ).withColumn("settled", F.lit(False)), "anchors")
    sizes = widths(length, gram)
    found = []
    for k in range(len(sizes)):
        # only the rows of this round are kept, and of the rounds before only the spans
        met = stored.write(ranges.join(_ranked(ranges), ["core", "hull"]), f"round_{sizes[k]}")
        stored.drop(ranges)
        spans = met.where("repeats AND NOT settled").select("key", (F.col("pos") - F.col("hi")).alias("a"), (F.col("pos") - F.col("lo") + F.lit(length)).alias("b"))
        found.append(materialise(spans, "spans"))
        if k + 1 < len(sizes):
            on = met.where((F.col("witness.key") == F.col("key")) & (F.col("witness.pos") == F.col("pos")) & F.col("goes_on"))
            on = on.withColumn("settled", F.col("settled") | F.col("repeats"))
            if k:
                rows, step = on.select([n for n, _ in CONTEXT]), _next_round(length, unit, sizes, k + 1)
            else:
                at = on.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("pos", "lo", "hi", "settled"))).alias("at"))
                rows, step = texts.join(at, "key").select("key", "text", "at"), _second_round(length, gram, unit, sizes)
            ranges = stored.write(rows.mapInArrow(step, f"{CONTEXT_SQL}, core long, hull long"), f"ranges_{sizes[k + 1]}")
        stored.drop(met)
    spans = found[0]
    for more in found[1:]:
        spans = spans.unionByName(more)
    return spans.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(4)]
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            data = text.encode()
            kept, at, removed, runs, stop = [], 0, 0, 0, -1
            for s in spans or ():
                a, b = max(s["a"], at), s["b"]
                if s["a"] > stop:
                    runs += 1
                if b > a:
                    kept.append(data[at:a])
                    removed += b - a
                    at = b
                stop = max(stop, b)
            kept.append(data[at:])
            for column, value in zip(out, (len(data), removed, runs, b"".join(kept)), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())],
            [*batch.schema.names, "n_bytes", "n_removed", "n_spans", "left"],
        )


def _keyed(docs: DataFrame) -> DataFrame:
    """A number for each row, the same whenever the rows are read: taken from id and text, equal rows share it."""
    return docs.withColumn("key", F.xxhash64("doc_id", F.lit("text"), "text"))


def cut_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``left`` (the bytes that stay) of each row."""
    rows = _keyed(documents(docs))
    spans = repeated_spans(rows.select("key", "text"), length, gram)
    joined = rows.join(spans, "key", "left").select("doc_id", "text", "spans")
    schema = "doc_id long, text string, spans array<struct<a:long,b:long>>, n_bytes long, n_removed long, n_spans long, left binary"
    return joined.mapInArrow(_cut, schema).drop("text", "spans")


def _places(data: bytes, spans: list) -> list[tuple[int, int]]:
    """The bytes from the first to the last word of each span."""
    words = Words([data])
    return [(int(words.start[s["a"]]), int(words.end[s["b"] - 1])) for s in spans]


def drop_repeats(docs: DataFrame, length: int = LENGTH, words: int = WORDS) -> DataFrame:
    """``docs`` without the repeated passages, strings of ``length`` bytes and runs of ``words`` words, all columns kept: a
    character that is cut in two goes as a whole, and ``n_chars``, where there is one, is counted again. A null text stays null."""
    rows = _keyed(documents(docs)).select("key", "text")
    spans = repeated_spans(rows, length).select(F.col("key").alias("__key"), F.col("spans").alias("__spans"))
    runs = repeated_spans(rows, words, min(words, GRAM_WORDS), CODE).select(F.col("key").alias("__key"), F.col("spans").alias("__words"))
    key = F.xxhash64(F.col("doc_id").cast("long"), F.lit("text"), F.coalesce("text", F.lit("")))
    joined = docs.withColumn("__key", key).join(spans, "__key", "left").join(runs, "__key", "left")

    @F.pandas_udf("string")
    def left(text, found, runs_):
        out = []
        for t, in_bytes, in_words in zip(text, found, runs_, strict=True):
            if t is None or in_bytes is None and in_words is None:
                out.append(t)
                continue
            data, kept, at = t.encode(), [], 0
            places = [(s["a"], s["b"]) for s in in_bytes] if in_bytes is not None else []
            for a, b in sorted(places + (_places(data, in_words) if in_words is not None else [])):
                if b > at:
                    kept.append(data[at : max(a, at)].decode(errors="ignore"))
                    at = b
            kept.append(data[at:].decode(errors="ignore"))
            out.append("".join(kept))
        import pandas as pd

        return pd.Series(out, dtype=object)

    new = joined.withColumn("text", left("text", "__spans", "__words"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        untouched = F.col("__spans").isNull() & F.col("__words").isNull()
        new = new.withColumn("n_chars", F.when(untouched, F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return new.select(docs.columns)


@query("op10_suffix_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cut_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.sha2("left", 256)).alias("kept_sha256"))
