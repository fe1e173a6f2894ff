"""Token ids as compressed blocks that give single documents quick access.

Layout of a dataset under one folder, written by Spark's own writer so that lost executors and
repeated tasks leave no partial files:

* ``dictionary``: one row, ``hash`` (SHA-256 of the bytes) and ``dictionary``, a zstandard dictionary
  trained on serialized id arrays of a bounded sample (``SAMPLE`` documents; it changes sizes only).
* ``blocks``: parquet sorted by document, a row per block of about ``BLOCK_BYTES``: the dictionary's
  hash, ``shard`` and ``block`` (order), ``first_id``/``last_id`` (footer statistics find a document's
  block), and the offset index (``doc_ids``, ``starts``, ``counts``, ``offsets``) into ``payload``,
  where every document is one zstandard frame of its own.
* ``shards``: ids before each shard.

Ids are little-endian unsigned integers, 16 bits wide where the vocabulary fits, else 32.

Defined results: a null text is empty and holds the end id alone. Null ``doc_id`` s come first; rows
with equal ids are ordered by their frames. No rows give an empty dataset. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tokens
from .common import by_bytes, documents, fresh_path, read, worker_cache
from .registry import query

#: Documents the dictionary is trained on, ids taken of each, and its size in bytes.
SAMPLE, SAMPLE_IDS, DICTIONARY_BYTES = 2000, 2048, 64 << 10
BLOCK_BYTES, LEVEL = 1 << 20, 3


def _joined(parts: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
    """Whole documents out of the parts of long ones."""
    last, held = -1, []
    for i, part in parts:
        if i != last and held:
            yield last, held[0] if len(held) == 1 else np.concatenate(held)
            held = []
        last = i
        held.append(part)
    if held:
        yield last, held[0] if len(held) == 1 else np.concatenate(held)


def width(path: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def train_dictionary(docs: DataFrame, path: str, end_id: int, kind: str) -> bytes:
    """A dictionary for serialized arrays, from the ``SAMPLE`` documents with the least hash; empty if they are too few."""
    import zstandard

    rows = documents(docs)
    chosen = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).distinct()  # ids only: no text is sorted
    sample = rows.join(F.broadcast(chosen), "doc_id", "left_semi").limit(SAMPLE).select(F.substring("text", 1, 8 * SAMPLE_IDS).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        for batch in by_bytes(batches, "text"):
            rows = [np.append(x, end_id)[:SAMPLE_IDS].astype(kind).tobytes() for _, x in _joined(tokens.ids(enc, batch.column("text").to_pylist()))]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["ids"])

    found = [bytes(r.ids) for r in sample.mapInArrow(encode, "ids binary").collect()]  # at most SAMPLE * SAMPLE_IDS ids
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, found).as_bytes()
    except zstandard.ZstdError:  # too few or too short samples to train on
        return b""


def _codec(dictionary: bytes, which: str):
    import zstandard

    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    make = {"in": lambda: zstandard.ZstdCompressor(level=LEVEL, dict_data=known), "out": lambda: zstandard.ZstdDecompressor(dict_data=known)}
    return worker_cache(f"zstd {which} {hashlib.sha256(dictionary).hexdigest()}", make[which])


def write(docs: DataFrame, folder: str, path: str, end_id: int) -> None:
    """Encodes every whole text, appends ``end_id`` and writes the dataset under ``folder``."""
    spark = docs.sparkSession
    kind = width(path)
    dictionary = train_dictionary(docs, path, end_id, kind)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary), kind)], "hash string, dictionary binary, kind string").write.parquet(f"{folder}/dictionary")

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, codec = tokens.encoder(path), _codec(dictionary, "in")
        for batch in by_bytes(batches, "text"):
            n, out = [], []
            for _, x in _joined(tokens.ids(enc, batch.column("text").to_pylist())):
                n.append(len(x) + 1)
                out.append(codec.compress(np.append(x, np.uint32(end_id)).astype(kind).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "n", "frame"])

    # written first: the sort below samples its input, and texts shall be encoded once
    staged = fresh_path(spark, "frames")
    documents(docs).mapInArrow(frames, "doc_id long, n long, frame binary").write.option("compression", "none").parquet(staged)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = spark.read.parquet(staged).repartitionByRange(parts, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "frame")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, start = TaskContext.get().partitionId(), 0, 0
        doc_ids, sizes, held, total = [], [], [], 0

        def block() -> pa.RecordBatch:
            starts = start + np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int64)
            known = [x for x in doc_ids if x is not None]
            row = {
                "hash": digest, "shard": shard, "block": number, "first_id": known[0] if known else None, "last_id": known[-1] if known else None,
                "doc_ids": doc_ids, "starts": starts.tolist(), "counts": sizes, "offsets": offsets.tolist(), "payload": b"".join(held),
            }
            return pa.RecordBatch.from_pylist([row], schema=BLOCK)

        for batch in batches:
            for doc_id, n, frame in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), batch.column("frame"), strict=True):
                doc_ids.append(doc_id)
                sizes.append(n)
                held.append(frame.as_py())
                total += len(held[-1])
                if total >= BLOCK_BYTES:
                    yield block()
                    number, start = number + 1, start + sum(sizes)
                    doc_ids, sizes, held, total = [], [], [], 0
        if held:
            yield block()

    ordered.mapInArrow(blocks, SCHEMA).write.option("compression", "none").parquet(f"{folder}/blocks")
    ends = spark.read.schema(SCHEMA).parquet(f"{folder}/blocks").select("shard", F.explode("counts").alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    ends.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base")).write.parquet(f"{folder}/shards")


BLOCK = pa.schema([
    ("hash", pa.string()), ("shard", pa.int64()), ("block", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("payload", pa.binary()),
])
SCHEMA = (
    "hash string, shard long, block long, first_id long, last_id long, doc_ids array<long>, starts array<long>, counts array<long>, "
    "offsets array<long>, payload binary"
)


def _open(spark: SparkSession, folder: str) -> tuple[str, bytes, str]:
    row = spark.read.parquet(f"{folder}/dictionary").first()  # the dataset's one dictionary, at most DICTIONARY_BYTES
    if hashlib.sha256(row.dictionary).hexdigest() != row.hash:
        raise ValueError(f"the dictionary in {folder} is damaged")
    return row.hash, bytes(row.dictionary), row.kind


def read_back(spark: SparkSession, folder: str, with_ids: bool = True, only: int | None = None) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and, if asked for, ``ids`` out of the files of ``folder``.

    ``only`` reads one document: its block comes from the footer statistics, its frame from the offset index.
    """
    digest, dictionary, kind = _open(spark, folder)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(dictionary, "out")
        for batch in batches:
            for row in batch.to_pylist():
                if row["hash"] != digest:
                    raise ValueError("a block was written with another dictionary")
                out = {"doc_id": [], "shard": [], "start": [], "n_tokens": [], "ids_crc32": [], "ids": []}
                for i, (doc_id, start, n) in enumerate(zip(row["doc_ids"], row["starts"], row["counts"], strict=True)):
                    if only is not None and doc_id != only:
                        continue
                    frame = row["payload"][row["offsets"][i] : row["offsets"][i + 1]]
                    found = np.frombuffer(codec.decompress(frame), dtype=kind).astype("<u4")
                    if len(found) != n:
                        raise ValueError(f"document {doc_id} holds {len(found)} ids, its index says {n}")
                    for k, v in zip(out, (doc_id, row["shard"], start, n, zlib.crc32(found.tobytes()), found.astype(np.int64) if with_ids else None), strict=True):
                        out[k].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), [pa.int64()] * 5 + [pa.list_(pa.int64())], strict=True)], list(out))

    rows = spark.read.schema(SCHEMA).parquet(f"{folder}/blocks")
    if only is not None:
        rows = rows.where(F.lit(only).between(F.col("first_id"), F.col("last_id")))
    rows = rows.select("hash", "shard", "doc_ids", "starts", "counts", "offsets", "payload")
    found = rows.mapInArrow(decode, "doc_id long, shard long, start long, n_tokens long, ids_crc32 long, ids array<long>")
    shards = spark.read.schema("shard long, base long").parquet(f"{folder}/shards")  # a row per written file
    out = found.join(F.broadcast(shards), "shard").withColumn("start", F.col("start") + F.col("base"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


@query("op1_token_files")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = fresh_path(spark, "token_files")
    write(read(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_back(spark, folder, with_ids=False)
