"""Token counts: the library encodes in Arrow functions, and only lengths leave them.

Batches are balanced by bytes and long texts are split at safe boundaries (``tokens``), so a task
holds one window of text and one bounded table of pieces whatever the texts are.

Defined results: a null text counts as empty (0 bytes, 0 tokens). A null ``doc_id`` stays null.
Repeated rows are counted one by one. No rows give no rows. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import by_bytes, documents, read
from .registry import query

LIMIT = 1024


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` of each row, with the vocabulary file ``path``."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path, count=True)
        for batch in by_bytes(batches, "text"):
            n = tokens.counts(enc, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = documents(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = rows.mapInArrow(lengths, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
