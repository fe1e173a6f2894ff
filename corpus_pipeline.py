"""The corpus pipeline: documents in, packed token sequences out.

Each stage calls one operator of ``tidemark.llm`` on all rows the stage before it kept, and all but the
last return the columns of ``documents``. Stages are written as Parquet and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact, minhash, packing, suffix, toxicity
from tidemark.llm.common import materialise, read


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the model learns from the labelled rows of ``docs`` outside the held-out fold."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row stays of those with equal texts."""
    return exact.drop_exact(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return minhash.drop_near(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur several times, strings of 400 bytes and runs of over 50 words, go at every place."""
    return suffix.drop_repeats(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids packed into sequences of 1,024, one row per piece."""
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


STAGES = [("toxicity", toxic), ("exact dedup", copies), ("near dedup", near_copies), ("repeated passages", passages), ("packing", sequences)]

#: Trained scores, shingle similarity and tokens have no SQL form; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; every stage but the last is written to the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
