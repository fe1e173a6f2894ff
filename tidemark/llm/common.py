"""Input columns, worker-wide caches and the grouping of linked ids."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import fresh_path, materialise

__all__ = ["Stored", "documents", "read", "worker_cache", "components", "materialise", "fresh_path", "by_bytes"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(docs: DataFrame) -> DataFrame:
    """``doc_id`` as long and ``text`` with null as the empty text; other columns play no part."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def worker_cache(name: str, make: Callable[[], object]) -> object:
    """An object that lives as long as the Python worker, shared by the tasks it runs."""
    kept = sys.modules.setdefault("_tidemark_worker", types.ModuleType("_tidemark_worker"))
    if not hasattr(kept, name):
        setattr(kept, name, make())
    return getattr(kept, name)


class Stored:
    """Tables written to the shared folder whose files are deleted as soon as nothing reads them any more.

    What was computed from a table must be written itself before the table goes, so that a lost
    executor never asks for it again.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, table: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(table)))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def by_bytes(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes of text each (a longer text is a slice of its own)."""
    for batch in batches:
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0), dtype=np.int64)
        start, total = 0, 0
        for i, size in enumerate(sizes):
            if i > start and total + size > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < batch.num_rows or batch.num_rows == 0:
            yield batch.slice(start)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one partition; gives an edge from each id to its least partner.

    The forest is emptied whenever it holds ``most`` ids, so memory doesn't grow with the partition.
    """
    most = 1 << 20
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def out() -> pa.RecordBatch:
        ids = [x for x in parent if find(x) != x]
        rows = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([find(x) for x in ids], pa.int64())], ["a", "b"])
        parent.clear()
        return rows

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > most:
            yield out()
    yield out()


def components(edges: DataFrame) -> DataFrame:
    """(``id``, ``component``) for every id of ``edges`` (``a``, ``b``): the least id reachable.

    Each partition first shrinks its edges to a union-find forest. The forests are then joined by
    alternating large-star and small-star rounds until no edge changes; the state lives in the
    shared folder, and only one count per round reaches the driver.
    """
    shrunk = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInArrow(_forest, "a long, b long")
    now = materialise(shrunk.distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a <> b").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            down.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct()
        )
        new = materialise(small, "edges")
        # a star forest has one edge per id, and no target is itself the source of an edge
        sources = new.groupBy("a").agg(F.count("*").alias("n"))
        bad = sources.where("n > 1").select("a").limit(1).unionByName(
            new.join(sources.select(F.col("a").alias("b")), "b", "left_semi").select("a").limit(1)
        )
        if bad.isEmpty():
            break
        now = new
    stars = new.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return stars.unionByName(new.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
