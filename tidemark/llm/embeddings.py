"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, exact rerank.

* Equal vectors are one class. Unit vectors go to the inverted list of their nearest coarse centroid;
  the residual is coded in ``SUBSPACES`` parts of 256 codewords each.
* Vectors at a cosine of ``t`` or more are at most ``d = sqrt(2 - 2t)`` apart. A partner of ``x`` is in list
  ``c`` only if ``x`` is no further than ``d`` behind the plane between ``c`` and its own list: those
  lists are probed, which is sufficient, not a fixed number.
* In a list, table lookups give the distance from ``x`` to each code. Codes further than ``d`` plus the
  code's own error, which is stored, can't belong to partners; all others get their exact cosine in
  double precision. So no link is lost whatever the quantiser looks like.
* A vector travels to each list it probes, so lists are as large as a task takes, not smaller.
* Larger lists are cut into blocks of about ``BLOCK`` vectors and their queries into blocks of about ``QUERIES``,
  so a hot list is many tasks. A task gives link counts and a spanning forest of its links, never all
  pairs. Groups come from union-find over the forests.

Centroids and codewords are fitted in numpy on at most ``SAMPLE`` vectors, those with the least hash;
every vector is indexed.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component link with
nothing; neither do vectors of different length. Each row is a vector of its own, so rows with one
``vec_id`` may link; a null ``vec_id`` counts as larger than any id. No rows give no rows; other
columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, fresh_path, materialise, read
from .registry import query

LEAST_COSINE, SAMPLE, SUBSPACES, CODEWORDS, LLOYD = 0.95, 8192, 8, 256, 5
MOST_LISTS, BLOCK, QUERIES = 4096, 8192, 8192
SLACK = 1e-4  # for rounding in the distances, which are sums of single precision; the rerank is exact


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :], 0)
    return d.argmin(1), d


def _lloyd(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(LLOYD):
        own, _ = _nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        total = np.stack([np.bincount(own, weights=x[:, j], minlength=len(centres)) for j in range(x.shape[1])], axis=1)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


class Quantiser:
    """Coarse centroids and the codewords of each subspace; at most MOST_LISTS + CODEWORDS vectors in all."""

    def __init__(self, sample: np.ndarray, lists: int):
        rng = np.random.default_rng(7)
        self.centres = _lloyd(sample, lists, rng)
        own, _ = _nearest(sample, self.centres)
        rest = sample - self.centres[own]
        edges = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
        self.parts = [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]
        self.words = [_lloyd(rest[:, p], CODEWORDS, rng) for p in self.parts]
        self.between = np.sqrt(_nearest(self.centres, self.centres)[1])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, distance to what the codes stand for, and distances to all centroids."""
        own, d = _nearest(x, self.centres)
        rest = x - self.centres[own]
        codes = np.stack([_nearest(rest[:, p], w)[0] for p, w in zip(self.parts, self.words)], axis=1).astype(np.uint8)
        back = np.concatenate([w[codes[:, i]] for i, w in enumerate(self.words)], axis=1)
        return own, codes, np.sqrt(((rest - back) ** 2).sum(1)), d

    def probes(self, own: np.ndarray, d: np.ndarray, reach: float) -> list[np.ndarray]:
        """Lists from the own one on that may hold partners: each pair of lists is met from the lower one."""
        out = []
        for i, c in enumerate(own):
            behind = (d[i] - d[i, c]) / np.maximum(2 * self.between[c], 1e-12)
            near = np.flatnonzero(behind <= reach + SLACK)
            out.append(np.union1d(near[near > c], [c]))
        return out

    def table(self, x: np.ndarray, lists: int) -> list[np.ndarray]:
        """Squared distances from the residual of each ``x`` to the codewords of each subspace."""
        rest = x - self.centres[lists]
        return [_nearest(rest[:, p], w)[1] for p, w in zip(self.parts, self.words)]


def _units(column: pa.Array) -> np.ndarray:
    x = np.array([np.frombuffer(v.as_buffer(), dtype=np.float64) for v in column])
    return x / np.linalg.norm(x / np.abs(x).max(1)[:, None], axis=1)[:, None] / np.abs(x).max(1)[:, None] if len(x) else x


def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.array(x, dtype=np.float64).tobytes() for x in batch.column("embedding").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, pa.binary())], ["id", "vector"])


def _indexed(quantiser: Quantiser, reach: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 1024):
                batch = whole.slice(begin, 1024)
                own, codes, error, d = quantiser.encode(_units(batch.column("vector")))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("vector"), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()),
                     pa.array(error, pa.float64()), pa.array([p.astype(np.int32) for p in quantiser.probes(own, d, reach)], pa.list_(pa.int32()))],
                    ["id", "vector", "list", "codes", "error", "probes"],
                )

    return rows


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An edge from each id in ``a`` and ``b`` to the least one it is joined with."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    rest = label != np.arange(len(ids))
    return ids[rest], ids[label[rest]]


def _linked(quantiser: Quantiser, least: float, reach: float):
    """Counts (``id``, null, number of links) and forest edges (``id``, ``other``, 0) of one block of a list and one of its queries."""

    def group(key: tuple, members: pa.Table, queries: pa.Table) -> pa.Table:
        counts: dict[int, int] = {}
        a_all, b_all = [], []
        if members.num_rows and queries.num_rows:
            place = key[0].as_py()
            my, mine = members.column("id").to_numpy(), members.column("n").to_numpy()
            y = _units(members.column("vector").combine_chunks())
            codes = np.array([np.frombuffer(v.as_buffer(), dtype=np.uint8) for v in members.column("codes").combine_chunks()])
            limit = ((reach + members.column("error").to_numpy()) ** 2 + SLACK).astype(np.float32)[:, None]
            total = np.zeros(len(my), dtype=np.int64)
            for begin in range(0, queries.num_rows, 256):
                part = queries.slice(begin, 256)
                ids, n, own = part.column("id").to_numpy(), part.column("n").to_numpy(), part.column("list").to_numpy()
                x = _units(part.column("vector").combine_chunks())
                # rows are codewords: a code copies the distances of all queries to it at once
                tables = [np.ascontiguousarray(t.T, dtype=np.float32) for t in quantiser.table(x, place)]
                found = []
                for first in range(0, len(my), 1024):
                    some = slice(first, first + 1024)
                    far = tables[0][codes[some, 0]]
                    for m, t in enumerate(tables[1:], 1):
                        far += t[codes[some, m]]
                    # in its own list a pair is met from the lower id
                    q, p = np.nonzero((far <= limit[some]) & ((own != place)[None, :] | (ids[None, :] < my[some, None])))
                    found.append((p, q + first))
                i, j = (np.concatenate(v) for v in zip(*found))
                for s in range(0, len(i), 1 << 16):
                    p, q = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                    link = np.einsum("ij,ij->i", x[p], y[q]) >= least
                    p, q = p[link], q[link]
                    for k, v in zip(ids, np.bincount(p, weights=mine[q], minlength=len(ids)).astype(np.int64)):
                        if v:
                            counts[int(k)] = counts.get(int(k), 0) + int(v)
                    total += np.bincount(q, weights=n[p], minlength=len(my)).astype(np.int64)
                    if len(p):
                        e, f = _forest(ids[p], my[q])
                        a_all.append(e)
                        b_all.append(f)
            for k, v in zip(my[total > 0], total[total > 0]):
                counts[int(k)] = counts.get(int(k), 0) + int(v)
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a_all, b_all))
        a, b = _forest(a, b) if len(a) else (a, b)
        return pa.table({
            "id": pa.array([*counts, *a.tolist()], pa.int64()), "other": pa.array([None] * len(counts) + b.tolist(), pa.int64()),
            "links": pa.array([*counts.values(), *[0] * len(a)], pa.int64()),
        })

    return group


def links(classes: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """Counts and forest edges of ``classes`` (``id``, ``n`` copies, ``vector`` as bytes of doubles, all of one length)."""
    reach = math.sqrt(max(0.0, 2 - 2 * least))
    size = classes.count()
    some = classes.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").collect()  # bounded
    sample = _units(pa.array([bytes(r.vector) for r in some], pa.binary()))
    quantiser = Quantiser(sample, max(1, min(MOST_LISTS, math.ceil(size / BLOCK), len(sample) // 4 or 1)))
    spec = "id long, vector binary, list int, codes binary, error double, probes array<int>"
    indexed = classes.select("id", "vector").mapInArrow(_indexed(quantiser, reach), spec).join(classes.select("id", "n"), "id")
    path = fresh_path(classes.sparkSession, "index")
    indexed.write.parquet(path)
    indexed, again = (classes.sparkSession.read.parquet(path) for _ in range(2))  # one for each side of the cogroup
    queries = again.select("id", "n", "vector", "list", F.explode("probes").alias("place"))
    # a row for each list, at most MOST_LISTS
    sizes = indexed.groupBy("list").agg(F.count("*").alias("m")).select(F.col("list").alias("place"), F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    asked = queries.groupBy("place").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
    plan = F.broadcast(materialise(sizes.join(asked, "place"), "plan"))
    members = (
        indexed.select(F.col("list").alias("place"), "id", "n", "vector", "codes", "error").join(plan, "place")
        .withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("place", "block", "part", "id", "n", "vector", "codes", "error")
    )
    queries = (
        queries.join(plan, "place").withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), "parts").cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("place", "block", "part", "id", "n", "vector", "list")
    )
    keys = ("place", "block", "part")
    return members.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(_linked(quantiser, least, reach), "id long, other long, links long")


def near_vectors(vectors: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id``, ``kept``."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.monotonically_increasing_id().alias("row"))
    rows = materialise(rows, "vectors")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    usable = rows.where(F.coalesce(fine, F.lit(False)))
    classes = usable.groupBy("embedding").agg(F.min("row").alias("id"), F.count("*").alias("n"))
    classes = materialise(classes, "vector_classes")
    own = usable.join(classes, "embedding").select("row", "id", "n")
    found = None
    for length in sorted(r.k for r in classes.select(F.size("embedding").alias("k")).distinct().collect()):  # the lengths that occur
        same = classes.where(F.size("embedding") == length)
        packed = same.select("id", "embedding").mapInArrow(_as_bytes, "id long, vector binary").join(same.select("id", "n"), "id")
        part = links(materialise(packed, "packed_vectors"), least)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = classes.select("id", F.col("id").alias("other"), F.col("n").alias("links")).limit(0)
    found = materialise(found, "vector_links")
    counts = found.where("other IS NULL").groupBy("id").agg(F.sum("links").alias("links"))
    edges = found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b"))
    groups = components(edges).withColumnRenamed("component", "class")
    placed = own.join(counts, "id", "left").join(groups, "id", "left").select(
        "row", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("class", "id").alias("class")
    )
    full = materialise(rows.select("row", "vec_id").join(placed, "row", "left").withColumn("class", F.coalesce("class", -1 - F.col("row"))), "placed")
    heads = full.groupBy("class").agg(F.min("vec_id").alias("component_id"))
    return full.join(heads, "class").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


@query("op2_pq_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))
