"""Near-duplicate documents: SuperMinHash signatures, banding, verification, union-find grouping.

Signatures: slot ``p`` of ``SLOTS`` holds the least ``r + j`` over the elements, where element ``x``
throws ``r`` uniform in [0, 1) into slot ``perm_x[j]`` in its step ``j`` and ``perm_x`` is a random
permutation of the slots that grows with ``j``. All elements of a batch take step ``j`` together;
a document stops as soon as none of its slots can still fall (each holds less than ``j``).

Banding: ``BANDS`` bands of ``ROWS`` slots. A pair at the similarity 0.75 shares no band with
probability (1 - 0.75^4)^32 = 5e-6.

Verification: equal shingle sets are one class (128 bits of their hashes). Bands give buckets of
classes. A bucket of at most ``SMALL`` classes names all its pairs, which bounds the rows by a
multiple of its members. In a larger one, each round tests all classes against a few
representatives drawn anew, who then leave; a bucket ends when all its classes have one label. Every
pair of a bucket with different labels is tested in the end, so no link is lost, and pairs that are
already joined are never named. What is left after ``ROUNDS`` is compared block by block: bit sets of the
hashes bound the similarity of two classes from above, sets of classes whose bound allows a link then meet in
the task, which tests the pairs and gives a spanning forest of the links, never the pairs. No similar pair of
a bucket is left out. Links hold on full sets of 64-bit
shingle hashes: 100 * intersection >= 75 * union.

Defined results: null or empty texts, and texts without words, have the empty set and link with
nothing; rows with one ``doc_id`` are one node, linked by whichever of their texts; a null ``doc_id``
links with nothing and is kept; no rows give no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, components, documents, materialise, read
from .registry import query
from .words import Words, mixed

SLOTS, BANDS, ROWS, SHINGLE, PERCENT = 128, 32, 4, 5, 75
SMALL, PICKS, ROUNDS, BLOCK, BLOCK_BYTES = 8, 1, 1, 1024, 16 << 20
#: Bits of the set of hashes modulo this number.
BITS = 4096
SLICE = 1 << 20  # bytes of text whose shingles are held together


def signatures(doc: np.ndarray, value: np.ndarray, n_docs: int, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash of each document's distinct ``value`` s; slots of documents without any stay infinite."""
    h = np.full((n_docs, slots), np.inf)
    flat = h.reshape(-1)
    perm = None
    live = np.arange(len(doc))
    for j in range(slots):
        draw = mixed(value[live], 2 * j + 11)
        r = (draw >> np.uint64(11)).astype(np.float64) * 2.0**-53
        k = j + (mixed(draw, 5) % np.uint64(slots - j)).astype(np.int64)
        if j == 0:
            slot = k
        else:
            if perm is None:  # the first step swapped entry 0 with the drawn one
                perm = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int32), (len(live), 1))
                at = np.arange(len(live))
                perm[at, first] = 0
                perm[:, 0] = first
            at = np.arange(len(live))
            slot = perm[at, k].astype(np.int64)
            perm[at, k] = perm[:, j]
            perm[:, j] = slot
        np.minimum.at(flat, doc[live] * slots + slot, r + j)
        open_ = h.max(axis=1) >= j + 1  # a later step throws j + 1 at least
        keep = open_[doc[live]]
        if j == 0:
            first = k[keep]
        elif not keep.all():
            perm = perm[keep]
        live = live[keep]
        if not len(live):
            break
    return h


def band_keys(h: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each document and band."""
    bits = h.view(np.uint64).reshape(len(h), bands, rows)
    key = np.zeros((len(h), bands), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(rows):
            key = mixed(key * np.uint64(0xD6E8FEB86659FD93) + bits[:, :, i], i)
        number = np.arange(bands, dtype=np.uint64)[None, :]  # in the low five bits
        return (mixed(key + number, 3) & ~np.uint64(31)) | number


def _sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, int]:
    texts = [x.encode() for x in batch.column("text").to_pylist()]
    doc, value = Words(texts).shingles(SHINGLE)
    return doc, value, len(texts)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for batch in by_bytes(batches, "text", SLICE):
        doc, value, n = _sets(batch)
        first = np.searchsorted(doc, np.arange(n + 1))
        h = signatures(doc, value, n)
        keys = band_keys(h).view(np.int64)
        bits = np.zeros((n, BITS), dtype=bool)
        bits[doc, (mixed(value) % np.uint64(BITS)).astype(np.int64)] = True
        bits = np.packbits(bits, axis=1)
        size = np.diff(first)
        digest = [hashlib.blake2b(value[first[i] : first[i + 1]].tobytes(), digest_size=16).digest() for i in range(n)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(list(keys), pa.list_(pa.int64())),
             pa.array([x.tobytes() for x in bits], pa.binary())],
            ["doc_id", "n", "digest", "keys", "bits"],
        )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text", SLICE):
        doc, value, n = _sets(batch)
        first = np.searchsorted(doc, np.arange(n + 1))
        rows = [value[first[i] : first[i + 1]].tobytes() for i in range(n)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.binary())], ["id", "set"])


def _alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets of hashes are similar enough."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(small) < PERCENT * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [[np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in batch.column(c)] for c in ("set_a", "set_b")]
        keep = [_alike(x, y) for x, y in zip(*sets, strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) whose sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(_similar, "a long, b long")


def _candidates(band: int, left: pa.Table, right: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of ``left`` with any: its number, those of the rows of ``right`` that may be similar and have another
    label, and the bound of their similarity. A pair that shares an earlier band as well is left to that one.

    Each bit that only one set has stands for at least one hash that the other set lacks, which bounds the intersection.
    """
    a, b = ([t.column(c).to_numpy() for c in ("id", "label", "n")] for t in (left, right))
    if not len(a[0]) or not len(b[0]):
        return
    bits_a, bits_b = (np.array([np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in t.column("bits")]) for t in (left, right))
    keys_a, keys_b = (np.array([x.values.to_numpy() for x in t.column("keys")]) for t in (left, right))
    ones = np.bitwise_count(bits_b).sum(axis=1, dtype=np.int64)
    for i in range(len(a[0])):
        both = np.bitwise_count(bits_b & bits_a[i]).sum(axis=1, dtype=np.int64)
        common = np.minimum(a[2][i] - (int(np.bitwise_count(bits_a[i]).sum(dtype=np.int64)) - both), b[2] - (ones - both))
        union = a[2][i] + b[2] - common
        before = (keys_b[:, :band] == keys_a[i, :band]).any(axis=1)
        found = np.flatnonzero((100 * common >= PERCENT * union) & ~before & (a[1][i] != b[1]) & (a[0][i] < b[0]))
        if len(found):
            yield i, found, common[found] / union[found]


def _meeting(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """The rows of two blocks that have any candidate in the other one, with their side."""
    sides = np.zeros(left.num_rows, dtype=bool), np.zeros(right.num_rows, dtype=bool)
    for i, found, _ in _candidates(key[0].as_py() & 31, left, right):
        sides[0][i] = True
        sides[1][found] = True
    out = [t.filter(pa.array(s)).append_column("side", pa.array([k] * int(s.sum()), pa.int32())) for k, (t, s) in enumerate(zip((left, right), sides))]
    return pa.concat_tables(out).select([n for n, _ in MEETING])


MEETING = [("bucket", "long"), ("block", "int"), ("other", "int"), ("side", "int"), ("id", "long"), ("label", "long"), ("n", "long"), ("keys", "array<long>"), ("bits", "binary")]


def _joined(key: tuple, table: pa.Table) -> pa.Table:
    """A spanning forest, over the labels, of the links between two blocks; pairs of the highest bounds are tested first and
    pairs that are joined by then need no test."""
    side = table.column("side").to_numpy()
    left, right = (table.filter(pa.array(side == k)) for k in (0, 1))
    (a, la), (b, lb) = ((t.column("id").to_numpy(), t.column("label").to_numpy()) for t in (left, right))
    sa, sb = ([np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in t.column("set")] for t in (left, right))
    found = list(_candidates(key[0].as_py() & 31, left, right))
    out_a, out_b = [], []
    if found:
        i = np.concatenate([np.full(len(j), k) for k, j, _ in found])
        j = np.concatenate([x for _, x, _ in found])
        order = np.argsort(-np.concatenate([x for _, _, x in found]), kind="stable")
        parent = {int(x): int(x) for x in (*la, *lb)}

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for p, q in zip(i[order].tolist(), j[order].tolist()):
            x, y = find(int(la[p])), find(int(lb[q]))
            if x != y and _alike(sa[p], sb[q]):
                parent[max(x, y)] = min(x, y)
                out_a.append(int(a[p]))
                out_b.append(int(b[q]))
    return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})


def _labelled(members: DataFrame, links: DataFrame | None) -> DataFrame:
    """``members`` (``bucket``, ``id``) with the label of each id after ``links``."""
    if links is None:
        return members.withColumn("label", F.col("id"))
    # one row per id meets the labels, not one per bucket; an id has at most ``BANDS`` buckets
    ids = members.groupBy("id").agg(F.collect_list("bucket").alias("buckets"))
    labels = ids.join(components(links), "id", "left").select("id", "buckets", F.coalesce("component", "id").alias("label"))
    return labels.select(F.explode("buckets").alias("bucket"), "id", "label")


def _open(labelled: DataFrame) -> DataFrame:
    """Members of the buckets in which more than one label is left."""
    labelled = materialise(labelled, "labelled")
    mixed_ = labelled.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("size")).where("x <> y")
    return labelled.join(mixed_.select("bucket", "size"), "bucket")


def links_between(members: DataFrame, sets: DataFrame, short: DataFrame) -> DataFrame:
    """Links (``a`` < ``b``) that join all similar classes of the buckets ``members`` (``bucket``, ``id``).

    ``sets`` (``id``, ``set``) holds their shingle hashes, ``short`` (``id``, ``n``, ``keys``, ``bits``) the size of the set,
    the key of each band and the bits of the hashes.
    """
    left, right = F.col("left"), F.col("right")
    sized = members.join(members.groupBy("bucket").agg(F.count("*").alias("size")), "bucket")
    few = sized.where(f"size <= {SMALL}").groupBy("bucket").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    named = few.select(F.explode("ids").alias("left"), "ids").select("left", F.explode(F.filter("ids", lambda x: x > F.col("left"))).alias("right"))
    pairs = named.select(left.alias("a"), right.alias("b")).distinct()
    links = materialise(_verified(pairs, sets).distinct(), "links")
    rest = materialise(sized.where(f"size > {SMALL}").select("bucket", "id"), "large_buckets")
    for k in range(ROUNDS):
        if rest.isEmpty():
            return links
        now = materialise(_open(_labelled(rest, links)), "open_buckets")
        if now.isEmpty():
            return links
        picks = now.groupBy("bucket").agg(*[F.expr(f"min_by(struct(id, label), xxhash64(id, {k}, {i}))").alias(f"p{i}") for i in range(PICKS)])
        picks = picks.select("bucket", F.explode(F.array_distinct(F.array(*[f"p{i}" for i in range(PICKS)]))).alias("p"))
        picks = picks.select("bucket", F.col("p.id").alias("pick"), F.col("p.label").alias("pick_label"))
        tests = now.join(picks, "bucket").where("label <> pick_label")
        pairs = tests.select(F.least("id", "pick").alias("a"), F.greatest("id", "pick").alias("b")).distinct()
        found = materialise(_verified(pairs, sets), "links")
        links = materialise(links.unionByName(found).distinct(), "links")
        # a representative has met every class of another label in its bucket, and leaves it
        rest = materialise(now.select("bucket", "id").join(picks.select("bucket", F.col("pick").alias("id")), ["bucket", "id"], "left_anti"), "large_buckets")
    now = materialise(_open(_labelled(rest, links)), "open_buckets")
    if now.isEmpty():
        return links
    sized = now.join(short, "id").select("bucket", "id", "label", "n", "keys", "bits")
    # a block's sets are bounded too: they meet in one task
    n_blocks = sized.groupBy("bucket").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    blocked = sized.join(n_blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    blocked = materialise(blocked, "blocks")
    blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    one = blocked.withColumn("other", blocks)
    two = blocked.withColumnRenamed("block", "other").withColumn("block", blocks)
    keys, cols = ("bucket", "block", "other"), ("bucket", "block", "other", "id", "label", "n", "keys", "bits")
    schema = ", ".join(f"{n} {t}" for n, t in MEETING)
    # bits first, so that full sets travel only with classes that may be similar to another one in their block
    meeting = one.select(*cols).groupBy(*keys).cogroup(two.select(*cols).groupBy(*keys)).applyInArrow(_meeting, schema)
    meeting = materialise(meeting, "meeting")
    found = materialise(meeting.join(sets, "id").groupBy(*keys).applyInArrow(_joined, "a long, b long"), "links")
    return materialise(links.unionByName(found).distinct(), "links")


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``."""
    rows = documents(docs)
    signed = materialise(rows.mapInArrow(_signed, "doc_id long, n long, digest binary, keys array<long>, bits binary"), "signed")
    usable = signed.where("n > 0 AND doc_id IS NOT NULL")
    classes = usable.groupBy("digest").agg(F.min("doc_id").alias("id"))
    own = materialise(usable.select("doc_id", "digest").join(classes, "digest").select("doc_id", "id").distinct(), "classes")
    first = usable.select("doc_id", "keys", "bits", "n").join(own.where("doc_id = id").select("doc_id"), "doc_id", "left_semi")
    bands = first.select(F.col("doc_id").alias("id"), F.explode("keys").alias("bucket")).distinct()
    shared = bands.join(bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "bucket", "left_semi")
    members = materialise(shared.select("bucket", "id"), "members")
    wanted = members.select(F.col("id").alias("doc_id")).distinct()
    sets = materialise(rows.join(wanted, "doc_id", "left_semi").mapInArrow(_hashed, "id long, set binary"), "sets")
    links = links_between(members, sets, first.select(F.col("doc_id").alias("id"), "n", "keys", "bits"))
    of_classes = own.where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    found = components(links.unionByName(of_classes))
    out = signed.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is kept, with all their columns."""
    gone = near_groups(docs).where("NOT kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("__id"), "left_anti")


@query("op5_superminhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents"))
