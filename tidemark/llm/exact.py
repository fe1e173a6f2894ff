"""Exact duplicates with a heavy-hitter split: frequent digests never meet in one task.

A frequent-items sketch (Misra-Gries counters, merged map-side) names the digests that may be
frequent. Their exact counts come from a map-side aggregate, and the verified winners, at most
``winners`` rows, are broadcast and joined map-side. All other digests are shuffled as usual; a
group among them holds less than about one part in ``winners`` of the rows.

Defined results: a null text counts as empty and equals other empty texts. A null ``doc_id`` is
smaller than any id. Of rows with the same text and the same id one stays, which one is
arbitrary. No rows give no rows. Other columns of the input play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, materialise, read
from .registry import query

#: Counters of the sketch, digests broadcast at most (about 100 bytes each), and the least size of a broadcast group.
COUNTERS, WINNERS, LEAST_GROUP = 4096, 512, 64


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``digest`` (SHA-256 of the UTF-8 text) and ``row``, which tells equal rows apart."""
    return documents(docs).select(
        "doc_id", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("digest"), F.monotonically_increasing_id().alias("row")
    )


def keepers(keyed: DataFrame, winners: int = WINNERS, least_group: int = LEAST_GROUP) -> DataFrame:
    """``keyed`` (``doc_id``, ``digest``, ``row``) with ``keep_id``, ``group_size`` and ``kept``.

    ``keyed`` is read several times and must give the same rows each time, as a written table does.
    """
    sketch = keyed.agg(F.expr(f"approx_top_k(hex(digest), {winners}, {max(COUNTERS, 2 * winners)})").alias("top"))
    frequent = sketch.select(F.explode("top").alias("t")).where(F.col("t.count") >= least_group).select(F.unhex("t.item").alias("digest"))
    newest = F.max(F.struct("doc_id", "row"))
    heavy = (
        keyed.join(F.broadcast(frequent), "digest", "left_semi").groupBy("digest")
        .agg(newest.alias("top"), F.count("*").alias("group_size"))
        .where(F.col("group_size") >= least_group)
    )
    heavy = materialise(heavy, "heavy")  # at most ``winners`` rows
    of_heavy = keyed.join(F.broadcast(heavy), "digest")
    rest = keyed.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    group = Window.partitionBy("digest")
    rest = rest.withColumns({"top": newest.over(group), "group_size": F.count("*").over(group)})
    return of_heavy.unionByName(rest).select(
        "doc_id", "digest", "row", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("top.row") == F.col("row")).alias("kept"),
    )


def exact_groups(docs: DataFrame, winners: int = WINNERS, least_group: int = LEAST_GROUP) -> DataFrame:
    """One row per document: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    keyed = materialise(digests(docs), "digests")
    return keepers(keyed, winners, least_group).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_exact(docs: DataFrame, winners: int = WINNERS, least_group: int = LEAST_GROUP) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    keyed = materialise(digests(docs), "digests")
    digest = F.unhex(F.sha2(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8"), 256))
    stay = keepers(keyed, winners, least_group).groupBy("doc_id", "digest").agg(
        F.max("kept").alias("__stays"), F.count("*").alias("__copies")
    ).where("__stays").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), "__copies")
    marked = docs.join(stay, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (digest == F.col("__digest")))
    once = marked.where("__copies = 1").select(docs.columns)
    again = marked.where("__copies > 1").dropDuplicates(["__id", "__digest"]).select(docs.columns)  # the same id and text, several times
    return once.unionByName(again)


SQL = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (
  SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, sha256(coalesce(text, '')) AS text_sha256
  FROM documents
  WINDOW w AS (PARTITION BY coalesce(text, ''))
)
"""


@query("op8_exact_dedup", SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"))
