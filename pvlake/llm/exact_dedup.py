"""Operator 4, exact dedup: 128-bit content hash, smallest stable id, bytes compared inside groups.

Texts are equal when they are identical after each run of white space is replaced by one space.
The hash groups rows with partial aggregation, so a group that holds a third of all rows is counted
before the shuffle. Only the texts of groups with two rows or more move, to be compared with the
text of the row that stays; a text that differs in spite of an equal hash forms a group of its own.

Defined results: null text counts as empty; empty texts are equal to each other; rows that repeat a
doc_id count one by one (one of them stays); rows without doc_id come after all others; an empty
table gives no rows; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pvlake.llm.common import WS, documents, id_and_text, whole_text
from pvlake.session import materialize

#: Group hashes up to this count (24 bytes each) are broadcast; beyond it the join shuffles.
BROADCAST_GROUPS = 500_000


def exact_dedup(docs: DataFrame, hash_bits: int = 128) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``hash_bits`` below 128 truncates the content hash; tests use it to force collisions.
    """
    norm = F.regexp_replace(whole_text(), WS, " ")
    rows = materialize(
        id_and_text(docs).select(
            F.monotonically_increasing_id().alias("rid"), "doc_id", norm.alias("norm"),
        ).select(
            "rid", "doc_id", "norm",
            F.substring(F.unhex(F.md5("norm")), 1, hash_bits // 8).alias("key"),
            F.sha2("norm", 256).alias("text_sha256"),
        ), "llm-exact")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")
    groups = rows.groupBy("key").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    several = materialize(groups.where("n > 1").select("key", F.col("first.rid").alias("first_rid")), "llm-exact-groups")
    if several.count() <= BROADCAST_GROUPS:
        several = F.broadcast(several)
    members = rows.select("rid", "key", "norm").join(several, "key")
    first = members.where("rid = first_rid").select("key", F.col("norm").alias("first_norm"))
    # bytes are compared here; hash equality alone never drops a row
    collided = members.where("rid != first_rid").join(first, "key").where("norm != first_norm").select(
        "rid", F.concat(F.lit("="), "norm").alias("other"))
    judged = materialize(rows.drop("norm").join(collided, "rid", "left").withColumn("other", F.coalesce("other", F.lit(""))), "llm-exact-judged")
    # both sides of the join below are written, so a group with a third of all rows can be split
    final = materialize(judged.groupBy("key", "other").agg(F.min(order).alias("first"), F.count("*").alias("group_size")), "llm-exact-final")
    return judged.join(final, ["key", "other"]).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size",
        (F.col("rid") == F.col("first.rid")).alias("kept"), "text_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM n
"""
