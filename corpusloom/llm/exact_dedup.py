"""Exact de-duplication of texts (operator 4).

Texts are grouped by a 128-bit content hash together with the text itself, so the grouping compares bytes and a
hash collision cannot join two texts.  Copies are merged map-side before the one shuffle of texts; after it only
(hash, id, count) rows move.  A hot group of copies is one row per task when it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.common import documents, query, stored, text_of


def text_groups(docs: DataFrame, text: Column, doc_id: str = "doc_id", keep: str = "largest",
                digest=F.md5, name: str = "exact-groups") -> DataFrame:
    """One row per distinct text: digest, keep_id, group_size, texts_of_digest (over 1 only on a collision), and the text then.

    ``keep`` is "smallest" or "largest": which id of a group stays.  Rows without an id stay only when no copy has one.
    """
    best = {"smallest": F.min, "largest": F.max}[keep](F.col(doc_id))
    per_text = (docs.select(F.col(doc_id), digest(text).alias("digest"), text.alias("text"))
                .groupBy("digest", "text").agg(best.alias("keep_id"), F.count("*").alias("group_size")))
    # one row per digest unless two texts collide: then every text of the digest is kept beside it
    per_digest = per_text.groupBy("digest").agg(
        F.count("*").alias("texts_of_digest"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
    return stored(per_digest, name)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "largest", digest=F.md5,
          carry: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` with keep_id, group_size and kept.

    Null texts count as empty texts.  Repeated rows with the same id and text are copies of each other: all of them
    are ``kept`` together when their id stays.  ``carry`` names the columns to return (default: the id); the text may be one.
    An empty table gives an empty result.
    """
    carry = [doc_id] if carry is None else carry
    t = text_of(text)
    groups = text_groups(docs, t, doc_id, keep, digest)
    rows = docs.select(*carry, *([doc_id] if doc_id not in carry else []), digest(t).alias("_digest"), t.alias("_text"))
    if groups.filter("texts_of_digest > 1").isEmpty():
        found = groups.select(F.col("digest").alias("_digest"), "keep_id", "group_size")
        out = rows.join(found, "_digest")
    else:  # different texts share a digest: join on the bytes as well
        best = {"smallest": F.min, "largest": F.max}[keep](F.col(doc_id))
        found = rows.groupBy("_digest", "_text").agg(best.alias("keep_id"), F.count("*").alias("group_size"))
        out = rows.join(found, ["_digest", "_text"])
    return out.withColumn("kept", F.col("keep_id").eqNullSafe(F.col(doc_id))).drop("_digest", "_text")


@query("op4_exact_dedup", """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))""")
def op4_exact_dedup(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", F.sha2(text_of(), 256).alias("text_sha256"))
    return dedup(docs, carry=["doc_id", "text_sha256"]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
