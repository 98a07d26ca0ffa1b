"""Version history of refined content, caches, and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from corpusloom.functions import text as T
from corpusloom.plans.ordered import numbered

ORDER = ["ts", "event_id"]


def assign_versions(df: DataFrame, key: str = "content_id", order=tuple(ORDER)) -> DataFrame:
    """Version number per content id by time.  A content id may hold any share of the rows."""
    return numbered(df, [key], list(order), "version")


def version_history(df: DataFrame, content_id, key: str = "content_id") -> DataFrame:
    return assign_versions(df.filter(F.col(key) == content_id), key).orderBy("version")


def compare_versions(df: DataFrame, v1: int, v2: int, key: str = "content_id", order=tuple(ORDER)) -> DataFrame:
    """Differences between two versions of every content id.

    Only the first max(v1, v2) rows of a content id matter; the rank limit is applied
    before the shuffle, so a hot id does not gather.
    """
    rank = F.row_number().over(W.partitionBy(key).orderBy(*order))
    first = df.withColumn("version", rank).filter(F.col("version") <= max(v1, v2))

    def side(v, p):
        return first.filter(F.col("version") == v).select(
            key, F.col("quality_gain").alias(f"{p}_gain"), F.col("refinement_type").alias(f"{p}_type"), F.col("ts").alias(f"{p}_ts"), F.col("content").alias(f"{p}_text"))

    j = side(v1, "a").join(side(v2, "b"), key)
    return j.select(key, F.col("a_type").alias("type1"), F.col("b_type").alias("type2"),
                    (T.n_words(F.col("b_text")) - T.n_words(F.col("a_text"))).alias("word_count_change"),
                    (F.col("b_gain") - F.col("a_gain")).alias("quality_change"),
                    (F.unix_micros("b_ts") - F.unix_micros("a_ts")).alias("time_difference_us"))


def refinement_statistics(df: DataFrame, key: str = "content_id") -> DataFrame:
    """Per content: count, gains, types, first and latest; the commonest type by count then name."""
    by_type = df.groupBy(key, "refinement_type").agg(
        F.count("*").alias("n"), F.sum("quality_gain").alias("gain"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return by_type.groupBy(key).agg(
        F.sum("n").alias("total_refinements"), F.sum("gain").alias("total_gain"),
        (F.sum("gain") / F.sum("n")).alias("average_gain"),
        F.array_join(F.array_sort(F.collect_set("refinement_type")), "|").alias("types"),
        F.min("first").alias("first"), F.max("last").alias("latest"),
        F.min_by("refinement_type", F.struct(-F.col("n"), F.col("refinement_type"))).alias("most_used"))


def refinement_overview(df: DataFrame) -> DataFrame:
    """Totals over all contents, with the commonest refinement type (first name on a tie)."""
    by_type = df.groupBy("refinement_type").agg(F.count("*").alias("n"), F.sum("quality_gain").alias("gain"))
    return by_type.agg(
        F.sum("n").alias("total_refinements"), F.sum("gain").alias("total_gain"), (F.sum("gain") / F.sum("n")).alias("average_gain"),
        F.min_by("refinement_type", F.struct(-F.col("n"), F.col("refinement_type"))).alias("most_used"))


def text_digest(c):
    return F.sha2(c, 256)


def reuse_cached_results(df: DataFrame, store: DataFrame, key: str, result: str, compute, col: str = "text") -> DataFrame:
    """Take stored results for known texts and compute the rest.

    ``store`` has columns digest and ``result``, one row per digest; the stored side of the join
    is digests and results only.  A text that a third of the rows share is a skewed key of the left side, which adaptive execution splits.
    """
    d = df.withColumn("digest", text_digest(F.col(col)))
    stored = store.select("digest", F.col(result).alias("_stored"), F.lit(True).alias("is_hit"))
    joined = d.join(stored, "digest", "left")
    return joined.withColumn("is_hit", F.coalesce("is_hit", F.lit(False))).withColumn(
        result, F.when(F.col("is_hit"), F.col("_stored")).otherwise(compute(F.col(col)))).drop("_stored")


def reconcile_counts(declared: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Keys whose declared count differs from the rows found."""
    actual = rows.groupBy(key).agg(F.count("*").alias("actual"))
    j = declared.join(actual, key, "full_outer")
    return j.withColumn("actual", F.coalesce("actual", F.lit(0))).withColumn("declared", F.coalesce("declared", F.lit(0))).filter("actual <> declared")


def dedupe_by_signature(df: DataFrame, q: str, a: str, order: list[str]) -> DataFrame:
    """First row of each (question, answer) signature: digests of the whole trimmed, lower-cased texts.

    A reducing aggregate: copies are dropped map-side, so a huge group of copies moves one row per task.
    """
    sig = [F.sha2(F.lower(T.trim_ws(F.col(c))), 256) for c in (q, a)]
    return df.groupBy(sig[0].alias("_q"), sig[1].alias("_a")).agg(
        F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_r")).select("_r.*")
