"""Cleaning, filters and routing: row-wise, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusloom.functions import scores as S, text as T


def sanitize(df: DataFrame, col: str = "text") -> DataFrame:
    return df.withColumn("_s", T.sanitize_text(F.col(col))).select(
        *[c for c in df.columns if c != col], "_s.is_valid", F.col("_s.text").alias(col), "_s.error")


def drop_headers_footers(df: DataFrame, col: str = "text") -> DataFrame:
    return df.select("doc_id", F.posexplode(T.meaningful_paragraphs(F.col(col))).alias("_p", "paragraph")).select(
        "doc_id", (F.col("_p") + 1).alias("para_no"), "paragraph")


def valid_qa(q, a):
    q, a = T.trim_ws(q), T.trim_ws(a)
    return (F.length(q) >= 10) & (F.length(a) >= 20) & (q != a)


def valid_qa_pairs(df: DataFrame, q: str = "question", a: str = "answer") -> DataFrame:
    return df.filter(valid_qa(F.col(q), F.col(a)))


def select_high_quality(df: DataFrame, at: float = 0.6) -> DataFrame:
    """Rows scored by ``with_quality`` that are good or rich in dialogue."""
    return df.filter((F.col("quality_score") > at) | (F.col("dialogue_potential") > at))


def select_complex(df: DataFrame, at: float = 0.5) -> DataFrame:
    return df.filter(F.col("complexity") > at)


def sanitize_output(df: DataFrame, text: str, metadata: str, score: str, longest: int | None = None, longest_value: int | None = None) -> DataFrame:
    """Scores that are no numbers become 0; texts and metadata values are cut only to lengths that the caller gives."""
    def cut(c, n):
        return F.substring(c, 1, n) if n else c

    return (df.withColumn(text, cut(F.col(text), longest))
            .withColumn(metadata, F.transform_values(metadata, lambda k, v: cut(v, longest_value)))
            .withColumn(score, F.coalesce(F.col(score).try_cast("double"), F.lit(0.0))))


def route_by_quality(df: DataFrame, enabled: bool = True) -> DataFrame:
    return df.withColumn("route", S.route(F.col("quality_score"), enabled))


def processing_defaults(df: DataFrame) -> DataFrame:
    """Suggested settings from columns complexity, polarity and has_qa."""
    x, p = F.col("complexity"), F.col("polarity")
    return (
        df.withColumn("suggested_length", F.when(x > 0.7, F.lit("detailed")).when(x < 0.3, F.lit("short"))
                      .otherwise(F.lit("medium")))
        .withColumn("complexity_note", F.when(x > 0.7, F.lit("Complex content - may need detailed explanation"))
                    .when(x < 0.3, F.lit("Simple content - can be concise")))
        .withColumn("tone_note", F.when(F.abs(p) > 0.3, F.concat(
            F.lit("Content has "), F.when(p > 0, F.lit("positive")).otherwise(F.lit("negative")), F.lit(" sentiment"))))
        .withColumn("format_suggestion", F.when(F.col("has_qa"), F.lit("Consider Q&A format preservation"))))


def apply_review_decisions(items: DataFrame, decisions: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Join reviewers' decisions (one per key): skipped rows go, edited texts replace the original."""
    joined = items.join(decisions, key, "left")
    return (joined.filter(F.coalesce(F.col("decision"), F.lit("pending")) != "skip")
            .withColumn("edited", F.col("edited_text").isNotNull())
            .withColumn(text, F.coalesce("edited_text", text))
            .withColumn("decision", F.coalesce("decision", F.lit("pending"))).drop("edited_text"))


def pending_recommendations(recs: DataFrame, applied: DataFrame, key: list[str], order: list[str],
                            keep: int = 50) -> DataFrame:
    """Recommendations not yet applied; the newest ``keep`` by a distributed top-k."""
    left = recs.join(applied, key, "left_anti")
    return left.orderBy(*[F.col(c).desc() for c in order]).limit(keep)
