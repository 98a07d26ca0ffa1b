"""The minimum end-to-end plan: clean, chunk, score, route, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusloom.functions import scores as S, text as T
from corpusloom.operators import chunking, cleaning


def quality_by_route(documents: DataFrame) -> DataFrame:
    """Count, mean quality and mean words of sentence chunks by language and route.

    Scan, projection and generator run in one stage; the only shuffle is the
    partially aggregated (lang, route) report.
    """
    clean = documents.select("doc_id", "lang", T.normalize_text(F.col("text")).alias("text"))
    chunks = chunking.chunk_by_sentences(clean, 1000, keep=("doc_id", "lang"))
    scored = cleaning.route_by_quality(S.with_quality(chunks))
    return scored.groupBy("lang", "route").agg(
        F.count("*").alias("n"), F.avg("quality_score").alias("mean_quality"),
        F.avg("word_count").alias("mean_words")).orderBy("lang", "route")
