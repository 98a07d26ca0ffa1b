"""SQL names for the text functions, as temporary SQL functions (no Python in the plan)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from corpusloom import fixed_values as FV

# name: (arguments, return type, SQL body)
SQL_FUNCTIONS = {
    "text_words": ("t STRING", "ARRAY<STRING>", r"filter(split(t, '\\s+'), w -> w <> '')"),
    "text_word_count": ("t STRING", "INT", r"regexp_count(t, '\\S+')"),
    "text_sentences": ("t STRING", "ARRAY<STRING>", r"filter(transform(split(t, '[.!?]+'), s -> regexp_replace(s, '^\\s+|\\s+$', '')), s -> s <> '')"),
    "text_reading_minutes": ("t STRING", "DOUBLE", r"regexp_count(t, '\\S+') / 200"),
    "text_jaccard": ("a STRING, b STRING", "DOUBLE", r"size(array_intersect(filter(split(lower(a), '\\s+'), w -> w <> ''), filter(split(lower(b), '\\s+'), w -> w <> ''))) / greatest(size(array_union(filter(split(lower(a), '\\s+'), w -> w <> ''), filter(split(lower(b), '\\s+'), w -> w <> ''))), 1)"),
    "quality_grade": ("score DOUBLE", "STRING", "CASE " + " ".join(f"WHEN score >= {at} THEN '{g}'" for at, g in FV.QUALITY_GRADES) + f" ELSE '{FV.LOWEST_GRADE}' END"),
    "quality_route": ("score DOUBLE", "STRING", f"CASE WHEN score >= {FV.AUTO_APPROVE_AT} THEN 'auto_approve' WHEN score >= {FV.MANUAL_REVIEW_AT} THEN 'manual_review' ELSE 'reject' END"),
    "length_ratio_score": ("r DOUBLE", "DOUBLE", f"greatest(0.0D, least(1.0D, 1.0D - abs(r - {FV.PAIR_RATIO_BEST}D) / {FV.PAIR_RATIO_BEST}D))"),
}


def register_text_functions(spark: SparkSession) -> list[str]:
    for name, (args, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return list(SQL_FUNCTIONS)
