"""Language lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom import fixed_values as FV
from corpusloom.functions import text as T

DEFAULT_LANGUAGE = "en"


def name_of(code: Column) -> Column:
    return F.coalesce(T.lookup(code, {l[0]: l[1] for l in FV.LANGUAGES}), F.upper(code))


def family_of(code: Column) -> Column:
    return T.lookup(code, {l[0]: l[2] for l in FV.LANGUAGES}, "Unknown")


def script_of(code: Column) -> Column:
    return T.lookup(code, {l[0]: l[3] for l in FV.LANGUAGES}, "Unknown")


def language_table(spark: SparkSession) -> DataFrame:
    """The language dimension: a fixed table of one row per known language."""
    return spark.createDataFrame(
        [l[:4] for l in FV.LANGUAGES], "lang string, name string, family string, script string")


def with_language(df: DataFrame, col: str = "text") -> DataFrame:
    out = df.withColumn("_l", T.language_code(F.col(col)))
    code = F.col("_l.code")
    return (out.withColumn("language", code).withColumn("language_name", name_of(code))
            .withColumn("language_confidence", F.col("_l.confidence"))
            .withColumn("script", script_of(code)).withColumn("family", family_of(code)).drop("_l"))


def processing_language(code: Column, target: str | None = None) -> Column:
    """struct(language, note): the language whose rules are used and why."""
    if target:
        return F.struct(F.lit(target).alias("language"), F.lit(None).cast("string").alias("note"))
    known = code.isin(*[l[0] for l in FV.LANGUAGES if l[4]])
    note = F.concat(F.lit("No model for "), name_of(code), F.lit(", using English"))
    return F.struct(F.when(known, code).otherwise(F.lit(DEFAULT_LANGUAGE)).alias("language"),
                    F.when(~known, note).alias("note"))
