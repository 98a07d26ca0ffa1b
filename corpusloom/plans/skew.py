"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SPREAD = "spark.corpusloom.spreadSmallTables"


def salted_join(left: DataFrame, right: DataFrame, on: list[str], row_id: Column, how: str = "left", salts: int = 16) -> DataFrame:
    """Join a possibly skewed left side to a right side that is unique on ``on``.

    Every left row takes one of ``salts`` numbers from its id and the right rows are
    repeated once per number, so the hottest key is split over ``salts`` tasks.  ``row_id`` must be the same when a task runs again.
    Where adaptive execution splits skewed joins a plain join does as well.
    """
    spread = F.pmod(F.xxhash64(row_id), F.lit(salts))
    lhs = left.withColumn("_salt", spread)
    rhs = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return lhs.join(rhs, on + ["_salt"], how).drop("_salt")


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row as a scalar subquery (no join)."""
    value = one_row.select(F.struct(*one_row.columns).alias("_s")).scalar()
    return df.withColumn("_one", value).select(*df.columns, "_one.*")


def spread(df: DataFrame) -> DataFrame:
    """Deal a table out over the cores where the session asks for it (``SPREAD``): local sessions over tables of one row group.

    Without that setting a table is read as its files are split, whatever the cluster.
    """
    if df.sparkSession.conf.get(SPREAD, "0") == "0":
        return df
    return df.repartition(int(df.sparkSession.conf.get(SPREAD)))
