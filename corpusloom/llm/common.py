"""Pieces that the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.session import scratch

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """Write once to the shared folder and read back: lineage ends here, and lost executors cost no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held.stored_at = path
    return held


def forget(*tables: DataFrame) -> None:
    """Delete the files of stored tables that nothing will read again."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def stored_by(df: DataFrame, name: str, key: str, buckets: int, **options) -> DataFrame:
    """Like ``stored``, in buckets of ``key``: joins on it need not move these rows again.

    The bucketing is known to the session's catalog only, under a name of its own; the files lie in the shared folder.
    """
    table = fresh(name.replace("-", "_"))
    (df.write.options(**options).bucketBy(buckets, key).option("path", scratch(df.sparkSession, name)).format("parquet").saveAsTable(table))
    return df.sparkSession.table(table)


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores behind it as make it differ from the names taken, letter case aside."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def fresh(prefix: str) -> str:
    """A column name that no table of the caller has."""
    return f"_{prefix}_{uuid.uuid4().hex[:8]}"
