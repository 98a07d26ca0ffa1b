"""Registration of queries and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as TY

QUERIES: dict = {}
ORACLES: dict = {}


def tidy(df: DataFrame) -> DataFrame:
    """One number format for all results: BIGINT, DOUBLE rounded to 6 places."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (TY.ByteType, TY.ShortType, TY.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (TY.DoubleType, TY.FloatType, TY.DecimalType)):
            # + 0.0 turns a negative zero into zero
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None):
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf, fn=fn: tidy(fn(spark, sf))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap
