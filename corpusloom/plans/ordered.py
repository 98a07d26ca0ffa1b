"""Order-dependent work without a single-task window.

A window over one hot key (or over the whole table) sorts that key in one task.
Here rows are range-partitioned on (keys, order), so a hot key is spread over
many slices.  The slices are stored once, which pins the slice number of every
row even when an executor is lost later.  What crosses a slice border is
one carry per slice; what a bounded frame needs from the block before is its
last few rows, copied in as context and dropped afterwards.

The input's plan runs once into a narrow table, from which Spark samples the
borders and cuts the slices.  Texts and other wide columns stay out of it and
meet their numbers in a join at the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F, types as TY

from corpusloom.session import scratch

BLOCK_ROWS = 100_000
#: Rows of a slice that the number of slices aims at.
SLICE_ROWS = 2_000_000
WIDE = (TY.StringType, TY.BinaryType, TY.ArrayType, TY.StructType)


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held.kept_at = path
    return held


def remove(df: DataFrame) -> None:
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df.kept_at)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def slices(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Range-partition on (keys, order) and pin the slice number as column ``_slice``.

    Slices are as many as shuffle partitions, or more where a slice would exceed SLICE_ROWS.
    """
    held = kept(df, "unordered")
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held.count() // SLICE_ROWS))
    cut = kept(held.repartitionByRange(n, *[F.col(c) for c in keys + order]).withColumn("_slice", F.spark_partition_id()), "slices")
    remove(held)
    return cut


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "rn") -> DataFrame:
    """Row number from 1 within ``keys`` by ``order``; ``order`` must be total within a key.

    Number = position inside (slice, key) + rows of the key in earlier slices.
    Only the first key of a slice can have earlier rows, and only as the last key
    of those slices, so the carries form a table of at most one row per slice.

    Wide columns beside keys and order are joined to the numbers by a 128-bit hash of their row, so only hashes are sorted; rows equal in
    all columns share out their numbers.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    if not any(isinstance(t, WIDE) for c, t in types.items() if c not in keys + order) or any(isinstance(t, (TY.MapType, TY.VariantType)) for t in types.values()):
        return _numbered(df, keys, order, name)
    hashed = df.withColumn("_a", F.xxhash64(F.lit(1), *df.columns)).withColumn("_b", F.xxhash64(F.lit(2), *df.columns))
    narrow = _numbered(hashed.select(*dict.fromkeys(keys + order), "_a", "_b"), keys, order, name)
    first = narrow.groupBy("_a", "_b").agg(F.min(name).alias("_first"))
    of_equal_rows = W.partitionBy("_a", "_b").orderBy(F.lit(0))
    return (hashed.join(first, ["_a", "_b"]).withColumn(name, F.col("_first") + F.row_number().over(of_equal_rows) - 1)
            .select(*df.columns, name))


def _numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    s = slices(df, keys, order).withColumn("_key", F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0))
    per_key = s.groupBy("_slice", "_key").agg(F.count("*").alias("n"))
    ends = per_key.groupBy("_slice").agg(
        F.min("_key").alias("first"), F.max("_key").alias("last"), F.max_by("n", "_key").alias("last_n"))
    edges = ends.select("_slice", F.col("first").alias("_key"), F.lit(0).cast("bigint").alias("n"),
                        F.lit(True).alias("head")).unionByName(
        ends.select("_slice", F.col("last").alias("_key"), F.col("last_n").alias("n"), F.lit(False).alias("head")))
    earlier = W.partitionBy("_key").orderBy("_slice").rangeBetween(W.unboundedPreceding, -1)
    carry = (edges.withColumn("carry", F.sum("n").over(earlier)).filter("head and carry > 0")
             .select("_slice", "_key", "carry"))
    local = W.partitionBy("_slice", "_key").orderBy(*[F.col(c) for c in order])
    return (s.withColumn("_local", F.row_number().over(local))
            .join(F.broadcast(carry), ["_slice", "_key"], "left")
            .withColumn(name, F.col("_local") + F.coalesce(F.col("carry"), F.lit(0)))
            .drop("_local", "carry", "_slice", "_key"))


def in_order(df: DataFrame, order: list[str], name: str = "rn", slices: int | None = None, of_slice: int = 64, rows: list[Column] | None = None) -> DataFrame:
    """All rows with their number from 1 by ``order``, sorted across the partitions, in one shuffle.

    Borders of the slices come from a sample of the order columns, as a range partitioning takes them; how many rows each slice holds is counted
    before anything is shuffled, so a row's number is known where it is sorted.  ``df`` is computed three times; it must give the same rows each time.
    With ``rows``, structs made of each row take its place, sorted among themselves; only the row they are made of is shuffled.
    """
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*[F.col(c) for c in order])
    total = df.select(*order).count()
    seen = df.select(key.alias("k")).sample(min(1.0, of_slice * n / max(total, 1)), seed=7).sort("k").toArrow().column("k").to_pylist() if total else []
    cuts = [seen[len(seen) * i // n] for i in range(1, n)] if len(seen) >= n else seen
    kind = f"array<{df.select(key.alias('k')).schema['k'].dataType.simpleString()}>"
    borders = df.sparkSession.createDataFrame([(cuts,)], f"c {kind}").select("c").scalar()
    d = df.withColumn("_borders", borders).withColumn("_slice", F.size(F.filter("_borders", lambda b: b <= key))).drop("_borders")
    counts = dict(map(tuple, d.groupBy("_slice").count().collect()))
    before = [sum(v for s, v in counts.items() if s < i) * len(rows or [1]) for i in range(len(cuts) + 1)]
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    sorted_ = d.repartitionById(len(before), F.col("_slice")).sortWithinPartitions(*order)
    if rows:
        sorted_ = sorted_.select("_slice", F.inline(F.array_sort(F.array(*rows))))
    return sorted_.withColumn("_local", local).withColumn(name, F.get(F.array(*[F.lit(b).cast("bigint") for b in before]), F.col("_slice")) + F.col("_local") + 1).drop("_slice", "_local")


def over_frames(df: DataFrame, keys: list[str], order: list[str], back: int,
                fn: Callable[[DataFrame, WindowSpec], DataFrame], block: int = BLOCK_ROWS) -> DataFrame:
    """Apply ``fn(df, window)`` where the window reaches at most ``back`` rows before the current one.

    Each key is cut into blocks of ``block`` rows; the last ``back`` rows of a block
    are repeated at the head of the next block, so every frame is whole.  Column
    ``rn`` (number within the key) is available to ``fn``.
    """
    if back >= block:
        raise ValueError("a frame must be shorter than a block")
    at = F.col("rn") - 1
    b = F.floor(at / block)
    rows = numbered(df, keys, order).withColumn("_block", F.explode(
        F.when(at % block >= block - back, F.array(b, b + 1)).otherwise(F.array(b))))
    rows = rows.withColumn("_context", F.col("_block") > b)
    window = W.partitionBy(*keys, "_block").orderBy("rn")
    return fn(rows, window).filter(~F.col("_context")).drop("_block", "_context")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, tie: str, qs: list[float]) -> DataFrame:
    """Exact, linearly interpolated quantiles per key: one column ``q<percent>`` each.

    Picks the rows at the needed ranks of a distributed sort; nothing is held per key.
    ``keys`` must have few values (it is the caller's list of metrics).
    """
    ranked = numbered(df.filter(F.col(value).isNotNull()), keys, [value, tie])
    total = ranked.groupBy(*keys).agg(F.count("*").alias("n"))
    want = total.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(q).alias("q"), ((F.col("n") - 1) * F.lit(q)).alias("at")) for q in qs])).alias("w"))
    want = want.select(*keys, "w.q", "w.at", F.explode(F.array(
        F.floor("w.at"), F.floor("w.at") + 1)).alias("lo")).withColumn("rn", F.col("lo") + 1)
    # a few ranks per key: the large side stays where it is
    got = ranked.select(*keys, "rn", value).join(F.broadcast(want), keys + ["rn"])
    part = F.col("at") - F.floor("at")
    weighted = F.when(F.col("lo") == F.floor("at"), F.col(value) * (1 - part)).otherwise(
        F.coalesce(F.col(value), F.lit(0.0)) * part)
    return got.groupBy(*keys).agg(*[
        F.sum(F.when(F.col("q") == q, weighted)).alias(f"q{round(q * 100)}") for q in qs])
