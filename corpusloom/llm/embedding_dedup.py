"""Near-duplicate vectors by random-hyperplane sign hashing (operator 13).

Each of several tables keys a vector by the sides it lies on of a few random hyperplanes.  Vectors of one label that share a bucket of some table are
compared by exact cosine in double precision; the links found join vectors into components.

Equal vectors of a label are one node from the start, so copies cost nothing after that.  Buckets are cut into blocks and compared block by
block, and of each comparison only a row per vector leaves its task: how many links it found, and a vector it is connected with.  A pair counts in
the first table whose bucket it shares, so link counts are exact over all tables although no pair is ever written down.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.common import query, stored
from corpusloom.llm.minhash import components

#: Vectors of a block.
BLOCK = 1024
#: Cells up to this size are compared together, pair distance by pair distance; larger ones by a matrix product each.
SMALL = 48


@dataclass(frozen=True)
class Planes:
    """``tables`` tables of ``bits`` hyperplanes each, drawn from ``seed``.  At cosine 0.98 one bit agrees in 0.936 of all cases, so 16 tables of
    16 bits miss 0.1 % of the pairs at the limit and fewer above it."""

    tables: int = 16
    bits: int = 16
    seed: int = 13

    def normals(self, dim: int) -> np.ndarray:
        return _normals(self, dim)

    def keys(self, v: np.ndarray) -> np.ndarray:
        """For each row of ``v`` its key in each table."""
        side = (v @ self.normals(v.shape[1]) > 0).reshape(len(v), self.tables, self.bits)
        return (side * (1 << np.arange(self.bits, dtype=np.int64))).sum(axis=2)


@lru_cache(64)
def _normals(planes: Planes, dim: int) -> np.ndarray:
    return np.random.default_rng([planes.seed, dim]).standard_normal((dim, planes.tables * planes.bits))


def finite(vector: Column) -> Column:
    """True for a vector that is not null and holds no null and no non-finite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine, F.lit(False))


def vectors_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each dimension that a column of lists has, with the matrix of their components."""
    at = np.append(column.offsets.to_numpy(), 0)[:len(column) + 1].astype(np.int64)
    values, size = column.values.to_numpy(zero_copy_only=False), np.diff(at)
    for dim in np.unique(size).tolist():
        rows = np.flatnonzero(size == dim)
        yield rows, values[at[rows][:, None] + np.arange(dim)].astype(np.float64)


def unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors scaled by powers of two, so that squares neither overflow nor vanish, and their lengths."""
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, initial=1e-308))[1][:, None])
    return v, np.sqrt(np.einsum("ij,ij->i", v, v))


def _links(v: np.ndarray, cell: np.ndarray, block: np.ndarray, cross: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs within a cell whose cosine is at least ``least``; in a cell of two blocks only pairs across them."""
    v, norm = unit(v)
    edge = np.append(0, np.flatnonzero(cell[1:] != cell[:-1]) + 1)
    size = np.diff(np.append(edge, len(cell)))
    small = np.repeat((size <= SMALL) & ~cross[edge], size)
    for apart in range(1, SMALL):
        a = np.flatnonzero((cell[apart:] == cell[:-apart]) & small[apart:])
        if not len(a):
            break
        b = a + apart
        hit = np.einsum("ij,ij->i", v[a], v[b]) >= least * norm[a] * norm[b]
        yield a[hit], b[hit]
    for k in np.flatnonzero((size > SMALL) | cross[edge]):
        mine = np.arange(edge[k], edge[k] + size[k])
        if cross[edge[k]]:
            first = block[mine] == block[mine].min()
            one, two = mine[first], mine[~first]
            a, b = np.nonzero(v[one] @ v[two].T >= least * norm[one][:, None] * norm[two])
            yield one[a], two[b]
        else:
            a, b = np.nonzero(np.triu(v[mine] @ v[mine].T >= least * norm[mine][:, None] * norm[mine], 1))
            yield mine[a], mine[b]


def _compare(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    held: pa.Table | None = None

    def told(t: pa.Table) -> pa.RecordBatch:
        c = {x: t.column(x).combine_chunks() for x in t.column_names}
        n = t.num_rows
        keys = np.asarray(c["keys"].flatten()).reshape(n, -1)
        table, copies, cell, block = (c[x].to_numpy() for x in ("tab", "copies", "cell", "block"))
        cross = c["cross"].to_numpy(zero_copy_only=False)
        links, head = np.zeros(n, np.int64), np.arange(n)
        for rows, v in vectors_of(c["v"]):
            pairs = []
            for a, b in _links(v, cell[rows], block[rows], cross[rows], least):
                a, b = rows[a], rows[b]
                new = np.argmax(keys[a] == keys[b], axis=1) == table[a]  # no earlier table has the pair
                pairs.append((a[new], b[new]))
            a, b = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
            links += np.bincount(a, copies[b], minlength=n).astype(np.int64) + np.bincount(b, copies[a], minlength=n).astype(np.int64)
            while True:  # the smallest position that links lead to
                low = np.minimum(head[a], head[b])
                new = head.copy()
                np.minimum.at(new, a, low)
                np.minimum.at(new, b, low)
                new = new[new]
                if (new == head).all():
                    break
                head = new
        has = np.flatnonzero(links)
        return pa.record_batch({"node": c["node"].take(pa.array(has)), "links": pa.array(links[has]), "head": c["node"].take(pa.array(head[has]))})

    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        cell = held.column("cell").to_numpy()
        cut = np.flatnonzero(cell[1:] != cell[:-1])
        if len(cut):  # the last cell may go on in the next batch
            yield told(held.slice(0, int(cut[-1]) + 1))
            held = held.slice(int(cut[-1]) + 1)
    if held is not None and held.num_rows:
        yield told(held)


def near_vectors(vectors: DataFrame, least: float = 0.98, planes: Planes = Planes(), vec_id: str = "vec_id", vector: str = "embedding",
                 label: str = "label") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links (other rows linked directly), component_id (smallest id that links lead to), kept.

    Rows are compared within a label and a dimension.  Rows without a label or an id, and vectors that are null, zero, empty or not finite, link with
    nothing; a row without an id has no component and is kept.  Rows that repeat with id and vector are all returned, linked with each other.
    """
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    v = F.col(vector).cast("array<double>")
    takes = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & finite(v) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    node = F.concat(F.hex(F.xxhash64(F.lit(1), label, v)), F.lit("-"), F.hex(F.xxhash64(F.lit(2), label, v)))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.when(takes, node).alias("node"), F.when(takes, v).alias("v"), F.col(label).alias("label"))

    def signed(batches):
        for b in batches:
            keys = np.zeros((b.num_rows, planes.tables), np.int64)
            for at, m in vectors_of(b.column(b.schema.get_field_index("v"))):
                keys[at] = planes.keys(unit(m)[0])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys.tolist(), pa.list_(pa.int64()))], names=[*b.schema.names, "keys"])

    nodes = (rows.filter(F.col("node").isNotNull()).groupBy("node")
             .agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v")))
    kinds = nodes.schema.simpleString().removeprefix("struct<").removesuffix(">")
    nodes = stored(nodes.mapInArrow(signed, f"{kinds},keys:array<bigint>"), "vector-nodes")

    key = ["label", "dim", "tab", "key"]
    entries = nodes.select("node", "label", F.size("v").alias("dim"), F.posexplode("keys").alias("tab", "key"))
    blocks = entries.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n")).filter("n > 1").drop("n")
    met = entries.join(blocks, key).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    met = met.select("node", *key, "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_other"))
    low, high = F.least("block", "_other"), F.greatest("block", "_other")
    cells = met.select("node", "tab", "block", (low != high).alias("cross"), F.xxhash64(*key, low, high).alias("cell"))
    beside = cells.join(nodes.select("node", "copies", "v", "keys"), "node").repartition(parts, "cell").sortWithinPartitions("cell")
    found = stored(beside.mapInArrow(lambda batches: _compare(batches, least), "node string, links long, head string"), "vector-links")

    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.filter("node <> head").select("node", F.col("head").alias("other")).distinct()
    cls = components(edges)
    first = cls.join(nodes.select("node", "id"), "node").groupBy("class").agg(F.min("id").alias("first"))
    per_node = (nodes.select("node", "id", "copies").join(linked, "node", "left").join(cls.join(first, "class").select("node", "first"), "node", "left")
                .select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("first", "id").alias("component_id")))
    return (rows.select("vec_id", "node").join(per_node, "node", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))


@query("op13_embedding_near_dedup")
def op13_embedding_near_dedup(spark, sf_dir):
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
