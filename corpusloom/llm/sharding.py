"""Sharding over fixed virtual slots (operator 3).

Records are hashed into a fixed number of virtual slots, bytes are summed per slot, and a versioned map says which
shard owns which slot.  Rebalancing edits the map: it moves few slots from heavy shards to light ones and leaves the
rest where they are.  The map has one row per virtual slot, so its size is a parameter and does not grow with the data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from corpusloom.llm.common import documents, query, text_of
from corpusloom.session import scratch

VIRTUAL_SLOTS = 8192
MAP_SCHEMA = "version int, virtual_slot int, shard int"


@dataclass(frozen=True)
class SlotMap:
    """Owner of every virtual slot at one version."""

    version: int
    owner: tuple[int, ...]

    @staticmethod
    def first(shards: int, slots: int = VIRTUAL_SLOTS) -> SlotMap:
        return SlotMap(1, tuple(s % shards for s in range(slots)))

    def loads(self, weight: list[int], shards: int) -> list[int]:
        total = [0] * shards
        for slot, shard in enumerate(self.owner):
            total[shard] += weight[slot]
        return total

    def rebalanced(self, weight: list[int], shards: int) -> SlotMap:
        """Next version for ``shards`` shards: move slots from the heaviest to the lightest shard while that evens them out.

        A move takes the slot whose weight is nearest to half the difference.  Slots of shards that no longer
        exist go first.  Weights are bytes per slot; the work is bounded by the number of slots.
        """
        owner, load = list(self.owner), [0] * shards
        held: list[list[int]] = [[] for _ in range(shards)]
        homeless = []
        for slot, shard in enumerate(owner):
            if shard < shards:
                held[shard].append(slot)
                load[shard] += weight[slot]
            else:
                homeless.append(slot)
        for slot in sorted(homeless, key=lambda s: (-weight[s], s)):
            to = min(range(shards), key=lambda k: (load[k], k))
            owner[slot], load[to] = to, load[to] + weight[slot]
            held[to].append(slot)
        for _ in range(4 * len(owner)):
            high = max(range(shards), key=lambda k: (load[k], -k))
            low = min(range(shards), key=lambda k: (load[k], k))
            gap = load[high] - load[low]
            fits = [s for s in held[high] if 0 < weight[s] < gap]
            if not fits:
                break
            slot = min(fits, key=lambda s: (abs(2 * weight[s] - gap), s))
            held[high].remove(slot)
            held[low].append(slot)
            owner[slot] = low
            load[high] -= weight[slot]
            load[low] += weight[slot]
        return SlotMap(self.version + 1, tuple(owner))

    def write(self, spark: SparkSession, path: str) -> None:
        """Append this version to the table of maps at ``path``."""
        rows = [(self.version, slot, shard) for slot, shard in enumerate(self.owner)]
        spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").parquet(path)

    @staticmethod
    def read(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The given version, or the newest."""
        table = spark.read.schema(MAP_SCHEMA).parquet(path)
        version = version or table.agg(F.max("version")).first()[0]
        rows = table.filter(F.col("version") == version).select("virtual_slot", "shard").collect()
        return SlotMap(version, tuple(shard for _, shard in sorted(rows)))


def virtual_slot(*key: Column, slots: int = VIRTUAL_SLOTS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


def slot_weights(rows: DataFrame, size: str = "size", slots: int = VIRTUAL_SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows per virtual slot; one record per slot comes to the driver."""
    weight, count = [0] * slots, [0] * slots
    for slot, b, n in rows.groupBy("virtual_slot").agg(F.sum(size), F.count("*")).collect():
        weight[slot], count[slot] = b, n
    return weight, count


def placed(rows: DataFrame, owner: SlotMap, count: list[int], order: list[str]) -> DataFrame:
    """Add shard and slot, the row's place in its shard without gaps from 0.

    A shard lists its virtual slots in turn, so a place is the rows of its earlier slots plus the rank inside
    the slot: the window sorts one of thousands of slots, never a shard.
    """
    before: dict[int, int] = {}
    table = []
    for slot, shard in enumerate(owner.owner):
        table.append((slot, shard, before.get(shard, 0)))
        before[shard] = before.get(shard, 0) + count[slot]
    where = rows.sparkSession.createDataFrame(table, "virtual_slot int, shard int, _before long")
    rank = F.row_number().over(W.partitionBy("virtual_slot").orderBy(*order))
    return (rows.withColumn("_rank", rank).join(F.broadcast(where), "virtual_slot")  # as many rows as slots
            .withColumn("slot", F.col("_before") + F.col("_rank") - 1).drop("_rank", "_before"))


def shard_documents(docs: DataFrame, shards: int, slots: int = VIRTUAL_SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard, slot and map_version of every row.

    Size is the UTF-8 bytes of the text plus 16.  A null text has no bytes; a null id is a key like any other.
    Records with the same id and text share a virtual slot.  The map starts with the slots dealt in turn and is
    edited once for the bytes measured; with ``map_path`` both versions are kept there.
    """
    spark = docs.sparkSession
    crc = F.crc32(text_of())
    rows = docs.select("doc_id", (F.octet_length(text_of()) + 16).cast("long").alias("size"), crc.alias("text_crc32"),
                       virtual_slot(F.col("doc_id"), crc, slots=slots).alias("virtual_slot"))
    weight, count = slot_weights(rows, slots=slots)
    old = SlotMap.first(shards, slots)
    new = old.rebalanced(weight, shards)
    if map_path:
        old.write(spark, map_path)
        new.write(spark, map_path)
        new = SlotMap.read(spark, map_path)
    return placed(rows, new, count, ["doc_id", "text_crc32", "size"]).withColumn("map_version", F.lit(new.version))


@query("op3_sharding")
def op3_sharding(spark, sf_dir):
    out = shard_documents(documents(spark, sf_dir), 40, map_path=scratch(spark, "slot-map"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
