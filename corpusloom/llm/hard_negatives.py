"""Hard negatives for anchors by slot-decomposed selection (operator 11).

An anchor's positives are the rows of its label that score best with it.  Each positive asks for the best rows of other labels whose score lies in a
window below the positive's own.  The windows of an anchor overlap; their upper limits cut the scores into disjoint slots.  Every row falls into one
slot, each task keeps the best few of each slot, and what the tasks kept is combined.  A window's answer is then the best of its own slot and all
slots below, merged slot by slot, without what lies under its lower limit: one pass over the rows answers all windows.

Anchors and rows are dealt into a grid of cells; in a cell the rows stream past a bounded block of anchors.  Scores are integer inner products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corpusloom.llm.common import query, stored
from corpusloom.llm.embedding_dedup import finite, vectors_of

#: Anchors of a block, rows that one block meets in a task, and rows of one matrix product.
ANCHORS, ROWS, STEP = 4096, 1 << 20, 512
#: Groups of labels that anchors meet their positives in.
LABEL_GROUPS = 64
MOST = (1 << 63) - 1


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers held as doubles, exact: as doubles where these hold every sum, else by Python integers, cut to the bounds of a long."""
    bound = float(a.shape[1]) * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if bound < 2.0**53:
        return a @ b.T
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    return np.clip(whole(a) @ whole(b).T, -MOST, MOST).astype(np.int64)


class Best:
    """The ``k`` best rows of each slot of each anchor of a block, from rows that come by ascending id."""

    def __init__(self, k: int, same: bool, v: np.ndarray, key: np.ndarray, label: np.ndarray, upper: np.ndarray, floor: np.ndarray):
        self.k, self.same, self.v, self.key, self.label, self.upper, self.floor = k, same, v, key, label, upper, floor
        self.least = np.full(upper.shape, -MOST - 1, np.int64)  # a full slot's last score
        self.kept = np.zeros((0, 5), np.int64)  # anchor, slot, score, id, tie

    def offer(self, v: np.ndarray, key: np.ndarray, label: np.ndarray) -> None:
        for at in range(0, len(v), STEP):
            mine, of = key[at:at + STEP], label[at:at + STEP]
            s = products(self.v, v[at:at + STEP])
            fits = ((self.label[:, None] == of) == self.same) & (s <= self.upper[:, :1]) & (s >= self.floor[:, None]) & (s > self.least.min(axis=1)[:, None])
            if self.same:  # other rows than the anchor itself
                fits &= (self.key[:, 0, None] != mine[:, 0]) | (self.key[:, 1, None] != mine[:, 1])
            a, j = np.nonzero(fits)
            score = s[a, j].astype(np.int64)
            slot = (score[:, None] <= self.upper[a]).sum(axis=1) - 1
            new = score > self.least[a, slot]
            found = np.column_stack([a, slot, score, mine[j]])[new].astype(np.int64)
            if len(found):
                self._merge(np.concatenate([self.kept, found]))

    def _merge(self, rows: np.ndarray) -> None:
        rows = rows[np.lexsort((rows[:, 4], rows[:, 3], -rows[:, 2], rows[:, 1], rows[:, 0]))]
        group = rows[:, 0] * self.upper.shape[1] + rows[:, 1]
        head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        rank = np.arange(len(rows)) - np.repeat(head, np.diff(np.append(head, len(rows))))
        last = rows[rank == self.k - 1]
        self.least[last[:, 0], last[:, 1]] = last[:, 2]
        self.kept = rows[rank < self.k]

    def told(self) -> np.ndarray:
        """Anchor's id and tie, the slot's upper limit, score, id and tie of each row kept."""
        a, slot = self.kept[:, 0], self.kept[:, 1]
        return np.column_stack([self.key[a], self.upper[a, slot], self.kept[:, 2:]])


KEPT = ("anchor_id", "anchor_tie", "upper", "score", "id", "tie")


def _cells(batches: Iterator[pa.RecordBatch], k: int, same: bool, scale: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell, anchors of a cell before its rows: what each cell keeps."""
    cell, waiting, blocks = None, [], {}

    def close() -> pa.RecordBatch:
        kept = [b.told() for b in blocks.values()]
        kept = np.concatenate(kept) if kept else np.zeros((0, len(KEPT)), np.int64)
        return pa.record_batch({n: pa.array(kept[:, i]) for i, n in enumerate(KEPT)})

    def open_blocks() -> None:
        anchors = pa.concat_tables(waiting).combine_chunks()
        column = lambda n: anchors.column(n).combine_chunks()
        key = np.column_stack([column("vec_id").to_numpy(), column("tie").to_numpy()])
        limits, at = column("uppers").values.to_numpy(), column("uppers").offsets.to_numpy().astype(np.int64)
        many = np.diff(at)
        wide = int(many.max())
        # descending; anchors of fewer windows repeat the first limit, which makes empty slots
        upper = limits[at[:-1, None] + np.maximum(0, np.arange(wide) - (wide - many)[:, None])]
        label, floor = column("label").to_numpy(), column("floor").to_numpy()
        for rows, v in vectors_of(column("v")):
            blocks[v.shape[1]] = Best(k, same, np.floor(v * scale), key[rows], label[rows], upper[rows], floor[rows])
        waiting.clear()

    for batch in batches:
        cells = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)] if len(cells) else [0]
        for at, stop in zip(cuts, cuts[1:]):
            if cells[at] != cell:
                if cell is not None:
                    yield close()
                cell, waiting, blocks = cells[at], [], {}
            part = pa.Table.from_batches([batch.slice(at, stop - at)])
            anchors = int(np.count_nonzero(~part.column("is_row").to_numpy()))
            if anchors:
                waiting.append(part.slice(0, anchors))
            rows = part.slice(anchors)
            if rows.num_rows and waiting:
                open_blocks()
            if rows.num_rows and blocks:
                column = lambda n: rows.column(n).combine_chunks()  # noqa: E731, B023
                key, label = np.column_stack([column("vec_id").to_numpy(), column("tie").to_numpy()]), column("label").to_numpy()
                for mine, v in vectors_of(column("v")):
                    if v.shape[1] in blocks:
                        blocks[v.shape[1]].offer(np.floor(v * scale), key[mine], label[mine])
    if cell is not None:
        yield close()


def _meet(anchors: DataFrame, rows: DataFrame, part: Column, parts: int, n_anchors: int, n_rows: int, k: int, same: bool, scale: float) -> DataFrame:
    """The ``k`` best of each slot of each anchor over all rows of the same ``part``, combined over the cells."""
    across = max(1, -(-n_anchors // ANCHORS))
    down = max(-(-n_rows // ROWS), -(-3 * parts // across))
    dealt = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id", "tie"), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    one = anchors.withColumn("_r", each(down)).withColumn("_a", dealt(across, 1)).withColumn("is_row", F.lit(False))
    two = rows.withColumn("_a", each(across)).withColumn("_r", dealt(down, 2)).withColumn("is_row", F.lit(True))
    two = two.withColumn("uppers", F.lit(None).cast("array<long>")).withColumn("floor", F.lit(None).cast("long"))
    cell = (part * F.lit(across) + F.col("_a")) * F.lit(down) + F.col("_r")
    columns = [cell.alias("cell"), "is_row", "vec_id", "tie", "label", "v", "uppers", "floor"]
    met = one.select(*columns).unionByName(two.select(*columns))
    met = met.repartition(parts, "cell").sortWithinPartitions("cell", "is_row", "vec_id", "tie")
    kept = met.mapInArrow(lambda b: _cells(b, k, same, scale), ", ".join(f"{n} long" for n in KEPT))
    best = W.partitionBy("anchor_id", "anchor_tie", "upper").orderBy(F.desc("score"), "id", "tie")
    return kept.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= k).drop("_rank")


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: tuple[int, int] = (50, 100), high: tuple[int, int] = (95, 100),
         scale: float = 256.0, vec_id: str = "vec_id", vector: str = "embedding", label: str | Column = "label") -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` is a condition on the columns of ``vectors``.  Components are scaled and rounded down; a score is the integer inner product, higher first,
    ties by smaller id.  An anchor's positives are its first other rows of its label, fewer where there are no more.  A positive's negatives are the
    first rows of other labels whose score lies between the fractions ``low`` and ``high`` of the positive's; an empty window has none.

    Rows without an id or a label, and vectors that are null or not finite, take no part.  Rows equal in id, label and vector count once; rows that share
    only the id are different rows, ordered by a hash of the vector.  Only vectors of one dimension meet.  Scores beyond a long count as its bounds.
    """
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    v = F.col(vector).cast("array<double>")
    of = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.xxhash64(of, v).alias("tie"), F.xxhash64(of).alias("label"), of.isNotNull().alias("_known"),
                          v.alias("v"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("_known") & finite(F.col("v"))).drop("_known")
    rows = stored(rows.dropDuplicates(["vec_id", "tie"]), "mining-rows")
    n, n_anchors = rows.agg(F.count("*"), F.count_if("is_anchor")).first()
    asking, rows = rows.filter("is_anchor").drop("is_anchor"), rows.drop("is_anchor")

    group = F.pmod(F.xxhash64("label", F.size("v")), F.lit(LABEL_GROUPS))
    free = asking.withColumn("uppers", F.array(F.lit(MOST))).withColumn("floor", F.lit(-MOST))
    pos = _meet(free, rows, group, parts, n_anchors, n, positives, True, scale)
    wide = F.col("score").cast("decimal(30,0)")
    down = lambda x, by: ((x - F.pmod(x, F.lit(by))) / F.lit(by)).cast("long")
    window = F.struct(down(wide * high[0], high[1]).alias("upper"), (-down(wide * -low[0], low[1])).alias("lower"), "score", "id", "tie")
    pos = pos.withColumn("w", window).filter("w.lower <= w.upper").groupBy("anchor_id", "anchor_tie").agg(F.collect_list("w").alias("windows"))
    pos = stored(pos, "mining-positives")

    key = asking.select("*", F.col("vec_id").alias("anchor_id"), F.col("tie").alias("anchor_tie"))
    limits = F.sort_array(F.array_distinct(F.transform("windows", lambda w: w["upper"])), asc=False)
    bounded = (key.join(pos, ["anchor_id", "anchor_tie"]).withColumn("uppers", limits)
               .withColumn("floor", F.array_min(F.transform("windows", lambda w: w["lower"]))).drop("windows"))
    slots = _meet(bounded, rows, F.lit(0).cast("long"), parts, n_anchors, n, negatives, False, scale)

    entry = "array<struct<down:bigint,id:bigint,tie:bigint>>"
    tops = slots.groupBy("anchor_id", "anchor_tie").agg(F.array_sort(F.collect_list(F.struct("upper", (-F.col("score")).alias("down"), "id", "tie"))).alias("tops"))

    def merge(done: Column, upper: Column) -> Column:
        """The best of this slot and all below it, put behind what lower slots have."""
        here = F.transform(F.filter("tops", lambda t: t["upper"] == upper), lambda t: F.struct(t["down"].alias("down"), t["id"].alias("id"), t["tie"].alias("tie")))
        below = F.coalesce(F.try_element_at(done, F.lit(-1))["best"], F.array().cast(entry))
        return F.concat(done, F.array(F.struct(upper.alias("upper"), F.slice(F.array_sort(F.concat(below, here)), 1, negatives).alias("best"))))

    suffix = F.aggregate(F.array_distinct(F.transform("tops", lambda t: t["upper"])), F.array().cast(f"array<struct<upper:bigint,best:{entry}>>"), merge)
    answers = pos.join(tops.select("anchor_id", "anchor_tie", suffix.alias("suffix")), ["anchor_id", "anchor_tie"])
    answers = answers.select("anchor_id", "suffix", F.explode("windows").alias("w"))
    below = F.try_element_at(F.filter("suffix", lambda s: s["upper"] <= F.col("w.upper")), F.lit(-1))["best"]
    inside = F.filter(below, lambda t: -t["down"] >= F.col("w.lower"))
    answers = answers.select("anchor_id", F.col("w.id").alias("positive_id"), F.col("w.score").alias("positive_score"), F.posexplode(inside).alias("_at", "t"))
    return answers.select("anchor_id", "positive_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("t.id").alias("negative_id"), "positive_score",
                          (-F.col("t.down")).alias("negative_score"))


@query("op11_hard_negatives")
def op11_hard_negatives(spark, sf_dir):
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, label=shifted)
