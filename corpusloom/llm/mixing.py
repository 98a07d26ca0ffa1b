"""Mixing sources to target weights by pivotal dependent rounding (operator 6).

Every record of a source is due the same number of copies, target over size of its source.  Its whole part is
granted; the fractional parts are rounded together: two records meet, and mass moves at random from one to the other
until one of them has 0 or 1.  Records meet in chunks of like size, each chunk leaves at most one fractional record,
and the residuals of the chunks meet again at the next level, so the work is a reduction tree whose depth is the
logarithm of the largest source.  Sums come out near the target since mass moves between records of like size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corpusloom.llm.common import documents, query, stored

CHUNK = 64
#: A remaining probability this near to 0 or 1 is rounding error of the sums.
EPS = 1e-9


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """Targets of the sources: source, source_size, target.

    Sources in code point order, null last, take the weights in turn and share ``share`` times all sizes.  A target
    stops at ``most`` times its source's size and the excess goes to the others by weight, until none is above.  That end state is
    min(cap, weight * level) for one level, found from running sums over the sources sorted by cap / weight.
    The table has one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int")))
    whole, up = W.partitionBy(), W.orderBy("_ratio", F.col("source").isNull(), "source")
    before = up.rowsBetween(W.unboundedPreceding, -1)
    per = (per.withColumn("_cap", F.col("source_size") * F.lit(float(most))).withColumn("_ratio", F.col("_cap") / F.col("weight"))
           .withColumn("_due", F.sum("source_size").over(whole) * F.lit(float(share)))
           .withColumn("_level", (F.col("_due") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
                       / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))))
    level = F.first(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level")), ignorenulls=True).over(
        up.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return (per.withColumn("_water", level)
            .withColumn("target", F.when(F.col("_water").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("weight") * F.col("_water"))))
            .select("source", "source_size", "target"))


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts only."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def _fold(rows: Column, level: int) -> Column:
    """Round the fractional records of one sorted chunk: array of (at, p) with p 0 or 1, the last one maybe still between."""
    one = lambda at, p: F.struct(at.alias("at"), p.alias("p"))
    none = F.lit(None).cast("struct<at:int,p:double>")
    start = F.struct(none.alias("open"), F.lit(None).cast("array<struct<at:int,p:double>>").alias("done"))

    def meet(acc, at):
        row = rows[at]
        a, b = acc["open"]["p"], row["p"]
        total = a + b
        low = total < 1
        # below 1 the loser gets 0 and the other keeps the sum; from 1 on the winner gets 1 and the other keeps the rest
        first = F.when(low, row["u"] < a / total).otherwise(row["u"] < (F.lit(1.0) - a) / (F.lit(2.0) - total))
        stays = F.when(first, acc["open"]["at"]).otherwise(at)
        leaves = F.when(first, at).otherwise(acc["open"]["at"])
        rest = F.when(low, total).otherwise(total - 1)
        rest = F.when(rest < EPS, F.lit(0.0)).when(rest > 1 - EPS, F.lit(1.0)).otherwise(rest)
        gone = F.array(one(leaves, F.when(low, F.lit(0.0)).otherwise(F.lit(1.0))))
        done = F.coalesce(acc["done"], F.array().cast("array<struct<at:int,p:double>>"))
        whole = rest.isin(0.0, 1.0)
        met = F.struct(
            F.when(~whole, one(stays, rest)).alias("open"),
            F.when(whole, F.concat(done, gone, F.array(one(stays, rest)))).otherwise(F.concat(done, gone)).alias("done"))
        return F.when(acc["open"].isNull(), F.struct(one(at, row["p"]).alias("open"), acc["done"].alias("done"))).otherwise(met)

    def finish(acc):
        done = F.coalesce(acc["done"], F.array().cast("array<struct<at:int,p:double>>"))
        return F.when(acc["open"].isNull(), done).otherwise(F.concat(done, F.array(acc["open"])))

    return F.aggregate(F.sequence(F.lit(0), F.size(rows) - 1), start, meet, finish)


def pivotal_copies(rows: DataFrame, key: list[str], seed: int = 7) -> DataFrame:
    """Add ``copies`` to rows that carry source, size and rate (copies due); the sum of copies and of words stays near what is due.

    ``key`` names the columns that tell records apart.  Equal records are one record of the tree, due as many times the copies, and share out what it
    takes; so no group of them meets in a task.  Reruns agree since every draw is a hash of seed, level and key.  Only hashes and sizes go through
    the tree; the other columns meet their copies in a join at the end.
    """
    of = ["source", "size", *key]
    marked = [*[F.isnull(c) for c in of], *of]
    rows = rows.withColumn("_a", F.xxhash64(F.lit(1), *marked)).withColumn("_b", F.xxhash64(F.lit(2), *marked))
    start = rows.groupBy("source", "size", "_a", "_b").agg(F.count("*").alias("_c"), F.max("rate").alias("rate")).withColumn("rate", F.col("rate") * F.col("_c"))
    whole = F.floor("rate")
    start = (start.withColumn("_base", whole.cast("long")).withColumn("_p", F.col("rate") - whole)
             .withColumn("_p", F.when(F.col("_p") < EPS, 0.0).when(F.col("_p") > 1 - EPS, 1.0).otherwise(F.col("_p"))))
    todo = start.select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.xxhash64(F.lit(seed), "_a", "_b").alias("_h"), "_p", F.struct("_a", "_b", "_c", "_base").alias("_row"))
    todo = stored(todo, "pivotal-records")
    done, level = [], 0
    while True:
        # strata of like size: an eighth of a doubling at the leaves, doublings above, then the whole source
        fine = {0: 8.0, 1: 1.0}.get(level, 0.0)
        rank = F.floor(F.log2(F.col("_z") + 1) * fine).cast("int")
        todo = todo.withColumn("_stratum", F.when(F.col("_p").isin(0.0, 1.0), F.lit(None)).otherwise(rank))
        open_ = todo.filter("_stratum is not null")
        chunks = F.ceil(F.count("*") / F.lit(CHUNK))
        counts = open_.groupBy(F.col("_s").alias("_cs"), F.col("_stratum").alias("_cz")).agg(chunks.alias("_chunks"))
        joined = open_.join(counts, F.col("_s").eqNullSafe(F.col("_cs")) & (F.col("_stratum") == F.col("_cz")))
        item = F.struct(F.col("_z").alias("z"), F.col("_h").alias("h"), F.col("_p").alias("p"),
                        _uniform(F.lit(seed), F.lit(level), "_h").alias("u"), F.col("_row").alias("row"))
        grouped = (joined.withColumn("_chunk", F.pmod(F.xxhash64(F.lit(level), "_h"), F.col("_chunks")))
                   .groupBy("_s", "_stratum", "_chunk").agg(F.array_sort(F.collect_list(item)).alias("_rows")))
        met = grouped.select("_s", "_rows", F.explode(_fold(F.col("_rows"), level)).alias("_o"))
        row = F.col("_rows")[F.col("_o.at")]
        after = met.select("_s", row["z"].alias("_z"), row["h"].alias("_h"), F.col("_o.p").alias("_p"), row["row"].alias("_row"))
        settled = todo.filter("_stratum is null").drop("_stratum")
        step = stored(after.unionByName(settled), f"pivotal-{level}")
        done.append(step.filter(F.col("_p").isin(0.0, 1.0)))
        todo = step.filter(~F.col("_p").isin(0.0, 1.0))
        left = todo.groupBy("_s").count().agg(F.max("count")).first()[0] or 0
        if left <= 1:
            break
        level += 1
    last = todo.withColumn("_p", (_uniform(F.lit(seed), F.lit(-1), "_h") < F.col("_p")).cast("double"))
    out = reduce(DataFrame.unionByName, [*done, last])
    taken = out.select("_row._a", "_row._b", "_row._c", (F.col("_row._base") + F.col("_p").cast("long")).alias("_t"))
    nth = F.row_number().over(W.partitionBy("_a", "_b").orderBy(F.lit(0)))
    share = F.floor(F.col("_t") / F.col("_c")) + F.when(nth <= F.col("_t") % F.col("_c"), 1).otherwise(0)
    return rows.join(taken, ["_a", "_b"]).withColumn("copies", share.cast("long")).drop("_a", "_b", "_c", "_t")


def mix(docs: DataFrame, weights: list[int], share: float = 1.5, most: float = 2.0, text: str = "text", source: str = "source", key: list[str] | None = None) -> DataFrame:
    """``doc`` (a struct of all columns of ``docs``) with source, size, source_size, target, rate and copies.

    Null texts and texts without words have size 0: they are due the copies of their source like the others.  Records
    without a source form a source of their own.  An empty table gives an empty result; a source whose sizes are all 0 is due one copy of each record.
    """
    named = F.xxhash64(*(key or ["doc_id", text]))
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col(source).alias("source"), word_count(text).alias("size"), named.alias("key"))
    return pivotal_copies(with_rates(rows, weights, share, most), ["key"]).drop("key")


def with_rates(rows: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """``rows`` (with source and size) with source_size, target and rate."""
    targets = source_targets(rows.select("source", "size"), weights, share, most).withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    return rows.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("rate", rate)


@query("op6_mixing")
def op6_mixing(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    sized = docs.select("doc_id", "source", word_count().alias("size"), F.xxhash64("text").alias("text_hash"))
    rows = with_rates(sized, [3, 1, 2], 1.5, 2.0)
    out = pivotal_copies(rows, ["doc_id", "text_hash"])
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
