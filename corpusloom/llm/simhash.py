"""SimHash document fingerprints (operator 5).

Every word votes on 128 signed bits with the bits of its hash; its weight is the square of its length up to 8, so short function
words count little.  A bit is set when the votes for it outweigh those against it.  Fingerprints within a Hamming radius
are found through permuted block tables: with more blocks than the radius, some choice of (blocks - radius) blocks is free of differences.

All of it is built-in column functions; a text is shuffled once, to lie beside the next document.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corpusloom.llm.common import documents, query, stored, text_of

BITS, LONGEST = 128, 8
#: Two counters of 32 bits share a sum: bit i of a hash in the low half, bit i + 32 in the high half.
PAIR = (1 << 32) + 1
#: Documents per bucket that bucket widths aim at, and the most buckets: their largest ids are a broadcast table.
BUCKET_DOCS, MOST_BUCKETS = 500, 1 << 16


def _votes() -> tuple[list[Column], Column]:
    # the guard against no word stands on the weight alone: inside branches Spark would hash the word anew for every bit
    length = F.least(F.coalesce(F.char_length("word"), F.lit(0)), F.lit(LONGEST)).cast("long")
    weight = length * length
    hashes = (F.xxhash64("word"), F.xxhash64("word", F.lit(1)))
    return [F.shiftrightunsigned(h, i).bitwiseAND(F.lit(PAIR)) * weight for h in hashes for i in range(32)], weight


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` with ``hi`` and ``lo``, the two halves of the text's fingerprint.

    ``keys`` must tell the rows apart.  Words are split at white space.  A text without words, and a null text, has no votes: all bits are 0.
    """
    words = F.filter(F.split(text_of(text), r"\s+"), lambda w: w != "")
    votes, weight = _votes()
    rows = texts.select(*keys, F.explode_outer(words).alias("word"))
    rows = rows.select(*keys, weight.alias("_w"), *[v.alias(f"_v{i}") for i, v in enumerate(votes)])
    sums = rows.groupBy(*keys).agg(F.sum("_w").alias("_w"), *[F.sum(f"_v{i}").alias(f"_v{i}") for i in range(len(votes))])

    def half(first: int) -> Column:
        bits = []
        for i in range(32):
            v = F.col(f"_v{first + i}")
            for shift, count in ((i, v.bitwiseAND(F.lit(0xFFFFFFFF))), (i + 32, F.shiftrightunsigned(v, 32))):
                bits.append(F.when(count * 2 > F.col("_w"), F.shiftleft(F.lit(1).cast("long"), shift)).otherwise(F.lit(0).cast("long")))
        return reduce(Column.bitwiseOR, bits)

    return sums.select(*keys, half(0).alias("hi"), half(32).alias("lo"))


def hex_of(hi: Column, lo: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def search(queries: DataFrame, prints: DataFrame, radius: int = 3, blocks: int = 8) -> DataFrame:
    """All pairs (query_id, id, distance) of fingerprints within ``radius`` bits: both tables have id, hi and lo.

    Equal fingerprints are one entry of the tables, and ids are put back at the end.
    """
    met = near_prints(queries, prints, radius, blocks)
    ids = prints.select("id", F.struct("hi", "lo").alias("p"))
    asked = queries.select(F.col("id").alias("query_id"), F.struct("hi", "lo").alias("q"))
    return met.join(asked, "q").join(ids, "p").select("query_id", "id", "distance")


def near_prints(queries: DataFrame, prints: DataFrame, radius: int, blocks: int) -> DataFrame:
    """All pairs (q, p, distance) of distinct fingerprints of two tables of hi and lo within ``radius`` bits, once each.

    The fingerprint is cut into ``blocks`` equal blocks (1, 2, 4, 8 or 16); each choice of blocks - radius of them is a table keyed by those
    blocks.  Two fingerprints within the radius agree in the key of some table, and count in the first of these.
    """
    width = BITS // blocks
    if blocks <= radius or BITS % blocks or 64 % width:
        raise ValueError("blocks must divide the fingerprint into parts of a half and be more than the radius")
    tables = list(combinations(range(blocks), blocks - radius))

    def block(i: int, of: str = "") -> Column:
        at = i * width
        half, shift = ("hi", at) if at < 64 else ("lo", at - 64)
        return F.shiftrightunsigned(of + half, shift).bitwiseAND(F.lit((1 << width) - 1)) if width < 64 else F.col(of + half)

    def keyed(df: DataFrame, name: str) -> DataFrame:
        keys = F.array(*[F.xxhash64(*[block(i) for i in chosen]) for chosen in tables])
        return df.select("hi", "lo").distinct().select(F.struct("hi", "lo").alias(name), F.posexplode(keys).alias("_table", "_key"))

    agree = [reduce(Column.__and__, [block(i, "q.") == block(i, "p.") for i in chosen]) for chosen in tables]
    first = F.coalesce(*[F.when(a, F.lit(t)) for t, a in enumerate(agree)])
    apart = distance((F.col("q.hi"), F.col("q.lo")), (F.col("p.hi"), F.col("p.lo")))
    met = keyed(queries, "q").join(keyed(prints, "p"), ["_table", "_key"])
    return met.filter((first == F.col("_table")) & (apart <= radius)).select("q", "p", apart.alias("distance"))


def near_counts(rows: DataFrame, asked: Column, radius: int = 3, blocks: int = 4) -> DataFrame:
    """``rows`` (hi and lo among their columns) with near_count: of the rows that are asked for, how many others have a fingerprint within ``radius`` bits."""
    copies = rows.groupBy("hi", "lo").agg(F.count("*").alias("_n"))
    queries = rows.filter(asked).select("hi", "lo").distinct()
    met = near_prints(queries, copies, radius, blocks).select("q.*", F.col("p.hi").alias("_h"), F.col("p.lo").alias("_l"))
    found = met.join(copies.select(F.col("hi").alias("_h"), F.col("lo").alias("_l"), "_n"), ["_h", "_l"]).groupBy("hi", "lo").agg((F.sum("_n") - 1).alias("near_count"))
    told = rows.filter(asked).join(found, ["hi", "lo"], "left").select(*rows.columns, "near_count")
    return told.unionByName(rows.filter(~F.coalesce(asked, F.lit(False))).withColumn("near_count", F.lit(None).cast("long")))


def beside_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows with their successor by descending id (the last one's is the first): bucket, rn, guest, doc_id, text, next_text.

    Ids are cut into buckets of equal width.  A bucket's last row finds its successor in a guest: the largest row of the bucket below, copied in.
    Guests (guest > 0) carry no successor and only serve the row before them.  Ties go by the text's hash; rows without an id come last.
    """
    low, high, n = docs.agg(F.min(doc_id), F.max(doc_id), F.count("*")).first()
    low, high = (0, 0) if low is None else (low - 1, high)
    width = max(1, -(-(high - low + 1) // min(MOST_BUCKETS, max(1, n // BUCKET_DOCS))))
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(low).cast("long"))
    bucket = F.floor((key - F.lit(low)) / F.lit(width)).cast("long")
    tops = sorted(docs.select(bucket.alias("b"), key.alias("k")).groupBy("b").agg(F.max("k")).collect())  # a row per bucket
    guests = [(top, tops[i + 1][0], 1) if i + 1 < len(tops) else (top, tops[0][0], 2) for i, (_, top) in enumerate(tops)]
    table = docs.sparkSession.createDataFrame(guests, "_top long, _to long, _role int")
    rows = docs.select(key.alias("_k"), F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    rows = rows.join(F.broadcast(table), F.col("_k") == F.col("_top"), "left")
    own = F.struct(F.floor((F.col("_k") - F.lit(low)) / F.lit(width)).cast("long").alias("bucket"), F.lit(0).alias("guest"))
    guest = F.struct(F.col("_to").alias("bucket"), F.col("_role").alias("guest"))
    rows = rows.select("_k", "doc_id", "text", F.explode(F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, guest))).alias("_at"))
    # as many tasks as shuffle partitions: adaptive execution would join partitions by bytes, and the work is by words
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("_at.bucket", "_at.guest", "_k", "doc_id", "text").repartition(parts, "bucket")
    order = W.partitionBy("bucket").orderBy("guest", F.desc("_k"), F.xxhash64("text"))
    return rows.select("bucket", F.row_number().over(order).alias("rn"), "guest", "doc_id", "text", F.lead("text").over(order).alias("next_text"))


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, hi and lo, both fingerprints and their likeness (1 - distance / bits) to each other and to the next document's.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document.
    Null texts are empty.  Every row comes out once; an empty table gives an empty result.
    """
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.when(F.col("guest") == 0, F.concat(F.left("text", n - half), F.left("next_text", half)))
    rows = beside_next(docs, doc_id, text).select("bucket", "rn", "guest", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    both = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))
    own = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")))
    keys = ["bucket", "rn", "guest", "doc_id", "n_chars", "edited_sha256"]
    rows = rows.select(*keys, F.explode(F.when(F.col("guest") == 0, both).otherwise(own)).alias("_t")).select(*keys, "_t.kind", "_t.text")
    prints = fingerprints(rows, [*keys, "kind"])
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    flat = prints.groupBy(*keys).agg(pick(0, "hi").alias("hi"), pick(0, "lo").alias("lo"), pick(1, "hi").alias("ehi"), pick(1, "lo").alias("elo"))
    order = W.partitionBy("bucket").orderBy("rn")
    flat = flat.withColumn("nhi", F.lead("hi").over(order)).withColumn("nlo", F.lead("lo").over(order)).filter("guest = 0")
    near = lambda hi, lo: F.lit(1.0) - distance((F.col("hi"), F.col("lo")), (F.col(hi), F.col(lo))) / F.lit(float(BITS))
    return flat.select("doc_id", "n_chars", "edited_sha256", "hi", "lo", hex_of(F.col("hi"), F.col("lo")).alias("fingerprint"),
                       hex_of(F.col("ehi"), F.col("elo")).alias("edited_fingerprint"), near("ehi", "elo").alias("near_edited"), near("nhi", "nlo").alias("near_next"))


@query("op5_simhash")
def op5_simhash(spark, sf_dir):
    """With near_count: for documents whose id is divisible by 100, how many others lie within three bits of theirs."""
    rows = stored(edited_fingerprints(documents(spark, sf_dir)), "fingerprints")
    return near_counts(rows, F.col("doc_id") % 100 == 0).drop("hi", "lo")
