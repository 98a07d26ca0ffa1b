"""Vector operators: hashed term vectors, cosine neighbours, similarity joins, clusters."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions import pairs as PF, text as T
from corpusloom.plans.skew import attach


def hashed_tf(df: DataFrame, dims: int = 100, col: str = "text") -> DataFrame:
    """Word-frequency vector of unit length; a word's place is the head of its md5 as a number, so any engine finds the same."""
    places = F.transform(T.words(F.lower(F.col(col))), lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint") % dims)
    counts = F.map_from_entries(F.transform(T.tally(places), lambda r: F.struct(r["value"], r["n"])))

    def scaled(n):
        norm = F.sqrt(F.aggregate(F.map_values(n), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        places_ = F.sequence(F.lit(0).cast("bigint"), F.lit(dims - 1).cast("bigint"))
        return T.let(norm, lambda z: F.transform(places_, lambda k: T.ratio(F.coalesce(F.try_element_at(n, k), F.lit(0)), z)))

    return df.withColumn("vector", T.let(counts, scaled))


def unit(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Scale vectors once, so a cosine later is one dot product per pair."""
    v = F.col(vec)
    norm = F.sqrt(PF.dot(v, v))
    d = df.withColumn("_norm", norm)
    return d.withColumn("_u", T.let(F.col("_norm"), lambda n: F.transform(v, lambda x: x.cast("double") / F.nullif(n, F.lit(0.0))))).drop("_norm")


def next_similarity(df: DataFrame, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Cosine of each vector with the one numbered next; the join key is unique, so it cannot skew."""
    u = unit(df, vec).select(key, "_u")
    nxt = u.select((F.col(key) - 1).alias(key), F.col(key).alias("next_id"), F.col("_u").alias("_n"))
    return u.join(nxt, key).select(key, "next_id", PF.dot(F.col("_u"), F.col("_n")).alias("similarity"))


#: Rows of one side that a pair of blocks holds, and query vectors of one block.
PAIR_BLOCK, QUERY_BLOCK = 256, 256
PIVOTS, PIVOT_SAMPLE = 8, 1000


def _angle(a: Column, b: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), PF.dot(a, b))))


def ring_pairs(df: DataFrame, doc: list[str], key: str, vec: str = "embedding", above: float = 0.7) -> DataFrame:
    """Pairs of vectors of one document that may have a cosine above the limit: ``doc``, key, _k2, and the unit vectors _u and _v (of one dimension).

    Angles obey the triangle inequality: the angles of two vectors to a pivot differ by no more than the angle between the two.  So with rings as wide as the
    limit's angle around a pivot, a pair lies in one ring or in neighbouring ones, and only those meet; further pivots rule out pairs by the same test
    before any product.  A ring of a large document is cut into blocks, so it is many tasks.
    """
    u = unit(df, vec).select(*doc, key, "_u").filter(F.get("_u", F.lit(0)).isNotNull())
    wide = math.acos(max(-1.0, min(1.0, above))) + 1e-6
    u = u.select("*", *[_angle(F.col("_u"), F.array(*[F.lit(x) for x in p])).alias(f"_a{i}") for i, p in enumerate(pivots(u, key))])
    angles = [c for c in u.columns if c.startswith("_a")]
    u = u.withColumn("_ring", F.floor((F.col(angles[0]) if angles else F.lit(0.0)) / F.lit(wide)))
    blocks = u.groupBy(*doc, "_ring").agg(F.ceil(F.count("*") / F.lit(PAIR_BLOCK)).alias("_n"))
    # of a pair the smaller key looks into its own and the neighbouring rings, where the larger one lies in one block
    right = u.join(blocks, [*doc, "_ring"]).withColumn("_block", F.pmod(F.xxhash64(key), "_n"))
    right = right.select(*doc, "_ring", "_block", F.col(key).alias("_k2"), F.col("_u").alias("_v"), *[F.col(c).alias(f"_b{c}") for c in angles])
    left = u.withColumn("_ring", F.explode(F.array(F.col("_ring") - 1, F.col("_ring"), F.col("_ring") + 1))).join(blocks, [*doc, "_ring"])
    left = left.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1))).drop("_n")
    near = F.col(key) < F.col("_k2")
    for c in angles:
        near = near & (F.abs(F.col(c) - F.col(f"_b{c}")) <= wide)
    return left.join(right, [*doc, "_ring", "_block"]).filter(near).select(*doc, key, "_k2", "_u", "_v")


def pivots(u: DataFrame, key: str) -> list[list[float]]:
    """Up to PIVOTS unit vectors far from each other, out of the PIVOT_SAMPLE smallest keys: each the furthest from those before it.

    Which pivots are taken changes what is ruled out early, never a result.
    """
    sample = [r["_u"] for r in u.select(key, "_u").orderBy(key).limit(PIVOT_SAMPLE).collect()]
    sample = np.array([v for v in sample if len(v) == len(sample[0])]) if sample else np.zeros((0, 0))
    taken, nearest = [], np.full(len(sample), -2.0)
    while len(sample) and len(taken) < PIVOTS and (not taken or nearest.min() < 1 - 1e-9):
        taken.append(sample[int(nearest.argmin())])
        nearest = np.maximum(nearest, sample @ taken[-1])
    return [v.tolist() for v in taken]


def related_chunks(df: DataFrame, doc: list[str], key: str, vec: str = "embedding", above: float = 0.7) -> DataFrame:
    """Chunks of one document whose cosine is above the limit, both ways; pairs that angles to pivots rule out are never formed."""
    hit = ring_pairs(df, doc, key, vec, above).withColumn("similarity", PF.dot(F.col("_u"), F.col("_v"))).filter(F.col("similarity") > above)
    both = F.array(F.struct(F.col(key).alias(key), F.col("_k2").alias("related")), F.struct(F.col("_k2").alias(key), F.col(key).alias("related")))
    return hit.select(*doc, "similarity", F.inline(both))


def beside_queries(items: DataFrame, queries: DataFrame, name: str, key: str, vec: str = "embedding") -> DataFrame:
    """Every item with every block of query vectors: key, _u (the item's unit vector) and _block, an array of struct(name, unit vector).

    The queries are a stated set of columns ``name`` and ``vec``.  They are dealt into blocks of QUERY_BLOCK; what an item has with each of a block is
    worked out inside its row.  Items are dealt into as many shares as keep all tasks busy, and Spark broadcasts the blocks only below its own threshold.
    """
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = max(1, -(-parts // n_blocks))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    dealt = unit(queries, vec).withColumn("_b", F.pmod(F.xxhash64(name), F.lit(n_blocks)))
    blocks = dealt.groupBy("_b").agg(F.collect_list(F.struct(name, "_u")).alias("_block")).withColumn("_s", numbers(shares))
    left = unit(items, vec).select(key, "_u", F.pmod(F.xxhash64(key), F.lit(shares)).alias("_s")).withColumn("_b", numbers(n_blocks))
    return left.join(blocks, ["_b", "_s"]).select(key, "_u", "_block")


def theme_similarity_join(items: DataFrame, themes: DataFrame, key: str, at_least: float = 0.7, vec: str = "embedding") -> DataFrame:
    """Items whose cosine with a theme vector reaches the limit; ``themes`` has columns theme and vec.  Only hits leave the row of an item."""
    near = lambda u: F.transform("_block", lambda t: F.struct(t["theme"].alias("theme"), PF.dot(u, t["_u"]).alias("similarity")))
    hits = F.filter(T.let(F.col("_u"), near), lambda t: t["similarity"] >= at_least)
    return beside_queries(items, themes, "theme", key, vec).select(key, F.inline(hits)).select("theme", key, "similarity")


def neighbour_coherence(df: DataFrame, doc: list[str], order: str, vec: str = "embedding") -> DataFrame:
    """Mean cosine of neighbouring vectors per document, clipped to 0..1; 1 for a single vector.

    Consecutive positions meet by equi-join on (document, position + 1): unique keys, no window per document.
    """
    u = unit(df, vec).select(*doc, order, "_u")
    nxt = u.select(*doc, (F.col(order) - 1).alias(order), F.col("_u").alias("_n"))
    sims = u.join(nxt, doc + [order], "left").select(*doc, PF.dot(F.col("_u"), F.col("_n")).alias("_s"))
    return sims.groupBy(*doc).agg(F.count("*").alias("n"), F.avg("_s").alias("_a")).select(
        *doc, "n", F.when(F.col("n") < 2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.col("_a"), F.lit(1.0)))).alias("coherence"))


def nearest_centre(df: DataFrame, centres: DataFrame, key: str, vec: str = "embedding") -> DataFrame:
    """The centre of largest cosine for every vector (smallest number on a tie); ``centres`` has columns centre and vec.

    The best of a block is found in the row, so a vector has as many rows as there are blocks of centres, not as there are centres.
    """
    near = lambda u: F.transform("_block", lambda t: F.struct(PF.dot(u, t["_u"]).alias("similarity"), (-t["centre"]).alias("o"), t["centre"].alias("centre")))
    per = beside_queries(df, centres, "centre", key, vec).select(key, F.array_max(T.let(F.col("_u"), near)).alias("_b"))
    best = per.groupBy(key).agg(F.max("_b").alias("_b"))
    return best.select(key, F.col("_b.centre").alias("centre"), F.col("_b.similarity").alias("similarity"))


def lloyd_clusters(df: DataFrame, key: str, k: int = 5, vec: str = "embedding", steps: int = 10) -> DataFrame:
    """k-means by Lloyd's steps from the ``k`` vectors of smallest key: key, cluster, similarity_to_centre, and the inertia as a column.

    A step assigns each vector to its nearest centre inside its row (the first of equally near ones) and takes the means, of which ``k`` vectors reach
    the driver; a centre that nobody is nearest to stays.  Steps end early when no centre moves.  Vectors that are null or of another dimension
    than the first are left out.
    """
    v = df.select(key, F.col(vec).cast("array<double>").alias("_v")).filter(F.col("_v").isNotNull())
    centres = [list(r["_v"]) for r in v.orderBy(key).limit(k).collect()]
    if not centres:
        return v.select(key, F.lit(0).alias("cluster"), F.lit(0.0).alias("similarity_to_centre"), F.lit(0.0).alias("inertia"))
    dims = len(centres[0])
    centres = [c for c in centres if len(c) == dims]
    v = v.filter(F.size("_v") == dims)

    def assigned(now: list[list[float]]) -> DataFrame:
        literal = F.split(F.lit(";".join(",".join(map(repr, c)) for c in now)), ";")
        held = F.transform(literal, lambda c: F.split(c, ",").cast("array<double>"))  # a constant for the optimizer
        apart = lambda c: F.aggregate(F.zip_with("_v", c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
        near = F.array_min(F.transform(held, lambda c, i: F.struct(apart(c).alias("d"), i.alias("i"), c.alias("c"))))
        return v.withColumn("_b", near)

    for _ in range(steps):
        means = assigned(centres).groupBy(F.col("_b.i").alias("i")).agg(*[F.avg(F.get("_v", F.lit(j))).alias(f"m{j}") for j in range(dims)]).collect()
        new = list(centres)
        for r in means:
            new[r["i"]] = [r[f"m{j}"] for j in range(dims)]
        if new == centres:
            break
        centres = new
    out = assigned(centres).select(key, F.col("_b.i").alias("cluster"), PF.cosine(F.col("_v"), F.col("_b.c")).alias("similarity_to_centre"), F.col("_b.d").alias("_d"))
    return attach(out, out.agg(F.sum("_d").alias("inertia"))).drop("_d")


def cluster_vectors(df: DataFrame, key: str, k: int = 5, vec: str = "embedding", seed: int = 42) -> DataFrame:
    """The same by Spark ML's k-means with its own first centres; the inertia of the model is a column."""
    d = df.select(key, F.col(vec).alias("_e"), array_to_vector(F.col(vec)).alias("features"))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(d)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    out = model.transform(d).withColumn("_c", F.get(centres, F.col("cluster")))
    return out.select(key, "cluster", PF.cosine(F.col("_e"), F.col("_c")).alias("similarity_to_centre"),
                      F.lit(model.summary.trainingCost).alias("inertia"))
