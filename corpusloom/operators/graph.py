"""Entity and concept relations within documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corpusloom.functions import text as T
from corpusloom.plans.ordered import kept, over_frames


def sentence_pairs(ents: Column) -> Column:
    """Pairs of entities of one sentence in list order."""
    return T.let(ents, lambda v: F.flatten(F.transform(v, lambda e, i: F.transform(
        F.slice(v, i + 2, F.size(v)), lambda f: F.struct(e["text"].alias("entity1"), f["text"].alias("entity2"))))))


def entity_cooccurrence(df: DataFrame, col: str = "text") -> DataFrame:
    """Entities named in the same sentence.  Pairs are made inside the row of the sentence: no self-join."""
    s = df.select("doc_id", F.posexplode(T.sentences(F.col(col))).alias("sent_no", "_s"))
    return s.select("doc_id", "sent_no", T.labeled_entities(F.col("_s")).alias("_e")).select(
        "doc_id", "sent_no", F.inline(sentence_pairs(F.col("_e")))).withColumn("confidence", F.lit(0.7))


def entity_graph(df: DataFrame, col: str = "text") -> DataFrame:
    """Neighbours of each entity per document, both ways from one pass over the texts; lists are bounded by the document."""
    s = df.select("doc_id", F.explode(T.sentences(F.col(col))).alias("_s")).select("doc_id", sentence_pairs(T.labeled_entities(F.col("_s"))).alias("_p"))
    there = F.transform("_p", lambda p: F.struct(p["entity1"].alias("entity"), p["entity2"].alias("other")))
    back = F.transform("_p", lambda p: F.struct(p["entity2"].alias("entity"), p["entity1"].alias("other")))
    both = s.select("doc_id", F.inline(F.array_distinct(F.concat(there, back))))
    return both.groupBy("doc_id", "entity").agg(F.array_sort(F.collect_set("other")).alias("neighbours"))


def chunk_terms(chunks: DataFrame, col: str = "text") -> DataFrame:
    """Distinct entities and concepts of each chunk."""
    c = F.col(col)
    terms = F.concat(F.transform(T.labeled_entities(c), lambda e: F.concat(F.lit("e:"), e["text"])),
                     F.transform(T.concepts(c), lambda k: F.concat(F.lit("c:"), k)))
    return chunks.select("doc_id", "chunk_no", F.explode(F.array_distinct(terms)).alias("term"))


def dependency_links(chunks: DataFrame, col: str = "text") -> DataFrame:
    """Of each term of a chunk the last earlier chunk of the document that holds it: doc_id, chunk_no, term, depends_on, n_earlier.

    One row per chunk and term at most: a term's holders form a chain, from which :func:`dependency_chunks` tells all of them on request.
    Chains are walked in blocks, so a term that a huge document repeats throughout is not one task.
    """
    held = chunk_terms(chunks, col)
    linked = over_frames(held, ["doc_id", "term"], ["chunk_no"], 1, lambda rows, w: rows.withColumn("depends_on", F.lag("chunk_no").over(w)))
    return linked.filter(F.col("depends_on").isNotNull()).select("doc_id", "chunk_no", "term", "depends_on", (F.col("rn") - 1).alias("n_earlier"))


def dependency_chunks(links: DataFrame) -> DataFrame:
    """All earlier chunks that share a term with a chunk, from its links: pointers along the chains are doubled until the longest one is covered.

    Each step stores its pairs, so no plan grows; the result is as long as the relation itself.
    """
    links = links.select("doc_id", "term", "chunk_no", "depends_on", "n_earlier")
    longest = links.agg(F.max("n_earlier")).first()[0] or 0
    known = jump = kept(links.drop("n_earlier"), "links")
    covered = 1
    while covered < longest:
        leap = jump.select("doc_id", "term", F.col("chunk_no").alias("depends_on"), F.col("depends_on").alias("_far"))
        further = lambda d: d.join(leap, ["doc_id", "term", "depends_on"]).select("doc_id", "term", "chunk_no", F.col("_far").alias("depends_on"))
        known, jump, covered = kept(known.unionByName(further(known)), "reach"), kept(further(jump), "leap"), 2 * covered
    return known.select("doc_id", "chunk_no", "depends_on").distinct()


def concept_clusters(chunks: DataFrame, col: str = "text") -> DataFrame:
    """Concepts seen in at least two chunks of a document, grouped by chunks that hold two or more of them."""
    k = chunks.select("doc_id", "chunk_no", F.explode(T.concepts(F.col(col))).alias("concept"))
    seen = k.withColumn("n", F.count("*").over(W.partitionBy("doc_id", "concept"))).filter("n >= 2")
    return (seen.groupBy("doc_id", "chunk_no").agg(F.array_sort(F.collect_set("concept")).alias("concepts"))
            .filter(F.size("concepts") >= 2))


def global_themes(chunks: DataFrame, col: str = "text") -> DataFrame:
    """Themes found in at least two chunks and a fifth of the chunks of a document."""
    names = F.transform(T.themes(F.col(col)), lambda t: t["theme"])
    rows = chunks.select("doc_id", names.alias("_t"))
    per_theme = rows.select("doc_id", F.explode("_t").alias("theme")).groupBy("doc_id", "theme").agg(F.count("*").alias("n"))
    total = rows.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    return per_theme.join(total, "doc_id").filter(F.col("n") >= F.greatest(F.lit(2.0), F.col("chunks") * 0.2))


def theme_coherence(chunks: DataFrame, col: str = "text") -> DataFrame:
    """Share of chunks holding the commonest theme; 0.5 without themes, 1 for a single chunk."""
    names = F.transform(T.themes(F.col(col)), lambda t: t["theme"])
    rows = chunks.select("doc_id", names.alias("_t"))
    best = rows.select("doc_id", F.explode("_t").alias("theme")).groupBy("doc_id", "theme").agg(F.count("*").alias("n")).groupBy(
        "doc_id").agg(F.max("n").alias("top"))
    total = rows.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    return total.join(best, "doc_id", "left").select("doc_id", F.when(F.col("chunks") < 2, F.lit(1.0)).when(
        F.col("top").isNull(), F.lit(0.5)).otherwise(F.least(F.col("top") / F.col("chunks"), F.lit(1.0))).alias("coherence"))
