"""Composed analyses of documents and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from corpusloom import fixed_values as FV
from corpusloom.functions import scores as S, text as T
from corpusloom.operators import extraction as EX, graph as GR, preparation as PR, themes as TH


def narrative_arc(chunks: DataFrame, col: str = "text") -> DataFrame:
    """Intensity of each chunk in document order, one row per chunk."""
    return S.with_semantics(chunks, col).select("doc_id", "chunk_no", "intensity")


def analyze_content(df: DataFrame, col: str = "text") -> DataFrame:
    """All analyses of a text in one struct column ``analysis``."""
    c = F.col(col)
    d = PR.with_structure(PR.with_profile(df, col), col)
    kinds = EX.sentence_type_counts(c)
    return d.select(*df.columns, F.struct(
        F.struct(F.length(c).alias("chars"), T.n_words(c).alias("words"), T.n_sentences(c).alias("sentences")).alias("features"),
        T.labeled_entities(c).alias("entities"),
        F.struct("structure_type", *[v.alias(k) for k, v in kinds.items()]).alias("structure"),
        F.transform(T.themes(c), lambda t: t["theme"]).alias("topics"),
        F.struct("polarity", "subjectivity").alias("sentiment"), F.col("complexity").alias("complexity"),
        F.transform(TH.phrase_scores(c), lambda p: p["phrase"]).alias("key_phrases"),
        F.col("discourse_style").alias("discourse_style")).alias("analysis"))


def analyze_semantics(chunks: DataFrame, col: str = "text") -> DataFrame:
    """Per document: chunk means, themes across chunks, coherence, relations and shared concepts.

    Each chunk is read once.  What crosses to its document are figures and its short lists of themes and concepts, never its text; what they
    have in common is worked out in the row of the document.
    """
    c = F.col(col)
    pairs_of = lambda s: T.let(F.size(T.labeled_entities(s)), lambda n: (n * (n - 1) / 2).cast("bigint"))
    scored = (S.with_semantics(chunks, col).withColumn("_pairs", F.aggregate(T.sentences(c), F.lit(0).cast("bigint"), lambda a, s: a + pairs_of(s)))
              .withColumn("_themes", F.transform(T.themes(c), lambda t: t["theme"])).withColumn("_concepts", T.concepts(c)))
    docs = scored.groupBy("doc_id").agg(
        F.count("*").alias("chunks"), F.avg("semantic_score").alias("mean_score"), F.avg("context_relevance").alias("mean_relevance"),
        F.max("intensity").alias("peak_intensity"), F.sum("n_entities").alias("entities"), F.sum("_pairs").alias("relations"),
        F.flatten(F.collect_list("_themes")).alias("_themes"), F.collect_list("_concepts").alias("_concepts"))
    docs = docs.withColumn("_t", T.tally(F.col("_themes"))).withColumn("_k", T.tally(F.flatten("_concepts")))
    most, n = F.array_max(F.transform("_t", lambda r: r["n"])), F.col("chunks")
    wide = F.filter("_t", lambda r: r["n"] >= F.greatest(F.lit(2.0), n * 0.2))
    shared = F.transform(F.filter("_k", lambda r: r["n"] >= 2), lambda r: r["value"])
    grouped = T.let(shared, lambda k: F.size(F.filter("_concepts", lambda held: F.size(F.array_intersect(held, k)) >= 2)))
    return docs.select(
        "doc_id", "chunks", "mean_score", "mean_relevance", "peak_intensity", "entities",
        F.when(n < 2, F.lit(1.0)).when(most.isNull(), F.lit(0.5)).otherwise(F.least(most / n, F.lit(1.0))).alias("coherence"),
        F.array_join(F.array_sort(F.transform(wide, lambda r: r["value"])), "|").alias("global_themes"), "relations", grouped.alias("concept_clusters"))


def analyze_chunks(chunks: DataFrame, col: str = "text") -> DataFrame:
    """Type, dialogue, density, readability, coherence and continuity of each chunk.

    Continuity compares the word sets of neighbouring chunks; hashes of words are made first, so no text is shuffled for it.
    A window holds the chunks of one text, so it is bounded.
    """
    c = F.col(col)
    d = chunks.withColumn("_low", T.lower_by_sign(c)).withColumn("_found", T.words_among(F.col("_low"), sorted({*S.CONTENT_TERMS, *T.CONCEPT_TERMS})))
    d = S.with_density(d.withColumn("_counts", S.content_counts(c, F.col("_low"), F.col("_found"))), col, F.col("_found"))
    d = d.withColumn("content_type", S.content_type({k: F.col("_counts")[k] for k in FV.CONTENT_PATTERNS}))
    d = d.withColumn("dialogue_potential", F.least(F.col("_counts.dialogue") / F.greatest(F.col("n_words") / 50, F.lit(1.0)), F.lit(1.0)))
    # scored first, shuffled after: the costly part keeps the parallelism of the scan; themes are made only where they are asked for
    d = T.settle(d.drop("_low", "_found", "_words", "_counts"), *S.DENSITY, "content_type", "dialogue_potential")
    d = S.with_score(d, col).withColumn("_set", F.transform("_distinct", lambda w: F.xxhash64(w))).drop("_distinct")
    d = d.withColumn("_prev", F.lag("_set").over(W.partitionBy("doc_id").orderBy("chunk_no")))
    shared = F.size(F.array_intersect("_set", "_prev"))
    return (d.withColumn("topic_continuity", F.coalesce(T.ratio(shared, F.size("_set") + F.size("_prev") - shared), F.lit(0.0)))
            .withColumnRenamed("readability_simple", "readability_score").withColumnRenamed("coherence_blend", "coherence_score")
            .drop("_prev", "_set"))
