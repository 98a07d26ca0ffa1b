"""Analysis profiles, labels and hints that prepare a text for transformation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom import fixed_values as FV
from corpusloom.functions import scores as S, text as T
from corpusloom.operators import themes as TH


def question_answers(c: Column) -> Column:
    """Sentences ending in ? with the sentence after them."""
    pairs = T.neighbours(T.marked_sentences(c), lambda a, b: F.struct(a.alias("question"), b.alias("potential_answer")))
    return F.filter(pairs, lambda p: p["question"].endswith("?"))


def with_profile(df: DataFrame, col: str = "text") -> DataFrame:
    """complexity, polarity, subjectivity and has_qa of each text."""
    c = F.col(col)
    out = df.withColumn("_alpha", T.alpha_tokens(F.lower(c))).withColumn("n_entities", T.n_labeled_entities(c))
    out = out.withColumn("_sent", S.sentiment(F.col("_alpha")))
    out = (out.withColumn("complexity", S.complexity(F.col("_alpha"), F.col("n_entities")))
           .withColumn("polarity", F.col("_sent.polarity")).withColumn("subjectivity", F.col("_sent.subjectivity"))
           .withColumn("has_qa", F.when(F.contains(c, F.lit("?")), F.size(question_answers(c)) > 0).when(c.isNotNull(), F.lit(False))).drop("_alpha", "_sent"))
    return T.settle(out, "n_entities", "complexity", "polarity", "subjectivity", "has_qa")


def _numbered(c: Column) -> Column:
    return c.rlike(r"(?md)^[ \t]*\d+\.")


def with_structure(df: DataFrame, col: str = "text") -> DataFrame:
    """structure_type and discourse_style labels; needs has_qa."""
    c, low = F.col(col), F.lower(F.col(col))
    marks = T.marked_sentences(c)
    plain = F.size(F.filter(marks, lambda s: ~s.endswith("?") & ~s.endswith("!")))
    structure = (F.when(F.col("has_qa"), F.lit("qa_format")).when(F.regexp_count(c, F.lit("[\"']")) > 2, F.lit("dialogue"))
                 .when(_numbered(c), F.lit("structured_list")).when(plain > 0.8, F.lit("expository")).otherwise(F.lit("mixed")))
    style = F.lit("descriptive")
    for kind, label in (("emphasis", "persuasive"), ("comparative", "argumentative"), ("temporal", "narrative"), ("causal", "analytical")):
        style = F.when(T.contains_any(low, FV.CONTEXT_WORDS[kind]), F.lit(label)).otherwise(style)
    return df.withColumn("structure_type", structure).withColumn("discourse_style", style)


def transformation_hints(c: Column, kind: str) -> Column:
    """Hints for a frame made by :func:`with_profile`."""
    hints = [
        F.when(F.col("has_qa"), F.lit("Content contains Q&A patterns - consider preserving this structure.")),
        F.when(F.regexp_count(c, F.lit("[\"']")) > 0, F.lit("Content contains dialogue - handle quoted speech appropriately.")),
        F.when(_numbered(c), F.lit("Content has numbered lists - consider maintaining organization."))]
    if kind == "training_data":
        hints.append(F.when(T.n_words(c) > 1, F.lit("Rich topic content - good for diverse training examples.")))
    elif kind == "rewrite_story":
        hints.append(F.when(F.abs("polarity") > 0.3, F.concat(
            F.lit("Content has "), F.when(F.col("polarity") > 0, F.lit("positive")).otherwise(F.lit("negative")),
            F.lit(" sentiment - consider in rewrite."))))
    return T.present(*hints)


def key_context(df: DataFrame, col: str = "text") -> DataFrame:
    """Complexity, sentiment, main topics, structure and style of each text, all from its own row; no topics are null."""
    pairs = T.bigrams(T.words(F.lower(F.col(col))))
    topics = T.let(pairs, lambda g: F.transform(TH.ranked_pairs(g, 5), lambda r: r["phrase"]))
    return df.select("doc_id", F.col("complexity").alias("complexity_level"), F.col("polarity").alias("sentiment"),
                     "structure_type", "discourse_style", T.let(topics, lambda t: F.when(F.size(t) > 0, F.array_join(t, "|"))).alias("main_topics"))


def preservation_notes(df: DataFrame, col: str = "text") -> DataFrame:
    c = F.col(col)
    d = df.select("doc_id", T.important_entities(T.labeled_entities(c)).alias("_e"), TH.phrase_scores(c, 5).alias("_p"))
    return d.select(
        "doc_id", F.transform(F.filter("_e", lambda e: e["importance"] == "high"), lambda e: e["text"]).alias("critical_entities"),
        F.transform("_p", lambda p: p["phrase"]).alias("important_phrases"),
        F.when(F.size("_e") > 0, F.lit("high")).otherwise(F.lit("medium")).alias("preservation_priority"))


def preparation_metadata(df: DataFrame, chunks: DataFrame, col: str = "text") -> DataFrame:
    """Chunk count and size, entities, distinct word pairs as key phrases, and the preparation grade per document."""
    per = chunks.select("doc_id", F.length(col).alias("_n"), (T.n_labeled_entities(F.col(col)) > 0).cast("int").alias("_e")).groupBy("doc_id").agg(
        F.count("*").alias("total_chunks"), F.avg("_n").alias("avg_chunk_size"), F.avg("_e").alias("_named"))
    d = df.select("doc_id", T.n_labeled_entities(F.col(col)).alias("entity_count"),
                  F.size(F.array_distinct(T.bigrams(T.words(F.col(col))))).alias("key_phrase_count")).join(per, "doc_id", "left").fillna(0)

    def step(n):
        return F.when(n > 5, F.lit(0.3)).when(n > 0, F.lit(0.1)).otherwise(F.lit(0.0))

    score = step(F.col("entity_count")) + step(F.col("key_phrase_count")) + F.col("_named") * 0.4
    return d.withColumn("preparation_quality", F.when(score > 0.7, F.lit("excellent")).when(score > 0.4, F.lit("good")).when(
        score > 0.2, F.lit("fair")).otherwise(F.lit("basic"))).drop("_named")
