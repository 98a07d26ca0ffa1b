"""Column functions that compare an original text with an enhanced one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom import fixed_values as FV
from corpusloom.functions import scores as S, text as T


def jaccard(a: Column, b: Column) -> Column:
    wa, wb = T.set_of(T.words(F.lower(a))), T.set_of(T.words(F.lower(b)))
    return F.when((F.size(wa) == 0) | (F.size(wb) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(wa, wb)) / F.size(F.array_union(wa, wb)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return dot(a, b) / F.nullif(norm, F.lit(0.0))


def length_ratio(original: Column, enhanced: Column) -> Column:
    return T.ratio(F.length(enhanced), F.length(original))


def length_ratio_score(r: Column) -> Column:
    return S.clip(F.lit(1.0) - F.abs(r - FV.PAIR_RATIO_BEST) / FV.PAIR_RATIO_BEST)


def new_entities(original: Column, enhanced: Column) -> Column:
    return F.array_except(T.surface_entities(enhanced), T.surface_entities(original))


def n_new_claims(original: Column, enhanced: Column) -> Column:
    """Claim phrases in the enhanced text whose pattern is absent from the original."""
    def one(phrases):
        pattern = T.word_pattern(phrases)
        return F.when(original.rlike(pattern), 0).otherwise(F.regexp_count(enhanced, F.lit(pattern)))

    return reduce(lambda a, b: a + b, [one(p) for p in FV.CLAIM_PHRASES])


def contradictions(original: Column, enhanced: Column) -> Column:
    """Words negated in the original and affirmed in the enhanced text, plus opposite pairs."""
    def negated(lead, tokens):
        found = F.regexp_extract_all(original, F.lit(r"(?iU)\b%s\s+(\w+)" % lead), F.lit(1))
        return F.filter(found, lambda w: F.array_contains(tokens, F.lower(w)))

    def opposite(word, other, tokens):
        found = F.regexp_extract_all(original, F.lit(r"(?iU)\b%s" % word), F.lit(0))
        return F.when(F.exists(tokens, lambda t: t.startswith(other)), found).otherwise(
            F.array().cast("array<string>"))

    return T.let(F.array_distinct(T.lower_tokens(enhanced)), lambda tokens: F.concat(
        negated("not", tokens), negated("no", tokens), opposite("false", "true", tokens),
        opposite("impossible", "possible", tokens)))


def unsupported(original: Column, enhanced: Column) -> Column:
    """Sentences over 20 characters of which over 70 % of the words are new."""
    parts = F.transform(F.split(enhanced, r"\."), T.trim_ws)

    def kept(known):
        def new_share(s):
            ws = T.set_of(T.words(F.lower(s)))
            return F.size(F.array_except(ws, known)) > F.size(ws) * 0.7

        return F.filter(parts, lambda s: (F.length(s) > 20) & new_share(s))

    return T.let(F.array_distinct(T.words(F.lower(original))), kept)


def with_assessment(df: DataFrame, original="original", enhanced="enhanced", tone: str = "") -> DataFrame:
    """Add every pair metric, the flags, the weighted score and the pass mark."""
    o, e = F.col(original), F.col(enhanced)
    out = (
        df.withColumn("_w", T.words(e)).withColumn("length_ratio", length_ratio(o, e))
        .withColumn("semantic_similarity", jaccard(o, e))
        .withColumn("n_new_entities", F.size(new_entities(o, e)))
        .withColumn("n_new_claims", n_new_claims(o, e))
        .withColumn("n_contradictions", F.size(contradictions(o, e)))
        .withColumn("n_unsupported", F.size(unsupported(o, e)))
        .withColumn("hallucination_score", F.least(
            F.col("n_new_entities") * 0.1 + F.col("n_new_claims") * 0.2 + F.col("n_contradictions") * 0.3
            + F.col("n_unsupported") * 0.1, F.lit(1.0)))
        .withColumn("readability_score", F.when(e == "", F.lit(0.0)).otherwise(S.readability_band(e, F.col("_w"))))
        .withColumn("coherence_score", F.when(e == "", F.lit(0.0)).otherwise(S.coherence_transitions(e)))
        .withColumn("completeness_score", S.completeness(e)).drop("_w"))
    sim, hal, r = F.col("semantic_similarity"), F.col("hallucination_score"), F.col("length_ratio")
    read, coh = F.col("readability_score"), F.col("coherence_score")

    def flag(cond, name, value):
        return F.when(cond, F.struct(F.lit(name).alias("name"), value.alias("value")))

    out = out.withColumn("flags", T.present(
        flag(sim < FV.PAIR_SIMILARITY_MIN, "low_semantic_similarity", sim),
        flag(r > FV.PAIR_RATIO_MAX, "excessive_expansion", r),
        flag(r < FV.PAIR_RATIO_MIN, "excessive_reduction", r),
        flag(hal > FV.PAIR_HALLUCINATION_MAX, "potential_hallucination", hal),
        flag(read < 0.5, "low_readability", read), flag(coh < 0.6, "low_coherence", coh)))
    overall = sim * 0.3 + (F.lit(1.0) - hal) * 0.2 + read * 0.2 + coh * 0.2 + length_ratio_score(r) * 0.1
    if tone:
        out = out.withColumn("tone_consistency", S.tone_consistency(e, tone))
        overall = overall * 0.9 + F.col("tone_consistency") * 0.1
    out = (out.withColumn("overall_score", overall)
           .withColumn("passed", (F.col("overall_score") >= FV.PAIR_OVERALL_MIN) & (F.size("flags") == 0)))
    return T.settle(out, *[c for c in out.columns if c not in df.columns])


def pair_recommendations() -> Column:
    """Advice for a frame made by :func:`with_assessment`."""
    names = F.transform(F.col("flags"), lambda f: f["name"])
    return T.present(
        F.when(F.col("semantic_similarity") < 0.7, F.lit("Consider staying closer to the original content's meaning")),
        F.when(F.col("hallucination_score") > 0.3, F.lit("Review for potential hallucinations or unsupported claims")),
        F.when(F.array_contains(names, "excessive_expansion"), F.lit("Content may be too verbose; consider condensing")),
        F.when(F.array_contains(names, "excessive_reduction"),
               F.lit("Content may be too brief; consider expanding key points")),
        F.when(F.col("readability_score") < 0.6,
               F.lit("Improve readability with shorter sentences and simpler words")),
        F.when(F.col("coherence_score") < 0.6, F.lit("Add transition words to improve flow between sentences")),
        F.when(~F.col("passed"), F.lit("Content requires manual review before export")))
