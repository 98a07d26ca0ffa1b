"""Validation: constraint columns per row, then partially aggregated reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom import fixed_values as FV
from corpusloom.functions import scores as S, text as T
from corpusloom.plans.skew import attach


def _score(issues: Column, warnings: Column, per_issue: float, per_warning: float = 0.1) -> Column:
    return S.clip(F.lit(1.0) - F.size(issues) * per_issue - F.size(warnings) * per_warning)


def record_issue(cid: Column, original: Column, output: Column) -> Column:
    """First problem of a record, or null."""
    missing = T.present(*[F.when(c.isNull(), F.lit(n)) for n, c in (("chunk_id", cid), ("original_content", original), ("gpt_output", output))])
    return (F.when(F.size(missing) > 0, F.concat(F.lit("Missing required fields: "), F.array_join(missing, ", ")))
            .when(T.trim_ws(cid) == "", F.lit("Invalid chunk_id"))
            .when(F.length(T.trim_ws(original)) < 10, F.lit("Invalid or too short original_content"))
            .when(F.length(T.trim_ws(output)) < 10, F.lit("Invalid or too short gpt_output")))


def validate_records(df: DataFrame) -> DataFrame:
    """Add ``issue`` and ``warning`` to rows of (chunk_id, original_content, gpt_output, quality_score)."""
    issue = record_issue(F.col("chunk_id"), F.col("original_content"), F.col("gpt_output"))
    return df.withColumn("issue", issue).withColumn("warning", F.when(
        F.col("issue").isNull() & (F.col("quality_score").isNull() | ~F.col("quality_score").between(0, 1)), F.lit("Invalid quality_score (should be 0-1)")))


def record_report(df: DataFrame) -> DataFrame:
    g = validate_records(df).agg(F.count("*").alias("total_entries"), F.count_if(F.col("issue").isNull()).alias("valid_entries"),
                                 F.count("warning").alias("warnings"))
    return g.withColumn("invalid_entries", F.col("total_entries") - F.col("valid_entries")).withColumn(
        "score", T.ratio(F.col("valid_entries"), F.col("total_entries"))).withColumn("is_valid", F.col("invalid_entries") == 0)


def validate_dialogue(df: DataFrame, col: str) -> DataFrame:
    c = F.col(col)
    teacher, student = F.regexp_count(c, F.lit(r"(?i)\*\*Teacher:\*\*|Teacher:")), F.regexp_count(c, F.lit(r"(?i)\*\*Student:\*\*|Student:"))
    has = c.rlike(r"(?i)Teacher:|Student:|Q:|A:")
    warnings = T.present(
        F.when(~has, F.lit("No clear dialogue markers found (Teacher/Student, Q/A)")),
        F.when((teacher > 0) & (student > 0) & (F.abs(teacher - student) > 2), F.concat(
            F.lit("Unbalanced dialogue: "), teacher.cast("string"), F.lit(" teacher vs "), student.cast("string"), F.lit(" student entries"))))
    issues = T.present(F.when(F.length(T.trim_ws(c)) < 100, F.lit("GPT output too short for meaningful dialogue")),
                       F.when(~c.rlike("[.!?]"), F.lit("No proper sentence endings found")))
    return (df.withColumn("issues", issues).withColumn("warnings", warnings)
            .withColumn("score", _score(F.col("issues"), F.col("warnings"), 0.5)).withColumn("is_valid", F.size("issues") == 0))


def _parts(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\."), lambda s: T.trim_ws(s) != ""))


def validate_integrity(df: DataFrame, original: str, output: str) -> DataFrame:
    o, g = F.col(original), F.col(output)
    d = df.withColumn("_on", T.n_words(o)).withColumn("_gn", T.n_words(g)).withColumn("_os", _parts(o)).withColumn("_gs", _parts(g))
    on, gn, ratio = F.col("_on"), F.col("_gn"), F.try_divide(F.col("_gs"), F.col("_os"))
    both = (F.col("_os") > 0) & (F.col("_gs") > 0)

    def open_end(c):
        t = T.trim_ws(c)
        return (t != "") & ~t.rlike("[.!?\"']$")

    warnings = T.present(
        F.when(on < 50, F.lit("Original content is very short (< 50 words)")).when(on > 1000, F.lit("Original content is very long (> 1000 words)")),
        F.when((gn >= 50) & (gn > 2000), F.lit("GPT output is very long (> 2000 words)")),
        F.when(o.endswith("...") | g.endswith("..."), F.lit("Content appears to be truncated")),
        F.when(open_end(o), F.lit("Original content doesn't end with proper punctuation")),
        F.when(open_end(g), F.lit("GPT output doesn't end with proper punctuation")),
        F.when(both & (ratio > 5), F.lit("GPT output significantly longer than original (possible repetition)"))
        .when(both & (ratio < 0.5), F.lit("GPT output much shorter than original (possible information loss)")))
    issues = T.present(F.when(gn < 50, F.lit("GPT output is too short (< 50 words)")))
    return (d.withColumn("issues", issues).withColumn("warnings", warnings).withColumn("score", _score(F.col("issues"), F.col("warnings"), 0.3))
            .withColumn("is_valid", F.size("issues") == 0)
            .withColumn("word_ratio", gn / F.greatest(on, F.lit(1))).withColumn("sentence_ratio", F.col("_gs") / F.greatest("_os", F.lit(1)))
            .drop("_on", "_gn", "_os", "_gs"))


def doubled_words(c: Column) -> Column:
    """Word pairs that repeat a word, non-overlapping, with only white space between."""
    return F.regexp_count(c, F.lit(r"(?iU)\b(\w+)\s+\1\b"))


def validate_content(df: DataFrame, col: str = "text") -> DataFrame:
    c = F.col(col)
    d = df.withColumn("_w", T.words(c)).withColumn("_l", F.transform(
        F.filter(F.split(c, r"\."), lambda s: T.trim_ws(s) != ""), T.n_words))
    avg = T.ratio(F.aggregate("_l", F.lit(0), lambda a, x: a + x), F.size("_l"))
    d = d.withColumn("vocabulary_ratio", S.vocabulary_stripped(F.col("_w"))).withColumn("_avg", avg)
    some = F.size("_l") > 0
    ellipsis = (F.length(c) - F.length(F.replace(c, F.lit("..."), F.lit("")))) / 3
    warnings = T.present(
        F.when(F.col("vocabulary_ratio") < 0.3, F.lit("Low vocabulary diversity (possible repetition)")),
        F.when(some & (F.col("_avg") < 5), F.lit("Very short average sentence length")).when(some & (F.col("_avg") > 30), F.lit("Very long average sentence length")),
        F.when(some & (F.size(T.set_of(F.col("_l"))) < F.size("_l") * 0.3), F.lit("Low sentence length variation")),
        F.when(ellipsis > 3, F.lit("Excessive use of ellipsis")), F.when(doubled_words(c) > 2, F.lit("Repeated words detected")))
    d = d.withColumn("warnings", warnings)
    return d.withColumn("score", S.clip(F.lit(1.0) - F.when(F.col("vocabulary_ratio") < 0.3, 0.2).otherwise(0.0) - F.size("warnings") * 0.1)).drop("_w", "_l", "_avg")


def validate_export(df: DataFrame, big_row: int = 100_000, big_total: int = 50 * 1024 * 1024) -> DataFrame:
    """Row and total sizes as JSON, and columns holding characters that trouble CSV."""
    size = F.length(F.to_json(F.struct(*df.columns)))
    text_cols = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    g = df.agg(F.count("*").alias("total_entries"), F.sum(size).alias("total_size"), F.count_if(size > big_row).alias("large_entries"),
               *[F.count_if(F.col(c).rlike('["\n\r]')).alias(f"_{c}") for c in text_cols])
    hostile = F.array_join(T.present(*[F.when(F.col(f"_{c}") > 0, F.lit(c)) for c in text_cols]), "|")
    n_warn = (F.col("large_entries") + (F.col("total_size") > big_total).cast("int")
              + reduce(lambda a, b: a + b, [(F.col(f"_{c}") > 0).cast("int") for c in text_cols], F.lit(0)))
    return g.select("total_entries", "total_size", "large_entries", hostile.alias("csv_hostile_columns"),
                    F.when(F.col("total_entries") == 0, F.lit(0.0)).otherwise(S.clip(F.lit(1.0) - n_warn * 0.1)).alias("score"))


def validate_dataset(df: DataFrame) -> DataFrame:
    """One row per check: record format, content integrity, dialogue format; the records are read once and all figures come from one aggregate."""
    checked = ["issues", "warnings", "score", "is_valid"]
    told = validate_records(df)
    fields = told.columns
    filled = told.withColumn("original_content", F.coalesce("original_content", F.lit(""))).withColumn("gpt_output", F.coalesce("gpt_output", F.lit("")))
    d = validate_integrity(filled, "original_content", "gpt_output").select(*fields, F.struct(*checked).alias("_integrity"))
    d = validate_dialogue(d, "gpt_output").select("issue", "warning", "_integrity", F.when(F.col("gpt_output") != "", F.struct(*checked)).alias("_dialogue"))

    def figures(c: str):
        return F.struct(F.avg(f"{c}.score").alias("score"), F.sum(F.size(f"{c}.issues")).alias("issues"), F.sum(F.size(f"{c}.warnings")).alias("warnings"),
                        F.bool_and(f"{c}.is_valid").alias("is_valid"), F.count(c).alias("entries"))

    n, bad = F.count("*"), F.count("issue")
    g = d.agg(F.struct(T.ratio(n - bad, n).alias("score"), bad.alias("issues"), F.count("warning").alias("warnings"), (bad == 0).alias("is_valid"), n.alias("entries")).alias("training_format"),
              figures("_integrity").alias("content_integrity"), figures("_dialogue").alias("dialogue_format"))
    rows = F.array(*[F.struct(F.lit(c).alias("category"), *[F.col(f"{c}.{x}").alias(x) for x in ("score", "issues", "warnings", "is_valid", "entries")])
                     for c in ("training_format", "content_integrity", "dialogue_format")])
    return g.select(F.inline(rows))


# fixed values: recommendation bands
BANDS = [
    (0.9, 0, "✅ Excellent quality - Ready for production use"), (0.8, 2, "🟢 Good quality - Minor improvements recommended"),
    (0.6, 5, "🟡 Acceptable quality - Review and fix issues before use"), (0.4, None, "🟠 Poor quality - Significant improvements needed"),
]
LOWEST_BAND = "🔴 Unacceptable quality - Major revision required"


def validation_summary(results: DataFrame) -> DataFrame:
    g = results.agg(F.bool_and("is_valid").alias("overall_valid"), F.avg("score").alias("overall_score"), F.sum("issues").alias("total_issues"),
                    F.sum("warnings").alias("total_warnings"), F.count("*").alias("validation_categories"))
    band = F.lit(LOWEST_BAND)
    for at, most, text in reversed(BANDS):
        ok = F.col("overall_score") >= at
        band = F.when(ok if most is None else ok & (F.col("total_issues") <= most), F.lit(text)).otherwise(band)
    return g.withColumn("recommendation", band)


UNIT_FIELDS = ["overall_score", "semantic_similarity", "hallucination_score", "readability_score", "coherence_score"]


def schema_errors(df: DataFrame) -> DataFrame:
    """Add array ``errors`` of the broken constraints of nested record rows."""
    q, i, o = F.col("quality_metrics"), T.trim_ws(F.col("input")), T.trim_ws(F.col("output"))
    checks = [F.when(q[f].isNull() | ~q[f].between(0, 1), F.lit(f"{f} out of range")) for f in UNIT_FIELDS]
    checks += [
        F.when(q["tone_consistency"].isNotNull() & ~q["tone_consistency"].between(0, 1), F.lit("tone_consistency out of range")),
        F.when(q["length_ratio"].isNull() | (q["length_ratio"] <= 0), F.lit("length_ratio not positive"))
        .when(q["length_ratio"] > 10, F.lit("Length ratio too high - possible processing error")),
        F.when(F.coalesce(i, F.lit("")) == "", F.lit("input empty")).when(F.length("input") > 100_000, F.lit("input exceeds maximum length")),
        F.when(F.coalesce(o, F.lit("")) == "", F.lit("output empty")).when(F.length("output") > 100_000, F.lit("output exceeds maximum length"))
        .when((i != "") & (F.length(o) < F.length(i) * 0.1), F.lit("Enhanced content too short compared to original"))
        .when((i != "") & (F.length(o) > F.length(i) * 20), F.lit("Enhanced content too long compared to original")),
        F.when(F.col("content_type").isNull() | ~F.col("content_type").isin(*FV.CONTENT_TYPES), F.lit("unknown content_type")),
        F.when(F.col("tone").isNull() | ~F.col("tone").isin(*FV.TONES), F.lit("unknown tone")),
        F.when(F.col("processing_time").isNull() | (F.col("processing_time") < 0), F.lit("processing_time negative")),
        F.when(F.col("api_cost") < 0, F.lit("api_cost negative"))]
    return df.withColumn("errors", T.present(*checks))


def validate_schema(df: DataFrame) -> DataFrame:
    """Count of each broken constraint, with the share of valid rows."""
    d = schema_errors(df).select("errors")
    total = d.agg(F.count("*").alias("total_items"), F.count_if(F.size("errors") == 0).alias("valid_items"))
    per = d.select(F.explode("errors").alias("error")).groupBy("error").agg(F.count("*").alias("n"))
    return attach(per, total).withColumn("validation_rate", T.ratio(F.col("valid_items"), F.col("total_items")))


_RESULT = "struct<chunks:string,metadata:string,quality_scores:string>"


def processing_result_check(df: DataFrame, col: str = "result") -> DataFrame:
    """First structural problem of a JSON result with chunks, metadata and quality_scores."""
    r = F.from_json(col, _RESULT)
    items = F.from_json(r["chunks"], "array<string>")
    item = [F.from_json(F.element_at(items, 1), "struct<text:string,quality_score:string>")]

    def lacks(field):
        return F.exists(items, lambda x: F.get_json_object(x, f"$.{field}").isNull())

    first_bad = F.array_position(F.transform(items, lambda x: F.get_json_object(x, "$.text").isNull() | F.get_json_object(
        x, "$.quality_score").isNull()), True) - 1
    bad = F.get(items, first_bad.cast("int"))
    error = (F.when(r["chunks"].isNull(), F.lit("Missing required field: chunks")).when(r["metadata"].isNull(), F.lit("Missing required field: metadata"))
             .when(r["quality_scores"].isNull(), F.lit("Missing required field: quality_scores"))
             .when(items.isNull(), F.lit("Chunks must be a list"))
             .when(first_bad >= 0, F.concat(F.lit("Chunk "), first_bad.cast("string"), F.lit(" missing '"), F.when(
                 F.get_json_object(bad, "$.text").isNull(), F.lit("text")).otherwise(F.lit("quality_score")), F.lit("' field")))
             .when(~r["metadata"].startswith("{"), F.lit("Metadata must be a dictionary"))
             .when(~r["quality_scores"].startswith("{"), F.lit("Quality scores must be a dictionary")))
    return df.withColumn("message", F.coalesce(error, F.lit("Output validation passed"))).withColumn("is_valid", F.col("message") == "Output validation passed")


def fine_tune_report(df: DataFrame) -> DataFrame:
    """Fitness of records (input, output, content_type, tone, overall_score) for fine-tuning."""
    g = df.agg(F.count("*").alias("total_items"), F.avg(F.length("input")).alias("avg_input_length"), F.avg(F.length("output")).alias("avg_output_length"),
               F.count_distinct("content_type").alias("content_types"), F.count_distinct("tone").alias("tones"),
               F.avg("overall_score").alias("avg_quality"), F.count_if(F.col("overall_score") < 0.7).alias("low_quality"))
    n = F.col("total_items")
    issues = T.present(
        F.when(n < 10, F.lit("Dataset too small for effective fine-tuning (minimum 10 items recommended)")),
        F.when(F.col("avg_quality") < 0.75, F.lit("Average quality score below recommended threshold (0.75)")))
    advice = T.present(
        F.when(F.col("content_types") > 3, F.lit("Consider grouping by content type for more focused fine-tuning")),
        F.when(F.col("tones") > 2, F.lit("Consider training separate models for different spiritual tones")),
        F.when(F.col("low_quality") > n * 0.1, F.concat(F.lit("Consider removing "), F.col("low_quality").cast("string"), F.lit(" low-quality items"))))
    return (g.withColumn("length_ratio", T.ratio(F.col("avg_output_length"), F.col("avg_input_length")))
            .withColumn("issues", issues).withColumn("recommendations", advice).withColumn("compatible", F.size("issues") == 0))


def training_data_report(df: DataFrame) -> DataFrame:
    """Totals, quality bands and format counts of records, and empty texts."""
    per = df.groupBy("format_type").agg(
        F.count("*").alias("n"), F.sum("quality_score").alias("q"), F.count_if(F.col("quality_score") >= 0.8).alias("high"),
        F.count_if((F.col("quality_score") >= 0.6) & (F.col("quality_score") < 0.8)).alias("medium"), F.count_if(F.col("quality_score") < 0.6).alias("low"),
        (F.count_if(T.trim_ws(F.col("input_text")) == "") + F.count_if(T.trim_ws(F.col("output_text")) == "")).alias("errors"))
    formats = F.map_from_entries(F.array_sort(F.collect_list(F.struct("format_type", "n"))))  # one entry per format
    return per.agg(F.sum("n").alias("total_items"), (F.sum("q") / F.sum("n")).alias("average_quality"), formats.alias("format_distribution"),
                   F.sum("high").alias("high"), F.sum("medium").alias("medium"), F.sum("low").alias("low"), F.sum("errors").alias("errors")).withColumn(
        "valid", F.col("errors") == 0)


def chunk_summary(df: DataFrame) -> DataFrame:
    """Totals and distributions over analysed chunks (one row)."""
    c = F.col
    g = df.agg(
        F.count("*").alias("total_chunks"), F.sum("word_count").alias("total_words"), F.sum("token_count").alias("total_tokens"),
        F.avg("word_count").alias("avg_words_per_chunk"), F.avg("token_count").alias("avg_tokens_per_chunk"),
        *[F.count_if(c("content_type") == k).alias(f"n_{k}") for k in FV.CONTENT_PATTERNS],
        F.avg("coherence_score").alias("avg_coherence_score"), F.avg("semantic_density").alias("avg_semantic_density"),
        F.count_if(c("dialogue_potential") > 0.3).alias("chunks_with_dialogue"), F.count_if(c("semantic_density") > 0.6).alias("chunks_with_high_density"),
        F.count_if(c("narrative_position") < 0.33).alias("beginning"),
        F.count_if((c("narrative_position") >= 0.33) & (c("narrative_position") < 0.67)).alias("middle"), F.count_if(c("narrative_position") >= 0.67).alias("end"))
    return g


def batch_quality(df: DataFrame, blank_apart: bool = False) -> DataFrame:
    """Mean, grade counts, issue and warning sums and the distinct recommendations of scored texts; ``blank_apart`` as in ``scores.quality_messages``."""
    m = S.quality_messages(blank_apart)
    d = df.select("quality_score", "quality_grade", F.size(m["issues"]).alias("_i"), F.size(m["warnings"]).alias("_w"), m["recommendations"].alias("_r"))
    grades = [g for _, g in FV.QUALITY_GRADES] + [FV.LOWEST_GRADE]
    recs = F.array_sort(F.array_distinct(F.flatten(F.collect_set("_r"))))  # sets of a few fixed texts
    return d.agg(F.count("*").alias("total_chunks"), F.avg("quality_score").alias("avg_quality"),
                 *[F.count_if(F.col("quality_grade") == g).alias(g.lower().replace(" ", "_")) for g in grades],
                 F.sum("_i").alias("issues_count"), F.sum("_w").alias("warnings_count"), F.nullif(F.array_join(recs, "|"), F.lit("")).alias("recommendations"))


def quality_summary(df: DataFrame) -> DataFrame:
    q = F.col("quality_score")
    bands = {"excellent": q >= 0.9, "good": (q >= 0.7) & (q < 0.9), "fair": (q >= 0.5) & (q < 0.7), "poor": q < 0.5}
    g = df.agg(F.count("*").alias("total_chunks"), F.count(q).alias("analyzed"), F.avg(q).alias("avg_quality"), F.min(q).alias("min_quality"),
               F.max(q).alias("max_quality"), F.coalesce(F.stddev_samp(q), F.lit(0.0)).alias("quality_std"), *[F.count_if(c).alias(f"{k}_count") for k, c in bands.items()])
    return g.select("*", *[T.ratio(F.col(f"{k}_count") * 100, F.col("analyzed")).alias(f"{k}_pct") for k in bands])


def export_quality_gate(df: DataFrame, at: float = 0.6) -> DataFrame:
    """Pass and fail counts at the gate, missing contents, and advice above 30 % failures."""
    g = df.agg(F.count("*").alias("total_records"), F.count_if(F.col("quality_score") >= at).alias("quality_passed"),
               F.count_if(F.col("content").isNull() | (F.col("content") == "")).alias("missing_content"), F.avg("quality_score").alias("avg_quality"))
    failed = F.col("total_records") - F.col("quality_passed")
    return (g.withColumn("quality_failed", failed).withColumn("is_valid", F.col("missing_content") == 0)
            .withColumn("recommendations", F.when(T.ratio(F.col("quality_failed"), F.col("total_records")) > 0.3, F.lit(
                "Consider improving content quality before export|Review and enhance low-quality chunks")).otherwise(F.lit(""))))


def theme_statistics(matches: DataFrame) -> DataFrame:
    """Counts, documents, mean confidence and confidence bands per theme."""
    c = F.col("confidence")
    return matches.groupBy("keyword").agg(
        F.count("*").alias("matches"), F.count_distinct("doc_id").alias("documents"), F.avg(c).alias("average_confidence"),
        F.count_if(c > 0.8).alias("high"), F.count_if((c > 0.5) & (c <= 0.8)).alias("medium"), F.count_if(c <= 0.5).alias("low"),
        F.array_join(F.array_sort(F.collect_set("method")), "|").alias("methods"))


def language_statistics(df: DataFrame) -> DataFrame:
    """Count, percent and mean confidence per language, marking the commonest."""
    g = df.groupBy("language", "language_name").agg(F.count("*").alias("n"), F.avg("language_confidence").alias("average_confidence"))
    total = g.agg(F.sum("n").alias("_total"), F.min_by("language", F.struct(-F.col("n"), F.col("language"))).alias("_top"))
    return attach(g, total).select("language", "language_name", "n", (F.col("n") * 100 / F.col("_total")).alias("percentage"),
                                   "average_confidence", (F.col("language") == F.col("_top")).alias("most_common"))
