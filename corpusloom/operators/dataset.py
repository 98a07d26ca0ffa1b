"""Prompt tables out, records in: no model is called here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom import prompts as P
from corpusloom.functions import scores as S, text as T
from corpusloom.operators import extraction as EX
from corpusloom.session import scratch


def fill(template: Column, values: dict, content: Column | None = None) -> Column:
    """Put values into the named places; the content goes in last, so its own braces stay as they are."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{%s}" % name), value if isinstance(value, Column) else F.lit(value))
    return out if content is None else F.replace(out, F.lit("{content}"), content)


def table_of(rows: list[dict]) -> Column:
    """A small literal table as array<struct>; exploding it per row replaces a cross join."""
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.items()]) for r in rows])


def render_training_prompts(chunks: DataFrame, formats=None, parameters=None, templates=None) -> DataFrame:
    t = templates or P.TRAINING_TEMPLATES
    rows = [{"format_type": k, "_t": fill_py(t[k], {**P.TRAINING_PARAMETERS, **(parameters or {})})} for k in (formats or t)]
    return chunks.select("chunk_id", "text", F.inline(table_of(rows))).select(
        "chunk_id", "format_type", fill(F.col("_t"), {}, F.col("text")).alias("prompt"))


def fill_py(template: str, values: dict) -> str:
    for k, v in values.items():
        template = template.replace("{%s}" % k, v)
    return template


def render_dialogue_prompts(chunks: DataFrame, topics: list[str] | None = None, num_items: int = 3) -> DataFrame:
    """One prompt per style; without given topics the first three themes of the chunk guide it."""
    rows = [{"style": k, "_t": fill_py(P.DIALOGUE_TEMPLATE, {"style": v, "num_items": str(num_items)})} for k, v in P.DIALOGUE_STYLES.items()]
    if topics:
        guide = F.lit("\nFocus on these topics: " + ", ".join(topics))
    else:
        own = F.array_join(F.transform(T.themes(F.col("text"), 3), lambda t: t["theme"]), ", ")
        guide = F.when(own != "", F.concat(F.lit("\nConsider these topics from the text: "), own)).otherwise(F.lit(""))
    return chunks.withColumn("_g", guide).select("chunk_id", "text", "_g", F.inline(table_of(rows))).select(
        "chunk_id", "style", fill(F.col("_t"), {"topics": F.col("_g")}, F.col("text")).alias("prompt"))


def narrator_rows(style: str, custom: dict | None = None) -> list[dict]:
    people = {**P.NARRATORS, **(custom or {})}
    return [{"kind": "narrator", "persona": k, "_t": fill_py(P.NARRATOR_TEMPLATE, {"name": n, "manner": m, "style": style})} for k, (n, m) in people.items()]


def rewriter_rows(tone: str, length: str) -> list[dict]:
    return [{"kind": "rewrite", "persona": k, "_t": fill_py(P.REWRITE_TEMPLATE, {"name": n, "tone": tone, "length": length})} for k, n in P.REWRITERS.items()]


def render_persona_prompts(chunks: DataFrame, style: str = "storytelling", tone: str = "neutral", length: str = "medium",
                           custom: dict | None = None) -> DataFrame:
    """Narrator and rewrite prompts; ``custom`` adds personas as key -> (name, manner)."""
    rows = narrator_rows(style, custom) + rewriter_rows(tone, length)
    return chunks.select("chunk_id", "text", F.inline(table_of(rows))).select(
        "chunk_id", "kind", "persona", fill(F.col("_t"), {}, F.col("text")).alias("prompt"))


def knowledge_rows(difficulty: str, num_items: int) -> list[dict]:
    return [{"knowledge_type": k, "_t": fill_py(P.KNOWLEDGE_TEMPLATE, {"request": r, "keys": keys, "difficulty": difficulty, "num_items": str(num_items)})}
            for k, (_, r, keys) in P.KNOWLEDGE_TYPES.items()]


def render_knowledge_prompts(chunks: DataFrame, difficulty: str = "Intermediate", num_items: int = 3) -> DataFrame:
    return chunks.select("chunk_id", "text", F.inline(table_of(knowledge_rows(difficulty, num_items)))).select(
        "chunk_id", "knowledge_type", fill(F.col("_t"), {}, F.col("text")).alias("prompt"))


def mixed_knowledge_set(chunks: DataFrame, difficulty: str = "Intermediate") -> DataFrame:
    """Every knowledge type for every chunk, two items each."""
    return render_knowledge_prompts(chunks, difficulty, 2).withColumn("id", F.concat_ws("_", "chunk_id", "knowledge_type"))


def render_refinement_prompts(chunks: DataFrame, target_tone: str = "professional", custom: str = "Improve the content") -> DataFrame:
    rows = [{"refinement_type": k, "_t": fill_py(fill_py(P.REFINEMENT_TEMPLATE, {"request": r}), {"target_tone": target_tone, "custom_instructions": custom})}
            for k, r in P.REFINEMENT_REQUESTS.items()]
    return chunks.select("chunk_id", "text", F.inline(table_of(rows))).select(
        "chunk_id", "refinement_type", fill(F.col("_t"), {}, F.col("text")).alias("prompt"))


def custom_prompts(chunks: DataFrame, templates: dict[str, str]) -> DataFrame:
    """The user's own templates by name, with a ``{content}`` place."""
    rows = [{"template": k, "_t": v} for k, v in templates.items()]
    return chunks.select("chunk_id", "text", F.inline(table_of(rows))).select(
        "chunk_id", "template", fill(F.col("_t"), {}, F.col("text")).alias("prompt"))


def render_enhanced_prompts(df: DataFrame, kind: str, style: dict | None = None) -> DataFrame:
    """Base request plus entities, context and style notes.  Needs ``with_profile`` columns and chunk_id."""
    style = {"persona": "general audience", "tone": "neutral", "format": "qa_pairs", "knowledge_type": "analogies",
             "length": "medium", **(style or {})}
    base = fill_py(P.BASE_REQUESTS.get(kind, "Transform the following content:"), style)
    c, low = F.col("text"), F.lower(F.col("text"))
    d = df.withColumn("_e", T.important_entities(T.labeled_entities(c)))

    def names(level):
        return F.array_join(F.transform(F.filter("_e", lambda e: e["importance"] == level), lambda e: e["text"]), ", ")

    from corpusloom import fixed_values as FV
    from corpusloom.operators.themes import phrase_scores
    phrases = F.array_join(F.transform(phrase_scores(c, 3), lambda p: p["phrase"]), ", ")
    ents = F.when(F.size("_e") == 0, F.lit("No specific entities to preserve.")).otherwise(F.array_join(T.present(
        F.when(names("high") != "", F.concat(F.lit("MUST preserve these important names/organizations: "), names("high"))),
        F.when(names("medium") != "", F.concat(F.lit("Should preserve these entities when possible: "), names("medium")))), "\n"))
    context = F.array_join(T.present(
        F.when(T.contains_any(low, FV.CONTEXT_WORDS["temporal"]), F.lit("Preserve temporal relationships and sequence.")),
        F.when(T.contains_any(low, FV.CONTEXT_WORDS["causal"]), F.lit("Maintain cause-and-effect relationships.")),
        F.when(phrases != "", F.concat(F.lit("Preserve these key concepts: "), phrases))), "\n")
    lengths = {"short": "Keep the output concise and focused.", "medium": "Provide balanced detail and explanation.",
               "detailed": "Include comprehensive explanations and examples."}
    notes = F.array_join(T.present(
        F.when(F.col("complexity") > 0.7, F.lit("The original content is complex - adapt appropriately for the target audience."))
        .when(F.col("complexity") < 0.3, F.lit("The original content is simple - maintain clarity while adding appropriate depth.")),
        F.when(F.lit(style["tone"] != "neutral"), F.lit(f"Adopt a {style['tone']} tone throughout the transformation.")),
        F.lit(lengths.get(style["length"]))), "\n")
    return d.select("chunk_id", F.concat_ws("\n\n", F.lit(base), F.concat(F.lit("KEEP:\n"), ents, F.lit("\n"), context),
                                            F.concat(F.lit("STYLE:\n"), notes), F.concat(F.lit("CONTENT:\n"), c)).alias("prompt"))


# --- records without a model --------------------------------------------------------------

_RECORD = ("id", "format_type", "input_text", "output_text", "quality_score")


def training_rows(formats: list[str]) -> list[Column]:
    """Rule-based records of a chunk as structs: three questions, one label, or one generic item per format."""
    c, cid = F.col("text"), F.col("chunk_id")

    def row(id_, fmt, i, o, q):
        return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in zip(_RECORD, (id_, fmt, i, o, q))])

    rows = []
    for f in formats:
        if f == "qa_pairs":
            rows += [row(F.concat(cid, F.lit(f"_qa_fallback_{i}")), f, q, F.concat(F.lit("Based on the content: "), c), 0.6)
                     for i, q in enumerate(P.RULE_QUESTIONS)]
        elif f == "classification":
            rows.append(row(F.concat(cid, F.lit("_classification_fallback")), f, c, "informational", 0.6))
        else:
            rows.append(row(F.concat(cid, F.lit(f"_{f}_fallback")), f, c, f"Processed content from {f}", 0.5))
    return rows


def training_records(chunks: DataFrame, formats: list[str]) -> DataFrame:
    """A row for each of the records of :func:`training_rows`."""
    return chunks.select("chunk_id", F.inline(F.array(*training_rows(formats))))


def dialogue_records(chunks: DataFrame) -> DataFrame:
    """Questions about the full-stop parts longer than 20 characters."""
    parts = F.split("text", r"\.")
    return (chunks.select("chunk_id", F.posexplode(parts).alias("_i", "_s")).withColumn("_s", T.trim_ws(F.col("_s")))
            .filter(F.length("_s") > 20).select(
        F.concat("chunk_id", F.lit("_fallback_"), F.col("_i").cast("string")).alias("id"),
        F.concat(F.lit("What can you tell me about "), "_s", F.lit("?")).alias("question"),
        F.concat("_s", F.lit(".")).alias("answer"), F.lit(0.5).alias("confidence")))


def variant_rows() -> list[dict]:
    rows = [{"kind": "narrator", "variant": k, "suffix": f"_persona_{k}_fallback", "score": 0.6,
             "_t": P.NARRATOR_FALLBACKS.get(k, P.NARRATOR_FALLBACK.replace("{name}", k))} for k in P.NARRATORS]
    rows += [{"kind": "rewrite", "variant": k, "suffix": f"_rewrite_{k}_fallback", "score": 0.6,
              "_t": P.REWRITE_FALLBACKS.get(k, P.REWRITE_FALLBACK.replace("{name}", k))} for k in P.REWRITERS]
    for k in P.KNOWLEDGE_TYPES:
        title, text, edu, _ = P.KNOWLEDGE_FALLBACK
        part = k
        if k in P.KNOWLEDGE_FALLBACKS:
            part, title, text, edu, _ = P.KNOWLEDGE_FALLBACKS[k]
        rows.append({"kind": "knowledge", "variant": k, "suffix": f"_{part}_fallback", "score": edu, "_t": text.replace("{type}", k.replace("_", " "))})
    rows += [{"kind": "refinement", "variant": k, "suffix": f"_{k}", "score": 0.5, "_t": P.REFINEMENT_FALLBACKS.get(k, P.REFINEMENT_FALLBACK)} for k in P.REFINEMENT_REQUESTS]
    return rows


def variant_records(chunks: DataFrame) -> DataFrame:
    """Template texts for every persona, rewrite, knowledge type and refinement."""
    return chunks.select("chunk_id", "text", F.inline(table_of(variant_rows()))).select(
        F.concat("chunk_id", "suffix").alias("id"), "kind", "variant", fill(F.col("_t"), {}, F.col("text")).alias("content"), "score")


def fill_missing_with_fallback(chunks: DataFrame, responses: DataFrame, fmt: str = "qa_pairs") -> DataFrame:
    """Parsed and rescued items, and rule-based records for the chunks that got none."""
    rows = EX.parsed_or_rescued(responses)
    # responses are read once: their records are few beside the texts, and the chunks that have some are told from the stored records
    path = scratch(chunks.sparkSession, "response-records")
    rows.write.parquet(path)
    items = chunks.sparkSession.read.schema(rows.schema).parquet(path)
    missing = chunks.join(items.select("chunk_id").distinct(), "chunk_id", "left_anti")
    return items.unionByName(training_records(missing, [fmt]))


def knowledge_items(chunks: DataFrame) -> DataFrame:
    """Rule-based knowledge items per chunk with value scores; difficulty by text length."""
    rows = []
    for k, (name, _, _) in P.KNOWLEDGE_TYPES.items():
        part, title, text, edu, fun = P.KNOWLEDGE_FALLBACKS.get(k, (k, *P.KNOWLEDGE_FALLBACK))
        rows.append({"knowledge_type": k, "type_name": name, "title": title, "content": text.replace("{type}", k.replace("_", " ")), "educational_value": edu, "entertainment_value": fun})
    n = T.n_words(F.col("text"))
    level = F.when(n < 50, F.lit("Beginner")).when(n < 150, F.lit("Intermediate")).otherwise(F.lit("Advanced"))
    return chunks.select("chunk_id", level.alias("difficulty"), F.inline(table_of(rows)))


def records_with_errors(df: DataFrame) -> DataFrame:
    """Refinement results; a failed row keeps its text with gain 0 and the error in words.

    Columns: content_id, original, refined, kind, error (null when it worked).
    """
    failed = F.col("error").isNotNull()
    return df.select(
        "content_id", "kind", F.when(failed, F.col("original")).otherwise(F.col("refined")).alias("refined"),
        F.when(failed, F.lit(0.0)).otherwise(S.refinement_gain(F.col("kind"), F.col("original"), F.col("refined"))).alias("quality_gain"),
        F.when(failed, F.concat(F.lit("Error during refinement: "), "error")).otherwise(
            S.change_summary(F.col("kind"), F.col("original"), F.col("refined"))).alias("changes_summary"))
