"""Queries: prompts, records, joins, versions.

Long texts are reported as length and md5, which checks every character.
"""

from pyspark.sql import functions as F

from corpusloom import fixed_values as FV, prompts as P
from corpusloom.functions import language as LG, pairs as PF, scores as SC, text as T
from corpusloom.operators import dataset as DS, extraction as EX, graph as GR, preparation as PR, vectors as VE, versions as VS
from corpusloom.registry.core import query
from corpusloom.registry.q_clean import MARKED, PARA_CHUNKS, TONE, para_chunks
from corpusloom.registry.q_extract import DIALOGUE, ENTITIES, PHR, RESP, SEGMENTS, THEMES, responses
from corpusloom.registry.q_score import GAIN, DESC, JAC, KINDS, REF, refined
from corpusloom.registry.sqlbits import *  # noqa: F403
from corpusloom.sources import tables as TB


def digest(df, col="prompt"):
    return df.withColumn("n_chars", F.length(col)).withColumn("md5", F.md5(col)).drop(col)


def values(rows, cols):
    """DuckDB VALUES list from dict rows."""
    def v(x):
        return q(x) if isinstance(x, str) else f"{x}::DOUBLE"
    return "(VALUES " + ", ".join("(" + ", ".join(v(r[c]) for c in cols) + ")" for r in rows) + f") t({', '.join(cols)})"


def put(expr="_t", content="text"):
    return f"replace({expr}, '{{content}}', {content})"


def prompt_sql(rows, cols, extra=""):
    keep = ", ".join(c for c in cols if c != "_t")
    return f"{PARA_CHUNKS}, r AS (SELECT chunk_id, {keep}, {put()} AS prompt FROM c, {values(rows, cols)}) SELECT chunk_id, {keep}, length(prompt) AS n_chars, md5(prompt) AS md5 FROM r"


TRAIN_ROWS = [{"format_type": k, "_t": DS.fill_py(t, P.TRAINING_PARAMETERS)} for k, t in P.TRAINING_TEMPLATES.items()]


@query("render_training_prompts", sql=prompt_sql(TRAIN_ROWS, ["format_type", "_t"]))
def render_training_prompts(spark, sf):
    return digest(DS.render_training_prompts(para_chunks(spark, sf)))


DLG_ROWS = [{"style": k, "_t": DS.fill_py(P.DIALOGUE_TEMPLATE, {"style": v, "num_items": "3"})} for k, v in P.DIALOGUE_STYLES.items()]


@query("render_dialogue_prompts", sql=f"""{PARA_CHUNKS}, {THEMES.replace('FROM m', 'FROM cm').replace('doc_id', 'chunk_id').replace('th AS (', 'cm AS (SELECT chunk_id, text FROM c), th AS (', 1)},
tg AS (SELECT chunk_id, string_agg(theme, ', ' ORDER BY rank) AS topics FROM tr WHERE rank <= 3 GROUP BY 1),
r AS (SELECT c.chunk_id, style, {put("replace(_t, '{topics}', CASE WHEN topics IS NULL THEN '' ELSE chr(10) || 'Consider these topics from the text: ' || topics END)")} AS prompt FROM c LEFT JOIN tg USING (chunk_id), {values(DLG_ROWS, ['style', '_t'])})
SELECT chunk_id, style, length(prompt) AS n_chars, md5(prompt) AS md5 FROM r""")
def render_dialogue_prompts(spark, sf):
    return digest(DS.render_dialogue_prompts(para_chunks(spark, sf)))


PERSONA_ROWS = DS.narrator_rows("storytelling") + DS.rewriter_rows("neutral", "medium")


@query("render_persona_prompts", sql=prompt_sql(PERSONA_ROWS, ["kind", "persona", "_t"]))
def render_persona_prompts(spark, sf):
    return digest(DS.render_persona_prompts(para_chunks(spark, sf)))


CUSTOM = {"librarian": ("A Librarian", "order and quiet humour")}


@query("custom_persona", sql=prompt_sql(DS.narrator_rows("storytelling", CUSTOM)[-1:], ["persona", "_t"]))
def custom_persona(spark, sf):
    return digest(DS.render_persona_prompts(para_chunks(spark, sf), custom=CUSTOM).filter("persona = 'librarian'").drop("kind"))


@query("custom_prompt", sql=prompt_sql([{"template": "short", "_t": "Say it shorter: {content}"}], ["template", "_t"]))
def custom_prompt(spark, sf):
    return digest(DS.custom_prompts(para_chunks(spark, sf), {"short": "Say it shorter: {content}"}))


@query("render_knowledge_prompts", sql=prompt_sql(DS.knowledge_rows("Intermediate", 3), ["knowledge_type", "_t"]))
def render_knowledge_prompts(spark, sf):
    return digest(DS.render_knowledge_prompts(para_chunks(spark, sf)))


REFINE_ROWS = [{"refinement_type": k, "_t": DS.fill_py(DS.fill_py(P.REFINEMENT_TEMPLATE, {"request": r}), {"target_tone": "professional", "custom_instructions": "Improve the content"})}
               for k, r in P.REFINEMENT_REQUESTS.items()]


@query("render_refinement_prompts", sql=prompt_sql(REFINE_ROWS, ["refinement_type", "_t"]))
def render_refinement_prompts(spark, sf):
    return digest(DS.render_refinement_prompts(para_chunks(spark, sf)))


@query("mixed_knowledge_set", sql=f"""{PARA_CHUNKS}, r AS (SELECT chunk_id, knowledge_type, {put()} AS prompt FROM c, {values(DS.knowledge_rows('Intermediate', 2), ['knowledge_type', '_t'])})
SELECT chunk_id || '_' || knowledge_type AS id, chunk_id, knowledge_type, length(prompt) AS n_chars, md5(prompt) AS md5 FROM r""")
def mixed_knowledge_set(spark, sf):
    return digest(DS.mixed_knowledge_set(para_chunks(spark, sf)))


BASE = DS.fill_py(P.BASE_REQUESTS["rewrite_story"], {"persona": "a child", "tone": "warm"})


@query("render_enhanced_prompts", sql=f"""WITH {MARKED}, {TONE}, {PHR}, {ENTITIES},
ir AS (SELECT doc_id, text, label, row_number() OVER (PARTITION BY doc_id ORDER BY list_position({lst(FV.ENTITY_LABEL_ORDER)}, label), start, text) AS rank FROM ent),
ia AS (SELECT doc_id, string_agg(text, ', ' ORDER BY rank) FILTER (label IN ('PERSON', 'ORG')) AS hi, string_agg(text, ', ' ORDER BY rank) FILTER (label = 'GPE') AS me FROM ir WHERE rank <= 10 GROUP BY 1),
ph AS (SELECT doc_id, string_agg(phrase, ', ' ORDER BY rank) AS phrases FROM pr WHERE rank <= 3 GROUP BY 1),
x AS (SELECT cx.doc_id, {q(BASE)} || chr(10) || chr(10) || 'KEEP:' || chr(10) ||
  CASE WHEN hi IS NULL AND me IS NULL THEN 'No specific entities to preserve.' ELSE array_to_string(list_filter(['MUST preserve these important names/organizations: ' || hi, 'Should preserve these entities when possible: ' || me], lambda z: z IS NOT NULL), chr(10)) END || chr(10) ||
  array_to_string(list_filter([CASE WHEN {anyof('lower(text)', FV.CONTEXT_WORDS['temporal'])} THEN 'Preserve temporal relationships and sequence.' END, CASE WHEN {anyof('lower(text)', FV.CONTEXT_WORDS['causal'])} THEN 'Maintain cause-and-effect relationships.' END,
    'Preserve these key concepts: ' || phrases], lambda z: z IS NOT NULL), chr(10)) || chr(10) || chr(10) || 'STYLE:' || chr(10) ||
  array_to_string(list_filter([CASE WHEN complexity > 0.7 THEN 'The original content is complex - adapt appropriately for the target audience.' WHEN complexity < 0.3 THEN 'The original content is simple - maintain clarity while adding appropriate depth.' END,
    'Adopt a warm tone throughout the transformation.', 'Provide balanced detail and explanation.'], lambda z: z IS NOT NULL), chr(10)) || chr(10) || chr(10) || 'CONTENT:' || chr(10) || text AS prompt
  FROM cx LEFT JOIN ia USING (doc_id) LEFT JOIN ph USING (doc_id))
SELECT doc_id AS chunk_id, length(prompt) AS n_chars, md5(prompt) AS md5 FROM x""")
def render_enhanced_prompts(spark, sf):
    d = PR.with_profile(TB.marked_documents(spark, sf)).withColumnRenamed("doc_id", "chunk_id")
    return digest(DS.render_enhanced_prompts(d, "rewrite_story", {"persona": "a child", "tone": "warm"}))


# --- records ----------------------------------------------------------------------------------
ALL_FORMATS = list(P.TRAINING_TEMPLATES)


def _record_sql(cte="c"):
    parts = [f"SELECT chunk_id, chunk_id || '_qa_fallback_{i}' AS id, 'qa_pairs' AS format_type, {q(t)} AS input_text, 'Based on the content: ' || text AS output_text, 0.6::DOUBLE AS quality_score FROM {cte}"
             for i, t in enumerate(P.RULE_QUESTIONS)]
    parts.append(f"SELECT chunk_id, chunk_id || '_classification_fallback', 'classification', text, 'informational', 0.6::DOUBLE FROM {cte}")
    parts += [f"SELECT chunk_id, chunk_id || '_{f}_fallback', '{f}', text, 'Processed content from {f}', 0.5::DOUBLE FROM {cte}"
              for f in ALL_FORMATS if f not in ("qa_pairs", "classification")]
    return " UNION ALL ".join(parts)


RECORDS = f"{PARA_CHUNKS}, records AS ({_record_sql()})"


def records(spark, sf):
    return DS.training_records(para_chunks(spark, sf), ALL_FORMATS)


@query("training_records_rule_based", sql=f"{RECORDS} SELECT id, format_type, md5(input_text) AS input_md5, md5(output_text) AS output_md5, quality_score FROM records")
def training_records_rule_based(spark, sf):
    return records(spark, sf).select("id", "format_type", F.md5("input_text").alias("input_md5"), F.md5("output_text").alias("output_md5"), "quality_score")


@query("dialogue_records_rule_based", sql=f"""{PARA_CHUNKS}, s AS (SELECT chunk_id, unnest(string_split(text, '.')) AS s, unnest(range(0, len(string_split(text, '.')))) AS i FROM c), t AS (SELECT chunk_id, i, {trim('s')} AS s FROM s WHERE s IS NOT NULL)
SELECT chunk_id || '_fallback_' || i AS id, 'What can you tell me about ' || s || '?' AS question, s || '.' AS answer, 0.5::DOUBLE AS confidence FROM t WHERE length(s) > 20""")
def dialogue_records_rule_based(spark, sf):
    return DS.dialogue_records(para_chunks(spark, sf))


@query("variant_records_rule_based", sql=f"""{PARA_CHUNKS}, r AS (SELECT chunk_id || suffix AS id, kind, variant, {put()} AS content, score FROM c, {values(DS.variant_rows(), ['kind', 'variant', 'suffix', 'score', '_t'])})
SELECT id, kind, variant, score, length(content) AS n_chars, md5(content) AS md5 FROM r""")
def variant_records_rule_based(spark, sf):
    return digest(DS.variant_records(para_chunks(spark, sf)), "content")


@query("fill_missing_with_fallback", sql=f"""{RESP}, resc AS (SELECT chunk_id, chunk_id || '_' || format_type || '_simple_' || i AS id, format_type, l AS input_text, 'Generated from content' AS output_text, 0.5::DOUBLE AS quality_score
  FROM (SELECT chunk_id, format_type, unnest(['[{{"question": oops]', '', {trim('head')}, 'last']) AS l, unnest([0, 1, 2, 3]) AS i FROM rs WHERE kind = 3) WHERE l <> ''),
items AS (SELECT *, 0.9::DOUBLE AS quality_score FROM parsed UNION ALL SELECT * FROM resc), miss AS (SELECT * FROM c WHERE chunk_id NOT IN (SELECT chunk_id FROM items)), fb AS ({_record_sql('miss')})
SELECT * FROM items UNION ALL SELECT * FROM fb WHERE format_type = 'qa_pairs'""")
def fill_missing_with_fallback(spark, sf):
    return DS.fill_missing_with_fallback(para_chunks(spark, sf).select("chunk_id", "text"), responses(spark, sf))


@query("records_with_errors", sql=f"""WITH {REF}, d AS (SELECT *, {NWORDS('enhanced')} - {NWORDS('original')} AS delta, length(enhanced) % 3 = 0 AS bad FROM r)
SELECT pair_id AS content_id, kind, CASE WHEN bad THEN original ELSE enhanced END AS refined, CASE WHEN bad THEN 0.0::DOUBLE ELSE {R(f'''least(0.5, {GAIN} * CASE WHEN kind IN ('add_examples', 'increase_detail') THEN least(2.0, {NWORDS('enhanced')} / {NWORDS('original')}) ELSE 1 END)''')} END AS quality_gain,
 CASE WHEN bad THEN 'Error during refinement: no reply' ELSE {DESC} || CASE WHEN delta > 10 THEN '. Added ' || delta || ' words for better explanation.' WHEN delta < -10 THEN '. Reduced by ' || -delta || ' words for conciseness.' ELSE '. Maintained similar length with improved quality.' END END AS changes_summary FROM d""")
def records_with_errors(spark, sf):
    d = refined(spark, sf).withColumn("error", F.when(F.length("enhanced") % 3 == 0, F.lit("no reply")))
    return DS.records_with_errors(d.select(F.col("pair_id").alias("content_id"), "original", F.col("enhanced").alias("refined"), "kind", "error"))


# --- joins ----------------------------------------------------------------------------------------

@query("pair_original_enhanced", sql=f"WITH {PAIRS} SELECT pair_id, length(original) AS original_chars, length(enhanced) AS enhanced_chars, {R(JAC)} AS similarity FROM p")
def pair_original_enhanced(spark, sf):
    p = TB.pairs(spark, sf)
    return p.select("pair_id", F.length("original").alias("original_chars"), F.length("enhanced").alias("enhanced_chars"),
                    PF.jaccard(F.col("original"), F.col("enhanced")).alias("similarity"))


def vector_docs(spark, sf):
    """Vectors as chunks of documents of up to 64 chunks."""
    return TB.table(spark, sf, "embeddings").withColumn("doc", F.floor(F.col("vec_id") / 64))


@query("related_chunks", sql=f"""WITH e AS (SELECT vec_id, label, vec_id // 64 AS doc, embedding::DOUBLE[] AS v FROM embeddings)
SELECT a.doc, a.vec_id, b.vec_id AS related, {R('list_cosine_similarity(a.v, b.v)')} AS similarity FROM e a JOIN e b ON a.doc = b.doc AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) > 0.25""")
def related_chunks(spark, sf):
    return VE.related_chunks(vector_docs(spark, sf), ["doc"], "vec_id", above=0.25)  # no pair of the test vectors reaches 0.7


TERMS = f"""{PARA_CHUNKS}, k AS (SELECT doc_id, chunk_no, chunk_id, text FROM c), m2 AS (SELECT chunk_id AS doc_id, text FROM k),
{ENTITIES.replace('FROM m)', 'FROM m2)').replace('FROM m,', 'FROM m2,')}, terms AS (SELECT k.doc_id, k.chunk_no, 'e' || ent.text AS term FROM ent JOIN k ON k.chunk_id = ent.doc_id
  UNION SELECT doc_id, chunk_no, 'c' || unnest({concepts('text')}) FROM k)"""


@query("dependency_links", sql=f"""{TERMS}, r AS (SELECT *, lag(chunk_no) OVER (PARTITION BY doc_id, term ORDER BY chunk_no) AS depends_on, row_number() OVER (PARTITION BY doc_id, term ORDER BY chunk_no) - 1 AS n_earlier FROM terms)
SELECT doc_id, chunk_no, left(term, 1) || ':' || term[2:] AS term, depends_on, n_earlier FROM r WHERE depends_on IS NOT NULL""")
def dependency_links(spark, sf):
    return GR.dependency_links(para_chunks(spark, sf))


@query("dependency_chunks", sql=f"""{TERMS}
SELECT DISTINCT a.doc_id, a.chunk_no, b.chunk_no AS depends_on FROM terms a JOIN terms b ON a.doc_id = b.doc_id AND a.term = b.term AND b.chunk_no < a.chunk_no""")
def dependency_chunks(spark, sf):
    return GR.dependency_chunks(GR.dependency_links(para_chunks(spark, sf)))


@query("theme_similarity_join", sql=f"""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), t AS (SELECT 'theme_' || label AS theme, arg_min(v, vec_id) AS v FROM e GROUP BY label)
SELECT theme, vec_id, {R('list_cosine_similarity(e.v, t.v)')} AS similarity FROM e, t WHERE list_cosine_similarity(e.v, t.v) >= 0.25""")
def theme_similarity_join(spark, sf):
    e = TB.table(spark, sf, "embeddings")
    themes = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding")).select(
        F.concat(F.lit("theme_"), F.col("label").cast("string")).alias("theme"), "embedding")
    return VE.theme_similarity_join(e, themes, "vec_id", 0.25)


SENT = f"""sn AS (SELECT doc_id, unnest({S('text')}) AS s, unnest(range(0, len({S('text')}))) AS sent_no FROM m), m2 AS (SELECT doc_id || '#' || sent_no AS doc_id, s AS text FROM sn)"""
COOC = f"""{SENT}, {ENTITIES.replace('FROM m)', 'FROM m2)')}, eo AS (SELECT split_part(doc_id, '#', 1)::BIGINT AS doc_id, split_part(doc_id, '#', 2)::BIGINT AS sent_no, text, row_number() OVER (PARTITION BY doc_id ORDER BY list_position(['PERSON', 'ORG', 'GPE'], label), start) AS n FROM ent),
co AS (SELECT a.doc_id, a.sent_no, a.text AS entity1, b.text AS entity2 FROM eo a JOIN eo b ON a.doc_id = b.doc_id AND a.sent_no = b.sent_no AND a.n < b.n)"""


@query("entity_cooccurrence", sql=f"WITH {MARKED}, {COOC} SELECT *, 0.7::DOUBLE AS confidence FROM co")
def entity_cooccurrence(spark, sf):
    return GR.entity_cooccurrence(TB.marked_documents(spark, sf))


@query("entity_graph", sql=f"""WITH {MARKED}, {COOC}, b AS (SELECT doc_id, entity1 AS entity, entity2 AS n FROM co UNION SELECT doc_id, entity2, entity1 FROM co)
SELECT doc_id, entity, string_agg(n, '|' ORDER BY n) AS neighbours FROM b GROUP BY 1, 2""")
def entity_graph(spark, sf):
    return GR.entity_graph(TB.marked_documents(spark, sf)).withColumn("neighbours", F.array_join("neighbours", "|"))


@query("concept_clusters", sql=f"""{PARA_CHUNKS}, k AS (SELECT doc_id, chunk_no, unnest({concepts('text')}) AS concept FROM c), s AS (SELECT *, count(*) OVER (PARTITION BY doc_id, concept) AS n FROM k)
SELECT doc_id, chunk_no, string_agg(concept, '|' ORDER BY concept) AS concepts FROM s WHERE n >= 2 GROUP BY 1, 2 HAVING count(*) >= 2""")
def concept_clusters(spark, sf):
    return GR.concept_clusters(para_chunks(spark, sf)).withColumn("concepts", F.array_join("concepts", "|"))


@query("global_themes", sql=f"""{PARA_CHUNKS}, {THEMES.replace('FROM m', 'FROM cm').replace('doc_id', 'chunk_id').replace('th AS (', 'cm AS (SELECT chunk_id, text FROM c), th AS (', 1)},
g AS (SELECT doc_id, theme, count(*) AS n FROM tr JOIN c USING (chunk_id) WHERE true GROUP BY 1, 2), t AS (SELECT doc_id, count(*) AS chunks FROM c GROUP BY 1)
SELECT doc_id, theme, n, chunks FROM g JOIN t USING (doc_id) WHERE n >= greatest(2, chunks * 0.2)""")
def global_themes(spark, sf):
    return GR.global_themes(para_chunks(spark, sf))


@query("span_anti_join", sql=f"WITH RECURSIVE {DIALOGUE}, {SEGMENTS} SELECT doc_id, start, question AS text FROM mono WHERE length(question) >= 20")
def span_anti_join(spark, sf):
    d = TB.dialogue_documents(spark, sf)
    paras = d.select("doc_id", F.inline(EX.exact_paragraphs(F.col("text")))).filter(F.length("text") >= FV.MIN_SEGMENT)
    spans = EX.with_qa_segments(d).select("doc_id", F.inline("qa_segments")).select("doc_id", F.col("start").alias("_s"), F.col("end").alias("_e"))
    free = paras.join(spans, (paras["doc_id"] == spans["doc_id"]) & (F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end")), "left_anti")
    return free.select("doc_id", "start", "text")


REFV = """rv AS (SELECT event_id, user_id AS content_id, event_type AS refinement_type, least(0.5, value / 1000) AS quality_gain, ts,
  'text of ' || repeat('word ', CAST(json_extract_string(props, '$.k') AS INT) % 7) AS content, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events)"""


@query("compare_versions", sql=f"""WITH {REFV} SELECT a.content_id, a.refinement_type AS type1, b.refinement_type AS type2, {NWORDS('b.content')} - {NWORDS('a.content')} AS word_count_change,
 {R('b.quality_gain - a.quality_gain')} AS quality_change, epoch_us(b.ts) - epoch_us(a.ts) AS time_difference_us FROM rv a JOIN rv b ON a.content_id = b.content_id AND a.version = 1 AND b.version = 3""")
def compare_versions(spark, sf):
    return VS.compare_versions(TB.refinements(spark, sf), 1, 3)


@query("version_history", sql=f"WITH {REFV} SELECT version, refinement_type, {R('quality_gain')} AS quality_gain, event_id FROM rv WHERE content_id = 8")
def version_history(spark, sf):
    return VS.version_history(TB.refinements(spark, sf), 8).select("version", "refinement_type", "quality_gain", "event_id")


@query("assign_versions", sql=f"WITH {REFV} SELECT content_id, event_id, version FROM rv")
def assign_versions(spark, sf):
    return VS.assign_versions(TB.refinements(spark, sf)).select("content_id", "event_id", "version")


@query("refinement_statistics", sql=f"""WITH {REFV}, t AS (SELECT content_id, refinement_type, count(*) AS n FROM rv GROUP BY 1, 2), b AS (SELECT content_id, arg_min(refinement_type, (-n, refinement_type)) AS most_used FROM t GROUP BY 1)
SELECT content_id, count(*) AS total_refinements, {R('sum(quality_gain)')} AS total_gain, {R('avg(quality_gain)')} AS average_gain, string_agg(DISTINCT refinement_type, '|' ORDER BY refinement_type) AS types,
 epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS latest_us, any_value(most_used) AS most_used FROM rv JOIN b USING (content_id) GROUP BY 1""")
def refinement_statistics(spark, sf):
    return VS.refinement_statistics(TB.refinements(spark, sf)).withColumn("first_us", F.unix_micros("first")).withColumn(
        "latest_us", F.unix_micros("latest")).drop("first", "latest")


@query("refinement_overview", sql=f"""WITH {REFV}, t AS (SELECT refinement_type, count(*) AS n, sum(quality_gain) AS gain FROM rv GROUP BY 1)
SELECT sum(n)::BIGINT AS total_refinements, {R('sum(gain)')} AS total_gain, {R('sum(gain) / sum(n)')} AS average_gain, arg_min(refinement_type, (-n, refinement_type)) AS most_used FROM t""")
def refinement_overview(spark, sf):
    """Statistics over all contents together."""
    return VS.refinement_overview(TB.refinements(spark, sf))


@query("language_dimension", sql="SELECT doc_id, lang, name, family, script FROM documents LEFT JOIN (VALUES " + ", ".join(
    f"('{l[0]}', '{l[1]}', '{l[2]}', '{l[3]}')" for l in FV.LANGUAGES) + ") l(lang, name, family, script) USING (lang)")
def language_dimension(spark, sf):
    return TB.table(spark, sf, "documents").select("doc_id", "lang").join(F.broadcast(LG.language_table(spark)), "lang", "left")


CACHE = f"st AS (SELECT DISTINCT text FROM documents WHERE doc_id % 2 = 0), ca AS (SELECT d.doc_id, st.text IS NOT NULL AS is_hit, {NWORDS('d.text')} AS word_count FROM documents d LEFT JOIN st ON st.text = d.text)"


def cached(spark, sf):
    d = TB.documents(spark, sf)
    store = d.filter("doc_id % 2 = 0").select(VS.text_digest(F.col("text")).alias("digest"), T.n_words(F.col("text")).alias("word_count")).groupBy(
        "digest").agg(F.max("word_count").alias("word_count"))
    return VS.reuse_cached_results(d, store, "doc_id", "word_count", T.n_words)


@query("reuse_cached_results", sql=f"WITH {CACHE} SELECT * FROM ca")
def reuse_cached_results(spark, sf):
    return cached(spark, sf).drop("text", "digest")


@query("cache_hit_rate", sql=f"WITH {CACHE} SELECT count(*) FILTER (is_hit) AS cache_hits, count(*) FILTER (NOT is_hit) AS cache_misses, {R('avg(is_hit::INT)')} AS cache_hit_rate FROM ca")
def cache_hit_rate(spark, sf):
    return cached(spark, sf).agg(F.count_if("is_hit").alias("cache_hits"), F.count_if(~F.col("is_hit")).alias("cache_misses"),
                                 F.avg(F.col("is_hit").cast("int")).alias("cache_hit_rate"))


@query("reconcile_counts", sql="""WITH a AS (SELECT source, count(*) AS actual FROM documents GROUP BY 1), d AS (SELECT source, actual + CASE WHEN source LIKE '%3' THEN 1 ELSE 0 END AS declared FROM a WHERE source NOT LIKE '%5' UNION ALL SELECT 'missing', 7)
SELECT source, coalesce(declared, 0) AS declared, coalesce(actual, 0) AS actual FROM a FULL JOIN d USING (source) WHERE coalesce(declared, 0) <> coalesce(actual, 0)""")
def reconcile_counts(spark, sf):
    d = TB.table(spark, sf, "documents").select("source")
    declared = d.filter("source NOT LIKE '%5'").groupBy("source").agg(F.count("*").alias("n")).select(
        "source", (F.col("n") + F.when(F.col("source").like("%3"), 1).otherwise(0)).alias("declared"))
    declared = declared.unionByName(spark.sql("SELECT 'missing' AS source, 7L AS declared"))
    return VS.reconcile_counts(declared, d, "source")


@query("dedupe_by_signature", sql=f"""WITH s AS (SELECT doc_id, lower({trim('split_part(text, chr(10), 1)')}) AS a, lower({trim('text')}) AS b FROM documents)
SELECT min(doc_id) AS doc_id FROM s GROUP BY a, b""")
def dedupe_by_signature(spark, sf):
    d = TB.documents(spark, sf).select("doc_id", F.substring_index("text", "\n", 1).alias("question"), F.col("text").alias("answer"))
    return VS.dedupe_by_signature(d, "question", "answer", ["doc_id"]).select("doc_id")


@query("semantic_coherence", sql=f"""WITH e AS (SELECT vec_id, vec_id // 64 AS doc, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT a.doc, list_cosine_similarity(a.v, b.v) AS s FROM e a LEFT JOIN e b ON b.doc = a.doc AND b.vec_id = a.vec_id + 1)
SELECT doc, count(*) AS n, {R('CASE WHEN count(*) < 2 THEN 1.0 ELSE greatest(0.0, least(1.0, avg(s))) END')} AS coherence FROM n GROUP BY 1""")
def semantic_coherence(spark, sf):
    return VE.neighbour_coherence(vector_docs(spark, sf), ["doc"], "vec_id")


LLOYD_STEPS = 4


def _lloyd_sql():
    steps = ["e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)", "c0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cluster, v AS c FROM (SELECT * FROM e ORDER BY vec_id LIMIT 5))"]
    for t in range(LLOYD_STEPS + 1):
        steps.append(f"a{t} AS (SELECT vec_id, any_value(v) AS v, min((list_distance(v, c), cluster)) AS b FROM e, c{t} GROUP BY 1)")
        if t < LLOYD_STEPS:
            steps.append(f"""u{t} AS (SELECT b[2] AS cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{t}), w{t} AS (SELECT cluster, i, avg(x) AS m FROM u{t} GROUP BY 1, 2),
n{t} AS (SELECT cluster, list(m ORDER BY i) AS c FROM w{t} GROUP BY 1), c{t + 1} AS (SELECT c{t}.cluster, coalesce(n{t}.c, c{t}.c) AS c FROM c{t} LEFT JOIN n{t} USING (cluster))""")
    return ", ".join(steps)


@query("cluster_texts", sql=f"""WITH {_lloyd_sql()} SELECT vec_id, b[2] AS cluster, {R('list_cosine_similarity(v, c)')} AS similarity_to_centre, {R(f'(SELECT sum(pow(b[1], 2)) FROM a{LLOYD_STEPS})')} AS inertia
FROM a{LLOYD_STEPS} JOIN c{LLOYD_STEPS} ON cluster = b[2]""")
def cluster_texts(spark, sf):
    return VE.lloyd_clusters(TB.table(spark, sf, "embeddings"), "vec_id", 5, steps=LLOYD_STEPS)


@query("cluster_texts_ml")
def cluster_texts_ml(spark, sf):
    """The same by Spark ML, whose random first centres no twin can follow."""
    return VE.cluster_vectors(TB.table(spark, sf, "embeddings"), "vec_id", 5)


@query("nearest_centre", sql=f"""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), t AS (SELECT label AS centre, arg_min(v, vec_id) AS c FROM e GROUP BY label),
s AS (SELECT vec_id, centre, list_cosine_similarity(v, c) AS similarity FROM e, t) SELECT vec_id, arg_max(centre, similarity)::BIGINT AS centre, {R('max(similarity)')} AS similarity FROM s GROUP BY 1""")
def nearest_centre(spark, sf):
    """Assignment to given centres: the first vector of each label."""
    e = TB.table(spark, sf, "embeddings")
    centres = e.groupBy(F.col("label").alias("centre")).agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return VE.nearest_centre(e, centres, "vec_id")


@query("knowledge_statistics", sql=f"""{PARA_CHUNKS}, k AS (SELECT CASE WHEN {NWORDS('text')} < 50 THEN 'Beginner' WHEN {NWORDS('text')} < 150 THEN 'Intermediate' ELSE 'Advanced' END AS difficulty FROM c),
t AS (SELECT difficulty, type_name, e, f FROM k, {values([dict(type_name=n, e=(P.KNOWLEDGE_FALLBACKS.get(t, (0, 0, 0, .5, .5)))[3], f=(P.KNOWLEDGE_FALLBACKS.get(t, (0, 0, 0, .5, .5)))[4]) for t, (n, _, _) in P.KNOWLEDGE_TYPES.items()], ['type_name', 'e', 'f'])})
SELECT type_name, difficulty, count(*) AS n, {R('avg(e)')} AS average_educational_value, {R('avg(f)')} AS average_entertainment_value, {R('(avg(e) + avg(f)) / 2')} AS quality_score FROM t GROUP BY 1, 2""")
def knowledge_statistics(spark, sf):
    k = DS.knowledge_items(para_chunks(spark, sf))
    return k.groupBy("type_name", "difficulty").agg(
        F.count("*").alias("n"), F.avg("educational_value").alias("average_educational_value"), F.avg("entertainment_value").alias("average_entertainment_value"),
        ((F.avg("educational_value") + F.avg("entertainment_value")) / 2).alias("quality_score"))
