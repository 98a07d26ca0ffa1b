"""Queries: cleaning, filters, routing, segmentation and chunking."""

from pyspark.sql import functions as F

from corpusloom import fixed_values as FV
from corpusloom.functions import scores as SC, text as T
from corpusloom.operators import chunking as CH, cleaning as CL
from corpusloom.registry.core import query
from corpusloom.registry.sqlbits import *  # noqa: F403
from corpusloom.sources import tables as TB

# --- flagship ---------------------------------------------------------------------------


@query("flagship_quality_by_route", sql=f"""
WITH RECURSIVE m AS (SELECT doc_id, lang,
  {trim("translate(regexp_replace(regexp_replace(regexp_replace(text, '[ '||chr(9)||']+', ' ', 'g'), '\\n\\s*\\d+\\s*\\n', chr(10), 'g'), '(?i)\\n\\s*Page \\d+\\s*\\n', chr(10), 'g'), '—‘’“”', '-''''\"\"')")} AS text
  FROM documents),
it AS (SELECT doc_id, unnest({MS('text')}) AS s, unnest(range(1, len({MS('text')}) + 1)) AS i FROM m),
{pack('it', 1000)},
{quality('c', 'doc_id, chunk_no')}
SELECT m.lang, {route('quality_score')} AS route, count(*) AS n, {R('avg(quality_score)')} AS mean_quality,
  {R('avg(word_count)')} AS mean_words FROM f2 JOIN m USING (doc_id) GROUP BY 1, 2
""")
def flagship(spark, sf):
    from corpusloom.plans.flagship import quality_by_route
    return quality_by_route(TB.text_table(spark, sf, "documents", "doc_id", "lang", "text"))


# --- cleaning -----------------------------------------------------------------------------

DIRTY = ("CASE doc_id % 7 WHEN 0 THEN '  ' || chr(7) || text || chr(10) WHEN 1 THEN text || '<script src=x>alert(1)</script> end' "
         "WHEN 2 THEN text || ' javascript: and VBScript: here' WHEN 3 THEN substr(text, 1, 8) WHEN 4 THEN '    ' "
         "WHEN 5 THEN NULL ELSE text END")


def _clean_sql(x):
    t = trim(x)
    out = rf"regexp_replace({t}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')"
    for p in FV.SCRIPT_PATTERNS:
        out = f"regexp_replace({out}, {q(p)}, '', 'g')"
    return out


@query("sanitize_text", sql=f"""
WITH x AS (SELECT doc_id, {DIRTY} AS text FROM documents), y AS (SELECT *, {trim('text')} AS t FROM x)
SELECT doc_id, NOT (text IS NULL OR t = '' OR length(t) < 10) AS is_valid,
  CASE WHEN text IS NULL OR t = '' THEN '' WHEN length(t) < 10 THEN t 
    ELSE {_clean_sql('text')} END AS text,
  CASE WHEN text IS NULL OR text = '' THEN 'Text input cannot be empty' WHEN t = '' THEN 'Text input cannot be empty after removing whitespace'
    WHEN length(t) < 10 THEN 'Text too short (minimum 10 characters)' ELSE '' END AS error FROM y""")
def sanitize_text(spark, sf):
    return CL.sanitize(TB.documents(spark, sf).withColumn("text", F.expr(DIRTY)))


@query("normalize_text", sql=f"""
{'WITH ' + MARKED} SELECT doc_id,
  {trim("translate(regexp_replace(regexp_replace(regexp_replace(text, '[ '||chr(9)||']+', ' ', 'g'), '\\n\\s*\\d+\\s*\\n', chr(10), 'g'), '(?i)\\n\\s*Page \\d+\\s*\\n', chr(10), 'g'), '—‘’“”', '-''''\"\"')")} AS text FROM m""")
def normalize_text(spark, sf):
    return TB.marked_documents(spark, sf).withColumn("text", T.normalize_text(F.col("text")))


@query("clean_fragment", sql=r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(' :- ' || text || '- : ', '\s+', ' ', 'g'),
  '^[:\-\s]+', ''), '[:\-\s]+$', '') AS text FROM documents""")
def clean_fragment(spark, sf):
    return TB.documents(spark, sf).withColumn(
        "text", T.clean_fragment(F.concat(F.lit(" :- "), F.col("text"), F.lit("- : "))))


PARAS = f"""pa AS (SELECT doc_id, list_filter(list_transform(CASE WHEN contains(text, chr(10) || chr(10)) THEN string_split(text, chr(10) || chr(10))
  ELSE list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda b: array_to_string(list_filter(list_transform(string_split(b, chr(10)),
    lambda l: {trim('l')}), lambda l: l <> ''), ' ')) END, lambda z: {trim('z')}),
  lambda z: length(z) > 50 AND NOT (length(z) < 100 AND {anyof('lower(z)', FV.HEADER_WORDS)}) AND NOT regexp_full_match(z, '\\d+')) AS ps FROM m)"""


@query("drop_headers_footers", sql=f"WITH {MARKED}, {PARAS} SELECT doc_id, unnest(range(1, len(ps) + 1)) AS para_no, unnest(ps) AS paragraph FROM pa")
def drop_headers_footers(spark, sf):
    return CL.drop_headers_footers(TB.marked_documents(spark, sf))


@query("valid_qa_pair", sql=f"""WITH {PAIRS} SELECT pair_id, original AS question, enhanced AS answer FROM p
WHERE length({trim('original')}) >= 10 AND length({trim('enhanced')}) >= 20 AND {trim('original')} <> {trim('enhanced')}""")
def valid_qa_pair(spark, sf):
    p = TB.pairs(spark, sf).select("pair_id", F.col("original").alias("question"), F.col("enhanced").alias("answer"))
    return CL.valid_qa_pairs(p)


@query("select_high_quality", sql=f"""WITH {DOCS}, {quality('m', 'doc_id')} SELECT doc_id, quality_score, {R('dialogue_potential')} AS dialogue_potential
FROM f2 WHERE quality_score > 0.6 OR dialogue_potential > 0.6""")
def select_high_quality(spark, sf):
    return CL.select_high_quality(SC.with_quality(TB.documents(spark, sf))).select(
        "doc_id", "quality_score", "dialogue_potential")


@query("sanitize_output", sql="""SELECT doc_id, text, text AS note,
  CASE doc_id % 3 WHEN 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS quality_score FROM documents""")
def sanitize_output(spark, sf):
    d = TB.documents(spark, sf).select(
        "doc_id", "text", F.create_map(F.lit("note"), F.col("text")).alias("metadata"),
        F.expr("CASE doc_id % 3 WHEN 0 THEN '0.5' WHEN 1 THEN 'n/a' END").alias("quality_score"))
    return CL.sanitize_output(d, "text", "metadata", "quality_score").select(
        "doc_id", "text", F.col("metadata")["note"].alias("note"), "quality_score")


@query("route_by_quality", sql=f"WITH {DOCS}, {quality('m', 'doc_id')} SELECT doc_id, quality_score, {route('quality_score')} AS route FROM f2")
def route_by_quality(spark, sf):
    return CL.route_by_quality(SC.with_quality(TB.documents(spark, sf))).select("doc_id", "quality_score", "route")


SENTI = f"""list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '\\p{{L}}+'))"""
TONE = f"""al AS (SELECT doc_id, text, {SENTI} AS al, {n_entities('text')} AS ne FROM m),
pol AS (SELECT *, len(list_filter(al, lambda w: list_contains({lst(FV.POSITIVE_WORDS)}, w))) AS pos, len(list_filter(al, lambda w: list_contains({lst(FV.NEGATIVE_WORDS)}, w))) AS neg FROM al),
cx AS (SELECT doc_id, text, pos, neg, len(al) AS na, CASE WHEN pos + neg = 0 THEN 0.0::DOUBLE ELSE (pos - neg) / (pos + neg) END AS polarity,
  CASE WHEN len(al) = 0 THEN 0.0::DOUBLE ELSE (pos + neg) / len(al) END AS subjectivity, CASE WHEN len(al) = 0 THEN 0.0::DOUBLE
  ELSE (len(list_distinct(al)) / len(al) * 0.3::DOUBLE + ne / len(al) * 0.3::DOUBLE) / 0.6::DOUBLE END AS complexity FROM pol)"""


@query("processing_defaults", sql=f"""WITH {MARKED}, {TONE}
SELECT doc_id, CASE WHEN complexity > 0.7 THEN 'detailed' WHEN complexity < 0.3 THEN 'short' ELSE 'medium' END AS suggested_length,
  CASE WHEN complexity > 0.7 THEN 'Complex content - may need detailed explanation' WHEN complexity < 0.3 THEN 'Simple content - can be concise' END AS complexity_note,
  CASE WHEN abs(polarity) > 0.3 THEN 'Content has ' || CASE WHEN polarity > 0 THEN 'positive' ELSE 'negative' END || ' sentiment' END AS tone_note,
  CASE WHEN len(list_filter({MS('text')}[:-2], lambda s: s LIKE '%?')) > 0 THEN 'Consider Q&A format preservation' END AS format_suggestion FROM cx""")
def processing_defaults(spark, sf):
    from corpusloom.operators import preparation as PR
    return CL.processing_defaults(PR.with_profile(TB.marked_documents(spark, sf))).select(
        "doc_id", "suggested_length", "complexity_note", "tone_note", "format_suggestion")


@query("apply_review_decisions", sql="""SELECT d.doc_id, coalesce(CASE WHEN l.toxic <> 1 AND l.quality = 0 THEN 'edited: ' || d.text END, d.text) AS text,
  coalesce(CASE WHEN l.quality = 0 THEN 'edit' WHEN l.quality = 1 THEN 'approve' END, 'pending') AS decision, coalesce(l.quality = 0, false) AS edited
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.toxic IS NULL OR l.toxic <> 1""")
def apply_review_decisions(spark, sf):
    d, l = TB.documents(spark, sf), TB.table(spark, sf, "labels")
    decision = F.when(F.col("toxic") == 1, F.lit("skip")).when(F.col("quality") == 0, F.lit("edit")).otherwise(F.lit("approve"))
    decided = l.join(d, "doc_id").select("doc_id", decision.alias("decision"), F.when(
        decision == "edit", F.concat(F.lit("edited: "), "text")).alias("edited_text"))
    return CL.apply_review_decisions(d, decided, "doc_id")


REC_SQL = f"""rec AS (SELECT doc_id, unnest([
  CASE WHEN quality_score < 0.4 THEN '1 quality_improvement high manual_review' WHEN quality_score < 0.6 THEN '1 quality_improvement medium enhance_settings' END,
  CASE WHEN coherence_score < 0.5 THEN '2 coherence medium restructure' END,
  CASE WHEN dialogue_potential < 0.3 THEN '3 dialogue low dialogue_enhancement' END,
  CASE WHEN word_count < 50 THEN '4 length medium combine_chunks' WHEN word_count > 800 THEN '4 length low split_chunk' END]) AS r FROM f2)"""


@query("pending_recommendations", sql=f"""WITH {DOCS}, {quality('m', 'doc_id')}, {REC_SQL}
SELECT doc_id, split_part(r, ' ', 2) AS type, split_part(r, ' ', 3) AS priority, split_part(r, ' ', 4) AS action FROM rec
WHERE r IS NOT NULL AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = rec.doc_id AND l.quality = 1 AND split_part(r, ' ', 2) = 'dialogue')
ORDER BY doc_id DESC, split_part(r, ' ', 2) DESC LIMIT 50""")
def pending_recommendations(spark, sf):
    recs = SC.with_quality(TB.documents(spark, sf)).select("doc_id", F.inline(SC.sample_recommendations()))
    applied = TB.table(spark, sf, "labels").filter("quality = 1").select("doc_id", F.lit("dialogue").alias("type"))
    return CL.pending_recommendations(recs, applied, ["doc_id", "type"], ["doc_id", "type"]).drop("message")


# --- segmentation ---------------------------------------------------------------------------


@query("split_sentences", sql=f"WITH {DOCS} SELECT doc_id, unnest(range(1, len({S('text')}) + 1)) AS sent_no, unnest({S('text')}) AS sentence FROM m")
def split_sentences(spark, sf):
    return CH.split_sentences(TB.documents(spark, sf))


PSPLIT = r"""ps AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS p FROM (SELECT doc_id, regexp_split_to_array(text, '\n\s*\n') AS a FROM m)),
po AS (SELECT doc_id, i, p, (sum(length(p) + 2) OVER (PARTITION BY doc_id ORDER BY i) - length(p) - 2)::BIGINT AS start_pos FROM ps)"""


@query("split_paragraphs", sql=f"""WITH {MARKED}, {PSPLIT} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS para_no, {trim('p')} AS paragraph,
  start_pos, start_pos + length(p) AS end_pos, {NWORDS('p')} AS word_count FROM po WHERE {trim('p')} <> ''""")
def split_paragraphs(spark, sf):
    return CH.split_paragraphs(TB.marked_documents(spark, sf))


LINES = """ln0 AS (SELECT doc_id, text, unnest(range(0, len(a))) AS line_no, unnest(a) AS l FROM (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM m)),
ln AS (SELECT *, (sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - 1)::BIGINT - length(regexp_replace(l, '^\\s+', '')) AS pos0 FROM ln0)"""
HEAD_RE = r"^(Chapter|Part|Section)\s+\d+|^[A-Z][A-Z\s]{10,}$|^\d+\.\s+[A-Z]|^#{1,6}\s+"


@query("section_headings", sql=f"""WITH {MARKED}, {LINES} SELECT doc_id, line_no AS line_number, {trim('l')} AS title, pos0 AS position
FROM ln WHERE regexp_matches({trim('l')}, {q(HEAD_RE)})""")
def section_headings(spark, sf):
    return CH.section_headings(TB.marked_documents(spark, sf))


@query("paragraph_breaks", sql=f"""WITH {MARKED}, {LINES}, lo AS (SELECT *, (sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - length(l) - 1)::BIGINT AS position FROM ln)
SELECT doc_id, position FROM lo WHERE line_no > 0 AND ({trim('l')} = '' OR regexp_matches({trim('l')}, '^(•|-|1\\.|2\\.)'))""")
def paragraph_breaks(spark, sf):
    return CH.paragraph_breaks(TB.marked_documents(spark, sf))


@query("list_structures", sql=f"""WITH {MARKED}, {LINES}, k AS (SELECT doc_id, line_no, {trim('l')} AS item FROM ln),
kk AS (SELECT *, CASE WHEN left(item, 1) IN ('•', '-', '*') THEN 'bullet' WHEN regexp_matches(item, '^\\d+\\.') THEN 'numbered'
  WHEN contains(item, ':') AND NOT item LIKE '%?' THEN 'definition' END AS kind FROM k) SELECT * FROM kk WHERE kind IS NOT NULL""")
def list_structures(spark, sf):
    return CH.list_structures(TB.marked_documents(spark, sf))


@query("line_length_mix", sql=f"""WITH {DOCS}, {LINES}, c AS (SELECT doc_id, {NWORDS('l')} AS n FROM ln), g AS (SELECT doc_id, count(*) AS total_lines,
  count(*) FILTER (n < 5) AS short_lines, count(*) FILTER (n BETWEEN 5 AND 15) AS medium_lines, count(*) FILTER (n > 15) AS long_lines FROM c GROUP BY 1)
SELECT *, {R('short_lines * 100 / total_lines')} AS short_pct, {R('medium_lines * 100 / total_lines')} AS medium_pct, {R('long_lines * 100 / total_lines')} AS long_pct FROM g""")
def line_length_mix(spark, sf):
    return CH.line_length_mix(TB.documents(spark, sf))


# --- chunking --------------------------------------------------------------------------------


@query("chunk_by_sentences", sql=chunks() + " SELECT * FROM c")
def chunk_by_sentences(spark, sf):
    return CH.chunk_by_sentences(TB.documents(spark, sf), 1000)


@query("chunk_by_paragraphs", sql=f"""WITH RECURSIVE {MARKED}, it AS (SELECT doc_id, unnest(a) AS s, unnest(range(1, len(a) + 1)) AS i FROM
  (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS a FROM m)), {pack('it', 600, chr(10) * 2)}
SELECT doc_id, chunk_no, {trim('text')} AS text, {NWORDS('text')} AS word_count, len(regexp_extract_all(text, '[.!?]')) AS sentence_count FROM c""")
def chunk_by_paragraphs(spark, sf):
    return CH.chunk_by_paragraphs(TB.marked_documents(spark, sf), 600)


@query("chunk_by_words", sql=f"""WITH RECURSIVE {DOCS}, it AS (SELECT doc_id, unnest({W('text')}) AS s, unnest(range(1, len({W('text')}) + 1)) AS i FROM m),
{pack('it', 199, ' ', 101)} SELECT doc_id, chunk_no, text, len(regexp_extract_all(text, '[.!?]')) AS sentence_count FROM c""")
def chunk_by_words(spark, sf):
    return CH.chunk_by_words(TB.documents(spark, sf), 200)


@query("chunk_fixed_words", sql=f"""WITH RECURSIVE {DOCS}, wd AS (SELECT doc_id, unnest({W('text')}) AS s, unnest(range(1, len({W('text')}) + 1)) AS i FROM m),
en AS (SELECT doc_id, i AS j FROM wd WHERE regexp_matches(s, '[.!?]$')), ct AS (SELECT doc_id, max(i) AS n FROM wd GROUP BY 1), px AS (SELECT doc_id, i, i + 118 AS lim FROM wd),
nx AS (SELECT px.doc_id, px.i, CASE WHEN px.i + 119 > ct.n THEN ct.n + 1 WHEN en.j >= px.i THEN en.j + 1 ELSE px.i + 120 END AS nxt FROM px JOIN ct USING (doc_id) ASOF LEFT JOIN en ON px.doc_id = en.doc_id AND px.lim >= en.j),
wk AS (SELECT doc_id, 1::BIGINT AS chunk_no, i, nxt FROM nx WHERE i = 1 UNION ALL SELECT n.doc_id, w.chunk_no + 1, n.i, n.nxt FROM wk w JOIN nx n ON n.doc_id = w.doc_id AND n.i = w.nxt)
SELECT wk.doc_id, chunk_no, string_agg(s, ' ' ORDER BY wd.i) AS text, count(*) AS word_count FROM wk JOIN wd ON wd.doc_id = wk.doc_id AND wd.i >= wk.i AND wd.i < wk.nxt GROUP BY 1, 2""")
def chunk_fixed_words(spark, sf):
    return CH.chunk_fixed_words(TB.documents(spark, sf), 120)


def semantic_sql(min_size):
    return f"""sp AS (SELECT doc_id, unnest(a) AS p, unnest(range(1, len(a) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?]*[.!?]+|[^.!?]+$') AS a FROM m)),
se AS (SELECT doc_id, p, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM sp),
sc AS (SELECT doc_id, e FROM se WHERE {anyof('lower(p)', FV.SEMANTIC_BOUNDARY_WORDS)}),
sw AS (SELECT doc_id, 0::BIGINT AS n, 0::BIGINT AS position, length(text) AS len FROM m
  UNION ALL SELECT w.doc_id, w.n + 1, (SELECT min(sc.e) FROM sc WHERE sc.doc_id = w.doc_id AND sc.e >= w.position + {min_size})::BIGINT, w.len FROM sw w WHERE w.position IS NOT NULL),
sb AS (SELECT doc_id, n AS boundary_no, position FROM sw WHERE position IS NOT NULL UNION ALL
  SELECT doc_id, max(n) + 1, max(len) FROM sw WHERE position IS NOT NULL GROUP BY doc_id HAVING max(position) < max(len))"""


@query("semantic_boundaries", sql=f"WITH RECURSIVE {MARKED}, {semantic_sql(200)} SELECT * FROM sb")
def semantic_boundaries(spark, sf):
    return CH.semantic_boundaries(TB.marked_documents(spark, sf), 200)


FLOW3 = [w for k in ("contrast", "conclusion", "temporal") for w in FV.FLOW_WORDS[k]]
SPEECH_SQL = r"""gq AS (SELECT doc_id, regexp_extract_all(text, '(?i)"[^"]*"[^"]*(?:said|asked|replied|answered)') AS f,
  regexp_split_to_array(text, '(?i)"[^"]*"[^"]*(?:said|asked|replied|answered)') AS g FROM m),
gu AS (SELECT doc_id, unnest(range(1, len(f) + 1)) AS i, unnest(f) AS s, unnest(g[1:len(f)]) AS gap FROM gq),
dl AS (SELECT doc_id, s AS speech, (sum(length(s) + length(gap)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS end_pos FROM gu)"""


@query("candidate_boundaries", sql=f"""WITH RECURSIVE {MARKED}, {semantic_sql(400)}, {PSPLIT}, {LINES}, {TOKENS}, {SPEECH_SQL},
allb AS (SELECT doc_id, 0::BIGINT AS position FROM m UNION SELECT doc_id, length(text) FROM m UNION SELECT doc_id, position FROM sb
  UNION SELECT doc_id, start_pos FROM po WHERE {trim('p')} <> ''
  UNION SELECT doc_id, pos0 FROM ln WHERE regexp_matches({trim('l')}, {q(HEAD_RE)})
  UNION SELECT doc_id, start FROM ts WHERE list_contains({lst(FLOW3)}, lower(tok)) OR list_contains({lst(FLOW3)}, lower(tok || t1 || t2))
    OR list_contains({lst(FLOW3)}, lower(tok || t1 || t2 || t3 || t4 || t5 || t6))
  UNION SELECT doc_id, end_pos - length(speech) FROM dl UNION SELECT doc_id, end_pos FROM dl)
SELECT doc_id, position FROM allb""")
def candidate_boundaries(spark, sf):
    return CH.candidate_boundaries(TB.marked_documents(spark, sf))


@query("context_chunks")
def context_chunks(spark, sf):
    return CH.context_chunks(TB.marked_documents(spark, sf), CH.ChunkingStrategy(120, 60, 200))


@query("chunk_with_context")
def chunk_with_context(spark, sf):
    return CH.chunk_with_context(TB.marked_documents(spark, sf), CH.ChunkingStrategy(120, 60, 150, 200, 50))


def _sentence_chunks(spark, sf, source=None, budget=1000):
    d = (source or TB.documents)(spark, sf)
    return CH.chunk_by_sentences(d, budget).withColumn("chunk_id", F.concat_ws("_", "doc_id", "chunk_no"))


PARA_CHUNKS = f"""WITH RECURSIVE {MARKED}, it AS (SELECT doc_id, unnest(a) AS s, unnest(range(1, len(a) + 1)) AS i FROM
  (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS a FROM m)), {pack('it', 2000, chr(10) * 2, out='c0')},
c AS (SELECT doc_id, chunk_no, doc_id || '_' || chunk_no AS chunk_id, {trim('text')} AS text FROM c0)"""


def para_chunks(spark, sf):
    """Paragraph chunks of the marked documents: they keep their punctuation."""
    return CH.chunk_by_paragraphs(TB.marked_documents(spark, sf), 2000).select(
        "doc_id", "chunk_no", F.concat_ws("_", "doc_id", "chunk_no").alias("chunk_id"), "text")


@query("split_oversized", sql=f"""{PARA_CHUNKS}, s AS (SELECT *, regexp_split_to_array(text, '[.!?]+') AS a FROM c),
h AS (SELECT *, len(a) // 2 AS mid, array_to_string(a[1:len(a) // 2], '. ') || '.' AS f, array_to_string(a[len(a) // 2 + 1:], '. ') AS g, {NWORDS('text')} AS n FROM s),
o AS (SELECT chunk_id, text, len(a) AS sentence_count, NULL::VARCHAR AS preceding, NULL::VARCHAR AS following, NULL::VARCHAR AS depends_on FROM h WHERE n <= 150
 UNION ALL SELECT chunk_id || '_a', f, mid, NULL, substr(g, 1, 100), NULL FROM h WHERE n > 150
 UNION ALL SELECT chunk_id || '_b', g, len(a) - mid, right(f, 100), NULL, chunk_id || '_a' FROM h WHERE n > 150)
SELECT *, {NWORDS('text')} AS word_count FROM o""")
def split_oversized(spark, sf):
    return CH.split_oversized(para_chunks(spark, sf).drop("doc_id", "chunk_no"), 150)


@query("merge_undersized", sql=chunks() + f""", w AS (SELECT doc_id, chunk_no, text, {NWORDS('text')} AS n FROM c),
g AS (SELECT *, sum(CASE WHEN chunk_no = 1 OR n >= 120 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY chunk_no) AS grp FROM w)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY grp) AS chunk_no, string_agg(text, ' ' ORDER BY chunk_no) AS text, sum(n)::BIGINT AS word_count FROM g GROUP BY doc_id, grp""")
def merge_undersized(spark, sf):
    return CH.merge_undersized(TB.documents(spark, sf), 1000, 120)


@query("fit_token_budget", sql=f"""{PARA_CHUNKS}, w AS (SELECT chunk_id, text, {W('text')} AS ws FROM c),
b AS (SELECT *, len(ws) AS n, floor(len(ws) / 0.75::DOUBLE)::BIGINT AS tk FROM w),
t AS (SELECT *, floor(n * (150.0::DOUBLE / tk) * 0.9::DOUBLE)::BIGINT AS target FROM b),
u AS (SELECT *, array_to_string(ws[1:target], ' ') AS cut FROM t),
v AS (SELECT chunk_id, tk AS tokens_before, CASE WHEN tk <= 150 OR target >= n THEN text WHEN regexp_matches(cut, '(?s)^.+[.!?]') THEN regexp_extract(cut, '(?s)^(.+[.!?])', 1) ELSE cut END AS text FROM u)
SELECT *, {NWORDS('text')} AS word_count, floor({NWORDS('text')} / 0.75::DOUBLE)::BIGINT AS token_count FROM v""")
def fit_token_budget(spark, sf):
    return CH.fit_token_budget(para_chunks(spark, sf).drop("doc_id", "chunk_no"), 150)


@query("narrative_segments", sql=f"""WITH {MARKED}, {ENTITIES}, g AS (SELECT doc_id, text, length(text) // 10 AS sz, unnest(range(0, 10)) AS k FROM m),
h AS (SELECT doc_id, k, sz, CASE WHEN k = 9 THEN length(text) ELSE k * sz + sz END AS en, CASE WHEN k = 9 THEN {NWORDS('substr(text, k * sz + 1)')} ELSE {NWORDS('substr(text, k * sz + 1, sz)')} END AS n FROM g),
e AS (SELECT h.doc_id, h.k, h.n, count(ent.start) AS ne FROM h LEFT JOIN ent ON ent.doc_id = h.doc_id AND ent.start >= h.k * h.sz AND ent.start < h.en GROUP BY 1, 2, 3)
SELECT doc_id, {R('k / 10.0')} AS position, n AS word_count, CASE WHEN n > 0 THEN {R('ne / n')} ELSE 0.0::DOUBLE END AS semantic_density FROM e""")
def narrative_segments(spark, sf):
    return CH.narrative_segments(TB.marked_documents(spark, sf))
