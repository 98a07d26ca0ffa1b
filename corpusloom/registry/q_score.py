"""Queries: scores of one text, of pairs, and vector similarity."""

from pyspark.sql import functions as F

from corpusloom import fixed_values as FV
from corpusloom.functions import language as LG, pairs as PF, scores as SC, text as T
from corpusloom.operators import analysis as AN, cleaning as CL, oplog as OL, preparation as PR, themes as TH, vectors as VE
from corpusloom.registry.core import ORACLES, query
from corpusloom.registry.q_clean import MARKED, TONE, para_chunks, PARA_CHUNKS
from corpusloom.registry.q_extract import (CT_PICK, DOUBLED, ENTITIES, THEMES, LANG, LCONF, LFAM, LNAMES, LSCR, PHR, POLY, GRAMS, content_sql,
                                           example_sql, mono_sql, poly, qa_sql, surface)
from corpusloom.registry.sqlbits import *  # noqa: F403
from corpusloom.sources import tables as TB


def docs(spark, sf):
    return TB.documents(spark, sf)


def _scored(spark, sf):
    return SC.with_quality(docs(spark, sf))


Q = f"WITH {DOCS}, {quality('m', 'doc_id')}"


@query("text_stats", sql=f"""WITH {MARKED}, x AS (SELECT doc_id, text, {W('text')} AS ws, {S('text')} AS ss FROM m)
SELECT doc_id, length(text) AS chars, len(ws) AS words, len(ss) AS sentences, len(list_filter(string_split(text, chr(10) || chr(10)), lambda z: {trim('z')} <> '')) AS paragraphs,
 {R("coalesce(list_avg(list_transform(ss, lambda s: len(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> '')))), 0)")} AS avg_sentence_length,
 {R('coalesce(list_avg(list_transform(ws, lambda w: length(w))), 0)')} AS avg_word_length, {R('len(ws) / 200')} AS reading_minutes FROM x""")
def text_stats(spark, sf):
    d = TB.marked_documents(spark, sf).withColumn("_w", T.words(F.col("text"))).withColumn("_s", T.sentences(F.col("text")))
    total = F.aggregate("_s", F.lit(0), lambda a, s: a + T.n_words(s))
    chars = F.aggregate("_w", F.lit(0), lambda a, w: a + F.length(w))
    return d.select(
        "doc_id", F.length("text").alias("chars"), F.size("_w").alias("words"), F.size("_s").alias("sentences"),
        F.size(F.filter(F.split("text", "\n\n"), lambda p: T.trim_ws(p) != "")).alias("paragraphs"),
        T.ratio(total, F.size("_s")).alias("avg_sentence_length"), T.ratio(chars, F.size("_w")).alias("avg_word_length"),
        (F.size("_w") / 200).alias("reading_minutes"))


@query("linguistic_features", sql=f"""WITH {DOCS}, x AS (SELECT doc_id, {W('text')} AS ws, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]') AS tk FROM m),
y AS (SELECT doc_id, ws, tk, list_filter(tk, lambda t: regexp_full_match(t, '\\p{{L}}+')) AS al FROM x)
SELECT doc_id, len(list_filter(al, lambda t: length(t) > 6)) AS complex_words, len(list_distinct(list_transform(al, lambda t: lower(t)))) AS unique_words,
  {R("CASE WHEN len(tk) = 0 THEN 0 ELSE len(list_filter(tk, lambda t: NOT regexp_matches(t, '[\\p{L}\\p{N}_]'))) / len(tk) END")} AS punctuation_density FROM y""")
def linguistic_features(spark, sf):
    c = F.col("text")
    words, punct = F.regexp_count(c, F.lit(T.WORD)), F.regexp_count(c, F.lit(r"[^\p{L}\p{N}_\s]"))
    alpha = F.filter(F.regexp_extract_all(c, F.lit(T.WORD), F.lit(0)), lambda t: t.rlike(r"^\p{L}+$"))
    return docs(spark, sf).withColumn("_a", alpha).select(
        "doc_id", F.size(F.filter("_a", lambda t: F.length(t) > 6)).alias("complex_words"),
        F.size(T.set_of(F.transform("_a", F.lower))).alias("unique_words"), T.ratio(punct, words + punct).alias("punctuation_density"))


@query("syllables", sql=f"WITH {DOCS} SELECT doc_id, {syllables('text')}::BIGINT AS syllables FROM m")
def syllables_(spark, sf):
    return docs(spark, sf).select("doc_id", SC.syllables(F.col("text")).alias("syllables"))


@query("flesch", sql=f"{Q} SELECT doc_id, {R('readability_score')} AS flesch FROM f2")
def flesch(spark, sf):
    c = F.col("text")
    return docs(spark, sf).select("doc_id", SC.flesch(T.n_words(c), T.n_sentences(c), SC.syllables(c)).alias("flesch"))


BAND = f"""bd AS (SELECT *, {W('enh')} AS bw, string_split(enh, '.') AS bp FROM SRC),
bs AS (SELECT *, (least(1.0, greatest(0.0, 1 - abs(len(bw) / len(bp) - 17.5) / 17.5)) + least(1.0, greatest(0.0, 1 - abs(CASE WHEN len(bw) = 0 THEN 0 ELSE list_sum(list_transform(bw, lambda w: length(w))) / len(bw) END - 5) / 5))) / 2 AS band FROM bd)"""


@query("readability_band", sql=f"WITH src AS (SELECT doc_id, text AS enh FROM documents), {BAND.replace('SRC', 'src')} SELECT doc_id, {R('band')} AS readability FROM bs")
def readability_band(spark, sf):
    return docs(spark, sf).withColumn("_w", T.words(F.col("text"))).select(
        "doc_id", SC.readability_band(F.col("text"), F.col("_w")).alias("readability"))


SIMPLE = f"""greatest(0.0, 1 - len({W('text')}) / len(regexp_split_to_array(text, '[.!?]+')) / 30 - CASE WHEN len({W('text')}) = 0 THEN 0 ELSE len(list_filter({W('text')}, lambda w: length(w) > 6)) / len({W('text')}) END)"""
INFO = f"len(list_distinct({W('lower(text)')})) / greatest(len({W('text')}), 1)"


@query("readability_simple", sql=f"WITH {DOCS} SELECT doc_id, {R(SIMPLE)} AS readability FROM m")
def readability_simple(spark, sf):
    return docs(spark, sf).withColumn("_w", T.words(F.col("text"))).select(
        "doc_id", SC.readability_simple(F.col("text"), F.col("_w")).alias("readability"))


@query("dialogue_potential", sql=f"""WITH {MARKED}, {DOUBLED}, c AS (SELECT doc_id, {content_sql()} FROM dd), x AS (SELECT doc_id, {dialogue_matches('text')} AS k, {NWORDS('text')} AS n FROM m)
SELECT doc_id, {R('CASE WHEN n = 0 THEN 0 ELSE least(1.0, k / n * 10) END')} AS dialogue_potential, {R('least(1.0, dialogue / greatest(n / 50, 1))')} AS chunk_dialogue_potential FROM x JOIN c USING (doc_id)""")
def dialogue_potential(spark, sf):
    c = F.col("text")
    d = TB.marked_documents(spark, sf).withColumn("_n", T.n_words(c))
    return d.select("doc_id", SC.dialogue_potential(c, F.col("_n")).alias("dialogue_potential"), F.least(
        SC.content_scores(c)["dialogue"] / F.greatest(F.col("_n") / 50, F.lit(1.0)), F.lit(1.0)).alias("chunk_dialogue_potential"))


def _moments(spark, sf):
    return docs(spark, sf).withColumn("_s", T.sentences(F.col("text"))).withColumn("_m", SC.sentence_moments(F.col("_s")))


@query("coherence_variance", sql=f"{Q} SELECT doc_id, {R('coherence_score')} AS coherence FROM f2")
def coherence_variance(spark, sf):
    return _moments(spark, sf).select("doc_id", SC.coherence_variance(F.col("_m")).alias("coherence"))


@query("coherence_cues", sql=f"""WITH {MARKED}, x AS (SELECT doc_id, len({S('text')}) AS n, {hits('lower(text)', FV.COHERENCE_CUES)} AS k FROM m)
SELECT doc_id, {R('CASE WHEN n < 2 THEN 0.8 ELSE least(1.0, k / n + 0.5) END')} AS coherence FROM x""")
def coherence_cues(spark, sf):
    c = F.col("text")
    return TB.marked_documents(spark, sf).select("doc_id", SC.coherence_cues(c, T.n_sentences(c)).alias("coherence"))


def transitions(x):
    sets = f"list_transform(string_split(lower({x}), '.'), lambda s: list_distinct({W('s')}))"
    return f"""CASE WHEN len(string_split({x}, '.')) < 2 THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(1, len(string_split({x}, '.'))), lambda i:
  CASE WHEN {anyof(f"string_split(lower({x}), '.')[i + 1]", FV.TRANSITION_PHRASES)} THEN 1.0 ELSE 0.0 END
  + CASE WHEN len(list_intersect({sets}[i], {sets}[i + 1])) >= 2 THEN 0.5 ELSE 0.0 END)) / (len(string_split({x}, '.')) - 1)) END"""


# The oracle works on numbered parts so that long texts stay linear.
TRANS = f"""tp AS (SELECT pid, unnest(a) AS s, unnest(range(1, len(a) + 1)) AS i FROM (SELECT pid, string_split(lower(enh), '.') AS a FROM SRC)),
tw AS (SELECT pid, i, s, list_distinct({W('s')}) AS w FROM tp), tl AS (SELECT *, lead(s) OVER v AS s2, lead(w) OVER v AS w2 FROM tw WINDOW v AS (PARTITION BY pid ORDER BY i)),
tc AS (SELECT pid, CASE WHEN count(*) < 2 THEN 1.0 ELSE least(1.0, sum(CASE WHEN s2 IS NULL THEN 0 ELSE CASE WHEN {anyof('s2', FV.TRANSITION_PHRASES)} THEN 1.0 ELSE 0.0 END
  + CASE WHEN len(list_intersect(w, w2)) >= 2 THEN 0.5 ELSE 0.0 END END)::DOUBLE / (count(*) - 1)) END AS coherence FROM tl GROUP BY pid)"""


@query("coherence_transitions", sql=f"WITH {MARKED}, src AS (SELECT doc_id AS pid, text AS enh FROM m), {TRANS.replace('SRC', 'src')} SELECT pid AS doc_id, {R('coherence')} AS coherence FROM tc")
def coherence_transitions(spark, sf):
    return TB.marked_documents(spark, sf).select("doc_id", SC.coherence_transitions(F.col("text")).alias("coherence"))


@query("sentence_variety", sql=f"{Q} SELECT doc_id, {R('sentence_variety')} AS variety FROM f2")
def sentence_variety(spark, sf):
    return _moments(spark, sf).select("doc_id", SC.sentence_variety(F.col("_m")).alias("variety"))


STRIPPED = f"""len(list_distinct(list_transform({W('lower(text)')}, lambda w: regexp_replace(w, '^[.,!?";]+|[.,!?";]+$', '', 'g')))) / greatest(len({W('text')}), 1)"""


@query("vocabulary_diversity", sql=f"{Q} SELECT doc_id, {R('vocabulary_diversity')} AS alphabetic, {R(STRIPPED)} AS stripped, {R(INFO)} AS raw FROM f2")
def vocabulary_diversity(spark, sf):
    return docs(spark, sf).withColumn("_w", T.words(F.col("text"))).select(
        "doc_id", SC.vocabulary_diversity(F.col("text")).alias("alphabetic"), SC.vocabulary_stripped(F.col("_w")).alias("stripped"),
        SC.information_density(F.col("_w")).alias("raw"))


@query("overall_quality", sql=f"{Q} SELECT doc_id, quality_score FROM f2")
def overall_quality(spark, sf):
    return _scored(spark, sf).select("doc_id", "quality_score")


@query("quality_grade", sql=f"{Q} SELECT doc_id, quality_grade FROM f2")
def quality_grade(spark, sf):
    return _scored(spark, sf).select("doc_id", "quality_grade")


BLANKS = "CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '  ' || chr(10) WHEN 2 THEN NULL ELSE text END"


@query("empty_quality_row", sql=f"WITH m AS (SELECT doc_id, {BLANKS} AS text FROM documents), {quality('m', 'doc_id')} SELECT doc_id, content_length, word_count, quality_score, quality_grade, empty FROM f2")
def empty_quality_row(spark, sf):
    d = SC.with_quality(docs(spark, sf).withColumn("text", F.expr(BLANKS)))
    return d.select("doc_id", "content_length", "word_count", "quality_score", "quality_grade", F.col("_empty").alias("empty"))


ISSUES_SQL = """array_to_string(list_filter([CASE WHEN word_count < 20 THEN 'Content too short (' || word_count || ' words)' END,
  CASE WHEN coherence_score < 0.5 THEN 'Low coherence - content may be fragmented' END], lambda x: x IS NOT NULL), '|')"""
WARN_SQL = """array_to_string(list_filter([CASE WHEN word_count > 1000 THEN 'Content very long (' || word_count || ' words)' END, CASE WHEN dialogue_potential < 0.3 THEN 'Low dialogue potential' END,
  CASE WHEN readability_score < 30 THEN 'Text may be too complex' WHEN readability_score > 90 THEN 'Text may be too simple' END, CASE WHEN sentence_variety < 0.4 THEN 'Low sentence variety' END,
  CASE WHEN vocabulary_diversity < 0.3 THEN 'Limited vocabulary diversity' END], lambda x: x IS NOT NULL), '|')"""
RECO_SQL = """array_to_string(list_filter([CASE WHEN word_count < 20 THEN 'Add more content or combine with other chunks' WHEN word_count > 1000 THEN 'Consider splitting into smaller chunks' END,
  CASE WHEN coherence_score < 0.5 THEN 'Review content structure and add transitions' END, CASE WHEN dialogue_potential < 0.3 THEN 'Consider using narrative-to-dialogue enhancement' END,
  CASE WHEN readability_score < 30 THEN 'Simplify sentence structure and vocabulary' WHEN readability_score > 90 THEN 'Add more varied sentence structures' END,
  CASE WHEN sentence_variety < 0.4 THEN 'Vary sentence lengths and structures' END, CASE WHEN vocabulary_diversity < 0.3 THEN 'Use more varied vocabulary' END], lambda x: x IS NOT NULL), '|')"""


@query("quality_issues", sql=f"{Q} SELECT doc_id, {ISSUES_SQL} AS issues, {WARN_SQL} AS warnings, {RECO_SQL} AS recommendations FROM f2")
def quality_issues(spark, sf):
    return _scored(spark, sf).select("doc_id", *[F.array_join(c, "|").alias(k) for k, c in SC.quality_messages().items()])


@query("optimization_suggestions", sql=f"""{Q}, o AS (SELECT doc_id, unnest([
 CASE WHEN quality_score < 0.6 THEN 'chunk|quality|high|Review and improve content structure' END, CASE WHEN dialogue_potential < 0.3 THEN 'chunk|enhancement|medium|Use narrative-to-dialogue enhancement mode' END,
 CASE WHEN word_count > 500 THEN 'chunk|chunking|medium|Split into smaller chunks for better processing' END, CASE WHEN coherence_score < 0.5 THEN 'chunk|structure|high|Review content structure and add transitions' END,
 CASE WHEN quality_score < 0.4 THEN 'sample|quality_improvement|high|manual_review' WHEN quality_score < 0.6 THEN 'sample|quality_improvement|medium|enhance_settings' END,
 CASE WHEN coherence_score < 0.5 THEN 'sample|coherence|medium|restructure' END, CASE WHEN dialogue_potential < 0.3 THEN 'sample|dialogue|low|dialogue_enhancement' END,
 CASE WHEN word_count < 50 THEN 'sample|length|medium|combine_chunks' WHEN word_count > 800 THEN 'sample|length|low|split_chunk' END]) AS r FROM f2)
SELECT doc_id, split_part(r, '|', 1) AS rule_set, split_part(r, '|', 2) AS type, split_part(r, '|', 3) AS priority, split_part(r, '|', 4) AS action FROM o WHERE r IS NOT NULL""")
def optimization_suggestions(spark, sf):
    d = _scored(spark, sf)

    def tag(name, notes):
        return F.transform(notes, lambda n: F.struct(F.lit(name).alias("rule_set"), n["type"].alias("type"), n["priority"].alias("priority"), n["action"].alias("action")))

    return d.select("doc_id", F.inline(F.concat(tag("chunk", SC.optimization_suggestions()), tag("sample", SC.sample_recommendations()))))


@query("sentiment", sql=f"WITH {MARKED}, {TONE} SELECT doc_id, {R('polarity')} AS polarity, {R('subjectivity')} AS subjectivity, pos AS positive, neg AS negative FROM cx")
def sentiment(spark, sf):
    return TB.marked_documents(spark, sf).select("doc_id", SC.sentiment(T.alpha_tokens(F.lower("text"))).alias("_s")).select("doc_id", "_s.*")


@query("complexity", sql=f"WITH {MARKED}, {TONE} SELECT doc_id, {R('complexity')} AS complexity FROM cx")
def complexity(spark, sf):
    return PR.with_profile(TB.marked_documents(spark, sf)).select("doc_id", "complexity")


@query("select_complex", sql=f"WITH {MARKED}, {TONE} SELECT doc_id, {R('complexity')} AS complexity FROM cx WHERE complexity > 0.5")
def select_complex(spark, sf):
    """The other half of the quality gate: complex texts."""
    return CL.select_complex(PR.with_profile(TB.marked_documents(spark, sf))).select("doc_id", "complexity")


SEM = f"""sm0 AS (SELECT *, {W('text')} AS ws, {n_entities('text')} AS e, len({concepts('text')}) AS k, {n_themes('lower(text)')} AS t, len(regexp_split_to_array(text, '[.!?]+')) AS sn FROM SRC),
sm1 AS (SELECT *, len(ws) AS n, len(list_distinct(list_transform(ws, lambda w: lower(w)))) / greatest(len(ws), 1) AS info,
  greatest(0.0, 1 - len(ws) / sn / 30 - CASE WHEN len(ws) = 0 THEN 0 ELSE len(list_filter(ws, lambda w: length(w) > 6)) / len(ws) END) AS rs FROM sm0),
sm2 AS (SELECT *, least(1.0, least(n / sn / 20, 1.0) * 0.2 + least(e / greatest(n, 1) * 100, 1.0) * 0.3 + least(k / greatest(n, 1) * 50, 1.0) * 0.2 + t / 10 * 0.2 + info * 0.1) AS semantic_score,
  least(1.0, (e + k) / greatest(n / 10, 1)) AS semantic_density, least(1.0, (k + t) / greatest(n / 100, 1)) AS context_relevance FROM sm1),
sm AS (SELECT *, least(1.0, semantic_density * 0.4 + info * 0.3 + rs * 0.3) AS blend, least(1.0, semantic_score * 0.4 + e / 10 * 0.3 + k / 10 * 0.2 + context_relevance * 0.1) AS intensity FROM sm2)"""
SEMD = f"WITH {MARKED}, {SEM.replace('SRC', 'm')}"


def _sem(spark, sf):
    return SC.with_semantics(TB.marked_documents(spark, sf))


@query("semantic_score", sql=f"{SEMD} SELECT doc_id, {R('semantic_score')} AS semantic_score FROM sm")
def semantic_score(spark, sf):
    return _sem(spark, sf).select("doc_id", "semantic_score")


@query("semantic_density", sql=f"{SEMD} SELECT doc_id, {R('semantic_density')} AS semantic_density FROM sm")
def semantic_density(spark, sf):
    return _sem(spark, sf).select("doc_id", "semantic_density")


@query("context_relevance", sql=f"{SEMD} SELECT doc_id, {R('context_relevance')} AS context_relevance FROM sm")
def context_relevance(spark, sf):
    return _sem(spark, sf).select("doc_id", "context_relevance")


@query("coherence_blend", sql=f"{SEMD} SELECT doc_id, {R('blend')} AS coherence FROM sm")
def coherence_blend(spark, sf):
    return _sem(spark, sf).select("doc_id", F.col("coherence_blend").alias("coherence"))


@query("narrative_arc", sql=f"{PARA_CHUNKS}, {SEM.replace('SRC', 'c')} SELECT doc_id, chunk_no, {R('intensity')} AS intensity FROM sm")
def narrative_arc(spark, sf):
    return AN.narrative_arc(para_chunks(spark, sf))


@query("completeness", sql=f"""WITH {MARKED} SELECT doc_id, {R(f"least(1.0, CASE WHEN {anyof('lower(text)', FV.INTRO_WORDS)} THEN 0.3 ELSE 0 END + CASE WHEN {anyof('lower(text)', FV.CONCLUSION_WORDS)} THEN 0.3 ELSE 0 END + CASE WHEN {anyof('lower(text)', FV.EXAMPLE_WORDS)} THEN 0.2 ELSE 0 END + CASE WHEN len(string_split(text, chr(10) || chr(10))) >= 2 THEN 0.2 ELSE 0 END)")} AS completeness FROM m""")
def completeness(spark, sf):
    return TB.marked_documents(spark, sf).select("doc_id", SC.completeness(F.col("text")).alias("completeness"))


@query("tone_consistency", sql=f"WITH {MARKED} " + " UNION ALL ".join(
    f"SELECT doc_id, '{n}' AS tone, {R(f'{hits(chr(108) + chr(111) + chr(119) + chr(101) + chr(114) + chr(40) + chr(116) + chr(101) + chr(120) + chr(116) + chr(41), k)} / {len(k)}')} AS score FROM m" for n, k in FV.TONE_KEYWORDS.items())
    + " UNION ALL SELECT doc_id, 'custom', 0.5::DOUBLE FROM m")
def tone_consistency(spark, sf):
    c = F.col("text")
    return TB.marked_documents(spark, sf).select("doc_id", F.inline(F.array(*[
        F.struct(F.lit(n).alias("tone"), SC.tone_consistency(c, n).cast("double").alias("score")) for n in FV.TONES])))


# --- pairs -----------------------------------------------------------------------------------------

@query("length_ratio_score", sql=f"WITH {PAIRS} SELECT pair_id, {R('length(enhanced) / length(original)')} AS length_ratio, {R('greatest(0.0, 1 - abs(length(enhanced) / length(original) - 1.35) / 1.35)')} AS score FROM p")
def length_ratio_score(spark, sf):
    r = PF.length_ratio(F.col("original"), F.col("enhanced"))
    return TB.pairs(spark, sf).select("pair_id", r.alias("length_ratio"), PF.length_ratio_score(r).alias("score"))


JAC = f"""len(list_intersect({W('lower(original)')}, {W('lower(enhanced)')})) / len(list_distinct(list_concat({W('lower(original)')}, {W('lower(enhanced)')})))"""


@query("jaccard_similarity", sql=f"WITH {PAIRS} SELECT pair_id, {R(JAC)} AS similarity FROM p")
def jaccard_similarity(spark, sf):
    return TB.pairs(spark, sf).select("pair_id", PF.jaccard(F.col("original"), F.col("enhanced")).alias("similarity"))


@query("cosine_similarity", sql=f"""SELECT a.vec_id, b.vec_id AS next_id, {R('list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])')} AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_similarity(spark, sf):
    return VE.next_similarity(TB.table(spark, sf, "embeddings"))


@query("hashed_tf_vector", sql=f"""WITH w AS (SELECT doc_id, unnest({W('lower(text)')}) AS w FROM documents), c AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 100 AS place, count(*) AS n FROM w GROUP BY 1, 2)
SELECT doc_id, place, {R('n / sqrt(sum(n * n) OVER (PARTITION BY doc_id))')} AS value FROM c""")
def hashed_tf_vector(spark, sf):
    v = VE.hashed_tf(docs(spark, sf)).select("doc_id", F.posexplode("vector").alias("place", "value"))
    return v.filter("value > 0")


def claims_sql():
    d_o, d_e = doubled("lower(original)"), doubled("lower(enhanced)")
    out = []
    for phrases in FV.CLAIM_PHRASES:
        alts = []
        for t in phrases:
            if t == r"\d+%":
                alts.append(r"[0-9]+%%[\p{L}\p{N}_]")
            else:
                alts.append(f"(?:{t.replace(chr(92) + 'd', '[0-9]').replace(' ', '  ')})(?:$|{NW})")
        pat = q(f"(?:^|{NW})(?:{'|'.join(alts)})")
        out.append(f"CASE WHEN regexp_matches({d_o}, {pat}) THEN 0 ELSE len(regexp_extract_all({d_e}, {pat})) END")
    return "(" + " + ".join(out) + ")"


def contra_list(o, e):
    toks = f"list_distinct(regexp_extract_all(lower({e}), '[\\p{{L}}\\p{{N}}_]+'))"
    d = doubled(o)
    neg = [f"list_filter(regexp_extract_all({d}, {q(f'(?i)(?:^|{NW}){w}' + chr(92) + 's+([' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]+)')}, 1), lambda z: list_contains({toks}, lower(z)))" for w in ("not", "no")]
    opp = [f"CASE WHEN len(list_filter({toks}, lambda z: starts_with(z, '{b}'))) > 0 THEN regexp_extract_all({d}, {q(f'(?i)(?:^|{NW})({a})')}, 1) ELSE [] END" for a, b in (("false", "true"), ("impossible", "possible"))]
    return f"list_concat(list_concat({neg[0]}, {neg[1]}), list_concat({opp[0]}, {opp[1]}))"


UNSUP = f"""list_filter(list_transform(string_split(enhanced, '.'), lambda s: {trim('s')}), lambda s: length(s) > 20 AND
  len(list_filter(list_distinct({W('lower(s)')}), lambda y: NOT list_contains({W('lower(original)')}, y))) > len(list_distinct({W('lower(s)')})) * 0.7::DOUBLE)"""
NEWENT = f"list_filter({surface('enhanced')}, lambda y: NOT list_contains({surface('original')}, y))"
ASSESS = f"""{PAIRS}, src AS (SELECT *, pair_id AS pid, enhanced AS enh FROM p), {BAND.replace('SRC', 'src')}, {TRANS.replace('SRC', 'src')},
aa AS (SELECT bs.pair_id, original, enhanced, length(enhanced) / length(original) AS length_ratio, {JAC} AS sim, len({NEWENT}) AS ne, {claims_sql()} AS nc, len({contra_list('original', 'enhanced')}) AS nx,
  len({UNSUP}) AS nu, band, coherence FROM bs JOIN tc USING (pid)),
ab AS (SELECT *, least(1.0::DOUBLE, ne * 0.1::DOUBLE + nc * 0.2::DOUBLE + nx * 0.3::DOUBLE + nu * 0.1::DOUBLE) AS hal FROM aa),
ac AS (SELECT *, list_filter([CASE WHEN sim < 0.75 THEN 'low_semantic_similarity' END, CASE WHEN length_ratio > 1.8 THEN 'excessive_expansion' END, CASE WHEN length_ratio < 0.5 THEN 'excessive_reduction' END,
  CASE WHEN hal > 0.3::DOUBLE THEN 'potential_hallucination' END, CASE WHEN band < 0.5 THEN 'low_readability' END, CASE WHEN coherence < 0.6 THEN 'low_coherence' END], lambda x: x IS NOT NULL) AS flags,
  sim * 0.3 + (1 - hal) * 0.2 + band * 0.2 + coherence * 0.2 + least(1.0, greatest(0.0, 1 - abs(length_ratio - 1.35) / 1.35)) * 0.1 AS overall FROM ab),
ad AS (SELECT *, overall >= 0.7 AND len(flags) = 0 AS passed FROM ac)"""


def assessed(spark, sf):
    return PF.with_assessment(TB.pairs(spark, sf))


@query("hallucination_score", sql=f"WITH {ASSESS} SELECT pair_id, ne AS n_new_entities, nc::BIGINT AS n_new_claims, nx AS n_contradictions, nu AS n_unsupported, {R('hal')} AS hallucination_score FROM ad")
def hallucination_score(spark, sf):
    return assessed(spark, sf).select("pair_id", "n_new_entities", "n_new_claims", "n_contradictions", "n_unsupported", "hallucination_score")


NEG = ["It is not %s and no way. ", "That is false. ", "It is impossible, not so! ", ""]
NEG_O = " || ".join(["CASE doc_id % 4 WHEN 0 THEN 'It is not ' || split_part(text, ' ', 2) || ' and no ' || split_part(text, ' ', 3) || '. ' WHEN 1 THEN 'That is false. ' WHEN 2 THEN 'It is impossible, not so! ' ELSE '' END", "text"])
NEG_E = "text || CASE doc_id % 3 WHEN 0 THEN ' True and possible.' WHEN 1 THEN ' Possibly so.' ELSE '' END"


@query("contradictions", sql=f"""WITH x AS (SELECT doc_id, {NEG_O} AS original, {NEG_E} AS enhanced FROM documents), y AS (SELECT doc_id, {contra_list('original', 'enhanced')} AS c FROM x)
SELECT doc_id, len(c) AS n, array_to_string(c, '|') AS words FROM y""")
def contradictions(spark, sf):
    d = docs(spark, sf).select("doc_id", F.expr(NEG_O).alias("original"), F.expr(NEG_E).alias("enhanced"))
    return d.select("doc_id", PF.contradictions(F.col("original"), F.col("enhanced")).alias("_c")).select(
        "doc_id", F.size("_c").alias("n"), F.array_join("_c", "|").alias("words"))


@query("unsupported_sentences", sql=f"""WITH {PAIRS}, u AS (SELECT pair_id, unnest({UNSUP}) AS s FROM p) SELECT pair_id, s AS sentence FROM u""")
def unsupported_sentences(spark, sf):
    return TB.pairs(spark, sf).select("pair_id", F.explode(PF.unsupported(F.col("original"), F.col("enhanced"))).alias("sentence"))


@query("new_entities", sql=f"WITH {PAIRS} SELECT pair_id, unnest({NEWENT}) AS entity FROM p")
def new_entities(spark, sf):
    return TB.pairs(spark, sf).select("pair_id", F.explode(PF.new_entities(F.col("original"), F.col("enhanced"))).alias("entity"))


@query("pair_assessment", sql=f"""WITH {ASSESS} SELECT pair_id, {R('length_ratio')} AS length_ratio, {R('sim')} AS semantic_similarity, {R('hal')} AS hallucination_score, {R('band')} AS readability_score,
 {R('coherence')} AS coherence_score, {R('overall')} AS overall_score, passed, array_to_string(flags, '|') AS flags FROM ad""")
def pair_assessment(spark, sf):
    return assessed(spark, sf).select("pair_id", "length_ratio", "semantic_similarity", "hallucination_score", "readability_score", "coherence_score",
                                      "overall_score", "passed", F.array_join(F.transform("flags", lambda f: f["name"]), "|").alias("flags"))


@query("pair_recommendations", sql=f"""WITH {ASSESS} SELECT pair_id, array_to_string(list_filter([CASE WHEN sim < 0.7 THEN 'Consider staying closer to the original content''s meaning' END,
 CASE WHEN hal > 0.3::DOUBLE THEN 'Review for potential hallucinations or unsupported claims' END, CASE WHEN list_contains(flags, 'excessive_expansion') THEN 'Content may be too verbose; consider condensing' END,
 CASE WHEN list_contains(flags, 'excessive_reduction') THEN 'Content may be too brief; consider expanding key points' END, CASE WHEN band < 0.6 THEN 'Improve readability with shorter sentences and simpler words' END,
 CASE WHEN coherence < 0.6 THEN 'Add transition words to improve flow between sentences' END, CASE WHEN NOT passed THEN 'Content requires manual review before export' END], lambda x: x IS NOT NULL), '|') AS advice FROM ad""")
def pair_recommendations(spark, sf):
    return assessed(spark, sf).select("pair_id", F.array_join(PF.pair_recommendations(), "|").alias("advice"))


@query("qa_quality", sql=f"WITH {PAIRS} SELECT pair_id, {R(qa_sql('original', 'enhanced'))} AS quality FROM p")
def qa_quality(spark, sf):
    return TB.pairs(spark, sf).select("pair_id", SC.qa_quality(F.col("original"), F.col("enhanced")).alias("quality"))


@query("monologue_quality", sql=f"WITH {MARKED} SELECT doc_id, {R(mono_sql('text'))} AS quality FROM m")
def monologue_quality(spark, sf):
    return TB.marked_documents(spark, sf).select("doc_id", SC.monologue_quality(F.col("text")).alias("quality"))


@query("example_quality", sql=f"WITH {PAIRS} SELECT pair_id, {R(example_sql('0.3', 'original', 'enhanced'))} AS quality FROM p")
def example_quality(spark, sf):
    return TB.pairs(spark, sf).select("pair_id", SC.example_quality(F.lit("dialogue"), F.col("original"), F.col("enhanced")).alias("quality"))


# --- language ------------------------------------------------------------------------------------------

@query("detect_language", sql=f"WITH {POLY}, l AS (SELECT doc_id, {LANG} AS language, {LCONF} AS language_confidence FROM m) SELECT doc_id, language, language_confidence, {LNAMES} AS language_name, {LFAM} AS family, {LSCR} AS script FROM l")
def detect_language(spark, sf):
    return LG.with_language(poly(spark, sf)).drop("text")


@query("processing_language", sql=f"""WITH {POLY}, l AS (SELECT doc_id, {LANG} AS language FROM m) SELECT doc_id, CASE WHEN language IN ('ko', 'ar', 'hi') THEN 'en' ELSE language END AS language,
 CASE WHEN language IN ('ko', 'ar', 'hi') THEN 'No model for ' || {LNAMES} || ', using English' END AS note FROM l""")
def processing_language(spark, sf):
    return LG.with_language(poly(spark, sf)).select("doc_id", LG.processing_language(F.col("language")).alias("_p")).select("doc_id", "_p.*")


# --- refinements, preparation -----------------------------------------------------------------------------
KINDS = [k for k, _, _ in FV.REFINEMENTS] + ["other"]
REF = f"""{PAIRS}, r AS (SELECT pair_id, original, enhanced, {pick(KINDS, 'conv_id + turn')} AS kind FROM p)"""


def refined(spark, sf):
    return TB.pairs(spark, sf).withColumn("kind", TB._pick(KINDS, F.col("conv_id") + F.col("turn")))


GAIN = "CASE kind " + " ".join(f"WHEN '{k}' THEN {g}" for k, g, _ in FV.REFINEMENTS) + " ELSE 0.15 END::DOUBLE"
DESC = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{d}'" for k, _, d in FV.REFINEMENTS) + " ELSE 'Applied refinement' END"


@query("refinement_gain", sql=f"WITH {REF} SELECT pair_id, kind, {R(f'''least(0.5, {GAIN} * CASE WHEN kind IN ('add_examples', 'increase_detail') THEN least(2.0, {NWORDS('enhanced')} / {NWORDS('original')}) ELSE 1 END)''')} AS gain FROM r")
def refinement_gain(spark, sf):
    return refined(spark, sf).select("pair_id", "kind", SC.refinement_gain(F.col("kind"), F.col("original"), F.col("enhanced")).alias("gain"))


@query("change_summary", sql=f"""WITH {REF}, d AS (SELECT *, {NWORDS('enhanced')} - {NWORDS('original')} AS delta FROM r) SELECT pair_id, {DESC} || CASE WHEN delta > 10 THEN '. Added ' || delta || ' words for better explanation.'
  WHEN delta < -10 THEN '. Reduced by ' || -delta || ' words for conciseness.' ELSE '. Maintained similar length with improved quality.' END AS summary FROM d""")
def change_summary(spark, sf):
    return refined(spark, sf).select("pair_id", SC.change_summary(F.col("kind"), F.col("original"), F.col("enhanced")).alias("summary"))


@query("suggest_refinements", sql=f"""{Q}, s AS (SELECT doc_id, quality_score, word_count, word_count / greatest(1, len(list_filter(string_split(text, '.'), lambda z: {trim('z')} <> ''))) AS av FROM f2)
SELECT doc_id, array_to_string(list_filter([CASE WHEN quality_score < 0.8 THEN 'fix_grammar_style' END, CASE WHEN av > 25 THEN 'improve_clarity' END, CASE WHEN av > 25 THEN 'simplify_language' END,
 CASE WHEN quality_score < 0.9 THEN 'enhance_engagement' END, CASE WHEN word_count < 100 THEN 'increase_detail' END, CASE WHEN word_count < 100 THEN 'add_examples' END, 'custom_refinement'], lambda x: x IS NOT NULL)[1:4], '|') AS suggestions FROM s""")
def suggest_refinements(spark, sf):
    return _scored(spark, sf).select("doc_id", F.array_join(SC.suggest_refinements(F.col("text"), F.col("quality_score")), "|").alias("suggestions"))


CTXW = ", ".join(f"{hits('lower(text)', ws)} > 0 AS {k}" for k, ws in FV.CONTEXT_WORDS.items())
STRUCT = f"""{TONE}, {PHR}, {ENTITIES}, sx AS (SELECT doc_id, text, complexity, polarity, {MS('text')} AS ss, string_split(text, chr(10)) AS ls, len(regexp_extract_all(text, '["'']')) AS quotes, {CTXW} FROM cx),
sy AS (SELECT *, len(list_filter(ss[:-2], lambda s: s LIKE '%?')) > 0 AS qa, len(list_filter(ls, lambda l: regexp_matches({trim('l')}, '^\\d+\\.') )) > 0 AS numbered,
  len(list_filter(ss, lambda s: NOT (s LIKE '%?' OR s LIKE '%!'))) AS decl FROM sx),
sz AS (SELECT *, CASE WHEN qa THEN 'qa_format' WHEN quotes > 2 THEN 'dialogue' WHEN numbered THEN 'structured_list' WHEN decl > 0.8 THEN 'expository' ELSE 'mixed' END AS structure_type,
  CASE WHEN causal THEN 'analytical' WHEN temporal THEN 'narrative' WHEN comparative THEN 'argumentative' WHEN emphasis THEN 'persuasive' ELSE 'descriptive' END AS discourse_style FROM sy)"""


def prepared(spark, sf):
    return PR.with_structure(PR.with_profile(TB.marked_documents(spark, sf)))


@query("structure_type", sql=f"WITH {MARKED}, {STRUCT} SELECT doc_id, structure_type FROM sz")
def structure_type(spark, sf):
    return prepared(spark, sf).select("doc_id", "structure_type")


@query("discourse_style", sql=f"WITH {MARKED}, {STRUCT} SELECT doc_id, discourse_style FROM sz")
def discourse_style(spark, sf):
    return prepared(spark, sf).select("doc_id", "discourse_style")


HINTS = """CASE WHEN qa THEN 'Content contains Q&A patterns - consider preserving this structure.' END, CASE WHEN quotes > 0 THEN 'Content contains dialogue - handle quoted speech appropriately.' END,
 CASE WHEN numbered THEN 'Content has numbered lists - consider maintaining organization.' END"""


@query("transformation_hints", sql=f"""WITH {MARKED}, {STRUCT} SELECT doc_id, array_to_string(list_filter([{HINTS}, CASE WHEN len({W('text')}) > 1 THEN 'Rich topic content - good for diverse training examples.' END], lambda x: x IS NOT NULL), '|') AS training_data,
 array_to_string(list_filter([{HINTS}, CASE WHEN abs(polarity) > 0.3 THEN 'Content has ' || CASE WHEN polarity > 0 THEN 'positive' ELSE 'negative' END || ' sentiment - consider in rewrite.' END], lambda x: x IS NOT NULL), '|') AS rewrite_story FROM sz""")
def transformation_hints(spark, sf):
    return prepared(spark, sf).select("doc_id", *[F.array_join(PR.transformation_hints(F.col("text"), k), "|").alias(k) for k in ("training_data", "rewrite_story")])


@query("key_context", sql=f"""WITH {MARKED}, {STRUCT}, {GRAMS.replace('w AS (SELECT', 'gw AS (SELECT', 1).replace('FROM w)', 'FROM gw)', 1).replace('g AS (SELECT doc_id, len(ws) - 1', 'gg AS (SELECT doc_id, len(ws) - 1', 1).replace('FROM g WHERE', 'FROM gg WHERE', 1)},
tp AS (SELECT doc_id, string_agg(phrase, '|' ORDER BY rank) AS main_topics FROM gr WHERE rank <= 5 GROUP BY 1)
SELECT doc_id, {R('complexity')} AS complexity_level, {R('polarity')} AS sentiment, main_topics, structure_type, discourse_style FROM sz LEFT JOIN tp USING (doc_id)""")
def key_context(spark, sf):
    return PR.key_context(prepared(spark, sf))


@query("preservation_notes", sql=f"""WITH {MARKED}, {STRUCT}, ir AS (SELECT doc_id, text, label, row_number() OVER (PARTITION BY doc_id ORDER BY list_position({lst(FV.ENTITY_LABEL_ORDER)}, label), start, text) AS rank FROM ent),
ia AS (SELECT doc_id, string_agg(text, '|' ORDER BY rank) FILTER (label IN ('PERSON', 'ORG')) AS critical, count(*) AS n FROM ir WHERE rank <= 10 GROUP BY 1),
ph AS (SELECT doc_id, string_agg(phrase, '|' ORDER BY rank) AS phrases FROM pr WHERE rank <= 5 GROUP BY 1)
SELECT doc_id, coalesce(critical, '') AS critical_entities, coalesce(phrases, '') AS important_phrases, CASE WHEN coalesce(n, 0) > 0 THEN 'high' ELSE 'medium' END AS preservation_priority FROM m LEFT JOIN ia USING (doc_id) LEFT JOIN ph USING (doc_id)""")
def preservation_notes(spark, sf):
    return PR.preservation_notes(TB.marked_documents(spark, sf)).select(
        "doc_id", F.array_join("critical_entities", "|").alias("critical_entities"), F.array_join("important_phrases", "|").alias("important_phrases"), "preservation_priority")


PREP = f"""{PARA_CHUNKS}, ce AS (SELECT doc_id, length(text) AS n, {n_entities('text')} AS e FROM c), cd AS (SELECT doc_id, count(*) AS total_chunks, avg(n) AS avg_chunk_size, avg((e > 0)::INT) AS named FROM ce GROUP BY 1),
de AS (SELECT m.doc_id, {n_entities('text')} AS entity_count, len(list_distinct(list_transform(list_zip(({W('text')})[:-2], ({W('text')})[2:]), lambda z: z[1] || ' ' || z[2]))) AS key_phrase_count, coalesce(total_chunks, 0) AS total_chunks, coalesce(avg_chunk_size, 0) AS avg_chunk_size, coalesce(named, 0) AS named FROM m LEFT JOIN cd USING (doc_id)),
dq AS (SELECT *, CASE WHEN entity_count > 5 THEN 0.3 WHEN entity_count > 0 THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN key_phrase_count > 5 THEN 0.3 WHEN key_phrase_count > 0 THEN 0.1 ELSE 0 END::DOUBLE + named * 0.4::DOUBLE AS s FROM de)"""


@query("preparation_quality", sql=f"{PREP} SELECT doc_id, CASE WHEN s > 0.7::DOUBLE THEN 'excellent' WHEN s > 0.4::DOUBLE THEN 'good' WHEN s > 0.2::DOUBLE THEN 'fair' ELSE 'basic' END AS preparation_quality FROM dq")
def preparation_quality(spark, sf):
    return PR.preparation_metadata(TB.marked_documents(spark, sf), para_chunks(spark, sf)).select("doc_id", "preparation_quality")


@query("preparation_metadata", sql=f"{PREP} SELECT doc_id, total_chunks, {R('avg_chunk_size')} AS avg_chunk_size, entity_count, key_phrase_count FROM dq")
def preparation_metadata(spark, sf):
    return PR.preparation_metadata(TB.marked_documents(spark, sf), para_chunks(spark, sf)).select(
        "doc_id", "total_chunks", "avg_chunk_size", "entity_count", "key_phrase_count")


# --- composed analyses --------------------------------------------------------------------------------------

def _analysis_sql():
    """The twins of the single analyses, joined by document."""
    of = {k: f"({ORACLES[k]})" for k in ("text_stats", "sentiment", "complexity", "structure_type", "discourse_style", "sentence_types", "extract_labeled_entities", "identify_themes", "phrase_importance")}
    return f"""WITH e AS (SELECT doc_id, string_agg(label || ':' || start || ':' || text, '|' ORDER BY label || ':' || start || ':' || text) AS entities FROM {of['extract_labeled_entities']} GROUP BY 1),
t AS (SELECT doc_id, string_agg(theme, '|' ORDER BY rank) AS topics FROM {of['identify_themes']} GROUP BY 1), k AS (SELECT doc_id, string_agg(phrase, '|' ORDER BY rank) AS key_phrases FROM {of['phrase_importance']} GROUP BY 1)
SELECT doc_id, chars, words, sentences, coalesce(entities, '') AS entities, structure_type, interrogative, exclamatory, declarative, coalesce(topics, '') AS topics, polarity, subjectivity, complexity,
  coalesce(key_phrases, '') AS key_phrases, discourse_style
FROM {of['text_stats']} JOIN {of['sentiment']} USING (doc_id) JOIN {of['complexity']} USING (doc_id) JOIN {of['structure_type']} USING (doc_id) JOIN {of['discourse_style']} USING (doc_id) JOIN {of['sentence_types']} USING (doc_id)
LEFT JOIN e USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)"""


@query("analyze_content", sql=_analysis_sql())
def analyze_content(spark, sf):
    """All parts of the analysis as columns, so that each is compared with the twin of its own operator."""
    a = AN.analyze_content(TB.marked_documents(spark, sf)).select("doc_id", "analysis.*")
    named = F.transform("entities", lambda e: F.concat(e["label"], F.lit(":"), e["start"].cast("string"), F.lit(":"), e["text"]))
    return a.select("doc_id", "features.*", F.array_join(F.array_sort(named), "|").alias("entities"), "structure.*", F.array_join("topics", "|").alias("topics"),
                    "sentiment.*", "complexity", F.array_join("key_phrases", "|").alias("key_phrases"), "discourse_style")


def _per_chunk(cte):
    return cte.replace("FROM m", "FROM cm").replace("doc_id", "chunk_id")


@query("analyze_semantics", sql=f"""{PARA_CHUNKS}, {SEM.replace('SRC', 'c')}, cm AS (SELECT chunk_id, text FROM c), {_per_chunk(THEMES)},
sn AS (SELECT doc_id || '_' || chunk_no AS cid, doc_id AS d0, unnest({S('text')}) AS s, unnest(range(0, len({S('text')}))) AS sent_no FROM c), m2 AS (SELECT d0 || '#' || cid || '#' || sent_no AS doc_id, s AS text FROM sn),
{ENTITIES.replace('FROM m)', 'FROM m2)')}, es AS (SELECT doc_id, count(*) AS n FROM ent GROUP BY 1), rl AS (SELECT split_part(doc_id, '#', 1)::BIGINT AS doc_id, sum(n * (n - 1) // 2)::BIGINT AS relations FROM es WHERE n > 1 GROUP BY 1),
tc AS (SELECT doc_id, theme, count(*) AS n FROM tr JOIN c USING (chunk_id) WHERE rank <= 5 GROUP BY 1, 2), ch AS (SELECT doc_id, count(*) AS chunks FROM c GROUP BY 1),
gt AS (SELECT doc_id, string_agg(theme, '|' ORDER BY theme) FILTER (n >= greatest(2, chunks * 0.2)) AS global_themes, max(n) AS top FROM tc JOIN ch USING (doc_id) GROUP BY 1),
kk AS (SELECT doc_id, chunk_no, unnest({concepts('text')}) AS concept FROM c), ks AS (SELECT *, count(*) OVER (PARTITION BY doc_id, concept) AS n FROM kk),
kc AS (SELECT doc_id, count(*) AS concept_clusters FROM (SELECT doc_id, chunk_no FROM ks WHERE n >= 2 GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1)
SELECT sm.doc_id, count(*) AS chunks, {R('avg(semantic_score)')} AS mean_score, {R('avg(context_relevance)')} AS mean_relevance, {R('max(intensity)')} AS peak_intensity, sum(e)::BIGINT AS entities,
 {R('any_value(CASE WHEN ch.chunks < 2 THEN 1.0 WHEN gt.top IS NULL THEN 0.5 ELSE least(1.0, gt.top / ch.chunks) END)')} AS coherence, coalesce(any_value(gt.global_themes), '') AS global_themes,
 coalesce(any_value(relations), 0) AS relations, coalesce(any_value(concept_clusters), 0) AS concept_clusters
FROM sm JOIN ch USING (doc_id) LEFT JOIN gt USING (doc_id) LEFT JOIN rl USING (doc_id) LEFT JOIN kc USING (doc_id) GROUP BY 1""")
def analyze_semantics(spark, sf):
    return AN.analyze_semantics(para_chunks(spark, sf))


ANC = f"""{PARA_CHUNKS}, {SEM.replace('SRC', 'c')}, dd AS (SELECT chunk_id AS doc_id, text, {doubled('lower(text)')} AS d FROM c), ct AS (SELECT doc_id AS chunk_id, {content_sql()} FROM dd),
cl AS (SELECT doc_id, chunk_no, list_distinct({W('lower(text)')}) AS w, chunk_id FROM c), cj AS (SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY chunk_no) AS pw FROM cl)"""


@query("analyze_chunks", sql=f"""{ANC} SELECT sm.doc_id, sm.chunk_no, {CT_PICK} AS content_type, {R('least(1.0, dialogue / greatest(n / 50, 1))')} AS dialogue_potential, {R('semantic_density')} AS semantic_density,
 {R('info')} AS information_density, {R('rs')} AS readability_score, {R('blend')} AS coherence_score, {R('CASE WHEN pw IS NULL THEN 0 ELSE len(list_intersect(w, pw)) / len(list_distinct(list_concat(w, pw))) END')} AS topic_continuity
FROM sm JOIN ct USING (chunk_id) JOIN cj USING (chunk_id)""")
def analyze_chunks(spark, sf):
    return AN.analyze_chunks(para_chunks(spark, sf)).select(
        "doc_id", "chunk_no", "content_type", "dialogue_potential", "semantic_density", "information_density",
        "readability_score", "coherence_score", "topic_continuity")


EC = "CASE " + " ".join(f"WHEN {anyof('lower(message)', k)} THEN '{c}'" for c, _, k in FV.ERROR_CLASSES) + " WHEN context = 'chunking' THEN 'processing' ELSE 'system' END"
ERRMSG = f"""em AS (SELECT event_id, {pick(TB.ERROR_TEXTS, "CAST(json_extract_string(props, '$.k') AS INT)")} AS message, CASE WHEN event_type = 'click' THEN 'chunking' ELSE 'upload' END AS context,
  CASE WHEN event_type = 'view' THEN 'ImportError' ELSE 'ValueError' END AS error_type FROM events), ek AS (SELECT *, {EC} AS category FROM em)"""


@query("classify_error", sql=f"""WITH {ERRMSG} SELECT event_id, category, CASE category {' '.join(f"WHEN '{c}' THEN '{s}'" for c, s, _ in FV.ERROR_CLASSES)} WHEN 'processing' THEN 'medium' ELSE 'high' END AS severity,
 category <> 'user_input' AS recoverable, category <> 'user_input' AND error_type <> 'ImportError' AS retry_recommended FROM ek""")
def classify_error(spark, sf):
    return OL.classify_errors(TB.error_messages(spark, sf)).drop("message", "context", "error_type")
