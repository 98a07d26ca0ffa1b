"""DuckDB fragments for the oracles, written from the operator definitions."""

from __future__ import annotations

from corpusloom import fixed_values as FV
from corpusloom.sources import tables as TB

NW = r"[^\p{L}\p{N}_]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def R(x: str) -> str:
    return f"round(({x})::DOUBLE, 6)"


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def W(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


def NWORDS(x: str) -> str:
    return f"len({W(x)})"


def S(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, '[.!?]+'), lambda s: {trim('s')}), lambda s: s <> '')"


def MS(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({x}, '[^.!?]+[.!?]*'), lambda s: {trim('s')}), lambda s: s <> '')"


def hits(low: str, terms) -> str:
    return f"len(list_filter({lst(terms)}, lambda t: contains({low}, t)))"


def anyof(low: str, terms) -> str:
    return f"({hits(low, terms)} > 0)"


def doubled(x: str) -> str:
    """Every character outside words twice, so that neighbouring matches never share a border."""
    return rf"regexp_replace({x}, '({NW})', '\1\1', 'g')"


def wcount(dlow: str, terms) -> str:
    """Whole-word occurrences of terms in lower-cased, doubled text."""
    alts = "|".join(t.replace(" ", "  ") for t in terms)
    return f"len(regexp_extract_all({dlow}, {q(f'(?:^|{NW})(?:{alts})(?:$|{NW})')}))"


def pick(values, by: str) -> str:
    return f"({lst(values)})[({by}) % {len(values)} + 1]"


MARKED = (f"m AS (SELECT doc_id, {pick(TB.HEADS, 'doc_id')} || replace(text, chr(10), chr(10) || chr(10)) || "
          f"{pick(TB.TAILS, 'doc_id')} AS text FROM documents)")
DOCS = "m AS (SELECT doc_id, text FROM documents)"
PAIRS = ("p AS (SELECT q.conv_id || '_' || q.turn AS pair_id, q.conv_id, q.turn, q.text AS original, a.text AS enhanced "
         "FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 "
         "WHERE q.role = 'user' AND a.role = 'assistant')")


def pack(items: str, budget: int, sep: str = " ", widest: int | None = None, out: str = "c") -> str:
    """CTEs packing ``items(doc_id, i, s)`` greedily; result ``out(doc_id, chunk_no, text, sentence_count)``."""
    n = len(sep)
    bound = "" if widest is None else f" AND b.i <= a.i + {widest}"
    return f"""
cum AS (SELECT doc_id, i, s, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i) AS cs FROM {items}),
reach AS (SELECT a.doc_id, a.i AS st, max(b.i) AS en FROM cum a JOIN cum b ON a.doc_id = b.doc_id AND b.i >= a.i{bound}
  AND (b.i = a.i OR b.cs - a.cs + length(a.s) + {n} * (b.i - 1 - a.i) <= {budget}) GROUP BY 1, 2),
walk AS (SELECT doc_id, 1::BIGINT AS chunk_no, st, en FROM reach WHERE st = 1
  UNION ALL SELECT r.doc_id, w.chunk_no + 1, r.st, r.en FROM walk w JOIN reach r ON r.doc_id = w.doc_id AND r.st = w.en + 1),
{out} AS (SELECT w.doc_id, w.chunk_no, string_agg(x.s, {q(sep)} ORDER BY x.i) AS text, count(*) AS sentence_count
  FROM walk w JOIN {items} x ON x.doc_id = w.doc_id AND x.i BETWEEN w.st AND w.en GROUP BY 1, 2)"""


def chunks(source: str = DOCS, budget: int = 1000) -> str:
    """``WITH RECURSIVE`` prelude giving m (texts) and c (sentence chunks)."""
    return (f"WITH RECURSIVE {source}, it AS (SELECT doc_id, unnest({MS('text')}) AS s, "
            f"unnest(range(1, len({MS('text')}) + 1)) AS i FROM m), {pack('it', budget)}")


# Words and the gaps between them with start offsets, from m(doc_id, text).
TOKENS = rf"""tk AS (SELECT doc_id, unnest(r) AS tok, unnest(range(1, len(r) + 1)) AS k FROM (
  SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+') AS r FROM m)),
ts AS (SELECT *, (sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY k) - length(tok))::BIGINT AS start,
  lead(tok) OVER w AS t1, lead(tok, 2) OVER w AS t2, lead(tok, 3) OVER w AS t3, lead(tok, 4) OVER w AS t4,
  lead(tok, 5) OVER w AS t5, lead(tok, 6) OVER w AS t6 FROM tk WINDOW w AS (PARTITION BY doc_id ORDER BY k))"""

_ORG = lst(FV.ORG_WORDS)
_PLACE = lst(FV.PLACE_WORDS)
# Labelled entities ent(doc_id, label, text, start) from runs of capitalised words.
ENTITIES = TOKENS + rf""",
cap AS (SELECT doc_id, k, tok, start, t1 AS gap, tok SIMILAR TO '[A-Z][a-z]+' AS is_cap FROM ts WHERE tok ~ '^[\p{{L}}\p{{N}}_]+$'),
lnk AS (SELECT *, is_cap AND coalesce(lag(is_cap) OVER w, false) AND regexp_full_match(lag(gap) OVER w, '\s+') AS joined
  FROM cap WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
run AS (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k) AS g FROM lnk),
pos AS (SELECT *, row_number() OVER (PARTITION BY doc_id, g ORDER BY k) AS n,
  lead(tok) OVER (PARTITION BY doc_id, g ORDER BY k) AS nxt,
  max(CASE WHEN tok IN (SELECT unnest({_PLACE})) THEN k END) OVER (PARTITION BY doc_id, g) AS place_k,
  first_value(k) OVER (PARTITION BY doc_id, g ORDER BY k) AS k0 FROM run WHERE is_cap),
ent AS (
  SELECT doc_id, 'PERSON' AS label, tok || gap || nxt AS text, start FROM pos WHERE n % 2 = 1 AND nxt IS NOT NULL
  UNION ALL SELECT doc_id, 'ORG', tok || gap || nxt, start FROM pos WHERE list_contains({_ORG}, nxt)
  UNION ALL SELECT p.doc_id, 'GPE', string_agg(a.tok, '' ORDER BY a.k), min(p.start) FROM pos p
    JOIN tk a ON a.doc_id = p.doc_id AND a.k BETWEEN p.k0 AND p.place_k
    WHERE p.n = 1 AND p.place_k > p.k0 GROUP BY p.doc_id, p.k)"""


def concepts(x: str) -> str:
    """Sorted distinct concept words of a text."""
    d = doubled(f"lower({x})")
    parts = []
    for lead, link in FV.CONCEPT_LEADS:
        pat = rf"(?:^|{NW})(?:{'|'.join(lead)})\s+(?:{'|'.join(link)})\s+([\p{{L}}\p{{N}}_]+)"
        parts.append(f"regexp_extract_all({d}, {q(pat)}, 1)")
    joined = parts[0]
    for p in parts[1:]:
        joined = f"list_concat({joined}, {p})"
    return f"list_sort(list_distinct(list_filter({joined}, lambda w: length(w) > 2)))"


def n_entities(x: str) -> str:
    """Count of labelled entities of a short text, from capitalised word pairs in doubled text."""
    d = doubled(x)
    cap = "[A-Z][a-z]+"
    pats = [rf"(?:^|{NW}){cap}\s+{cap}(?:$|{NW})",
            rf"(?:^|{NW}){cap}\s+(?:{'|'.join(FV.ORG_WORDS)})(?:$|{NW})",
            rf"(?:^|{NW}){cap}(?:\s+{cap})*\s+(?:{'|'.join(FV.PLACE_WORDS)})(?:$|{NW})"]
    return "(" + " + ".join(f"len(regexp_extract_all({d}, {q(p)}))" for p in pats) + ")"


def n_themes(low: str) -> str:
    return "(" + " + ".join(f"({hits(low, k)} > 0)::INT" for k in FV.THEME_KEYWORDS.values()) + ")"


def syllables(x: str) -> str:
    return (f"coalesce(list_sum(list_transform({W(f'lower({x})')}, lambda w: greatest(1, len(regexp_extract_all(w, '[aeiouy]+'))"
            f" - CASE WHEN w LIKE '%e' AND len(regexp_extract_all(w, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END))), 0)")


def dialogue_matches(x: str) -> str:
    d = doubled(f"lower({x})")
    said = (rf"(?:^|{NW})(?:{'|'.join(FV.SPEECH_PRONOUNS)})\s+(?:{'|'.join(FV.SHORT_SPEECH_VERBS)})(?:$|{NW})")
    return (f"(len(regexp_extract_all({x}, '\"[^\"]*\"')) + len(regexp_extract_all({x}, '''[^'']*''')) + "
            f"{wcount(d, FV.SPEECH_VERBS)} + len(regexp_extract_all({d}, {q(said)})) + "
            f"len(regexp_extract_all({x}, '[?!]')) + {wcount(d, FV.QUESTION_WORDS)} + {wcount(d, FV.RESPONSE_WORDS)})")


def grade(x: str) -> str:
    whens = " ".join(f"WHEN {x} >= {at} THEN {q(g)}" for at, g in FV.QUALITY_GRADES)
    return f"CASE {whens} ELSE {q(FV.LOWEST_GRADE)} END"


def route(x: str) -> str:
    return f"CASE WHEN {x} >= 0.7 THEN 'auto_approve' WHEN {x} >= 0.4 THEN 'manual_review' ELSE 'reject' END"


def quality(source: str, keys: str) -> str:
    """CTEs f0..f2: quality parts of ``source(keys, text)``; f2 has every score column."""
    return f"""f0 AS (SELECT {keys}, coalesce(text, '') AS text, {W("coalesce(text, '')")} AS ws, {S("coalesce(text, '')")} AS ss FROM {source}),
f1 AS (SELECT {keys}, text, len(ws) AS word_count, len(ss) AS sentence_count, ws,
  list_transform(ss, lambda s: {NWORDS('s')}::DOUBLE) AS lens, {syllables('text')} AS syl, {dialogue_matches('text')} AS dm,
  list_filter(ws, lambda w: regexp_full_match(w, '\\p{{L}}+')) AS alpha, ({trim('text')} = '') AS empty FROM f0),
f2a AS (SELECT {keys}, text, empty, word_count, sentence_count,
  CASE WHEN empty THEN 0 ELSE length(text) END AS content_length,
  CASE WHEN word_count = 0 OR sentence_count = 0 THEN 0.0 ELSE least(100.0, greatest(0.0, 206.835::DOUBLE
    - 1.015::DOUBLE * (word_count / sentence_count) - 84.6::DOUBLE * (syl / word_count))) END AS readability_score,
  CASE WHEN word_count = 0 THEN 0.0::DOUBLE ELSE least(1.0, dm / word_count * 10) END AS dialogue_potential,
  CASE WHEN sentence_count < 2 THEN 0.8::DOUBLE ELSE least(1.0, greatest(0.3, 1.0 - list_var_samp(lens) / (list_avg(lens) ** 2))) END AS coherence_score,
  CASE WHEN sentence_count = 0 THEN 0.0::DOUBLE WHEN sentence_count < 2 THEN 0.5 ELSE least(1.0, list_stddev_samp(lens) / list_avg(lens)) END AS sentence_variety,
  CASE WHEN len(alpha) = 0 THEN 0.0::DOUBLE ELSE len(list_distinct(list_transform(alpha, lambda w: lower(w)))) / len(alpha) END AS vocabulary_diversity
  FROM f1),
f2b AS (SELECT *, CASE WHEN empty THEN 0.0::DOUBLE ELSE round((CASE WHEN word_count < 20 THEN 0.2 WHEN word_count > 1000 THEN 0.7
    WHEN word_count <= 500 THEN 0.8::DOUBLE + 0.2::DOUBLE * ((word_count - 20) / 480.0::DOUBLE) ELSE 0.8 END)::DOUBLE * 0.15::DOUBLE
  + coherence_score * 0.25::DOUBLE + dialogue_potential * 0.20::DOUBLE + sentence_variety * 0.10::DOUBLE + vocabulary_diversity * 0.15::DOUBLE
  + (CASE WHEN readability_score < 30 THEN 0.3 WHEN readability_score > 90 THEN 0.7 ELSE 0.8 END)::DOUBLE * 0.15::DOUBLE, 3) END AS quality_score FROM f2a),
f2 AS (SELECT *, CASE WHEN empty THEN 'Empty' ELSE {grade('quality_score')} END AS quality_grade FROM f2b)"""
