"""Brute-force comparisons, edge rows, hot keys and round trips on small fixtures."""

import json
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import fixed_values as FV
from corpusloom.functions import pairs as PF, scores as S, text as T
from corpusloom.operators import analysis as AN, chunking as CH, cleaning as CL, export as EXP, extraction as EX, graph as GR, monitor as MO, themes as TH, vectors as VE
from corpusloom.plans import ordered, skew
from corpusloom.sources import readers as RD, tables as TB
from corpusloom.streaming import stateful as SF, streams as ST

EDGE = [None, "", "   \n ", "word", "no end mark here", "Élan vital déjà vu. Ça va!", "it it it it. it it.", "x" * 1500 + ". y."]
STORY = ('Chapter 1\n\nThe old house stood alone. "Who is there?" asked Tom. However, nobody replied.\n\n'
         "Then the wind rose and the door opened. Meanwhile, in the garden, a cat slept. Finally it was over. ") * 6


def texts(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def one(df):
    return [r[0] for r in df.collect()]


# --- chunking -------------------------------------------------------------------------------

def test_sentence_chunks_keep_all_sentences_and_the_budget(spark):
    d = texts(spark, [STORY, *EDGE])
    sents = {}
    for r in CH.split_sentences(d).orderBy("doc_id", "sent_no").collect():
        sents.setdefault(r.doc_id, []).append(r.sentence)
    got = {}
    for r in CH.chunk_by_sentences(d, 120).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r.doc_id, []).append((r.text, r.sentence_count))
    for k, v in sents.items():
        assert re.sub(r"[.!?\s]+", " ", " ".join(t for t, _ in got[k])).strip() == re.sub(r"\s+", " ", " ".join(v))
        assert all(n == 1 or len(t) <= 121 + n for t, n in got[k])
    assert sorted(got) == sorted(sents)


def brute_fixed_cuts(text, target):
    cur, at, cuts = [], 0, []
    for w in text.split():
        cur.append(w)
        if len(cur) >= target:
            joined = " ".join(cur)
            ends = [m.end() for m in re.finditer(r"[.!?]+\s+", joined)]
            if ends:
                cuts.append(at + ends[-1])
                at, cur = at + ends[-1], joined[ends[-1]:].split()
            else:
                cuts.append(at + len(joined))
                at, cur = at + len(joined) + 1, []
    return cuts


def test_fixed_word_cuts(spark):
    rows = [STORY, " ".join(f"w{i}" for i in range(300)), "a. b! c? " * 70, "one"]
    for target in (5, 17, 50):
        got = one(texts(spark, rows).orderBy("doc_id").select(CH.fixed_word_cuts(F.col("text"), target)))
        assert got == [brute_fixed_cuts(t, target) for t in rows]


def brute_chosen(text, cuts, s):
    at, out = 0, [0]
    for b in cuts:
        if b <= at:
            continue
        n = len(text[at:b].split())
        if s.min_size <= n <= s.max_size:
            out.append(b)
            at = b
        elif n > s.max_size:
            out += [at + k for k in brute_fixed_cuts(text[at:b], s.target_size)]
            at = b
    if max(out) < len(text):
        out.append(len(text))
    return out


def test_chosen_cuts_match_recounting_every_stretch(spark):
    rng = random.Random(5)
    strategy = CH.ChunkingStrategy(12, 6, 20)
    for _ in range(6):
        text = "".join(rng.choice(["ab", "c", " ", " ", "\n", ". "]) for _ in range(400)) + "z"
        cuts = sorted({0, len(text), *(rng.randrange(len(text)) for _ in range(25))})
        d = spark.createDataFrame([(text, cuts)], "text string, cuts array<int>")
        assert one(d.select(CH.chosen_cuts(F.col("text"), F.col("cuts"), strategy))) == [brute_chosen(text, cuts, strategy)]


def test_context_chunks_cover_the_text(spark):
    rows = CH.context_chunks(texts(spark, [STORY]), CH.ChunkingStrategy(40, 20, 60)).orderBy("start_pos").collect()
    assert rows[0].start_pos == 0 and rows[-1].end_pos == len(STORY)
    assert all(a.end_pos == b.start_pos for a, b in zip(rows, rows[1:]))
    assert rows[1].preceding_context.endswith(STORY[:rows[1].start_pos].strip()[-10:])
    assert [r.chunk_id for r in rows][:2] == ["chunk_000", "chunk_001"]


def test_spans_offsets(spark):
    text = "éa then b Then, then"
    got = one(texts(spark, [text]).select(T.spans(F.col("text"), T.word_pattern(["then"]))))[0]
    assert [(r.start, r.end, r.text) for r in got] == [(m.start(), m.end(), m.group()) for m in re.finditer(r"\bthen\b", text, re.I)]


# --- scores ---------------------------------------------------------------------------------

def brute_syllables(text):
    def word(w):
        n = len(re.findall("[aeiouy]+", w))
        return max(1, n - 1 if w.endswith("e") and n > 1 else n)
    return sum(word(w) for w in text.lower().split())


def test_syllables(spark):
    rows = ["able bee idea queue rhythm the a-e e.e. Éte ate aotie x eee. make, made", STORY, "", "yye aeiouye strengths e"]
    assert one(texts(spark, rows).orderBy("doc_id").select(S.syllables(F.col("text")))) == [brute_syllables(t) for t in rows]


def test_quality_of_edge_rows(spark):
    rows = {r.doc_id: r for r in S.with_quality(texts(spark, EDGE)).collect()}
    for i in (0, 1, 2):
        assert rows[i].quality_grade == "Empty" and rows[i].quality_score == 0 and rows[i].word_count == 0
    assert all(0 <= r.quality_score <= 1 for r in rows.values())
    assert rows[3].sentence_variety == 0.5 and rows[3].coherence_score == 0.8


def test_all_row_operators_take_edge_rows(spark):
    d = texts(spark, EDGE)
    for fn in (CH.chunk_by_words, CH.chunk_by_paragraphs, CH.chunk_fixed_words, CH.semantic_boundaries, CH.merge_undersized, CH.narrative_segments,
               EX.dialogue_indicators, EX.flow_markers, EX.context_markers, S.with_semantics, TH.phrase_importance, TH.top_phrases,
               EX.smart_detect_cascade, EX.detect_content_type, CL.sanitize):
        fn(d).collect()


def test_scores_stay_in_range(spark):
    r = S.with_semantics(texts(spark, [STORY, *EDGE[3:]])).collect()
    for name in ("semantic_score", "semantic_density", "context_relevance", "coherence_blend", "intensity", "information_density"):
        assert all(0 <= x[name] <= 1 for x in r)


def test_pair_assessment_by_hand(spark):
    d = spark.createDataFrame([("The door is not safe. It is false", "The door is safe and true. Studies show 50 doors"), ("same words here", "same words here")], "original string, enhanced string")
    a, b = PF.with_assessment(d).collect()
    assert a.n_contradictions == 2 and a.n_new_claims == 1
    assert b.semantic_similarity == 1.0 and b.hallucination_score == 0.0 and b.length_ratio == 1.0
    assert math.isclose(PF_tone(d), 0.2 * 1)


def PF_tone(d):
    return d.limit(1).select(S.tone_consistency(F.lit("grace"), "christian_mysticism")).first()[0]


def test_cosine(spark):
    d = spark.createDataFrame([([1.0, 2.0], [2.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert one(d.select(PF.cosine(F.col("a"), F.col("b")))) == [pytest.approx(0.8), None]


# --- extraction -----------------------------------------------------------------------------

QA_TEXT = ("Q: What is the purpose of this thing?\nA: It exists so that we can test the rules.\n\n"
           "Question: How does one begin the long work?\nAnswer: By taking the first small step today.\n\n"
           "A closing paragraph that stands on its own and is long enough.\n\nStudent: short?\nTeacher: no\n\n"
           "Alice: Where do the rivers finally go?\nBob: They all go down to the wide sea.")


def test_dictionary_hits_are_those_of_plain_search(spark):
    """Short and long phrases, phrases inside others and over themselves, case, signs outside the basic plane, null and empty texts and phrases."""
    draw = random.Random(11)
    rows = ["".join(draw.choice("abA é😀.\n") for _ in range(draw.randint(0, 150))) for _ in range(60)] + ["", None, "aaaa aaaaa", "Ab" * 30]
    phrases = ["a", "aa", "ab", "b a", "é", "😀", "aba", "ababababab", "A b", "", None, "aa", "not there at all", "\n\n"] + [rows[k][3:3 + n] for k in range(8) for n in (4, 9, 20)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    words = spark.createDataFrame([(p,) for p in phrases], "keyword string")
    for case in (False, True):
        low = (lambda x: x) if case else str.lower
        got = sorted((r.doc_id, r.keyword, r.start_pos, r.end_pos, r.matched_text, r.sentence_index, r.paragraph_index) for r in TH.dictionary_hits(df, words, case).collect())
        want = [(i, p, m.start(), m.end(), m[0], sum(x in ".!?" for x in t[:m.start()]), t[:m.start()].count("\n\n"))
                for i, t in enumerate(rows) if t for p in {p for p in phrases if p} for m in re.finditer(re.escape(low(p)), low(t))]
        want = [(i, p, s, e, rows[i][s:e], a, b) for i, p, s, e, _, a, b in want]
        assert got == sorted(want) and got
    assert TH.dictionary_hits(df, words.limit(0)).count() == 0


def test_ten_thousand_phrases_in_one_pass(spark):
    draw = random.Random(12)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 6)))
    rows = [" ".join(word() for _ in range(400)) for _ in range(40)]
    phrases = sorted({" ".join(word() for _ in range(2)) for _ in range(10_000)} | {" ".join(t.split()[5:8]) for t in rows})
    hits = TH.dictionary_hits(texts(spark, rows).withColumn("doc_id", F.xxhash64("text")), spark.createDataFrame([(p,) for p in phrases], "keyword string"))
    found = {p for p in phrases if any(p in t for t in rows)}
    assert {r.keyword for r in hits.collect()} == found and len(found) >= 40 and len(phrases) > 9_900
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_dictionary_keeps_place_of_signs_that_change_length(spark):
    """A sign that lower case makes two, a sigma at a word's end, runs of line ends, and a text longer than a slice."""
    rows = ["x\u0130y the end. the", "\u039f\u0394\u039f\u03a3 the", "a\n\n\nthe\n\n\n\n the", "b" * ((1 << 20) - 2) + "the. the end"]
    hits = TH.dictionary_places(texts(spark, rows).withColumn("doc_id", F.length("text")), spark.createDataFrame([("the",), ("\u03bf\u03b4\u03bf\u03c3",)], "keyword string"))
    got = sorted((r.doc_id, r.start_pos, r.matched_text, r.sentence_index, r.paragraph_index) for r in hits.collect())
    long = len(rows[3])
    assert got == [(8, 0, "\u039f\u0394\u039f\u03a3", 0, 0), (8, 5, "the", 0, 0), (15, 4, "the", 0, 1), (15, 12, "the", 0, 3), (16, 4, "the", 0, 0), (16, 13, "the", 1, 0),
                   (long, long - 12, "the", 0, 0), (long, long - 7, "the", 1, 0)]


def test_dictionary_takes_seconds_for_a_million_signs(spark):
    """Every position is hashed in blocks: before, each one ran through an expression of its own (measured: 94 s for 27 million signs on 8 cores)."""
    draw = random.Random(14)
    rows = [" ".join("".join(draw.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(60_000)) for _ in range(8)]
    words = spark.createDataFrame([(" ".join(rows[k % 8].split()[k:k + 2])[:4 + k % 9],) for k in range(300)], "keyword string")
    df = texts(spark, rows).withColumn("doc_id", F.xxhash64("text")).repartition(8)
    TH.dictionary_places(df.limit(1), words).count()
    start = time.time()
    assert TH.dictionary_places(df, words).count() >= 300
    assert time.time() - start < 5


def test_patterns_pass_over_places_before_their_boundary_and_find_the_same(spark):
    """Word patterns tried by first sign, and syllables in one pattern, against the plain forms."""
    assert T.word_pattern(["said", "so", "as"]).startswith("(?iU)(?=[sa])") and T.PERSON_PATTERN.startswith("(?U)(?=[A-Z])")
    draw = random.Random(21)
    terms = ["said", "so", "so on", "i", "as", "kept"]
    rows = ["".join(draw.choice(["said", "so", " on", " ", "i", "as", "K", "\u212aept", "\u017fo", "\u0130", "\u0131", "é", "\u0301", ".", "e", "_", "bete", "aeb"]) for _ in range(draw.randint(0, 30))) for _ in range(300)]
    low, c = F.lower("text"), F.col("text")
    old = F.regexp_count(low, F.lit("[aeiouy]+")) - F.regexp_count(low, F.lit(r"[aeiouy][^\saeiouy]+[aeiouy]*e(?!\S)")) + T.n_words(c) - F.regexp_count(low, F.lit(r"[aeiouy]\S*"))
    same = texts(spark, rows).select(F.regexp_extract_all(c, F.lit(T.word_pattern(terms)), F.lit(0)).alias("a"), F.regexp_extract_all(c, F.lit(r"(?iU)\b(?:" + "|".join(terms) + r")\b"), F.lit(0)).alias("b"),
                                     S.syllables(c).alias("x"), old.alias("y")).collect()
    assert all(r.a == r.b and r.x == r.y for r in same) and sum(len(r.a) for r in same) > 50


def test_starts_of_items_across_blocks(spark):
    for n in (0, 1, 2, 63, 64, 65, 128, 129, 1000):
        sizes = [k % 7 for k in range(n)]
        got = spark.createDataFrame([(sizes,)], "v array<int>").select(T.starts_of(F.col("v")).alias("a")).first().a
        assert got == [sum(sizes[:k]) for k in range(n)]


def test_length_bins_score_each_text_once(spark, sf):
    df = S.with_quality(TB.documents(spark, sf)).select("word_count", "quality_score")
    out = MO.quality_by_length_bin(df)
    assert sum(r.n for r in out.collect()) == df.count()
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("ReusedExchange") >= 1


def test_overlaps_of_many_spans_take_linear_time(spark):
    """A hundred thousand spans of one text: before, every kept one copied all kept before it."""
    span = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("keyword"), F.lit(0.5).alias("confidence"))
    n = 100_000
    spans = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((i * 3).alias("start"), (i * 3 + 3 + i % 2).alias("end"), F.lit("k").alias("keyword"), (i % 5 / 10.0).alias("confidence")))
    kept = []
    for i in range(n):
        s = (i * 3, i * 3 + 3 + i % 2, i % 5 / 10.0)
        if not kept or s[0] >= kept[-1][1]:
            kept.append(s)
        elif s[2] > kept[-1][2]:
            kept[-1] = s
    start = time.time()
    got = spark.range(1).select(TH.dedupe_spans(spans).alias("v")).first().v
    assert [(r.start, r.end, r.confidence) for r in got] == kept and time.time() - start < 30
    assert spark.range(1).select(F.size(TH.dedupe_spans(F.filter(F.array(span), lambda x: F.lit(False))))).first()[0] == 0


def test_responses_are_parsed_or_rescued_as_apart(spark):
    rows = [("a", "qa_pairs", 'So: [{"question": "q", "answer": "b"}, {"question": "r"}] done'), ("b", "classification", "[broken {\n\n line ]\n last "), ("c", "x", "nothing"),
            ("d", "x", None), ("e", "qa_pairs", "[]"), ("f", "x", '[{"input": "i", "output": "o"}]'), ("g", "qa_pairs", '[{"question": oops]\n\n \nlast')]
    df = spark.createDataFrame(rows, "chunk_id string, format_type string, response string")
    apart = EX.parse_model_responses(df).unionByName(EX.rescue_unparsed(df)).drop("metadata")
    got = EX.parsed_or_rescued(df)
    assert got.columns == apart.columns and sorted(got.collect()) == sorted(apart.collect()) and got.count() >= 5


def test_chunk_summary_analyses_chunks_once(spark, sf):
    from corpusloom.registry import QUERIES
    plan = QUERIES["chunk_summary"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan


def brute_segments(text, patterns):
    """Spans taken pattern by pattern, each unless it meets one taken before."""
    taken = []
    for i, (pattern, q, a) in enumerate(patterns):
        for m in re.finditer(pattern, text, re.I | re.S):
            if not any(m.start() < e and s < m.end() for s, e, *_ in taken):
                taken.append((m.start(), m.end(), i, m[q].strip(), m[a].strip()))
    return sorted(taken)


def test_segments_of_overlapping_patterns_are_those_of_plain_search(spark):
    """Random texts over short patterns that overlap in every way, longer and shorter than what is taken before."""
    draw = random.Random(6)
    patterns = [(r"(b)c*(d)", 1, 2), (r"(a)b+(c)", 1, 2), (r"(c)[abd]{2,6}?(a)", 1, 2), (r"(d)(a)", 1, 2), (r"(a)[^a]*(a)", 1, 2)]
    rows = ["".join(draw.choice("abcd") for _ in range(draw.randint(0, 120))) for _ in range(60)]
    got = texts(spark, rows).select(EX.qa_segments(F.col("text"), patterns, None, 0).alias("s"), "text").collect()
    for r in got:
        assert [(m["start"], m["end"], m["pattern_no"], m["question"], m["answer"]) for m in r["s"]] == brute_segments(r["text"], patterns)


def test_many_segments_take_linear_time(spark):
    """Thirty thousand pairs in one text, a general pattern meeting all of them again."""
    text = "\n\n".join(f"Q: what is the matter of number {k} here\nA: the matter is that of number {k} there" for k in range(15_000))
    text += "\n\n" + "\n\n".join(f"Visitor: what is the matter of number {k} here\nTeacher: the matter is that of number {k} there" for k in range(15_000))
    start = time.time()
    assert one(texts(spark, [text]).select(F.size(EX.qa_segments(F.col("text"))))) == [30_000]
    assert time.time() - start < 60


def test_long_questions_are_kept(spark):
    text = "Q: " + "why " * 3000 + "\nA: " + "so " * 3000
    (seg,) = one(texts(spark, [text]).select(EX.qa_segments(F.col("text"))))[0]
    assert len(seg["question"]) == 11_999 and len(seg["answer"]) == 8_999


def test_qa_segments_and_free_paragraphs(spark):
    d = EX.with_qa_segments(texts(spark, [QA_TEXT, None]))
    segs = EX.extract_qa_segments(texts(spark, [QA_TEXT])).orderBy("start").collect()
    assert [s.question for s in segs] == ["What is the purpose of this thing?", "How does one begin the long work?", "Where do the rivers finally go?"]
    assert all(QA_TEXT[s.start:s.end].count("\n") == 1 for s in segs)
    free = EX.extract_monologue_segments(d).collect()
    assert any(r.question.startswith("A closing paragraph") for r in free)
    assert all(QA_TEXT.startswith(r.question, r.start) for r in free)


ALL_PATTERNS = (
    "Q: What is the very first question here?\nA: It is the first of many good answers.\n\n"
    "Question: How does one begin the long work?\nAnswer: By taking the first small step today.\n\n"
    "Q2: Which of the numbers do we like best?\nA2: The second number, as it is the nearest.\n\n"
    "Interviewer: Where did the long journey begin?\nInterviewee: It began in a small town by the sea.\n\n"
    "Host: Who was the guest that came last night?\nGuest: That was the old man from the valley.\n\n"
    "Alice: Where do the rivers finally go?\nBob: They all go down to the wide sea.\n\n"
    "Student: What should be learned before all else?\nGuru: To listen well before one speaks.\n\n"
    "Seeker: Where may the quiet place be found?\nSage: Inside, behind all of the noise.\n\n"
    "Is there anything left to be said today?\n\nOnly that the evening was a long one.\n\n"
    "3. Did the third point ever get an answer?\nYes, it got one after a long while.\n\nThe end of it all comes here.")


def test_all_segment_patterns_in_one_text(spark):
    """Kept spans are matches of their pattern, do not overlap, and a match left out overlaps one of an earlier or the same pattern."""
    text = "\n\n".join([ALL_PATTERNS, "A paragraph between that asks nothing.", ALL_PATTERNS.replace("long", "short")])
    segs = one(texts(spark, [text]).select(EX.qa_segments(F.col("text"), shortest=0, longest=10**6)))[0]
    kept = [(s.start, s.end, s.pattern_no) for s in segs]
    assert kept == sorted(kept) and all(x[1] <= y[0] for x, y in zip(kept, kept[1:]))
    for i, (pattern, q, a) in enumerate(FV.QA_SEGMENT_PATTERNS):
        matches = {m.span(): m for m in re.finditer(pattern, text, re.S | re.I)}
        for s in segs:
            if s.pattern_no == i:
                m = matches[(s.start, s.end)]
                assert (s.question, s.answer) == (m.group(q).strip(), m.group(a).strip())
        for lo, hi in matches:
            assert (lo, hi, i) in kept or any(k[2] <= i and k[0] < hi and lo < k[1] for k in kept)
    # some patterns are special cases of an earlier one and never win; each is tried alone as well
    for i, p in enumerate(FV.QA_SEGMENT_PATTERNS):
        alone = one(texts(spark, [text]).select(EX.qa_segments(F.col("text"), [p], [EX.SEGMENT_GUARDS[i]], 0, 10**6)))[0]
        assert [(s.start, s.end) for s in alone] == [m.span() for m in re.finditer(p[0], text, re.S | re.I)] and alone


def test_sentence_chunks_keep_end_marks(spark, sf):
    docs = TB.documents(spark, sf)
    marks = lambda s: sum(s.count(c) for c in ".!?")
    by_doc = {}
    for r in CH.chunk_by_sentences(docs, 1000).collect():
        by_doc[r.doc_id] = by_doc.get(r.doc_id, 0) + marks(r.text)
    for r in docs.collect():
        body = r.text.lstrip(".!? \n")  # marks before the first sentence belong to none
        assert by_doc.get(r.doc_id, 0) == marks(body)
    scored = S.with_quality(CH.chunk_by_sentences(docs, 1000)).agg(*[F.countDistinct(c) for c in ("sentence_count", "coherence_score", "sentence_variety")]).first()
    assert min(scored) > 1


def test_speaker_pairs_drop_unanswered_questions(spark):
    text = "Visitor: Is anybody at home today?\nVisitor: What should I do with the key?\nTeacher: Leave it under the old stone.\nTeacher: again"
    got = one(texts(spark, [text]).select(EX.speaker_pairs(F.col("text"))))[0]
    assert [(g.question, g.answer) for g in got] == [("What should I do with the key?", "Leave it under the old stone.")]


def test_first_by_signature(spark):
    rows = [("What is it, really?", "An answer long enough here."), ("WHAT is it, really?", "an ANSWER long enough here."), ("other question", "An answer long enough here.")]
    d = spark.createDataFrame([([{"question": q, "answer": a} for q, a in rows],)], "r array<struct<question:string,answer:string>>")
    got = one(d.select(EX.first_by_signature(F.col("r"))))[0]
    assert [g.question for g in got] == ["What is it, really?", "other question"]


def test_dedupe_spans(spark):
    """No kept spans overlap, and a dropped span overlaps a kept one of at least its confidence or one that replaced it."""
    rng = random.Random(3)
    for _ in range(5):
        rows = [(a, a + rng.randrange(1, 9), rng.choice("abc"), rng.choice([0.5, 0.7, 0.8])) for a in (rng.randrange(60) for _ in range(30))]
        d = spark.createDataFrame([(1, *r) for r in rows], "doc_id int, start int, end int, keyword string, confidence double")
        got = [(r.start, r.end, r.keyword, r.confidence) for r in TH.dedupe_overlaps(d).collect()]
        assert set(got) <= set(rows) and got == sorted(got)
        assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))
        best = max(r[3] for r in rows)
        assert any(g[3] == best for g in got)
        for r in set(rows) - set(got):
            near = [g for g in got if g[0] < r[1] + 8 and r[0] < g[1] + 8]
            assert any(g[3] >= r[3] for g in near), (r, got)


def test_responses(spark):
    rows = [("c1", "qa_pairs", 'Sure: [{"question":"q1","answer":"a1"},{"question":"q2"}] bye'), ("c2", "qa_pairs", "[]"), ("c3", "qa_pairs", "[broken\n\nsecond] line"), ("c4", "qa_pairs", None)]
    d = spark.createDataFrame(rows, "chunk_id string, format_type string, response string")
    assert [(r.id, r.input_text, r.output_text) for r in EX.parse_model_responses(d).orderBy("id").collect()] == [("c1_qa_pairs_0", "q1", "a1"), ("c1_qa_pairs_1", "q2", "")]
    assert [(r.id, r.input_text) for r in EX.rescue_unparsed(d).orderBy("id").collect()] == [("c3_qa_pairs_simple_0", "[broken"), ("c3_qa_pairs_simple_2", "second] line")]


# --- ordered plans and skew -----------------------------------------------------------------

def hot_rows(spark, n=3000):
    """One key holds almost all rows; others are few."""
    return spark.range(n).select(F.col("id"), F.when(F.col("id") % 50 == 0, F.col("id") % 7).otherwise(F.lit(3)).alias("k"),
                                 (F.col("id") * 7919 % 1009).cast("double").alias("v"))


def test_numbered_with_a_hot_key(spark):
    got = ordered.numbered(hot_rows(spark), ["k"], ["v", "id"]).toPandas().sort_values(["k", "v", "id"])
    assert (got.groupby("k").cumcount() + 1 == got.rn).all() and len(got) == 3000


def test_frames_cross_blocks_and_slices(spark):
    df = hot_rows(spark)
    got = ordered.over_frames(df, ["k"], ["v", "id"], 4, lambda d, w: d.withColumn("m", F.sum("id").over(w.rowsBetween(-4, 0))), block=16)
    pd_ = got.toPandas().sort_values(["k", "v", "id"])
    want = pd_.groupby("k").id.rolling(5, min_periods=1).sum().reset_index(drop=True)
    assert len(pd_) == 3000 and np.allclose(pd_.m.to_numpy(), want.to_numpy())
    with pytest.raises(ValueError):
        ordered.over_frames(df, ["k"], ["v", "id"], 16, lambda d, w: d, block=16)


def test_exact_quantiles(spark):
    df = hot_rows(spark)
    got = {r.k: r for r in ordered.exact_quantiles(df, ["k"], "v", "id", [0.25, 0.5, 0.75]).collect()}
    for k, g in df.toPandas().groupby("k"):
        assert np.allclose([got[k].q25, got[k].q50, got[k].q75], np.quantile(g.v, [0.25, 0.5, 0.75]))


def test_salted_join_equals_plain_join(spark):
    left = hot_rows(spark, 500)
    right = spark.createDataFrame([(i, f"n{i}") for i in range(0, 7, 2)], "k long, name string")
    plain = sorted((r.id, r.name) for r in left.join(right, "k", "left").collect() if r.name)
    salted = [(r.id, r.name) for r in skew.salted_join(left, right, ["k"], F.col("id")).collect()]
    assert len(salted) == 500 and sorted(x for x in salted if x[1]) == plain


def test_theme_join_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(0)
    v, w = rng.normal(size=(60, 4)), rng.normal(size=(5, 4))
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    themes = spark.createDataFrame([(f"t{i}", x.tolist()) for i, x in enumerate(w)], "theme string, embedding array<double>")
    cosine = (v / np.linalg.norm(v, axis=1)[:, None]) @ (w / np.linalg.norm(w, axis=1)[:, None]).T
    want = {(f"t{j}", i) for i in range(60) for j in range(5) if cosine[i, j] >= 0.5}
    centres = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(w)], "centre long, embedding array<double>")
    for block in (1, 2, 64):
        monkeypatch.setattr(VE, "QUERY_BLOCK", block)
        joined = VE.theme_similarity_join(items, themes, "vec_id", 0.5)
        assert {(r.theme, r.vec_id) for r in joined.collect()} == want and want
        assert {(r.vec_id, r.centre) for r in VE.nearest_centre(items, centres, "vec_id").collect()} == set(enumerate(cosine.argmax(axis=1)))
    # only blocks meet items: no exchange carries a row for an item and a theme
    assert made_by_joins(joined) == 60


def made_by_joins(df):
    """Rows that the joins of a plan put out when it runs."""
    df.collect()
    nodes, n = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        p = nodes.pop()
        if "AdaptiveSparkPlan" in p.nodeName():
            nodes.append(p.executedPlan())
            continue
        if "QueryStage" in p.nodeName():
            nodes.append(p.plan())
            continue
        if "Join" in p.nodeName():
            n = max(n, p.metrics().apply("numOutputRows").value())
        nodes += [p.children().apply(i) for i in range(p.children().size())]
    return n


def test_related_chunks_form_only_pairs_of_near_rings(spark, monkeypatch):
    """Groups of vectors far apart: few pairs are formed, all of them near by their angles, and none of the similar ones is missing; one document holds most rows."""
    monkeypatch.setattr(VE, "PAIR_BLOCK", 40)
    rng = np.random.default_rng(5)
    centre = np.eye(8)[np.arange(420) % 8] * np.where(np.arange(420) % 16 < 8, 1, -1)[:, None]
    v = centre + rng.normal(scale=0.04, size=(420, 8))
    doc = np.where(np.arange(420) < 360, 0, 1 + np.arange(420) % 3)
    rows = [(int(d), i, x.tolist()) for i, (d, x) in enumerate(zip(doc, v))] + [(0, 900, [0.0] * 8), (0, 901, None), (2, 902, v[0].tolist())]
    df = spark.createDataFrame(rows, "doc long, k long, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1)[:, None]
    want = {(a, b) for a in range(420) for b in range(420) if a != b and doc[a] == doc[b] and u[a] @ u[b] > 0.9}
    got = {(r.k, r.related) for r in VE.related_chunks(df, ["doc"], "k", above=0.9).collect()}
    assert {p for p in got if 902 not in p} == want and want
    pairs = {(r.k, r._k2) for r in VE.ring_pairs(df, ["doc"], "k", above=0.9).collect()}
    every = sum(n * (n - 1) // 2 for n in np.bincount(doc))
    assert {p for p in want if p[0] < p[1]} <= pairs and len(pairs) < every / 3
    assert VE.related_chunks(df.limit(0), ["doc"], "k").count() == 0


def test_lloyd_steps_are_plain_ones(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(90, 4)) + 4 * np.eye(4)[np.arange(90) % 3]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(200, None), (201, [1.0])]
    df = spark.createDataFrame(rows, "k long, embedding array<double>")
    c = v[:3]
    for _ in range(6):
        near = ((v[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([v[near == j].mean(axis=0) for j in range(3)])
    apart = ((v[:, None] - c) ** 2).sum(axis=2)
    got = {r.k: r for r in VE.lloyd_clusters(df, "k", 3, steps=6).collect()}
    assert {k: r.cluster for k, r in got.items()} == dict(enumerate(apart.argmin(axis=1)))
    assert got[0].inertia == pytest.approx(apart.min(axis=1).sum()) and VE.lloyd_clusters(df.limit(0), "k").count() == 0


def test_semantics_of_documents_take_one_scan(spark, sf):
    from corpusloom.operators import analysis as AN
    from corpusloom.registry.q_clean import para_chunks
    plan = AN.analyze_semantics(para_chunks(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan and plan.count("Aggregate [doc_id") == 1


def test_dependencies_are_the_closure_of_links(spark):
    draw = random.Random(9)
    names = ["Ada Lovelace", "Alan Turing", "Grace Hopper", "Kurt Godel"]
    rows = [(d, k, " and then ".join(draw.sample(names, draw.randint(0, 2)) + ["nobody."])) for d in range(3) for k in range(40 if d else 150)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_no int, text string")
    terms = {}
    for r in GR.chunk_terms(chunks).collect():
        terms.setdefault((r.doc_id, r.term), []).append(r.chunk_no)
    links = GR.dependency_links(chunks)
    got = sorted((r.doc_id, r.term, r.chunk_no, r.depends_on, r.n_earlier) for r in links.collect())
    assert got == sorted((d, t, b, a, i + 1) for (d, t), c in terms.items() for i, (a, b) in enumerate(zip(sorted(c), sorted(c)[1:])))
    every = {(d, b, a) for (d, _), c in terms.items() for a in c for b in c if a < b}
    assert {tuple(r) for r in GR.dependency_chunks(links).collect()} == every and len(every) > 2 * len(got)


def test_top_n_per_hot_key_is_cut_before_the_shuffle(spark):
    df = hot_rows(spark)
    plan = MO.keep_last_n(df, 5, ["id"], ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


# --- streams --------------------------------------------------------------------------------

def test_alert_stream_equals_batch(spark, sf, tmp_path):
    from corpusloom.registry.q_stream import _stream_alert_rows
    rows = lambda d: sorted((r.session_id, r.content_id, r.type, r.severity, round(r.value, 9)) for r in d.collect())
    stream = rows(_stream_alert_rows(spark, sf, str(tmp_path)))
    assert stream == rows(MO.alerts(TB.samples(spark, sf))) and stream


def test_retention_state_shrinks(spark, sf, tmp_path):
    """Alerts leave the state an interval after they were raised; what is left open is the batch answer."""
    from corpusloom.registry.q_stream import retained
    queries = retained(spark, sf, str(tmp_path), 24)
    changes = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/retention/data").select("content_id", "type", "change").collect()]
    raised, over = ({c[:2] for c in changes if c[2] == k} for k in ("raised", "retracted"))
    assert len(queries) == 3 and len(changes) == len(raised) + len(over) and over < raised
    want = {(r.content_id, r.type) for r in ST.recent_alerts(MO.alerts(TB.samples(spark, sf)), 24).collect()}
    assert raised - over == want
    left = [q.lastProgress["stateOperators"][0]["numRowsTotal"] for q in queries]
    assert max(left) < len(raised) / 2


def cached_rows(spark, tmp_path, pieces, live_ms=1000, late="2 seconds"):
    """Feed (row, key, seconds, value) piece by piece; returns the rows given out and the state left after each piece."""
    out, left = str(tmp_path), []
    for k, piece in enumerate(pieces):
        rows = spark.createDataFrame(piece, "event_id long, key string, at double, value double").withColumn("ts", F.timestamp_seconds("at"))
        rows.write.mode("append").parquet(f"{out}/in")
        s = spark.readStream.schema(rows.schema).parquet(f"{out}/in")
        q = ST.run_to_end(SF.result_cache(s, lambda r: r["value"] * 2, key="key", live_ms=live_ms, late=late), out)
        left.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    return sorted(tuple(r) for r in spark.read.parquet(f"{out}/data").select("event_id", "key", "result", "hit", "source").collect()), left


def test_cache_answers_repeats_until_they_expire(spark, tmp_path):
    pieces = [[(1, "a", 100.0, 5.0), (2, "a", 100.5, 6.0), (3, "b", 100.2, 7.0)],
              [(4, "a", 100.9, 8.0), (5, "a", 101.0, 9.0), (6, "c", 104.0, 1.0)],      # 4 after a restart, 5 is a whole life later
              [(7, "b", 102.1, 2.0), (8, "a", 101.5, 3.0), (9, None, 104.5, 4.0)],      # 7 late within the watermark, 8 behind it
              [(10, "a", 200.0, 1.0), (11, None, 104.9, 5.0)]]
    got, left = cached_rows(spark, tmp_path, pieces)
    assert got == sorted([(1, "a", 10.0, False, 1), (2, "a", 10.0, True, 1), (3, "b", 14.0, False, 3), (4, "a", 10.0, True, 1), (5, "a", 18.0, False, 5),
                          (6, "c", 2.0, False, 6), (7, "b", 4.0, False, 7), (9, None, 8.0, False, 9), (10, "a", 2.0, False, 10), (11, None, 8.0, True, 9)])
    assert left[-1] < max(left)  # all but the newest key have gone


def test_hooks_see_errors(spark, sf):
    seen = []

    def bad(batch, batch_id):
        raise RuntimeError("no")

    handler = ST.with_hooks(bad, None, [lambda b, e: seen.append((b, str(e)))])
    with pytest.raises(RuntimeError):
        handler(None, 4)
    assert seen == [(4, "no")]


# --- sources and sinks -----------------------------------------------------------------------

def test_read_corpus_and_file_facts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("first\nsecond", encoding="utf-8")
    (tmp_path / "b.md").write_text("# é", encoding="utf-8")
    (tmp_path / "c.bin").write_bytes(b"\x00")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in RD.read_text_corpus(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "first\nsecond", "b.md": "# é"}
    facts = {r.name.rsplit("/", 1)[1]: r.bytes for r in RD.file_facts(spark, str(tmp_path)).collect()}
    assert facts["c.bin"] == 1 and len(facts) == 3


def test_page_assembly_in_parts(spark):
    pages = spark.createDataFrame([(1, i, f"this is page number {i}" if i % 3 else "x") for i in range(10)], "doc int, page_no int, text string")
    rows = RD.page_text_assembly(pages, part=4).orderBy("part_no").collect()
    assert len(rows) == 3 and {(r.total_pages, r.processed_pages, r.skipped_pages) for r in rows} == {(10, 6, 4)}
    assert rows[0].text == "--- Page 1 ---\nthis is page number 1\n\n--- Page 2 ---\nthis is page number 2"


def test_csv_and_json_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(1, 'say "hi"\nthere', [1, 2]), (2, "a,b", [])], "id int, text string, n array<int>")
    EXP.write_csv(d, str(tmp_path / "csv"))
    back = spark.read.options(header=True, multiLine=True, escape='"').csv(str(tmp_path / "csv")).orderBy("id").collect()
    assert [(r.id, r.text, json.loads(r.n)) for r in back] == [("1", 'say "hi"\nthere', [1, 2]), ("2", "a,b", [])]
    EXP.write_json(d, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json/manifest")).first().total_items == 2


def test_bundle_and_routed_folders(spark, tmp_path):
    d = spark.createDataFrame([(f"r{i}", f"in {i}", f"out {i}", i / 4) for i in range(4)], "id string, input_text string, output_text string, quality_score double")
    EXP.write_bundle(d, str(tmp_path / "b"), ["id"])
    md = [r.value for r in spark.read.text(str(tmp_path / "b/markdown")).collect()]
    assert md.count("---") == 4 and "*Quality Score: 0.75*" in md
    EXP.write_routed(CL.route_by_quality(d), str(tmp_path / "r"))
    assert {r.route: r["count"] for r in spark.read.parquet(str(tmp_path / "r")).groupBy("route").count().collect()} == {"reject": 2, "manual_review": 1, "auto_approve": 1}


def test_sanitize_messages(spark):
    rows = [None, "", "  ", "short", "abc\x07def ghij <script>x</script> javascript:run", "y" * 1_000_001]
    got = {r.doc_id: r for r in CL.sanitize(texts(spark, rows)).collect()}
    assert [got[i].is_valid for i in range(6)] == [False, False, False, False, True, True]
    assert got[4].text == "abcdef ghij  run" and len(got[5].text) == 1_000_001
    refused = texts(spark, rows).select(T.sanitize_text(F.col("text"), longest=1000).alias("s")).filter("s.error like '%too long%'").first()
    assert not refused.s.is_valid and len(refused.s.text) == 1_000_001  # refused, not cut


def test_scores_that_meet_a_threshold_fall_as_in_sql(spark):
    import duckdb
    from corpusloom.registry.sqlbits import quality
    rng = random.Random(4)
    lengths = [[9, 8, 2, 1, 5]] + [[rng.randint(1, 3) * rng.randint(1, 12) for _ in range(rng.randint(2, 14))] for _ in range(3000)]
    rows = [(i, " ".join("word " * (n - 1) + "end." for n in sizes)) for i, sizes in enumerate(lengths)]
    con = duckdb.connect()
    con.execute("create table m (doc_id bigint, text varchar)")
    con.executemany("insert into m values (?, ?)", rows[:1])
    want = dict(con.execute(f"with {quality('m', 'doc_id')} select doc_id, coherence_score from f2").fetchall())
    got = S.with_quality(spark.createDataFrame(rows, "doc_id long, text string"))
    assert want[0] < 0.5 and got.filter("doc_id = 0").first().coherence_score == want[0]
    m = con.execute("select 1.0 - list_var_samp(l) / (list_avg(l) ** 2), list_stddev_samp(l) / list_avg(l) from (select unnest(?::DOUBLE[][]) as l)", [lengths]).fetchall()
    sides = [(max(c, 0.3) < 0.5, v < 0.4) for c, v in m]
    assert [(r.coherence_score < 0.5, r.sentence_variety < 0.4) for r in got.orderBy("doc_id").collect()] == sides


def test_rows_in_order_take_one_shuffle(spark, tmp_path):
    rows = [(f"r{i * 7919 % 1000:03}" if i else None, i % 3, "text " * (i % 50)) for i in range(1000)]
    d = spark.createDataFrame(rows, "id string, part int, text string").repartition(5)
    for order in (["id"], ["part", "id"]):
        got = ordered.in_order(d, order, "n").withColumn("p", F.spark_partition_id()).collect()
        want = d.orderBy(*order).collect()
        assert [tuple(r[:4]) for r in sorted(got, key=lambda r: r.n)] == [(*w, i + 1) for i, w in enumerate(want)]
        assert [r.p for r in sorted(got, key=lambda r: r.n)] == sorted(r.p for r in got) and len({r.p for r in got}) > 4
        plan = ordered.in_order(d, order, "n")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Repartition") == 2 and "Join" not in plan and "Window" not in plan  # that of the input, and one more
    assert ordered.in_order(d.filter("part = 9"), ["id"]).count() == 0


def test_json_export_is_compressed(spark, sf):
    from corpusloom.registry import QUERIES
    paths = [f for f in QUERIES["export_json"](spark, sf).inputFiles()]
    assert paths and all(f.endswith(".gz") for f in paths)


def test_segments_run_the_patterns_once(spark):
    talk = "Q: What is the oldest idea of all?\nA: It is an answer of some length.\n\nA paragraph that stands alone, without any labels.\n\n" + "Long one. " * 400
    d = texts(spark, [talk, "", None, talk.replace("oldest", "old\ufdd0est"), STORY])
    got = EX.union_segments(d)
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()
    parts = EX.extract_qa_segments(d).select("doc_id", "start", "content_type", "question", "answer", "quality_score").unionByName(
        EX.extract_monologue_segments(EX.with_qa_segments(d)).drop("confidence"))
    rows = [tuple(r) for r in got.drop("confidence").collect()]
    assert sorted(rows) == sorted(tuple(r) for r in parts.select(got.drop("confidence").columns).collect())
    kinds = [r.content_type for r in got.filter("doc_id = 0").orderBy("start").collect()]
    assert kinds[0] == "qa" and "monologue" in kinds and kinds.count("passage") > 1
    plain, marked = ([(r.start, r.end, r.text, r.groups) for r in d.filter(f"doc_id = {i}").select(F.inline(T.spans(F.col("text"), r"(?s)Q: (.+?)\n(A): ", (1, 2)))).collect()] for i in (0, 3))
    assert plain == [(0, 38, "Q: What is the oldest idea of all?\nA: ", ["What is the oldest idea of all?", "A"])]
    assert len(marked) == 1 and marked[0][1] == plain[0][1] + 1 and marked[0][3] == ["What is the old\ufdd0est idea of all?", "A"]


def test_cache_computes_many_keys_at_once(spark, tmp_path):
    rows = spark.range(4000).select(F.col("id").alias("event_id"), F.concat(F.lit("k"), F.col("id") % 2000).alias("key"), F.timestamp_seconds(F.lit(100)).alias("ts"), F.lit(1.0).alias("value"))
    rows.write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    ST.run_to_end(SF.result_cache(s, lambda r: r["value"] * len(r), key="key", shares=16), str(tmp_path))
    got = spark.read.parquet(f"{tmp_path}/data").agg(F.count("*"), F.count_if("hit"), F.min("result"), F.count_if(F.col("source") == F.substring("key", 2, 9).cast("long"))).first()
    assert tuple(got[:2]) == (4000, 2000) and got[2] > 50 and got[3] == 4000


def test_one_file_per_text_is_made_by_all_cores(spark, sf):
    from corpusloom.registry import QUERIES
    files = QUERIES["read_text_corpus"](spark, sf).inputFiles()
    assert len({re.search(r"part-(\d+)", f).group(1) for f in files}) > 4  # the number of the task that wrote it


# --- places of themes in one cut of a text --------------------------------------------------------------

def test_theme_spans_are_those_of_plain_search(spark):
    import re
    themes = ["then", "Freedom", "of the", "der", "aa", "i", "ς", "o. t", " x", "n "]
    rows = [*EDGE, STORY, "Then THEN then. aaaa aaa! of the der DER", "İ then. İİ i! ΑΣ. ς Σ", "leſ ſ then", "no. then o. t x x. n x n ", "...then!!aa??", "then" * 300 + ". " + "a then. " * 200]

    def low(t):
        return "".join(x.lower()[0] for x in t.replace("Σ", "σ").replace("İ", "i"))

    def brute(text):
        t, out = low(text or ""), set()
        for k in themes:
            out |= {(m.start(), k, "regex") for m in re.finditer(re.escape(low(k)), t)}
            for s in re.finditer(r"[^.!?]+", t):
                body = s.group().strip(" \t\n\x0b\f\r")
                at = body.find(low(k))
                if body and at >= 0:
                    out.add((s.start() + s.group().index(body) + at, k, "sentence"))
        return sorted((a, a + len(k), k, 0.7 if m == "sentence" else 0.5, m) for a, k, m in out)

    got = texts(spark, rows).orderBy("doc_id").select(TH.theme_spans(F.col("text"), themes)).collect()
    assert [sorted(tuple(s) for s in r[0]) for r in got] == [brute(t) for t in rows]


def test_theme_statistics_reads_the_documents_once(spark, sf):
    from __spark_entry__ import queries
    plan = queries()["theme_statistics"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1, plan


def test_union_of_theme_matches_stays_in_the_row_of_a_text(spark, sf):
    from __spark_entry__ import queries
    plan = queries()["union_theme_matches"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Aggregate" not in plan, plan


# --- words of the content types and concepts from one pass ------------------------------------------------

ODD_WORDS = [*EDGE, STORY, "He said he said. THEY SAID; she  said she\nsaid said", "ſaid saiḋ said́ said_ said1 1said -said-", "was like was x\rlike y", "was\nlike it was as was like\nlike was",
             "in conclusion, in  conclusion; took place according to research shows took\nplace", "İt was like İ. WAS it LIKE K", "idea of truth. Idea OF İstanbul, idea of ΑΣ. idea of idea of x of abc",
             "nature of it; nature of\ttruth essence \n of \n léa knowledge about art2 heart of gold", "'a' b 'c \"d\" \"\" e\" f", "first second-third, tall/short", "they said"]


def test_content_counts_and_concepts_are_those_of_sql(spark):
    import duckdb
    from corpusloom.registry.q_extract import DOUBLED, content_sql
    from corpusloom.registry.sqlbits import concepts as concepts_sql
    con = duckdb.connect()
    con.execute("CREATE TABLE m (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO m VALUES (?, ?)", [list(x) for x in enumerate(t or "" for t in ODD_WORDS)])
    names = ["dialogue", "description", "exposition", "narrative"]
    want = con.execute(f"WITH {DOUBLED}, c AS (SELECT doc_id, text, {content_sql()} FROM dd) SELECT {', '.join(names)}, {concepts_sql('text')} FROM c ORDER BY doc_id").fetchall()
    counts = S.content_scores(F.col("text"))
    d = texts(spark, [t or "" for t in ODD_WORDS])
    got = d.orderBy("doc_id").select(*[counts[n].alias(n) for n in names], T.concepts(F.col("text")).alias("k")).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    # the analysis of chunks finds the same
    a = AN.analyze_chunks(d.withColumn("chunk_no", F.lit(1))).orderBy("doc_id").select("n_concepts", "concepts", "content_type").collect()
    assert [(r[0], r[1]) for r in a] == [(len(r[4]), r[4]) for r in want]
    assert [r[2] for r in a] == [names[r[:4].index(max(r[:4]))] for r in want]


def test_analyze_chunks_makes_no_themes_that_nobody_asks_for(spark, sf):
    from __spark_entry__ import queries
    plan = queries()["analyze_chunks"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "cognition" not in plan and plan.count(T.WORD + "+,") == 1, plan
    every = AN.analyze_chunks(texts(spark, [STORY]).withColumn("chunk_no", F.lit(1)))
    assert set(S.with_semantics(texts(spark, [STORY])).columns) - {"readability_simple", "coherence_blend"} <= set(every.columns)
    assert "learning" in every._jdf.queryExecution().optimizedPlan().toString()


def test_export_chunks_for_ai_makes_what_it_writes(spark, sf):
    from __spark_entry__ import queries
    plan = queries()["export_chunks_for_ai"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "cognition" not in plan and "xxhash64" not in plan and plan.count(T.WORD + "+,") == 1, plan


def test_entities_of_runs_words_and_low_text_are_those_of_the_whole(spark):
    """counted in runs of capitalised words only, words cut at single signs, low text made once; all as by the patterns over the whole text."""
    odd = [*EDGE, STORY, "Ada Lovelace met Alan Turing of Acme Corp in New York City", "Ada Bob Cx9 Dee Eff", "Ada\u00a0Bob\nNew\tYork  City State. Aa Bb City Cc Country", "Xx Inc Inc Ltd",
           "\u00e9Ada Bob", "Ada Bob\u0301 Cee Dee", "_Ada Bob Cee", "Ada-Bob Cee.Dee Eff", "Mac Donald McDonald Corp Company", "A Bb Cc", "\u0130Ada Bob \u03a3Cee Dee", "Aa Bb " * 200, "City Aa Bb", "City State", "Aa Citya Bb Stat", "Aa State.City Bb Country City",
           "a\tb \x0b c\fd\re  f\n\n g ", " \n ", "\u0130\u03a3 A\u03a3 \u017fAID", "no\u2003break\u00a0here"]
    c = F.col("text")
    plain = sum((F.size(F.regexp_extract_all(c, F.lit(p), F.lit(0))) for p in T.LABEL_PATTERNS.values()), F.lit(0))
    low = F.array_join(F.transform(F.split(F.translate(c, "\u03a3\u0130", "\u03c3i"), ""), F.lower), "")
    got = texts(spark, odd).select(T.n_labeled_entities(c), plain, T.words_at_hand(c), T.words(c), T.lower_by_sign(c), low).collect()
    assert all((r[0], r[2], r[4]) == (r[1], r[3], r[5]) for r in got), [r for r in got if (r[0], r[2], r[4]) != (r[1], r[3], r[5])][:2]
    assert texts(spark, ["Aa Bb " * 20000 + "City"]).select(T.n_labeled_entities(c)).first()[0] == 20001  # a run of any length


def test_export_chunks_for_ai_reads_a_text_once_for_its_entities_and_quotes(spark, sf):
    from __spark_entry__ import queries
    plan = queries()["export_chunks_for_ai"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert '"[^"]*"' not in plan and plan.count(T.RUN_PATTERN) == 1, plan
    for part in (*FV.ORG_WORDS, "he said", "took place"):
        assert not re.search(rf"Contains\([^,]+, {part}\)", plan), part
    assert "_distinct, _distinct" not in plan  # word sets are not carried on where nobody asks for them


# --- blank and missing texts as in SQL ---------------------------------------------------------------

@pytest.fixture(scope="module")
def blank_tables(sf, tmp_path_factory):
    """The smallest tables, their documents joined by blank, missing and quoted texts."""
    import duckdb
    out = tmp_path_factory.mktemp("blank")
    rows = ["", None, " ", "\n", "", '""', '"', "\\N", "\\\\N", "\\Na", "null", "a\r\nb \"q\", c", " lead and trail ", "\\", "\r", "#c"]
    duckdb.connect().execute(f"""copy (select * from read_parquet('{sf}/documents.parquet') union all
        select 900001 + i, t, 'en', 's', length(t) from (select unnest($1::varchar[]) as t, unnest(range({len(rows)})) as i)) to '{out}/documents.parquet' (format parquet)""", [rows])
    for t in "region nation customer supplier part orders lineitem events embeddings pages benchmark labels conversations".split():
        (out / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
    return str(out)


def as_sql(spark, tables, name):
    from __spark_entry__ import oracle_sql, queries
    from check_oracles import compare, connect
    return compare(spark, connect(tables), tables, name, queries()[name], oracle_sql()[name])


@pytest.mark.parametrize("name", ["batch_quality", "quality_issues"])
def test_messages_of_blank_texts_are_those_of_sql(spark, blank_tables, name):
    got = as_sql(spark, blank_tables, name)
    assert got.startswith("ok"), got


def test_blank_texts_may_be_told_apart_and_texts_are_scored_once(spark, sf):
    from corpusloom.operators import validation as VA
    d = S.with_quality(texts(spark, ["", STORY]))
    assert VA.batch_quality(d.filter("doc_id = 0"), True).first().recommendations == "Add content to analyze"
    apart, alike = ({r.doc_id: r.i for r in d.select("doc_id", S.quality_messages(x)["issues"].alias("i")).collect()} for x in (True, False))
    assert apart[0] == ["Content is empty"] and alike[0] == ["Content too short (0 words)"] and apart[1] == alike[1]
    assert one(VA.batch_quality(d.filter("doc_id < 0")).select("recommendations")) == [None]
    from __spark_entry__ import queries
    assert queries()["batch_quality"](spark, sf)._jdf.queryExecution().optimizedPlan().toString().count("Relation ") == 1


def test_csv_keeps_empty_and_missing_texts_apart(spark, blank_tables, tmp_path):
    rows = [(1, ""), (2, None), (3, "\\N"), (4, "\\\\N"), (5, "\\N\n"), (6, "\n\\N"), (7, '""'), (8, " "), (None, "x")]
    EXP.write_csv(spark.createDataFrame(rows, "id int, text string"), str(tmp_path / "csv"))
    assert {tuple(r) for r in EXP.read_csv(spark, str(tmp_path / "csv"), "id int, text string").collect()} == set(rows)
    got = as_sql(spark, blank_tables, "export_csv")
    assert got.startswith("ok"), got


def test_gate_counts_missing_contents_as_sql_does(spark, blank_tables):
    from corpusloom.operators import validation as VA
    got = as_sql(spark, blank_tables, "export_quality_gate")
    assert got.startswith("ok"), got
    d = spark.createDataFrame([("a", 0.7), ("", 0.7), (None, 0.5)], "content string, quality_score double")
    assert VA.export_quality_gate(d).first().missing_content == 2


# --- long runs, names and phrases ----------------------------------------------------------------------

ODD = [*EDGE, STORY, "Ada Lovelace met Alan Turing of Acme Corp in New York City", "Ada Bob Cx9 Dee Eff", "Ada Bob\nNew\tYork  City State. Aa Bb City Cc Country", "Xx Inc Inc Ltd",
       "éAda Bob", "Ada Bob́ Cee Dee", "_Ada Bob Cee", "Ada-Bob Cee.Dee Eff", "City Aa Bb", "City State", "Aa Citya Bb Stat", "Aa State.City Bb Country City", "Aa Bb " * 200 + "City x",
       "a1 b_ c² İd éf good,bad Good-bad", "one two", "Ada Bob", "x Ada Bob " * 40, "word " * 31, "word " * 32, "word " * 33, "a b c Ada Bob d e f " + "w " * 100, "﷐ Ada Bob ﷑ Cee Dee City"]


def test_runs_of_any_length_are_labelled(spark):
    """a text of thousands of capitalised words took the stack of a task and with it the executor."""
    d = texts(spark, ["Aa Bb " * 4000 + "City x"])
    n = T.labeled_entities(F.col("text"))
    assert d.select(F.size(n), F.size(F.filter(n, lambda e: e["label"] == "PERSON")), F.array_max(F.transform(n, lambda e: F.length(e["text"])))).first()[:] == (4001, 4000, 24004)


def test_entities_from_runs_are_those_of_the_patterns(spark):
    c = F.col("text")

    def labelled(k, p):
        return F.transform(T.spans(c, p), lambda s: F.struct(s["text"].alias("text"), F.lit(k).alias("label"), s["start"].alias("start"), s["end"].alias("end")))

    plain = F.concat(*[labelled(k, p) for k, p in T.LABEL_PATTERNS.items()])
    for r in texts(spark, ODD).select(T.labeled_entities(c).alias("a"), plain.alias("b")).collect():
        assert (r.a and [tuple(e)[:4] for e in r.a]) == (r.b and [tuple(e) for e in r.b])


def test_phrases_and_letter_words_are_those_of_all_pairs_and_tokens(spark):
    c = F.col("text")
    tokens = F.filter(T.lower_tokens(c), lambda t: t.rlike(r"^\p{L}+$"))
    for keep in (1, 3, 15):
        for r in texts(spark, ODD).select("text", TH.phrase_scores(c, keep).alias("p"), T.alpha_tokens(F.lower(c)).alias("a"), tokens.alias("b")).collect():
            assert r.a == r.b
            if r.text is None:
                assert r.p is None
                continue
            ws = [w for w in re.split(r"[ \t\n\x0b\f\r]+", r.text) if w]
            rows = []
            for i, g in enumerate(f"{a} {b}" for a, b in zip(ws, ws[1:])):
                name = re.fullmatch("[A-Z][a-z]+ [A-Z][a-z]+", g) is not None
                rows.append((-round(0.16 + 0.2 * name + 0.2 * (1 - abs(0.5 - i / len(ws))), 9), i, g, 1.0 if name else 0.5))
            assert [(x.at, x.phrase, x.base_importance) for x in r.p] == [x[1:] for x in sorted(rows)[:keep]], r.text[:40]


# --- one file a text ---------------------------------------------------------------------------------

def test_a_file_for_a_text_starts_no_process(spark, tmp_path):
    def started():
        return int(re.search(r"processes (\d+)", open("/proc/stat").read()).group(1))

    rows = [(i, f"text {i}\nsecond é") for i in range(400)] + [(-5, "minus"), (7, "again"), (1000, ""), (1001, None), (1002, "\r\n")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(8, "doc_id")
    RD.write_text_corpus(d.limit(1), str(tmp_path / "warm"))
    before = started()
    RD.write_text_corpus(d, str(tmp_path / "a"))
    assert started() - before < 300  # the writer of Spark starts some for each file
    got = RD.corpus_texts(spark, str(tmp_path / "a")).collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == sorted((i, t + "\n" if t is not None else "") for i, t in rows)
    assert [r.n_chars for r in got if r.doc_id in (1000, 1001)].count(None) == 1
    RD.write_text_corpus(d, str(tmp_path / "a"))  # as a task that runs again
    assert RD.corpus_texts(spark, str(tmp_path / "a")).count() == len(rows)


def test_corpus_in_another_store_is_written_by_spark(spark, tmp_path, monkeypatch):
    rows = [(1, "a\nb"), (-2, ""), (3, None)]
    monkeypatch.setattr(RD, "_local", lambda *_: None)
    RD.write_text_corpus(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "b"))
    assert {tuple(r) for r in RD.corpus_texts(spark, str(tmp_path / "b")).collect()} == {(1, "a\nb\n", 4), (-2, "\n", 1), (3, None, None)}


def test_local_paths_are_told_from_other_stores(spark):
    assert [RD._local(spark, p) for p in ("/a b/c", "file:/a/b", "file:///a/b", "hdfs://h/a", "s3a://b/a", "viewfs://s/a")] == ["/a b/c", "/a/b", "/a/b", None, None, None]


def test_read_text_corpus_of_blank_texts_is_as_sql(spark, blank_tables):
    got = as_sql(spark, blank_tables, "read_text_corpus")
    assert got.startswith("ok"), got


# --- a bundle of rows made of chunks ---------------------------------------------------------------------

def test_rows_made_of_sorted_rows_are_numbered_as_themselves(spark):
    d = spark.range(3000).select(F.concat_ws("_", F.pmod(F.hash("id"), F.lit(90)), "id", F.lit("")).alias("k"), F.repeat(F.lit("x"), 50).alias("t"))
    rows = [F.struct(F.concat("k", F.lit(s)).alias("id"), F.col("t").alias("v")) for s in ("qa_1", "b", "qa_0")]
    out = ordered.in_order(d, ["k"], "n", slices=7, rows=rows)
    got = [(r.n, r.id) for r in out.orderBy("n").collect()]
    assert got == list(enumerate(sorted(f"{r.k}{s}" for r in d.collect() for s in ("qa_1", "b", "qa_0")), 1))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline") < plan.index("RepartitionByExpression")  # made after the shuffle


def test_bundle_of_chunks_is_that_of_their_records(spark, tmp_path):
    from corpusloom.operators import dataset as DS
    d = spark.createDataFrame([(f"{i % 13}_{i}", f"text {i}\nline ", f"{i % 13}_{i}_") for i in range(200)], "chunk_id string, text string, begins string")
    formats = ["qa_pairs", "classification", "few_shot_examples"]
    EXP.write_bundle(d, str(tmp_path / "a"), ["begins"], rows=DS.training_rows(formats))
    EXP.write_bundle(DS.training_records(d, formats).drop("chunk_id"), str(tmp_path / "b"), ["id"])
    for f in ("json", "csv", "markdown", "txt"):
        a, b = (sorted(one(spark.read.text(str(tmp_path / x / f)))) for x in "ab")
        assert a == b and len(a) >= 1000, f
    assert [spark.read.json(str(tmp_path / x / "manifest")).first().total_items for x in "ab"] == [1000, 1000]
    from pathlib import Path
    from corpusloom.session import shared_dir
    assert not list(Path(shared_dir(spark)).glob("bundle-rows*"))
