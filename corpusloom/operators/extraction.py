"""Extraction of questions and answers, dialogue, markers, entities and model responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom import fixed_values as FV
from corpusloom.functions import scores as S, text as T
from corpusloom.operators.cleaning import valid_qa


# --- questions and answers -----------------------------------------------------------------

def structured_qa(c: Column) -> Column:
    """array<struct<question,answer,pattern_no>> of labelled pairs, in pattern then text order."""
    def one(i, pattern):
        p = F.lit("(?ismd)" + pattern)
        pairs = F.arrays_zip(F.regexp_extract_all(c, p, F.lit(1)).alias("q"), F.regexp_extract_all(c, p, F.lit(2)).alias("a"))
        return F.transform(pairs, lambda r: F.struct(
            T.clean_fragment(r["q"]).alias("question"), T.clean_fragment(r["a"]).alias("answer"),
            F.lit(i).alias("pattern_no")))

    found = F.concat(*[one(i, p) for i, p in enumerate(FV.STRUCTURED_QA_PATTERNS)])
    return F.filter(found, lambda r: valid_qa(r["question"], r["answer"]))


def first_by_signature(rows: Column) -> Column:
    """Keep the first of the rows that share question and answer, case-blind and trimmed."""
    def sig(r):
        return F.concat_ws("\u0001", F.lower(T.trim_ws(r["question"])), F.lower(T.trim_ws(r["answer"])))

    signed = F.sort_array(F.transform(rows, lambda r, i: F.struct(sig(r).alias("sig"), i.alias("i"), r.alias("row"))))
    firsts = T.let(signed, lambda v: F.filter(v, lambda x, k: (k == 0) | (F.get(v, k - 1)["sig"] != x["sig"])))
    in_order = F.sort_array(F.transform(firsts, lambda x: F.struct(x["i"].alias("i"), x["row"].alias("row"))))
    return F.transform(in_order, lambda x: x["row"])


def extract_structured_qa(df: DataFrame, col: str = "text") -> DataFrame:
    keep = [c for c in df.columns if c != col]
    return df.select(*keep, F.posexplode(first_by_signature(structured_qa(F.col(col)))).alias("_i", "_r")).select(
        *keep, F.col("_i").alias("example_no"), "_r.question", "_r.answer", F.lit("structured_qa").alias("type"),
        F.lit(0.9).alias("confidence"))


#: What a text must hold for a segment pattern to be tried, in the order of the patterns: one of these, lower-cased.
SEGMENT_GUARDS = [
    ("\na:", "\na-"), ("\nanswer:", "\nanswer-"), ("\na",), ("\nguest", "\ninterviewee"), ("\nguest",), (":", "-"),
    ("\nteacher", "\nmaster", "\nguru"), ("\nteacher", "\nmaster", "\nsage"), ("?",), ("?",),
]


#: Of patterns that begin with anything, what must stand somewhere: without it they would look on from every sign of the text.
SEGMENT_NEEDS = {8: r"\?\s*\n\n", 9: r"\?\s*\n"}


def qa_segments(c: Column, patterns=None, guards=None, shortest: int = FV.MIN_SEGMENT, longest: int | None = None) -> Column:
    """array<struct<question,answer,start,end,pattern_no>> of question-answer spans, by start.

    Patterns are tried in their order; a span that overlaps one taken before is skipped.  Spans, questions and answers of a pattern come from
    one pass of it.

    Matches of one pattern never overlap, so those taken and those found stand in one order of their starts, and two passes, one from each
    side, tell which of the found ones are free: the time is that of sorting.
    """
    source = list(patterns or FV.QA_SEGMENT_PATTERNS)
    guards = guards or (SEGMENT_GUARDS if patterns is None else [("",)] * len(source))

    def one(i, low):
        pattern, q, a = source[i]
        p = "(?isd)" + pattern
        found = F.transform(T.spans(c, p, (q, a)), lambda m: F.struct(
            T.trim_ws(F.get(m["groups"], F.lit(0))).alias("question"), T.trim_ws(F.get(m["groups"], F.lit(1))).alias("answer"),
            m["start"].alias("start"), m["end"].alias("end"), F.lit(i).alias("pattern_no")))
        may = T.contains_any(low, guards[i])
        if patterns is None and i in SEGMENT_NEEDS:
            may = may & c.rlike(SEGMENT_NEEDS[i])
        return F.when(may, found).otherwise(F.array().cast(f"array<{_SEGMENT}>"))

    def joined(taken, found):
        mark = lambda rows, new: F.transform(rows, lambda m: F.struct(m["start"].alias("at"), F.lit(new).alias("new"), m.alias("m")))
        kind = f"struct<at:int,new:boolean,m:{_SEGMENT}>"
        both = F.sort_array(F.concat(mark(taken, False), mark(found, True)))
        told = lambda state, gone, row: F.struct(state.alias("state"), F.when(~gone, row).alias("row"))
        onward = T.scan(both, F.lit(0), lambda end, x: told(F.when(x["new"], end).otherwise(x["m"]["end"]), x["new"] & (x["at"] < end), x), kind)
        back = T.scan(F.reverse(onward), F.lit(2**31 - 1), lambda start, x: told(
            F.when(x["new"], start).otherwise(x["at"]), x["new"] & (x["m"]["end"] > start), x["m"]), _SEGMENT)
        return F.reverse(back)

    def every(low):
        found = F.array(*[one(i, low) for i in range(len(source))])
        return F.aggregate(found, F.array().cast(f"array<{_SEGMENT}>"), lambda taken, f: F.when(F.size(f) == 0, taken).when(F.size(taken) == 0, f).otherwise(joined(taken, f)))

    def sized(x):
        n = F.length(x)
        return n >= shortest if longest is None else n.between(shortest, longest)

    return F.filter(T.let(F.lower(c), every), lambda m: sized(m["question"]) & sized(m["answer"]))


_SEGMENT = "struct<question:string,answer:string,start:int,end:int,pattern_no:int>"


def with_qa_segments(df: DataFrame, col: str = "text", patterns=None) -> DataFrame:
    return T.settle(df.withColumn("qa_segments", qa_segments(F.coalesce(F.col(col), F.lit("")), patterns)), "qa_segments")


def extract_qa_segments(df: DataFrame, col: str = "text", patterns=None) -> DataFrame:
    keep = [c for c in df.columns if c != col]
    rows = with_qa_segments(df, col, patterns).select(*keep, F.inline("qa_segments"))
    return (rows.withColumn("content_type", F.lit("qa")).withColumn("confidence", F.lit(0.8))
            .withColumn("quality_score", S.qa_quality(F.col("question"), F.col("answer"))))


def exact_paragraphs(c: Column) -> Column:
    """Trimmed paragraphs with exact offsets: array<struct<start,end,text>>."""
    gaps = T.spans(c, r"\n\s*\n")
    starts = F.concat(F.array(F.lit(0)), F.transform(gaps, lambda g: g["end"]))
    ends = F.concat(F.transform(gaps, lambda g: g["start"]), F.array(F.length(c)))

    def trimmed(s, e):
        raw = F.substr(c, s + 1, e - s)
        text = T.trim_ws(raw)
        at = s + F.length(raw) - F.length(F.regexp_replace(raw, r"^\s+", ""))
        return F.struct(at.alias("start"), (at + F.length(text)).alias("end"), text.alias("text"))

    return F.zip_with(starts, ends, trimmed)


def _pack_sentences(c: Column) -> Column:
    """Sentence pieces of a long paragraph, each up to the segment limit with its joining blank."""
    sents = F.split(c, r"(?<=[.!?])\s+")
    zero = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def push(acc):
        return F.when(F.length(T.trim_ws(acc["cur"])) >= FV.MIN_SEGMENT, F.array_append(
            acc["out"], T.trim_ws(acc["cur"]))).otherwise(acc["out"])

    def step(acc, s):
        fits = F.length(acc["cur"]) + F.length(s) <= FV.MAX_SEGMENT
        return F.when(fits, F.struct(F.concat(acc["cur"], s, F.lit(" ")).alias("cur"), acc["out"].alias("out"))).otherwise(
            F.struct(F.concat(s, F.lit(" ")).alias("cur"), push(acc).alias("out")))

    return F.aggregate(sents, zero, step, push)


def _free_paragraphs(c: Column, spans: Column) -> Column:
    """Long enough paragraphs that touch none of the spans.  The anti join is between two arrays of one row, so it needs no shuffle."""
    return F.filter(exact_paragraphs(c), lambda p: (F.length(p["text"]) >= FV.MIN_SEGMENT) & ~F.exists(
        spans, lambda s: (p["start"] < s["end"]) & (s["start"] < p["end"])))


def monologue_segments(c: Column, spans: Column) -> Column:
    """array<struct<start,content_type,confidence,question,answer>> of the paragraphs that touch no span; long ones in pieces."""
    def row(p, kind, confidence, text):
        return F.struct(p["start"].alias("start"), F.lit(kind).alias("content_type"), F.lit(confidence).alias("confidence"), text.alias("question"), F.lit("").alias("answer"))

    return F.flatten(F.transform(_free_paragraphs(c, spans), lambda p: F.when(
        F.length(p["text"]) > FV.MAX_SEGMENT, F.transform(_pack_sentences(p["text"]), lambda x: row(p, "passage", 0.5, x)))
        .otherwise(F.array(row(p, "monologue", 0.6, p["text"])))))


def extract_monologue_segments(df: DataFrame, col: str = "text") -> DataFrame:
    """Paragraphs that touch no question-answer span.  Needs column ``qa_segments``."""
    keep = [c for c in df.columns if c not in (col, "qa_segments")]
    rows = df.select(*keep, F.inline(monologue_segments(F.col(col), F.col("qa_segments"))))
    return rows.select(*keep, "start", "content_type", "confidence", "question", "answer", S.monologue_quality(F.col("question")).alias("quality_score"))


def union_segments(df: DataFrame, col: str = "text") -> DataFrame:
    """Question-answer and monologue segments in one schema, from one row of both: texts are read, and the patterns run, once."""
    keep = [c for c in df.columns if c != col]
    qa = F.transform("qa_segments", lambda s: F.struct(
        s["start"].alias("start"), F.lit("qa").alias("content_type"), F.lit(0.8).alias("confidence"), s["question"].alias("question"), s["answer"].alias("answer")))
    rows = with_qa_segments(df, col).select(*keep, F.inline(F.concat(qa, F.coalesce(monologue_segments(F.col(col), F.col("qa_segments")), F.array().cast("array<struct<start:int,content_type:string,confidence:double,question:string,answer:string>>")))))
    q, a = F.col("question"), F.col("answer")
    return rows.withColumn("quality_score", F.when(F.col("content_type") == "qa", S.qa_quality(q, a)).otherwise(S.monologue_quality(q)))


def detect_content_type(df: DataFrame, col: str = "text") -> DataFrame:
    """Share of question-answer text, the type it implies and a confidence."""
    keep = [c for c in df.columns if c != col]
    d = with_qa_segments(df, col)
    c = F.coalesce(F.col(col), F.lit(""))
    covered = F.aggregate("qa_segments", F.lit(0), lambda a, s: a + s["end"] - s["start"])
    d = d.select(*keep, F.length(T.trim_ws(c)).alias("_n"), F.size("qa_segments").alias("qa_segments"),
                 T.ratio(covered, F.length(c)).alias("qa_ratio"))
    small, talk = F.col("_n") < FV.MIN_SEGMENT, F.col("qa_ratio") >= FV.QA_RATIO_AT
    return d.select(
        *keep, F.when(small, F.lit(0)).otherwise(F.col("qa_segments")).alias("qa_segments"),
        F.when(small, F.lit("insufficient")).when(talk, F.lit("dialogue")).otherwise(F.lit("monologue")).alias("primary_type"),
        F.when(small, F.lit(0.0)).otherwise(F.col("qa_ratio")).alias("qa_ratio"),
        F.when(small, F.lit(0.0)).when(talk, F.least(F.col("qa_ratio") * 2, F.lit(1.0))).otherwise(
            F.least((1 - F.col("qa_ratio")) * 2, F.lit(1.0))).alias("confidence"))


# fixed values: advice by content type
DIALOGUE_ADVICE = [
    "✅ Use Q&A enhancement mode for best results", "🎯 Focus on dialogue-specific spiritual tones",
    "📊 Expect high-quality training data output",
]
MONOLOGUE_ADVICE = [
    "📝 Content will be processed as standalone passages", "🔄 Consider generating synthetic Q&A from passages",
    "⚠️ Quality scores may be lower (0.3 base)", "🎨 Use narrative-focused enhancement tones",
]
MIXED_ADVICE = "🔀 Mixed content detected - hybrid processing will be used"
FEW_ADVICE = "📈 Consider uploading additional content for better training data"


def content_recommendations() -> Column:
    """Advice for columns primary_type, qa_ratio and total_segments."""
    none = F.array().cast("array<string>")
    kind, share = F.col("primary_type"), F.col("qa_ratio")
    return F.concat(
        F.when(kind == "dialogue", T.lit_array(DIALOGUE_ADVICE)).when(kind == "monologue", T.lit_array(MONOLOGUE_ADVICE)).otherwise(none),
        F.when((share > 0) & (share < FV.QA_RATIO_AT), F.array(F.lit(MIXED_ADVICE))).otherwise(none),
        F.when(F.col("total_segments") < 10, F.array(F.lit(FEW_ADVICE))).otherwise(none))


def monologue_records(df: DataFrame, col: str = "text") -> DataFrame:
    """Paragraphs of each document as answers to a question chosen by topic."""
    return (df.select("doc_id", F.posexplode(T.meaningful_paragraphs(F.col(col))).alias("paragraph_index", "answer"))
            .withColumn("question", S.contextual_question(F.col("answer")))
            .withColumn("type", F.lit("monologue")).withColumn("confidence", F.lit(0.3)))


def speaker_pairs(c: Column) -> Column:
    """Question line followed by an answer line of labelled speakers; a new question drops an unanswered one."""
    def role(name):
        low = F.lower(name)
        return (F.when(T.contains_any(low, FV.QUESTION_SPEAKERS), F.lit("q"))
                .when(T.contains_any(low, FV.ANSWER_SPEAKERS), F.lit("a")))

    speaker = r"^([A-Z][^:]*?):\s*(.+)$"
    said = F.transform(T.lines(c), lambda l: F.struct(
        T.trim_ws(F.regexp_extract(T.trim_ws(l), speaker, 1)).alias("who"),
        T.trim_ws(F.regexp_extract(T.trim_ws(l), speaker, 2)).alias("what")))
    said = F.filter(F.transform(said, lambda s: F.struct(role(s["who"]).alias("role"), s["who"].alias("who"), s["what"].alias("what"))),
                    lambda s: s["role"].isNotNull())
    follow = T.neighbours(said, lambda a, b: F.struct(
        a["role"].alias("r1"), b["role"].alias("r2"), a["what"].alias("question"), b["what"].alias("answer"),
        a["who"].alias("questioner"), b["who"].alias("answerer")))
    return F.filter(follow, lambda p: (p["r1"] == "q") & (p["r2"] == "a") & valid_qa(p["question"], p["answer"]))


def smart_detect_cascade(df: DataFrame, col: str = "text") -> DataFrame:
    """Labelled pairs if a text has any, else speaker pairs, else paragraphs; with method and quality.

    The choice is made per row before exploding, so nothing is shuffled or computed for later branches.
    """
    keep = [c for c in df.columns if c != col]
    c = T.normalize_text(F.col(col))
    d = df.select(*keep, c.alias("_t"))
    d = d.withColumn("_qa", first_by_signature(structured_qa(F.col("_t")))).withColumn("_talk", speaker_pairs(F.col("_t")))

    def rows(kind, array, q, a):
        return F.transform(array, lambda r: F.struct(F.lit(kind).alias("type"), q(r).alias("question"), a(r).alias("answer")))

    paras = T.meaningful_paragraphs(F.col("_t"))
    chosen = (F.when(F.size("_qa") > 0, rows("structured_qa", F.col("_qa"), lambda r: r["question"], lambda r: r["answer"]))
              .when(F.size("_talk") > 0, rows("dialogue", F.col("_talk"), lambda r: r["question"], lambda r: r["answer"]))
              .otherwise(rows("monologue", paras, S.contextual_question, lambda r: r)))
    return (d.select(*keep, F.posexplode(chosen).alias("example_no", "_r")).select(*keep, "example_no", "_r.*")
            .withColumn("extraction_method", F.lit("pattern_cascade"))
            .withColumn("quality_score", S.example_quality(F.col("type"), F.col("question"), F.col("answer"))))


def pair_dialogue_turns(pairs: DataFrame) -> DataFrame:
    """Valid user/assistant pairs as dialogue examples."""
    p = pairs.select("pair_id", F.col("original").alias("question"), F.col("enhanced").alias("answer"))
    return p.filter(valid_qa(F.col("question"), F.col("answer"))).select(
        "*", F.lit("dialogue").alias("type"), F.lit("user").alias("questioner"), F.lit("assistant").alias("answerer"),
        F.lit(0.8).alias("confidence"))


def qa_line_pairs(c: Column) -> Column:
    """Line state machine: question and answer prefixes, other lines continue the answer."""
    def starts(l, prefixes):
        out = F.lit(False)
        for p in prefixes:
            out = out | l.startswith(p)
        return out

    def after_colon(l):
        return T.trim_ws(F.regexp_replace(l, r"^[^:]*:", ""))

    pair = "array<struct<question:string,answer:string>>"
    zero = F.struct(F.lit("").alias("q"), F.lit("").alias("a"), F.array().cast(pair).alias("out"))

    def push(acc):
        return F.when((acc["q"] != "") & (acc["a"] != ""), F.array_append(
            acc["out"], F.struct(acc["q"].alias("question"), acc["a"].alias("answer")))).otherwise(acc["out"])

    def step(acc, l):
        more = F.when(acc["a"] == "", l).otherwise(F.concat(acc["a"], F.lit(" "), l))
        return (
            F.when(starts(l, ["Q:", "Question:", "**Q:", "Q."]), F.struct(
                after_colon(l).alias("q"), F.lit("").alias("a"), push(acc).alias("out")))
            .when(starts(l, ["A:", "Answer:", "**A:", "A."]), F.struct(
                acc["q"].alias("q"), after_colon(l).alias("a"), acc["out"].alias("out")))
            .when((acc["q"] != "") & (l != "") & ~starts(l, ["Q", "A", "**"]), F.struct(
                acc["q"].alias("q"), more.alias("a"), acc["out"].alias("out")))
            .otherwise(acc))

    return F.aggregate(F.transform(T.lines(c), T.trim_ws), zero, step, push)


def parse_qa_lines(df: DataFrame, col: str = "text") -> DataFrame:
    keep = [c for c in df.columns if c != col]
    return df.select(*keep, F.posexplode(qa_line_pairs(F.col(col))).alias("dialogue_no", "_p")).select(
        *keep, "dialogue_no", "_p.question", "_p.answer", F.lit(0.7).alias("confidence"))


# --- dialogue signs, markers ----------------------------------------------------------------

def speaker_tags(c: Column) -> Column:
    heads = F.transform(F.filter(T.lines(c), lambda l: F.contains(l, F.lit(":"))), lambda l: F.regexp_extract(l, r"^([^:]*):", 1))
    return F.transform(F.filter(heads, lambda h: (T.n_words(h) <= 3) & T.trim_ws(h).rlike(r"^\p{Lu}")), T.trim_ws)


def dialogue_indicators(df: DataFrame, col: str = "text") -> DataFrame:
    c = F.col(col)
    return df.select("doc_id", F.regexp_count(c, F.lit("[\"']")).alias("quotation_marks"),
                     F.array_join(speaker_tags(c), "|").alias("speaker_tags"),
                     T.count_words_in(c, FV.DIALOGUE_VERBS).alias("dialogue_verbs"))


def dialogue_sections(df: DataFrame, col: str = "text") -> DataFrame:
    from corpusloom.operators.chunking import SPEECH
    return df.select("doc_id", F.inline(T.spans(F.col(col), SPEECH)))


def flow_markers(df: DataFrame, lexicon: dict | None = None, col: str = "text") -> DataFrame:
    """Count and positions of flow words per kind, from one pass of the pattern of each kind."""
    rows = [F.struct(F.lit(kind).alias("flow_type"), F.transform(T.word_spans(F.col(col), ws), lambda s: s["start"]).alias("positions"))
            for kind, ws in (lexicon or FV.FLOW_WORDS).items()]
    return (df.select("doc_id", F.inline(F.array(*rows))).filter(F.size("positions") > 0)
            .withColumn("n_matches", F.size("positions")))


def context_markers(df: DataFrame, lexicon: dict | None = None, col: str = "text") -> DataFrame:
    low = F.lower(F.col(col))
    return df.select("doc_id", *[F.array_join(T.terms_found(low, ws), "|").alias(kind) for kind, ws in (lexicon or FV.CONTEXT_WORDS).items()],
                     F.array_join(F.array_sort(F.array_intersect(T.lower_tokens(F.col(col)), T.lit_array(FV.DISCOURSE_WORDS))), "|").alias("discourse"))


def sentence_type_counts(c: Column) -> dict[str, Column]:
    s = T.marked_sentences(c)
    q, x = F.size(F.filter(s, lambda v: v.endswith("?"))), F.size(F.filter(s, lambda v: v.endswith("!")))
    return {"interrogative": q, "exclamatory": x, "declarative": F.size(s) - q - x}


def sentence_types(df: DataFrame, col: str = "text") -> DataFrame:
    return df.select("doc_id", *[v.alias(k) for k, v in sentence_type_counts(F.col(col)).items()])


# --- model responses ------------------------------------------------------------------------

RESPONSE_FIELDS = {  # fixed values: response field names per record format
    "qa_pairs": ("question", "answer"), "classification": ("text", "label"),
    "instruction_following": ("instruction", "output"), "dialogue_data": ("user_message", "assistant_response"),
    "summarization_data": ("source_text", "summary"),
}


def _payload() -> Column:
    return F.regexp_extract("response", r"(?s)(\[.*\])", 1)


def _items() -> Column:
    return F.from_json(_payload(), "array<map<string,string>>")


def _field(which: int, item: Column | None = None) -> Column:
    m = F.col("_m") if item is None else item
    out = m[("input", "output")[which]]
    for fmt, names in RESPONSE_FIELDS.items():
        out = F.when(F.col("format_type") == fmt, m[names[which]]).otherwise(out)
    return F.coalesce(out, F.lit(""))


def parse_model_responses(df: DataFrame) -> DataFrame:
    """Records from the JSON array inside each response (chunk_id, format_type, response)."""
    rows = df.select("chunk_id", "format_type", F.posexplode(_items()).alias("_i", "_m"))
    return rows.select(
        "chunk_id", F.concat_ws("_", "chunk_id", "format_type", F.col("_i").cast("string")).alias("id"), "format_type",
        _field(0).alias("input_text"), _field(1).alias("output_text"), F.to_json("_m").alias("metadata"), F.lit(0.9).alias("quality_score"))


def rescue_unparsed(df: DataFrame) -> DataFrame:
    """Responses with a bracketed part that is no JSON: their non-blank lines."""
    broken = df.filter((_payload() != "") & _items().isNull())
    lines_ = F.filter(F.transform(T.lines(F.col("response")), lambda l, i: F.struct(
        i.alias("i"), T.trim_ws(l).alias("l"))), lambda r: r["l"] != "")
    return broken.select("chunk_id", "format_type", F.inline(lines_)).select(
        "chunk_id", F.concat(F.concat_ws("_", "chunk_id", "format_type"), F.lit("_simple_"), F.col("i").cast("string")).alias("id"),
        "format_type", F.col("l").alias("input_text"), F.lit("Generated from content").alias("output_text"),
        F.to_json(F.create_map(F.lit("source_line"), "l")).alias("metadata"), F.lit(0.5).alias("quality_score"))


def parsed_or_rescued(df: DataFrame) -> DataFrame:
    """The rows of :func:`parse_model_responses` and :func:`rescue_unparsed` without their metadata, from one reading of each response."""
    d = T.settle(df.select("chunk_id", "format_type", "response").withColumn("_p", _payload()), "_p")
    d = T.settle(d.withColumn("_v", F.from_json("_p", "array<map<string,string>>")), "_v")

    def row(tail, given, told, score):
        return F.struct(F.concat(F.concat_ws("_", "chunk_id", "format_type"), tail).alias("id"), given.alias("input_text"), told.alias("output_text"), F.lit(score).alias("quality_score"))

    items = F.transform("_v", lambda m, i: row(F.concat(F.lit("_"), i.cast("string")), _field(0, m), _field(1, m), 0.9))
    lines_ = F.filter(F.transform(T.lines(F.col("response")), lambda l, i: row(
        F.concat(F.lit("_simple_"), i.cast("string")), T.trim_ws(l), F.lit("Generated from content"), 0.5)), lambda r: r["input_text"] != "")
    return d.select("chunk_id", "format_type", F.inline(F.when(F.col("_v").isNotNull(), items).when(F.col("_p") != "", lines_))).select(
        "chunk_id", "id", "format_type", "input_text", "output_text", "quality_score")
