"""Segmentation and chunking: one row per document in, rows per piece out.

A greedy chunker depends on what it has packed so far, so it is a fold over the
array of one document.  The fold runs inside the row: no shuffle, and a document
is the unit of memory.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom import fixed_values as FV
from corpusloom.functions import scores as S, text as T


@dataclass(frozen=True)
class ChunkingStrategy:
    """Sizes in words; ``context_window`` words count as four characters each."""
    target_size: int = 500
    min_size: int = 100
    max_size: int = 1000
    token_budget: int = 1000
    prompt_tokens: int = 200
    context_window: int = 100
    preserve_paragraphs: bool = True
    respect_sections: bool = True


_PIECES = "array<struct<text:string,n:int>>"


def greedy_pack(items: Column, budget: int, sep: str = " ") -> Column:
    """Pack items in order; a new piece starts when current + next would exceed ``budget``.

    The joining separator is not counted for the item being added.  The length of the current piece is carried along, so it is not counted again for each item.
    """
    zero = F.struct(F.lit("").alias("cur"), F.lit(0).alias("len"), F.lit(0).alias("n"), F.array().cast(_PIECES).alias("out"))

    def step(acc, s):
        size, empty = F.length(s), acc["cur"] == ""
        done = F.array_append(acc["out"], F.struct(acc["cur"].alias("text"), acc["n"].alias("n")))
        return F.when(~empty & (acc["len"] + size > budget), F.struct(s.alias("cur"), size.alias("len"), F.lit(1).alias("n"), done.alias("out"))).otherwise(F.struct(
            F.when(empty, s).otherwise(F.concat(acc["cur"], F.lit(sep), s)).alias("cur"), F.when(empty, size).otherwise(acc["len"] + len(sep) + size).alias("len"),
            (acc["n"] + 1).alias("n"), acc["out"].alias("out")))

    def finish(acc):
        return F.when(acc["cur"] == "", acc["out"]).otherwise(
            F.array_append(acc["out"], F.struct(acc["cur"].alias("text"), acc["n"].alias("n"))))

    return F.aggregate(items, zero, step, finish)


def pack_words(word_array: Column, budget: int) -> Column:
    """Pack words by joined length; a first word longer than the budget stands alone."""
    zero = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def step(acc, w):
        joined = F.length(acc["cur"]) + 1 + F.length(w)
        empty = acc["cur"] == ""
        return (
            F.when(empty & (F.length(w) > budget), F.struct(
                F.lit("").alias("cur"), F.array_append(acc["out"], w).alias("out")))
            .when(empty, F.struct(w.alias("cur"), acc["out"].alias("out")))
            .when(joined > budget, F.struct(w.alias("cur"), F.array_append(acc["out"], acc["cur"]).alias("out")))
            .otherwise(F.struct(F.concat(acc["cur"], F.lit(" "), w).alias("cur"), acc["out"].alias("out"))))

    return F.aggregate(word_array, zero, step, lambda acc: F.when(acc["cur"] == "", acc["out"]).otherwise(
        F.array_append(acc["out"], acc["cur"])))


def _last_sentence_end(c: Column) -> Column:
    """Length of the text up to and including the white space after the last sentence end."""
    return F.length(F.regexp_extract(c, r"(?s)^(.*[.!?]+\s+)", 1))


def fixed_word_cuts(c: Column, target: int) -> Column:
    """Cut positions in a text: about ``target`` words each, backed off to the last sentence end."""
    zero = F.struct(F.lit("").alias("cur"), F.lit(0).alias("n"), F.lit(0).alias("at"),
                    F.array().cast("array<int>").alias("cuts"))

    def step(acc, w):
        cur = F.when(acc["cur"] == "", w).otherwise(F.concat(acc["cur"], F.lit(" "), w))
        back = _last_sentence_end(cur)
        rest = T.trim_ws(F.substr(cur, back + 1))
        cut_soft = F.struct(
            rest.alias("cur"), T.n_words(rest).alias("n"), (acc["at"] + back).alias("at"),
            F.array_append(acc["cuts"], acc["at"] + back).alias("cuts"))
        # the blank after a hard cut counts too, or every later cut would land inside a word
        cut_hard = F.struct(
            F.lit("").alias("cur"), F.lit(0).alias("n"), (acc["at"] + F.length(cur) + 1).alias("at"),
            F.array_append(acc["cuts"], acc["at"] + F.length(cur)).alias("cuts"))
        grow = F.struct(cur.alias("cur"), (acc["n"] + 1).alias("n"), acc["at"].alias("at"), acc["cuts"].alias("cuts"))
        return F.when(acc["n"] + 1 < target, grow).when(back > 0, cut_soft).otherwise(cut_hard)

    return F.aggregate(T.words(c), zero, step, lambda acc: acc["cuts"])


# --- rows of pieces -------------------------------------------------------------------

def _explode_pieces(df: DataFrame, pieces: Column, keep: list[str]) -> DataFrame:
    return (df.select(*keep, F.posexplode(pieces).alias("_pos", "_p"))
            .select(*keep, (F.col("_pos") + 1).alias("chunk_no"), F.col("_p.text").alias("text"),
                    F.col("_p.n").alias("sentence_count")))


def chunk_by_sentences(df: DataFrame, budget: int = 1000, keep=("doc_id",), col: str = "text") -> DataFrame:
    return _explode_pieces(df, greedy_pack(T.marked_sentences(F.col(col)), budget), list(keep))


def chunk_by_paragraphs(df: DataFrame, budget: int = 1000, keep=("doc_id",), col: str = "text") -> DataFrame:
    pieces = _explode_pieces(df, greedy_pack(F.split(F.col(col), "\n\n"), budget, "\n\n"), list(keep))
    return (pieces.withColumn("text", T.trim_ws(F.col("text"))).withColumn("word_count", T.n_words(F.col("text")))
            .withColumn("sentence_count", F.regexp_count("text", F.lit("[.!?]"))))


def chunk_by_words(df: DataFrame, budget: int = 1000, keep=("doc_id",), col: str = "text") -> DataFrame:
    return (df.select(*keep, F.posexplode(pack_words(T.words(F.col(col)), budget)).alias("_pos", "text"))
            .select(*keep, (F.col("_pos") + 1).alias("chunk_no"), "text")
            .withColumn("sentence_count", F.regexp_count("text", F.lit("[.!?]"))))


def chunk_fixed_words(df: DataFrame, target: int = 500, keep=("doc_id",), col: str = "text") -> DataFrame:
    """Pieces of the space-joined words of a text between the fixed-size cuts."""
    flat = df.withColumn("_flat", F.array_join(T.words(F.col(col)), " "))
    cuts = flat.withColumn("_cuts", fixed_word_cuts(F.col("_flat"), target))
    starts = F.concat(F.array(F.lit(0)), F.col("_cuts"))
    ends = F.concat(F.col("_cuts"), F.array(F.length("_flat")))
    return (cuts.select(*keep, "_flat", F.posexplode(F.arrays_zip(starts.alias("s"), ends.alias("e"))).alias("_pos", "_c"))
            .select(*keep, (F.col("_pos") + 1).alias("chunk_no"),
                    T.trim_ws(F.substr("_flat", F.col("_c.s") + 1, F.col("_c.e") - F.col("_c.s"))).alias("text"))
            .filter("text <> ''").withColumn("word_count", T.n_words(F.col("text"))))


def split_sentences(df: DataFrame, col: str = "text") -> DataFrame:
    return (df.select("doc_id", F.posexplode(T.sentences(F.col(col))).alias("_pos", "sentence"))
            .select("doc_id", (F.col("_pos") + 1).alias("sent_no"), "sentence"))


def paragraph_spans(c: Column) -> Column:
    """Non-blank paragraphs as array<struct<start,text>>; separators count as two characters."""
    return F.filter(T.offsets(F.split(c, r"\n\s*\n"), 2), lambda p: T.trim_ws(p["text"]) != "")


def split_paragraphs(df: DataFrame, col: str = "text") -> DataFrame:
    return df.select("doc_id", F.posexplode(paragraph_spans(F.col(col))).alias("_pos", "_p")).select(
        "doc_id", (F.col("_pos") + 1).alias("para_no"), T.trim_ws(F.col("_p.text")).alias("paragraph"),
        F.col("_p.start").alias("start_pos"), (F.col("_p.start") + F.length("_p.text")).alias("end_pos"),
        T.n_words(F.col("_p.text")).alias("word_count"))


HEADING = r"^(?:(?:Chapter|Part|Section)\s+\d+|[A-Z][A-Z\s]{10,}$|\d+\.\s+[A-Z]|#{1,6}\s+)"


def headings(c: Column) -> Column:
    """array<struct<line_number,title,position>> of heading lines."""
    def numbered(l, i):
        left = F.length(l["text"]) - F.length(F.regexp_replace(l["text"], r"^\s+", ""))
        return F.struct(i.alias("line_number"), T.trim_ws(l["text"]).alias("title"), (l["start"] + left).alias("position"))

    return F.filter(F.transform(T.offsets(T.lines(c), 1), numbered), lambda l: l["title"].rlike(HEADING))


def section_headings(df: DataFrame, col: str = "text") -> DataFrame:
    return df.select("doc_id", F.inline(headings(F.col(col))))


def paragraph_breaks(df: DataFrame, col: str = "text") -> DataFrame:
    """Offsets of blank or bullet lines after the first line."""
    marks = F.filter(T.offsets(T.lines(F.col(col)), 1), lambda l: (l["start"] > 0)
                     & T.trim_ws(l["text"]).rlike(r"^(?:$|•|-|1\.|2\.)"))
    return df.select("doc_id", F.explode(marks).alias("_l")).select("doc_id", F.col("_l.start").alias("position"))


def list_kind(line: Column) -> Column:
    return (F.when(line.rlike(r"^[•\-*]"), F.lit("bullet")).when(line.rlike(r"^\d+\."), F.lit("numbered"))
            .when(F.contains(line, F.lit(":")) & ~line.endswith("?"), F.lit("definition")))


def list_structures(df: DataFrame, col: str = "text") -> DataFrame:
    return (df.select("doc_id", F.posexplode(T.lines(F.col(col))).alias("line_no", "_l"))
            .select("doc_id", "line_no", T.trim_ws(F.col("_l")).alias("item"))
            .withColumn("kind", list_kind(F.col("item"))).filter("kind is not null"))


def line_length_mix(df: DataFrame, col: str = "text") -> DataFrame:
    n = F.transform(T.lines(F.col(col)), T.n_words)
    out = df.select("doc_id", n.alias("_n")).select(
        "doc_id", F.size("_n").alias("total_lines"),
        F.size(F.filter("_n", lambda k: k < 5)).alias("short_lines"),
        F.size(F.filter("_n", lambda k: (k >= 5) & (k <= 15))).alias("medium_lines"),
        F.size(F.filter("_n", lambda k: k > 15)).alias("long_lines"))
    for kind in ("short", "medium", "long"):
        out = out.withColumn(f"{kind}_pct", T.ratio(F.col(f"{kind}_lines") * 100, F.col("total_lines")))
    return out


# --- boundaries -----------------------------------------------------------------------

def semantic_cuts(c: Column, min_size: int, terms=None) -> Column:
    """0, each sentence end at least ``min_size`` characters on whose sentence has a boundary word, and the length."""
    pieces = F.regexp_extract_all(c, F.lit(r"[^.!?]*[.!?]+|[^.!?]+$"), F.lit(0))

    def cuts(v):
        # one look at each sentence tells whether it has a boundary word; only the ends of those that do are walked
        marked = F.transform(v, lambda p: T.let(F.lower(p), lambda low: T.contains_any(low, terms or FV.SEMANTIC_BOUNDARY_WORDS)))
        ends = F.zip_with(T.starts_of(F.transform(v, F.length)), v, lambda at, p: at + F.length(p))
        held = F.filter(F.zip_with(ends, marked, lambda e, m: F.when(m, e)), lambda e: e.isNotNull())
        far = T.scan(held, F.lit(0), lambda last, e: F.when(e - last >= min_size, F.struct(e.alias("state"), e.alias("row"))).otherwise(
            F.struct(last.alias("state"), F.lit(None).cast("int").alias("row"))), "int")
        return F.concat(F.array(F.lit(0)), far)

    return T.let(T.let(pieces, cuts), lambda k: F.when(F.element_at(k, -1) < F.length(c), F.array_append(k, F.length(c))).otherwise(k))


def semantic_boundaries(df: DataFrame, min_size: int = 200, terms=None, col: str = "text") -> DataFrame:
    return df.select("doc_id", F.posexplode(semantic_cuts(F.col(col), min_size, terms)).alias("boundary_no", "position"))


SPEECH = r'(?i)"[^"]*"[^"]*(?:said|asked|replied|answered)'


def candidate_cuts(c: Column, strategy: ChunkingStrategy = ChunkingStrategy()) -> Column:
    """Sorted distinct positions: text ends, paragraphs, headings, flow words, speech, semantic cuts."""
    flow = [w for kind in ("contrast", "conclusion", "temporal") for w in FV.FLOW_WORDS[kind]]
    speech = F.when(F.contains(c, F.lit('"')), T.spans(c, SPEECH)).otherwise(T.no_spans())
    parts = [F.array(F.lit(0), F.length(c)), semantic_cuts(c, strategy.min_size * 4),
             F.transform(T.word_spans(c, flow), lambda s: s["start"]),
             F.transform(speech, lambda s: s["start"]), F.transform(speech, lambda s: s["end"])]
    if strategy.preserve_paragraphs:
        parts.append(F.transform(paragraph_spans(c), lambda p: p["start"]))
    if strategy.respect_sections:
        parts.append(F.transform(headings(c), lambda h: h["position"]))
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def candidate_boundaries(df: DataFrame, strategy: ChunkingStrategy = ChunkingStrategy(), col: str = "text") -> DataFrame:
    return df.select("doc_id", F.explode(candidate_cuts(F.col(col), strategy)).alias("position"))


def chosen_cuts(c: Column, cuts: Column, strategy: ChunkingStrategy = ChunkingStrategy()) -> Column:
    """Boundaries that give pieces of ``min_size`` to ``max_size`` words; longer stretches are cut by word count.

    Words are counted once per gap between candidates and added up; a word that runs
    across a candidate is counted in both gaps and taken off once.
    """
    def gap(a, b):
        return F.struct(b.alias("b"), T.n_words(F.substr(c, a + 1, b - a)).alias("n"),
                        F.when((a > 0) & F.substr(c, a, F.lit(2)).rlike(r"^\S\S$"), 1).otherwise(0).alias("joined"))

    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.array(F.lit(0)).alias("out"))

    def step(acc, g):
        # A gap right after a chosen boundary starts afresh, so nothing is taken off there.
        n = acc["n"] + g["n"] - F.when(acc["n"] > 0, g["joined"]).otherwise(0)
        inner = F.transform(fixed_word_cuts(F.substr(c, acc["at"] + 1, g["b"] - acc["at"]), strategy.target_size),
                            lambda k: k + acc["at"])

        def state(at, n_, out):
            return F.struct(at.alias("at"), n_.alias("n"), out.alias("out"))

        return (F.when(n < strategy.min_size, state(acc["at"], n, acc["out"]))
                .when(n <= strategy.max_size, state(g["b"], F.lit(0), F.array_append(acc["out"], g["b"])))
                .otherwise(state(g["b"], F.lit(0), F.concat(acc["out"], inner))))

    return F.aggregate(T.neighbours(cuts, gap), zero, step, lambda acc: F.when(
        F.array_max(acc["out"]) < F.length(c), F.array_append(acc["out"], F.length(c))).otherwise(acc["out"]))


def context_chunks(df: DataFrame, strategy: ChunkingStrategy = ChunkingStrategy(), col: str = "text") -> DataFrame:
    """Chunks at the chosen boundaries with the text around them and their place in the document."""
    c, reach = F.col("_text"), strategy.context_window * 4
    d = df.select("doc_id", F.col(col).alias("_text")).withColumn("_cuts", candidate_cuts(c, strategy))
    d = d.withColumn("_at", chosen_cuts(c, F.col("_cuts"), strategy))
    pieces = F.zip_with(F.slice("_at", 1, F.size("_at") - 1), F.slice("_at", 2, F.size("_at") - 1),
                        lambda a, b: F.struct(a.alias("s"), b.alias("e")))
    s, e = F.col("_p.s"), F.col("_p.e")
    lead = F.greatest(s - reach, F.lit(0))
    rows = d.select("doc_id", "_text", F.posexplode(pieces).alias("_pos", "_p")).select(
        "doc_id", F.format_string("chunk_%03d", F.col("_pos")).alias("chunk_id"), s.alias("start_pos"),
        e.alias("end_pos"), T.trim_ws(F.substr(c, s + 1, e - s)).alias("text"),
        T.trim_ws(F.substr(c, lead + 1, s - lead)).alias("preceding_context"),
        T.trim_ws(F.substr(c, e + 1, F.lit(reach))).alias("following_context"),
        T.ratio(s, F.length(c)).alias("narrative_position"))
    rows = rows.filter("text <> ''")
    return (rows.withColumn("word_count", T.n_words(F.col("text")))
            .withColumn("sentence_count", F.size(F.split("text", "[.!?]+")))
            .withColumn("token_count", token_estimate(F.col("word_count"))))


# --- adjusting chunks -----------------------------------------------------------------

def token_estimate(n_words: Column) -> Column:
    return F.floor(n_words / 0.75).cast("int")


def split_oversized(df: DataFrame, max_words: int = 1000) -> DataFrame:
    """Halve chunks over ``max_words`` by sentence; needs chunk_id and text, returns previews and the dependency."""
    sents = F.split("text", "[.!?]+")
    mid = F.floor(F.size(sents) / 2).cast("int")
    first = F.concat(F.array_join(F.slice(sents, F.lit(1), mid), ". "), F.lit("."))
    second = F.array_join(F.slice(sents, mid + 1, F.size(sents) - mid), ". ")
    none = F.lit(None).cast("string")

    def row(cid, text, n, before, after, dep):
        return F.struct(cid.alias("chunk_id"), text.alias("text"), n.alias("sentence_count"),
                        before.alias("preceding"), after.alias("following"), dep.alias("depends_on"))

    halves = F.array(
        row(F.concat("chunk_id", F.lit("_a")), F.col("_first"), F.col("_mid"), none, F.substring("_second", 1, 100), none),
        row(F.concat("chunk_id", F.lit("_b")), F.col("_second"), F.size(sents) - F.col("_mid"),
            F.right("_first", F.lit(100)), none, F.concat("chunk_id", F.lit("_a"))))
    whole = F.array(row(F.col("chunk_id"), F.col("text"), F.size(sents), none, none, none))
    rest = [c for c in df.columns if c not in ("chunk_id", "text", "sentence_count")]
    return (df.withColumn("_mid", mid).withColumn("_first", first).withColumn("_second", second)
            .select(*rest, F.inline(F.when(T.n_words(F.col("text")) > max_words, halves).otherwise(whole)))
            .withColumn("word_count", T.n_words(F.col("text"))))


def merge_small(pieces: Column, min_words: int) -> Column:
    """Join every piece under ``min_words`` words to the piece before it."""
    return F.aggregate(
        pieces, F.array().cast("array<string>"),
        lambda acc, p: F.when((T.n_words(p) >= min_words) | (F.size(acc) == 0), F.array_append(acc, p)).otherwise(
            F.array_append(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
                           F.concat_ws(" ", F.element_at(acc, F.when(F.size(acc) == 0, F.lit(None)).otherwise(F.lit(-1))), p))))


def merge_undersized(df: DataFrame, budget: int = 1000, min_words: int = 100, col: str = "text") -> DataFrame:
    """Sentence-packed chunks in which no chunk but the first is shorter than ``min_words``."""
    texts = F.transform(greedy_pack(T.marked_sentences(F.col(col)), budget), lambda p: p["text"])
    return (df.withColumn("_p", texts)
            .select("doc_id", F.posexplode(merge_small(F.col("_p"), min_words)).alias("_pos", "text"))
            .select("doc_id", (F.col("_pos") + 1).alias("chunk_no"), "text")
            .withColumn("word_count", T.n_words(F.col("text"))))


def fit_text(c: Column, available: int) -> Column:
    """Text cut to 90 % of the token budget at the last sentence end, when it is over the budget."""
    ws = T.words(c)
    n = F.size(ws)
    tokens = token_estimate(n)
    target = F.floor(n * (F.lit(float(available)) / tokens) * 0.9).cast("int")
    cut = F.array_join(F.slice(ws, F.lit(1), F.greatest(target, F.lit(0))), " ")
    sentence = F.regexp_extract(cut, r"(?s)^(.+[.!?])", 1)
    return F.when((tokens <= available) | (target >= n), c).otherwise(
        F.when(sentence == "", cut).otherwise(sentence))


def fit_token_budget(df: DataFrame, available: int = 800, col: str = "text") -> DataFrame:
    return (df.withColumn("tokens_before", token_estimate(T.n_words(F.col(col))))
            .withColumn(col, fit_text(F.col(col), available))
            .withColumn("word_count", T.n_words(F.col(col)))
            .withColumn("token_count", token_estimate(F.col("word_count"))))


def chunk_with_context(df: DataFrame, strategy: ChunkingStrategy = ChunkingStrategy()) -> DataFrame:
    """Context chunks, the oversized halved and all cut to the token budget."""
    rows = context_chunks(df, strategy).drop("word_count", "sentence_count", "token_count")
    return fit_token_budget(split_oversized(rows, strategy.max_size), strategy.token_budget - strategy.prompt_tokens)


def narrative_segments(df: DataFrame, parts: int = 10, col: str = "text") -> DataFrame:
    """Equal slices of a text with entity density and word count."""
    c = F.col(col)
    d = df.select("doc_id", c.alias("_t"), T.labeled_entities(c).alias("_e")).select(
        "doc_id", "_t", "_e", F.floor(F.length("_t") / parts).cast("int").alias("_size"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("segment"))
    start = F.col("segment") * F.col("_size")
    end = F.when(F.col("segment") == parts - 1, F.length("_t")).otherwise(start + F.col("_size"))  # the last slice takes the rest
    words = T.n_words(F.substr("_t", start + 1, end - start))
    found = F.size(F.filter("_e", lambda e: (e["start"] >= start) & (e["start"] < end)))
    return d.select("doc_id", (F.col("segment") / float(parts)).alias("position"), words.alias("word_count"),
                    F.when(words > 0, found / F.greatest(words, F.lit(1))).otherwise(F.lit(0.0)).alias("semantic_density"))
