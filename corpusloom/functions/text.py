"""Column functions over text: splitting, cleaning, counting, spans.

All functions take and return Columns and stay inside the JVM.  Heavy arrays
(words, sentences) should be put in their own ``withColumn`` once and reused;
Catalyst keeps such projections apart when they are referenced more than once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom import fixed_values as FV

WORD = r"[\p{L}\p{N}_]+"


def settle(df: DataFrame, *names: str) -> DataFrame:
    """Fix computed columns behind a one-row generator.

    Catalyst copies the whole expression of a column into every filter on it; a
    filter is not pushed through a generator, so the column is computed once.
    """
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.inline(F.array(F.struct(*[F.col(n) for n in names]))))


def lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def trim_ws(c: Column) -> Column:
    """Strip every kind of white space, not only the space character."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def lower_by_sign(c: Column) -> Column:
    """Lower case with one sign for each sign of the text: the two signs that Java turns by their neighbours or into two are taken first.

    Texts of ASCII alone have none of these; the others are lowered once, since ``let`` holds what is compared and given out.
    """
    def whole(low):
        return F.when(F.length(low) == F.length(c), low).otherwise(F.array_join(F.transform(F.split(c, ""), lambda x: F.left(F.lower(x), F.lit(1))), ""))

    taken = F.when(F.contains(c, F.lit("\u03a3")) | F.contains(c, F.lit("\u0130")), F.translate(c, "\u03a3\u0130", "\u03c3i")).otherwise(c)
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(let(F.lower(taken), whole))


def words(c: Column) -> Column:
    return F.array_remove(F.split(c, r"\s+"), F.lit(""))


def words_at_hand(c: Column) -> Column:
    """:func:`words` of a stored column: texts whose only blanks are spaces and line ends are cut at single signs, which needs no pattern."""
    other = contains_any(c, ["\t", "\x0b", "\f", "\r"])
    return F.array_remove(F.when(other, F.split(c, r"\s+")).otherwise(F.split(F.replace(c, F.lit("\n"), F.lit(" ")), " ")), F.lit(""))


def n_words(c: Column) -> Column:
    """Word count without building the word array."""
    return F.regexp_count(c, F.lit(r"\S+"))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "[.!?]+"), trim_ws), lambda s: s != "")


def n_sentences(c: Column) -> Column:
    """Count of non-blank runs between end marks."""
    return F.regexp_count(c, F.lit(r"[^.!?]*[^.!?\s][^.!?]*"))


def marked_sentences(c: Column) -> Column:
    """Sentences that keep their end marks."""
    return F.filter(
        F.transform(F.regexp_extract_all(c, F.lit(r"[^.!?]+[.!?]*"), F.lit(0)), trim_ws),
        lambda s: s != "",
    )


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def lower_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def alpha_words(c: Column) -> Column:
    """Words of a text made of letters only, lower-cased: one pass over the text."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?<!\S)\p{L}+(?!\S)"), F.lit(0)), F.lower)


def alpha_tokens(low: Column) -> Column:
    """The tokens of a lower-cased text that are made of letters only: one pass over the text."""
    return F.regexp_extract_all(low, F.lit(rf"(?<!{WORD[:-1]})\p{{L}}++(?!{WORD[:-1]})"), F.lit(0))


def let(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once.

    Inside a higher-order function an outer expression is evaluated again for every
    element; binding it to a lambda variable first avoids that.
    """
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def scan(items: Column, zero: Column, step, kind: str, block: int = 128) -> Column:
    """What ``step(state, item)`` gives out, in order: it returns struct(state, row), and a null row gives nothing.

    Every step of an aggregate copies what it has gathered.  So a first pass only finds the state at which each block of items starts, and
    each block then gathers its own rows: the time is in proportion to the items.
    """
    def cut(all_items):
        blocks = F.greatest(F.ceil(F.size(all_items) / block).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.slice(all_items, i * block + 1, F.lit(block)))

    def starts(blocks):
        first = F.struct(zero.alias("state"), F.array_remove(F.array(zero), zero).alias("seen"))
        return F.aggregate(blocks, first, lambda acc, b: F.struct(
            F.aggregate(b, acc["state"], lambda s, x: step(s, x)["state"]).alias("state"), F.array_append(acc["seen"], acc["state"]).alias("seen")), lambda acc: acc["seen"])

    def gather(b, s0):
        start = F.struct(s0.alias("state"), F.array().cast(f"array<{kind}>").alias("rows"))
        add = lambda acc, x: let(step(acc["state"], x), lambda s: F.struct(
            s["state"].alias("state"), F.when(s["row"].isNull(), acc["rows"]).otherwise(F.array_append(acc["rows"], s["row"])).alias("rows")))
        return F.aggregate(b, start, add, lambda acc: acc["rows"])

    return let(items, lambda v: let(cut(v), lambda blocks: F.flatten(F.zip_with(blocks, starts(blocks), gather))))


def ratio(part: Column, whole: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(float(default)))


def contains_any(lowered: Column, terms) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(t)) for t in terms])


def hits(lowered: Column, terms) -> Column:
    """How many of the terms occur as substrings."""
    return reduce(lambda a, b: a + b, [F.contains(lowered, F.lit(t)).cast("int") for t in terms])


def terms_found(lowered: Column, terms) -> Column:
    """The terms that occur as substrings, in list order."""
    return let(lowered, lambda low: F.filter(lit_array(terms), lambda t: F.contains(low, t)))


def word_pattern(terms) -> str:
    """Whole-word, case-blind alternation with Unicode word boundaries.

    A place whose sign begins no term is passed over before its boundary is looked at, and only the terms of its first sign are tried there, in their order.
    """
    by_first = {}
    for t in terms:
        by_first.setdefault(t[0].lower(), []).append(t[1:])
    if not all(k.isascii() and k.isalpha() for k in by_first):
        return r"(?iU)\b(?:" + "|".join(terms) + r")\b"
    return r"(?iU)(?=[" + "".join(by_first) + r"])\b(?:" + "|".join(f"{k}(?:{'|'.join(rest)})" for k, rest in by_first.items()) + r")\b"


def count_words_in(c: Column, terms) -> Column:
    """Whole-word occurrences; the pattern runs only where a term occurs at all."""
    return F.when(contains_any(F.lower(c), terms), F.regexp_count(c, F.lit(word_pattern(terms)))).otherwise(F.lit(0))


def words_among(low: Column, terms) -> Column:
    """The words of a lower-cased text that are among the terms, in order with repeats: one pass over the text, whatever the number of terms."""
    return F.filter(F.regexp_extract_all(low, F.lit(WORD + "+"), F.lit(0)), lambda w: w.isin(*terms))


def lower_pattern(terms) -> str:
    """Whole-word alternation for lower-cased text; only a place whose sign begins a term is looked at further."""
    return rf"(?=[{''.join(sorted({t[0] for t in terms}))}])(?<!{WORD[:-1]})(?:{'|'.join(terms)})(?!{WORD[:-1]})"


def count_chars_in(c: Column, chars: str) -> Column:
    """Occurrences of any of the characters, without a pattern."""
    return F.length(c) - F.length(F.translate(c, chars, ""))


def count_substring(c: Column, part: str) -> Column:
    """Non-overlapping occurrences of a substring, without a pattern."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("int")


def set_of(array: Column) -> Column:
    return F.array_distinct(array)


def present(*cols: Column) -> Column:
    """Array of the non-null values, in order."""
    return F.filter(F.array(*cols), lambda x: x.isNotNull())


#: Two signs that Unicode keeps free of meaning, put around matches and between their groups.
MARKS = ("\ufdd0", "\ufdd1")


def starts_of(lengths: Column, block: int = 64) -> Column:
    """Where each item begins when items of these lengths follow one another.

    Sums run on inside blocks, each from the sum of the blocks before it: an append copies a block at most, so the time is in proportion to the items.
    """
    def running(items, first):
        return F.aggregate(items, F.array(first), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))

    def in_blocks(v):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")), lambda i: F.slice(v, i * block + 1, F.lit(block)))
        return let(blocks, lambda bs: F.flatten(F.zip_with(bs, starts_of_blocks(bs), lambda b, at: running(F.slice(b, F.lit(1), F.size(b) - 1), at))))

    def starts_of_blocks(bs):
        sums = F.transform(bs, lambda b: F.aggregate(b, F.lit(0), lambda s, n: s + n))
        return running(F.slice(sums, F.lit(1), F.size(bs) - 1), F.lit(0))

    return let(lengths, lambda v: F.when(F.size(v) == 0, F.array().cast("array<int>")).when(F.size(v) <= block, running(F.slice(v, F.lit(1), F.greatest(F.size(v) - 1, F.lit(0))), F.lit(0))).otherwise(in_blocks(v)))


def split_at(c: Column, pattern: str, groups: tuple[int, ...] = ()) -> Column:
    """A text as array of gaps and matches by turns, a gap first and last, from one pass of the pattern: it marks the matches, and the marks are cut at.

    With ``groups``, a match is followed by its groups, MARKS[1] before each.  A text that holds a mark itself is read in a pass for each of them.
    """
    out, part = MARKS

    def slow(found):
        whole = F.transform(found, lambda m: F.array_join(F.array(m, *[F.regexp_extract(m, pattern, g) for g in groups]), part)) if groups else found
        gaps = F.split(c, pattern)
        return F.concat(F.flatten(F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), whole, lambda g, m: F.array(F.coalesce(g, F.lit("")), m))),
                        F.array(F.coalesce(F.get(gaps, F.size(found)), F.lit(""))))

    marked = F.regexp_replace(c, pattern, out + part.join(["$0", *[f"${g}" for g in groups]]) + out)
    held = F.contains(c, F.lit(out)) | F.contains(c, F.lit(part)) if groups else F.contains(c, F.lit(out))
    return F.when(held, let(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), slow)).otherwise(F.split(marked, out))


def of_matches(pieces: Column, fn, kind: str) -> Column:
    """``fn(i)`` for the place i (from 0) of each match in the pieces of :func:`split_at`."""
    return F.when(F.size(pieces) > 2, F.transform(F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2)), fn)).when(pieces.isNotNull(), F.array().cast(f"array<{kind}>"))


def spans(c: Column, pattern: str, groups: tuple[int, ...] = ()) -> Column:
    """All matches as array<struct<start,end,text>> with code-point offsets, and their groups as an array if wanted; no match may be empty."""
    kind = "struct<start:int,end:int,text:string" + (",groups:array<string>>" if groups else ">")
    part = MARKS[1]

    def found(v):
        # the groups behind a match do not count as signs of the text
        whole = (lambda x: F.substring_index(x, part, 1)) if groups else (lambda x: x)
        lengths = F.transform(v, lambda x, i: F.when(i % 2 == 1, F.length(whole(x))).otherwise(F.length(x))) if groups else F.transform(v, F.length)

        def match(at):
            def one(i):
                m = F.get(v, i)
                row = [F.get(at, i).alias("start"), F.get(at, i + 1).alias("end")]
                if groups:
                    return let(F.split(m, part), lambda g: F.struct(*row, F.get(g, F.lit(0)).alias("text"), F.slice(g, 2, len(groups)).alias("groups")))
                return F.struct(*row, m.alias("text"))

            return one

        return let(starts_of(lengths), lambda at: of_matches(v, match(at), kind))

    return let(split_at(c, pattern, groups), found)


def sentence_spans(c: Column) -> Column:
    """Trimmed, non-empty sentences as array<struct<start,text>> with exact offsets."""
    def trimmed(s):
        rest = F.ltrim(s["text"], F.lit(" \t\n\x0b\f\r"))
        return F.struct((s["end"] - F.length(rest)).alias("start"), trim_ws(s["text"]).alias("text"))

    return F.filter(F.transform(spans(c, "[^.!?]+"), trimmed), lambda s: s["text"] != "")


def word_spans(c: Column, terms) -> Column:
    """Spans of whole-word terms; texts that hold none of them skip the pattern."""
    return F.when(contains_any(F.lower(c), terms), spans(c, word_pattern(terms))).otherwise(no_spans())


def no_spans() -> Column:
    return F.array().cast("array<struct<start:int,end:int,text:string>>")


def tally(items: Column) -> Column:
    """array<struct<value,n>> of the distinct items of one array with their counts.

    Sort, find where the value changes, and take differences of those places: no explode, no shuffle.
    """
    def runs(s):
        places = F.transform(s, lambda x, i: i + 1)
        starts = F.filter(places, lambda i: (i == 1) | (F.element_at(s, i) != F.get(s, i - 2)))
        return let(starts, lambda v: F.transform(v, lambda at, k: F.struct(
            F.element_at(s, at).alias("value"), (F.coalesce(F.get(v, k + 1), F.size(s) + 1) - at).alias("n"))))

    return let(F.sort_array(items), runs)


def offsets(parts: Column, gap: int) -> Column:
    """Parts with their start offsets when ``gap`` characters separate them."""
    def placed(v):
        at = starts_of(F.transform(v, lambda p: F.length(p) + gap))
        return F.zip_with(at, v, lambda i, p: F.struct(i.alias("start"), p.alias("text")))

    return let(parts, placed)


# --- cleaning ---------------------------------------------------------------------

def normalize_text(c: Column) -> Column:
    """Collapse blanks, drop page-number lines, straighten dashes and quotes; keep newlines."""
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"\n\s*\d+\s*\n", "\n")
    c = F.regexp_replace(c, r"(?i)\n\s*Page \d+\s*\n", "\n")
    c = F.translate(c, "—‘’“”", "-''\"\"")
    return trim_ws(c)


def clean_fragment(c: Column) -> Column:
    c = F.regexp_replace(c, r"\s+", " ")
    c = F.regexp_replace(c, r"^[:\-\s]+", "")
    return F.regexp_replace(c, r"[:\-\s]+$", "")


def sanitize_text(c: Column, longest: int | None = None) -> Column:
    """struct(is_valid, text, error): trimmed, free of control characters and script; too short texts are refused, and those over ``longest`` if given."""
    t = trim_ws(c)
    clean = F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    for pattern in FV.SCRIPT_PATTERNS:
        clean = F.regexp_replace(clean, pattern, "")
    n = F.length(t)

    def row(valid, text, error):
        return F.struct(F.lit(valid).alias("is_valid"), text.alias("text"), F.lit(error).alias("error"))

    return (
        F.when(c.isNull() | (c == ""), row(False, F.lit(""), "Text input cannot be empty"))
        .when(t == "", row(False, F.lit(""), "Text input cannot be empty after removing whitespace"))
        .when(n < FV.MIN_TEXT_LENGTH, row(
            False, t, f"Text too short (minimum {FV.MIN_TEXT_LENGTH} characters)"))
        .when(n > F.lit(longest), row(False, clean, f"Text too long (maximum {longest} characters)"))
        .otherwise(row(True, clean, ""))
    )


def html_to_text(c: Column) -> Column:
    """Markup to text: comments, script and style dropped, tags removed, common entities decoded."""
    for pattern in (r"(?s)<!--.*?-->", r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>",
                    r"<[^>]*>"):
        c = F.regexp_replace(c, pattern, "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
                         ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def meaningful_paragraphs(c: Column) -> Column:
    """Paragraphs over 50 characters that are neither headers, footers nor page numbers."""
    by_blank = F.split(c, "\n\n")
    by_line = F.transform(F.split(c, r"\n\s*\n"), lambda p: F.array_join(
        F.filter(F.transform(lines(p), trim_ws), lambda x: x != ""), " "))
    paras = F.transform(F.when(F.contains(c, F.lit("\n\n")), by_blank).otherwise(by_line), trim_ws)
    return F.filter(paras, lambda p: (F.length(p) > 50)
                    & ~((F.length(p) < 100) & contains_any(F.lower(p), FV.HEADER_WORDS))
                    & ~p.rlike(r"^\s*\d+\s*$"))


# --- entities, concepts, themes -----------------------------------------------------

# a capital is looked for before a boundary is: the boundary costs far more
PERSON_PATTERN = r"(?U)(?=[A-Z])\b[A-Z][a-z]+\s+[A-Z][a-z]+\b"
ORG_PATTERN = r"(?U)(?=[A-Z])\b[A-Z][a-z]+\s+(?:" + "|".join(FV.ORG_WORDS) + r")\b"
PLACE_PATTERN = r"(?U)(?=[A-Z])\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:" + "|".join(FV.PLACE_WORDS) + r")\b"
#: Runs of two and more capitalised words, which every match of the label patterns lies in; possessive, so a long run needs no stack.
RUN_PATTERN = r"(?U)(?=[A-Z])\b[A-Z][a-z]++(?:\s++[A-Z][a-z]++\b)++"
LABEL_PATTERNS = {"PERSON": PERSON_PATTERN, "ORG": ORG_PATTERN, "GPE": PLACE_PATTERN}


def surface_entities(c: Column) -> Column:
    """Distinct capitalised words, quoted terms and numbers."""
    return F.array_distinct(F.concat(
        F.regexp_extract_all(c, F.lit(r"(?U)\b[A-Z][a-z]+\b"), F.lit(0)),
        F.regexp_extract_all(c, F.lit(r'"([^"]+)"'), F.lit(1)),
        F.regexp_extract_all(c, F.lit(r"(?U)\b[0-9]+(?:\.[0-9]+)?\b"), F.lit(0))))


#: From the start of a run of capitalised words to its last place word; greedy over signs, so a long run needs no stack.
_PLACE_OF_RUN = r"(?Us)\A.*\s(?:" + "|".join(FV.PLACE_WORDS) + r")\b"


def labeled_entities(c: Column) -> Column:
    """array<struct<text,label,start,end,confidence>> from the label patterns.

    One pass finds the runs of capitalised words, and the patterns read only these.  The place pattern matches a run once, from its first
    word to its last place word, if that is not the first; asked so, a run of any length needs no stack.
    """
    def row(label, text, start, end):
        return F.struct(text.alias("text"), F.lit(label).alias("label"), start.alias("start"), end.alias("end"), F.lit(0.6).alias("confidence"))

    def pairs(runs, label):
        return F.flatten(F.transform(runs, lambda r: F.transform(spans(r["text"], LABEL_PATTERNS[label]), lambda s: row(
            label, s["text"], r["start"] + s["start"], r["start"] + s["end"]))))

    def places(runs):
        found = F.transform(runs, lambda r: F.struct(r["start"].alias("start"), F.regexp_extract(r["text"], _PLACE_OF_RUN, 0).alias("text")))
        return F.transform(F.filter(found, lambda p: p["text"] != ""), lambda p: row("GPE", p["text"], p["start"], p["start"] + F.length(p["text"])))

    return let(spans(c, RUN_PATTERN), lambda runs: F.concat(pairs(runs, "PERSON"), pairs(runs, "ORG"), places(runs)))


def n_labeled_entities(c: Column) -> Column:
    """Count of the label patterns' matches, found as by :func:`labeled_entities`, in runs set apart by full stops."""
    place = r"(?U)\s(?:" + "|".join(FV.PLACE_WORDS) + r")\b"

    def counted(runs):
        pairs = let(F.array_join(runs, "."), lambda r: F.regexp_count(r, F.lit(PERSON_PATTERN)) + F.regexp_count(r, F.lit(ORG_PATTERN)))
        return F.when(F.size(runs) == 0, F.lit(0)).otherwise(pairs + F.size(F.filter(runs, lambda r: r.rlike(place))))

    return let(F.regexp_extract_all(c, F.lit(RUN_PATTERN), F.lit(0)), counted)


def important_entities(entities: Column, keep: int = 10) -> Column:
    """First ``keep`` entities by label priority and position, with an importance level."""
    order = {label: i for i, label in enumerate(FV.ENTITY_LABEL_ORDER)}

    def ranked(e):
        r = F.lit(len(order))
        for label, i in order.items():
            r = F.when(e["label"] == label, i).otherwise(r)
        level = F.when(e["label"].isin("PERSON", "ORG"), "high").when(
            e["label"].isin(*FV.ENTITY_LABEL_ORDER), "medium").otherwise("low")
        return F.struct(r.alias("rank"), e["start"].alias("start"), e["text"].alias("text"),
                        e["label"].alias("type"), level.alias("importance"))

    return F.slice(F.array_sort(F.transform(entities, ranked)), 1, keep)


#: Words that may begin a concept.
CONCEPT_TERMS = sorted({w for lead, _ in FV.CONCEPT_LEADS for w in lead})


def concepts(c: Column, keep: int | None = None, low: Column | None = None, found: Column | None = None) -> Column:
    """Words named as "idea of X" and the like: lower-cased, distinct, sorted; all, or the first ``keep`` for display.

    A pattern runs only where one of its leading words occurs.  ``low`` and ``found`` are the lower-cased text and its words among CONCEPT_TERMS, where these are at hand.
    """
    def every(t):
        def one(lead, link):
            held = contains_any(t, lead) if found is None else F.arrays_overlap(found, lit_array(lead))
            return F.when(held, F.regexp_extract_all(t, F.lit(rf"{lower_pattern(lead)}\s+(?:{'|'.join(link)})\s+({WORD})"), F.lit(1))).when(
                t.isNotNull(), F.array().cast("array<string>"))

        return F.array_sort(F.array_distinct(F.filter(F.concat(*[one(*x) for x in FV.CONCEPT_LEADS]), lambda w: F.length(w) > 2)))

    all_of = let(lower_by_sign(c), every) if low is None else every(low)
    return F.slice(all_of, 1, keep) if keep else all_of


def themes(c: Column, keep: int | None = None, lexicon: dict | None = None) -> Column:
    """array<struct<theme,score>>: themes by number of keywords present, best first; all, or the first ``keep`` for display."""
    table = (lexicon or FV.THEME_KEYWORDS).items()

    def ranked(low):
        rows = [F.named_struct(F.lit("neg"), -hits(low, kws), F.lit("pos"), F.lit(i), F.lit("theme"), F.lit(name))
                for i, (name, kws) in enumerate(table)]
        every = F.array_sort(F.filter(F.array(*rows), lambda r: r["neg"] < 0))
        return F.slice(every, 1, keep) if keep else every

    return F.transform(let(F.lower(c), ranked), lambda r: F.struct(
        r["theme"].alias("theme"), (-r["neg"]).alias("score")))


def neighbours(items: Column, fn) -> Column:
    """``fn(item, next item)`` over an array."""
    def zipped(v):
        n = F.greatest(F.size(v) - 1, F.lit(0))
        return F.zip_with(F.slice(v, F.lit(1), n), F.slice(v, F.lit(2), n), fn)

    return let(items, zipped)


def bigrams(word_array: Column) -> Column:
    return neighbours(word_array, lambda a, b: F.concat_ws(" ", a, b))


# --- language ------------------------------------------------------------------------

def language_code(c: Column) -> Column:
    """struct(code, confidence) from script ranges; kana is tested before Han."""
    low = F.lower(c)

    def row(code, conf):
        return F.struct(F.lit(code).alias("code"), F.lit(conf).alias("confidence"))

    return (
        F.when(low.rlike("[а-яё]"), row("ru", 0.8))
        .when(c.rlike("[぀-ヿ]"), row("ja", 0.8))
        .when(c.rlike("[一-龯]"), row("zh", 0.8))
        .when(c.rlike("[가-힣]"), row("ko", 0.8))
        .when(c.rlike("[ا-ي]"), row("ar", 0.8))
        .when(low.rlike("[à-ÿ]") & F.contains(low, F.lit("ñ")), row("es", 0.7))
        .when(low.rlike("[à-ÿ]") & F.contains(low, F.lit("ç")), row("fr", 0.7))
        .when(low.rlike("[à-ÿ]"), row("fr", 0.6))
        .otherwise(row("en", 0.6)))


def lookup(key: Column, table: dict, default=None) -> Column:
    """Value of a small literal table by key."""
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out
