"""Themes, phrases and span handling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions import text as T, windows

def theme_matches(df: DataFrame, themes: list[str], before: int = 2, after: int = 2, col: str = "text") -> DataFrame:
    """First hit of each theme in each sentence, with the sentences around it.

    Hits are found inside the row of a text, so neither text nor sentences are copied before the filter.
    """
    def found(c, ss):
        def joined(at, n):
            return F.array_join(F.transform(F.slice(ss, at, n), lambda x: x["text"]), " ")

        def hits_of(s, i):
            low, lead = F.lower(s["text"]), F.least(i, F.lit(before))

            def hit(k):
                at = F.position(F.lower(k), low) - 1
                start = s["start"] + at
                return F.struct(
                    k.alias("keyword"), i.alias("sentence_index"), start.alias("start_pos"), (start + F.length(k)).alias("end_pos"),
                    joined(i - lead + 1, lead).alias("context_before"), joined(i + 2, F.lit(after)).alias("context_after"),
                    joined(i - lead + 1, lead + 1 + after).alias("full_chunk"),
                    T.count_substring(F.substr(c, F.lit(1), s["start"]), "\n\n").alias("paragraph_index"), F.lit(0.7).alias("confidence"),
                    F.substr(s["text"], at + 1, F.length(k)).alias("matched_text"))

            return F.transform(F.filter(T.lit_array(themes), lambda k: F.contains(low, F.lower(k))), hit)

        return F.flatten(F.transform(ss, hits_of))

    c = F.col(col)
    return df.select("doc_id", F.inline(T.let(T.sentence_spans(c), lambda ss: found(c, ss))))


_HITS = "array<struct<start:int,end:int,keyword:string,confidence:double,sentence_index:int,paragraph_index:int>>"
_SPANS = "array<struct<start:int,end:int,keyword:string,confidence:double,method:string>>"


def regex_hits(c: Column, themes: list[str], case_sensitive: bool = False) -> Column:
    """array<struct<start,end,keyword,confidence>> of every literal occurrence."""
    flag = "" if case_sensitive else "(?iu)"
    low = F.lower(c)
    return F.concat(*[F.when(F.contains(low, F.lit(t.lower())), _tagged(c, flag + r"\Q" + t + r"\E", t)).otherwise(
        F.array().cast(_HITS)) for t in themes])


def theme_spans(c: Column, themes: list[str], methods: tuple[str, ...] = ("regex", "sentence")) -> Column:
    """array<struct<start,end,keyword,confidence,method>>: the places of :func:`theme_matches_regex` (method regex) and :func:`theme_matches` (sentence), without the text around them.

    The lower-cased text is cut at each theme once.  An occurrence is the first of its sentence where an end mark lies in the gap before it.  Themes that hold an end
    mark or begin or end with white space may reach over a sentence; those are looked for sentence by sentence.
    """
    blank = " \t\n\x0b\f\r"
    whole = [t for t in themes if t and not set(t) & set(".!?") and t.strip(blank) == t]
    rest = [t for t in themes if t not in whole] if "sentence" in methods else []

    def span(start, end, theme, method):
        return F.struct(start.alias("start"), end.alias("end"), F.lit(theme).alias("keyword"), F.lit(0.7 if method == "sentence" else 0.5).alias("confidence"), F.lit(method).alias("method"))

    def key_of(theme):
        return theme.translate({0x3a3: 0x3c3, 0x130: 0x69}).lower()

    def places(low, theme):
        key = key_of(theme)
        kinds = [m for m in methods if m == "regex" or theme in whole]
        if not key or not kinds:
            return F.array().cast(_SPANS)

        def of(gaps, ends, method):
            at = F.sequence(F.lit(0), F.size(gaps) - 2)
            if method == "sentence":
                at = F.filter(at, lambda i: (i == 0) | F.get(gaps, i).rlike("[.!?]"))
            return F.transform(at, lambda i: span(F.get(ends, i + 1) - len(key), F.get(ends, i + 1), theme, method))

        found = T.let(F.split(low, r"\Q" + key + r"\E"), lambda gaps: T.let(
            T.starts_of(F.transform(gaps, lambda g: F.length(g) + len(key))), lambda ends: F.concat(*[of(gaps, ends, m) for m in kinds])))
        return F.when(F.contains(low, F.lit(key)), found).otherwise(F.array().cast(_SPANS))

    def in_sentences(s):
        def one(k):
            start = s["start"] + F.position(k["low"], s["text"]) - 1
            return F.struct(start.alias("start"), (start + F.length(k["keyword"])).alias("end"), k["keyword"].alias("keyword"), F.lit(0.7).alias("confidence"), F.lit("sentence").alias("method"))

        keys = F.array(*[F.struct(F.lit(t).alias("keyword"), F.lit(key_of(t)).alias("low")) for t in rest])
        return F.transform(F.filter(keys, lambda k: F.contains(s["text"], k["low"])), one)

    def every(low):
        spans = [places(low, t) for t in themes]
        return F.concat(*spans, *([F.coalesce(F.flatten(F.transform(T.sentence_spans(low), in_sentences)), F.array().cast(_SPANS))] if rest else []))

    return T.let(T.lower_by_sign(c), every)


def _tagged(c: Column, pattern: str, name: str) -> Column:
    """Matches of one pattern with the end marks and blank lines before them.

    What gaps and matches hold is added up once over the text, so no match reads its whole prefix again.
    """
    def found(v):
        before = lambda count: T.starts_of(F.transform(v, count))
        return T.let(before(F.length), lambda at: T.let(before(lambda x: T.count_chars_in(x, ".!?")), lambda ends: T.let(
            before(lambda x: T.count_substring(x, "\n\n")), lambda lines: T.of_matches(v, lambda i: F.struct(
                F.get(at, i).alias("start"), F.get(at, i + 1).alias("end"), F.lit(name).alias("keyword"), F.lit(0.5).alias("confidence"),
                F.get(ends, i).alias("sentence_index"), F.get(lines, i).alias("paragraph_index")), _HITS[6:-1]))))

    return T.let(T.split_at(c, pattern), found)


def _with_context(rows: DataFrame, reach: int = 200) -> DataFrame:
    """Text around the hits (columns _t, start, end and the counts)."""
    lead = F.least(F.col("start"), F.lit(reach))
    return rows.select(
        "doc_id", "keyword", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "confidence",
        F.substr("_t", F.col("start") + 1, F.col("end") - F.col("start")).alias("matched_text"),
        T.trim_ws(F.substr("_t", F.col("start") - lead + 1, lead)).alias("context_before"),
        T.trim_ws(F.substr("_t", F.col("end") + 1, F.lit(reach))).alias("context_after"),
        "sentence_index", "paragraph_index")


def theme_matches_regex(df: DataFrame, themes: list[str], case_sensitive: bool = False, col: str = "text") -> DataFrame:
    rows = df.select("doc_id", F.col(col).alias("_t"), F.inline(regex_hits(F.col(col), themes, case_sensitive)))
    return _with_context(rows)


#: The columns of a place but its text's.
_PLACE = "keyword string,start int,end int,matched_text string,sentence_index int,paragraph_index int"


def dictionary_places(df: DataFrame, phrases: DataFrame, case_sensitive: bool = False, key: str = "doc_id", col: str = "text") -> DataFrame:
    """Every occurrence of every phrase (column keyword) in every text, in one pass whatever the number of phrases.

    A phrase is keyed by its first ``windows.KEY_SIGNS`` signs (all of it, if shorter).  Windows of a text are hashed as they roll on; those that hit the table of key
    bits are the only ones that leave its row, and they carry all that is told of a place, so texts are not moved.  They meet the phrases by an equi-join on
    the key and are compared in full.  Of occurrences of one phrase that overlap each other the leftmost counts.  ``key`` must tell the texts apart.  Empty
    and null phrases are left out; repeated ones count once.
    """
    low = (lambda c: c) if case_sensitive else T.lower_by_sign
    p = phrases.select("keyword").filter(F.length("keyword") > 0).distinct().withColumn("_low", low(F.col("keyword")))
    p = p.withColumn("_key", F.left("_low", F.lit(windows.KEY_SIGNS))).withColumn("_n", F.length("_low"))
    # a phrase that begins as it ends can overlap itself
    p = p.withColumn("_self", F.exists(F.sequence(F.lit(1), F.col("_n")), lambda k: (k < F.col("_n")) & (F.left("_low", F.col("_n") - k) == F.right("_low", F.col("_n") - k))))
    longest, sizes, n = p.agg(F.max("_n"), F.collect_set(F.least("_n", F.lit(windows.KEY_SIGNS))), F.count("*")).first()
    longest, sizes = longest or 1, sorted(sizes)
    bits = min(max(n.bit_length() + 8, 12), 24)  # some hundred bits a phrase, two megabytes at most
    per_byte = p.select("_key").distinct().mapInArrow(windows.key_bits(bits), "b long").groupBy(F.shiftright("b", 3).alias("w")).agg(F.bit_or(F.expr("shiftleft(1, cast(b & 7 as int))")).alias("v"))
    table = np.zeros(1 << bits - 3, np.uint8)
    for w, v in per_byte.collect():  # at most a row for eight bits
        table[w] = v

    id_type = df.select(key).schema[0].dataType.simpleString()
    kinds = {"_id": id_type, "_key": "string", "_next": "string", "_raw": "string", "start": "int", "sentence_index": "int", "paragraph_index": "int"}
    texts = df.select(F.col(key).alias("_id"), F.col(col).alias("_t")).select("_id", "_t", low(F.col("_t")).alias("_l"))
    spots = texts.mapInArrow(windows.candidates(table, sizes, longest, bits, ",".join(kinds)), ",".join(f"{k} {v}" for k, v in kinds.items()))
    known = p if n > 100_000 else F.broadcast(p)
    hits = spots.join(known, "_key").filter(F.startswith("_next", "_low")).select(
        "_id", "keyword", "start", (F.col("start") + F.col("_n")).alias("end"), F.left("_raw", F.col("_n")).alias("matched_text"), "sentence_index", "paragraph_index", "_self")
    names = [x.split()[0] for x in _PLACE.split(",")]
    free = lambda at: T.scan(at, F.lit(0), lambda end, x: F.struct(
        F.when(x["start"] >= end, x["end"]).otherwise(end).alias("state"), F.when(x["start"] >= end, x).alias("row")),
        "struct<" + ",".join(x.replace(" ", ":") for x in _PLACE.split(",")[1:]) + ">")
    apart = hits.filter("_self").groupBy("_id", "keyword").agg(F.sort_array(F.collect_list(F.struct(*names[1:]))).alias("_at")).select("_id", "keyword", F.inline(free(F.col("_at"))))
    every = hits.filter("not _self").select("_id", *names).unionByName(apart)
    return every.select(F.col("_id").alias("doc_id"), "keyword", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), F.lit(0.5).alias("confidence"),
                        "matched_text", "sentence_index", "paragraph_index")


def dictionary_hits(df: DataFrame, phrases: DataFrame, case_sensitive: bool = False, reach: int = 200, key: str = "doc_id", col: str = "text") -> DataFrame:
    """The places of :func:`dictionary_places` with the text around them: the columns of :func:`theme_matches_regex`."""
    places = dictionary_places(df, phrases, case_sensitive, key, col)
    rows = places.join(df.select(F.col(key).alias("doc_id"), F.col(col).alias("_t")), "doc_id")
    return _with_context(rows.withColumnRenamed("start_pos", "start").withColumnRenamed("end_pos", "end"), reach)


def theme_confidence(rows: DataFrame, matched: str = "matched_text", chunk: str = "full_chunk", context: int | None = None) -> DataFrame:
    """0.5, plus 0.3 for an exact match; with ``context``, longer chunks are cut to that many characters around the match."""
    hit, cut = F.col(matched), F.col(chunk)
    if context:
        text, at = cut, F.position(hit, cut)
        start = F.greatest(at - context // 2 - 1, F.lit(0))
        end = F.least(F.length(text), at - 1 + F.length(hit) + context // 2)
        cut = F.when((F.length(text) > context) & (at > 0), F.substr(text, start + 1, end - start)).otherwise(text)
    return rows.withColumn("confidence", F.when(F.lower(hit) == F.lower("keyword"), F.lit(0.8)).otherwise(F.lit(0.5))).withColumn(
        chunk, T.trim_ws(cut))


def dedupe_spans(spans: Column) -> Column:
    """Left-to-right greedy: a span overlapping the last kept one replaces it only with higher confidence.

    Ties are broken by (start, -confidence, keyword).
    """
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), (-s["confidence"]).alias("neg"), s["keyword"].alias("keyword"), s["end"].alias("end"))))
    kind = "struct<start:int,neg:double,keyword:string,end:int>"
    mark = lambda start, end: F.struct(start.alias("start"), F.lit(0.0).alias("neg"), F.lit("").alias("keyword"), end.alias("end")).cast(kind)
    zero, after = mark(F.lit(-1), F.lit(-1)), mark(F.lit(2**31 - 1), F.lit(2**31 - 1))  # one behind all spans gives the last kept one out
    none = F.lit(None).cast(kind)

    def step(last, s):
        apart = s["start"] >= last["end"]
        return F.struct(F.when(apart | (s["neg"] < last["neg"]), s).otherwise(last).alias("state"), F.when(apart & (last["end"] >= 0), last).otherwise(none).alias("row"))

    kept = T.scan(F.array_append(ordered.cast(f"array<{kind}>"), after), zero, step, kind)
    return F.transform(kept, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["keyword"].alias("keyword"), (-s["neg"]).alias("confidence")))


def dedupe_overlaps(matches: DataFrame, key: str = "doc_id") -> DataFrame:
    """Overlap-free matches per document (columns start, end, keyword, confidence).

    A group is the matches of one text row, so it is bounded by that text.
    """
    spans = matches.groupBy(key).agg(F.collect_list(F.struct("start", "end", "keyword", "confidence")).alias("_s"))
    return spans.select(key, F.inline(dedupe_spans(F.col("_s"))))


def custom_patterns(df: DataFrame, patterns: dict[str, str], col: str = "text") -> DataFrame:
    """Matches of the user's own regular expressions, labelled by name."""
    found = F.concat(*[_tagged(F.col(col), p, n) for n, p in patterns.items()])
    return _with_context(df.select("doc_id", F.col(col).alias("_t"), F.inline(found)))


def ranked_pairs(grams: Column, keep: int) -> Column:
    """The most frequent word pairs of an array of them, as array<struct<neg,phrase>>: minus the count, then the pair."""
    counts = F.filter(T.tally(grams), lambda r: F.length(r["value"]) > 2)
    return F.slice(F.sort_array(F.transform(counts, lambda r: F.struct((-r["n"]).alias("neg"), r["value"].alias("phrase")))), 1, keep)


def top_phrases(df: DataFrame, keep: int = 10, col: str = "text") -> DataFrame:
    """Most frequent word pairs per document with their share, counted inside the row: no shuffle."""
    d = df.select("doc_id", T.bigrams(T.words(F.lower(F.col(col)))).alias("_g"))
    return d.select("doc_id", F.size("_g").alias("_n"), F.posexplode(ranked_pairs(F.col("_g"), keep)).alias("_i", "_r")).select(
        "doc_id", (F.col("_i") + 1).alias("rank"), "_r.phrase", (-F.col("_r.neg")).alias("frequency"),
        F.least(-F.col("_r.neg") / F.col("_n"), F.lit(1.0)).alias("importance"))


def phrase_scores(c: Column, keep: int = 15) -> Column:
    """Best word pairs of a text by length, name status and closeness to the middle.

    Any name is worth more than any other pair, so only names and the pairs next to the middle are scored and sorted.
    """
    def capital(w):
        return (w >= "A") & (w < "[")

    def scored(ws, n):
        def one(i):
            def row(g):
                name = g.rlike(r"\A[A-Z][a-z]+ [A-Z][a-z]+\z")
                value = (F.lit(0.4 * 2 / 5) + F.when(name, F.lit(0.4 * 0.5)).otherwise(F.lit(0.0))
                         + F.lit(0.2) * (F.lit(1.0) - F.abs(F.lit(0.5) - i / n)))
                return F.struct((-F.round(value, 9)).alias("neg"), i.alias("at"), g.alias("phrase"),
                                F.when(name, F.lit(1.0)).otherwise(F.lit(0.5)).alias("base_importance"))

            return T.let(F.concat_ws(" ", F.get(ws, i), F.get(ws, i + 1)), row)

        return one

    def ranked(ws, n):
        middle = F.shiftright(n, 1)
        low = F.greatest(middle - keep - 1, F.lit(0))
        near = F.sequence(low, F.greatest(F.least(middle + keep + 1, n - 2), low))
        names = F.filter(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: capital(F.get(ws, i)) & capital(F.get(ws, i + 1)))
        places = F.filter(F.array_union(names, near), lambda i: i + 1 < n)
        return F.when(n.isNotNull(), F.slice(F.sort_array(F.transform(places, scored(ws, n))), 1, keep))

    return T.let(T.words(c), lambda ws: T.let(F.size(ws), lambda n: ranked(ws, n)))


def phrase_importance(df: DataFrame, keep: int = 15, col: str = "text") -> DataFrame:
    return df.select("doc_id", F.posexplode(phrase_scores(F.col(col), keep)).alias("_i", "_p")).select(
        "doc_id", (F.col("_i") + 1).alias("rank"), "_p.phrase", (-F.col("_p.neg")).alias("importance"), "_p.base_importance")
