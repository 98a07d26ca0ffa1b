"""The given tables and the logical inputs derived from them.

Every derived input is a row-wise projection or an equi-join of whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.functions import text as T
from corpusloom.plans.skew import spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def text_table(spark: SparkSession, sf: str, name: str, *cols: str) -> DataFrame:
    """The named columns of a table of texts, spread over the cores where the session asks for it."""
    return spread(table(spark, sf, name).select(*cols))


def documents(spark, sf) -> DataFrame:
    return text_table(spark, sf, "documents", "doc_id", "text")


# Lines put before and after a document so that every structural pattern occurs.
HEADS = [
    "Chapter 7\n\n", "THE OLD AND NEW WORLD\n\n", "3. Third part\n\n", "## Notes\n\n",
    "Ada Lovelace wrote on the idea of freedom and the nature of truth.\n\n",
]
TAILS = [
    "\n\nWhat is knowledge about art? However, \"it was like this\" said Alan Turing of Acme Corp. "
    "Then Ada Lovelace met Alan Turing in New York City!",
    "\n\nBob Stone: 'stop' she said. \"Not now\" and 'later' he replied. Because it was good, they love it.",
    "\n\n1. one thing\n2. another thing\n- first item\n• second item\n* third item\nName: value of it\n\n"
    "Finally, in conclusion, on the other hand it ended.",
    "\n\nGrowth and development of learning. For example the idea of freedom and the nature of truth; therefore a bad choice was made "
    "by Ada Lovelace and Alan Turing.\n\n42\n\nCopyright page of it all",
]


def _pick(values: list[str], by) -> "F.Column":
    return F.element_at(T.lit_array(values), (F.pmod(by, F.lit(len(values))) + 1).cast("int"))


def marked_documents(spark, sf) -> DataFrame:
    """Documents with blank-line paragraphs, headings, lists, speech, questions and names."""
    d = documents(spark, sf)
    return d.select("doc_id", F.concat(
        _pick(HEADS, F.col("doc_id")), F.replace("text", F.lit("\n"), F.lit("\n\n")),
        _pick(TAILS, F.col("doc_id"))).alias("text"))


def turns(spark, sf) -> DataFrame:
    return text_table(spark, sf, "conversations", "conv_id", "turn", "role", "text")


def pairs(spark, sf) -> DataFrame:
    """A user turn and the assistant turn right after it.

    Turns are numbered without gaps, so "right after" is an equi-join on
    (conv_id, turn), whose keys are unique: a very long conversation spreads evenly.
    """
    t = turns(spark, sf)
    q = t.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("original"))
    a = t.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                              F.col("text").alias("enhanced"))
    return q.join(a, ["conv_id", "turn"]).select(
        F.concat_ws("_", "conv_id", "turn").alias("pair_id"), "conv_id", "turn", "original", "enhanced")


QA_STYLES = [("Q: ", "A: "), ("Question: ", "Answer: "), ("Visitor: ", "Teacher: ")]


def qa_documents(spark, sf) -> DataFrame:
    """One text per pair: a question line and an answer line in one of four styles, then a closing paragraph.

    Style 3 has no labels, so such a text is plain prose.
    """
    def plain(c):
        return T.trim_ws(F.regexp_replace(c, r"[\s:—\-]+", " "))

    p = pairs(spark, sf).select("pair_id", F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4)).cast("int").alias("style"),
                                plain(F.col("original")).alias("u"), plain(F.col("enhanced")).alias("a"))
    q_lead = F.when(F.col("style") == 3, F.lit("")).otherwise(_pick([s[0] for s in QA_STYLES], F.col("style")))
    a_lead = F.when(F.col("style") == 3, F.lit("")).otherwise(_pick([s[1] for s in QA_STYLES], F.col("style")))
    return p.withColumn("text", F.concat(q_lead, F.col("u"), F.lit("\n"), a_lead, F.col("a"),
                                         F.lit("\n\nAs a closing remark on this: "), F.col("u")))


#: Labels of a question line and an answer line.
DIALOGUE_STYLES = [("Q: ", "A: "), ("Question: ", "Answer: "), ("Q7: ", "A7: "), ("Interviewer: ", "Guest: "), ("Host: ", "Guest: "),
                   ("Visitor: ", "Teacher: "), ("Student: ", "Teacher: "), ("Seeker: ", "Sage: ")]


def dialogue_documents(spark, sf) -> DataFrame:
    """Every document as a dialogue of its lines: each two of them become a question and an answer, in one of eight labelled styles by turns.

    Every tenth document is one open question with an answer paragraph, every tenth one a numbered question.  Signs that the labels and
    questions stand out by are taken out of the lines.  Documents of fewer than two lines are as empty.
    """
    raw = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: T.trim_ws(F.regexp_replace(x, r"[\s:—\-?0-9]+", " ")))
    d = documents(spark, sf).select("doc_id", F.filter(raw, lambda x: x != "").alias("ls"))
    leads = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(a).alias("a")) for q, a in DIALOGUE_STYLES])
    n = F.size("ls")

    def block(k):
        at = F.get(leads, F.pmod(F.col("doc_id") + k, F.lit(len(DIALOGUE_STYLES))).cast("int"))
        return F.concat(at["q"], F.get("ls", 2 * k), F.lit("\n"), at["a"], F.get("ls", 2 * k + 1))

    pairs_of = F.transform(F.sequence(F.lit(0), F.floor(n / 2).cast("int") - 1), block)
    rest = F.when(n % 2 == 1, F.array(F.element_at("ls", -1))).otherwise(F.array().cast("array<string>"))
    question, answer = F.array_join(F.slice("ls", 1, n - 1), " "), F.element_at("ls", -1)
    kind = F.pmod("doc_id", F.lit(10))
    text = (F.when(n < 2, F.lit("")).when(kind == 8, F.concat(question, F.lit("?\n\n"), answer))
            .when(kind == 9, F.concat(F.lit("1. "), question, F.lit("?\n"), answer)).otherwise(F.array_join(F.concat(pairs_of, rest), "\n\n")))
    return d.select("doc_id", text.alias("text"))


def doc_pages(spark, sf) -> DataFrame:
    return turns(spark, sf).select(F.col("conv_id").alias("doc"), F.col("turn").alias("page_no"), "text")


def page_results(spark, sf) -> DataFrame:
    """Page recognition results: one row per turn with confidence, method, language and warnings."""
    n = F.length("text")
    return turns(spark, sf).select(
        F.col("conv_id").alias("doc"), F.col("turn").alias("page_no"), "text",
        (40 + F.pmod(n, F.lit(60))).cast("double").alias("confidence"),
        _pick(["text", "ocr", "hybrid"], n).alias("method"),
        _pick(["en", "fr", "de"], F.col("conv_id") * (F.col("turn") % 2)).alias("language"),
        T.present(F.when(n % 2 == 0, F.lit("Low contrast")), F.when(n % 5 == 0, F.lit("Skewed page"))).alias("warnings"))


def _k():
    return F.get_json_object("props", "$.k").cast("int")


def _events(spark, sf) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def samples(spark, sf) -> DataFrame:
    return _events(spark, sf).select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("content_id"), "ts",
        F.least(F.lit(1.0), F.col("value") / 100).alias("quality_score"),
        F.col("value").alias("processing_time"), _k().alias("word_count"), F.col("event_type").alias("stage"))


def audit(spark, sf) -> DataFrame:
    return _events(spark, sf).select(
        "event_id", "ts", F.col("user_id").alias("session_id"), "event_type", F.col("event_type").alias("model"),
        (F.col("value") / 1000).alias("cost_usd"), _k().alias("total_tokens"))


def operations(spark, sf) -> DataFrame:
    return _events(spark, sf).select(
        "event_id", "ts", F.col("event_type").alias("name"), F.col("value").alias("duration"),
        _k().cast("double").alias("memory_delta"), F.lit(50.0).alias("expected_duration"))


ERROR_NAMES = ["network", "api", "file_io", "processing", "validation", "memory", "timeout", "user_input", "system"]
ERROR_TEXTS = [
    "Connection refused by host", "HTTP status 429", "Permission denied", "Out of memory", "Timed out",
    "Read timeout", "Schema mismatch", "Bad parameter", "Something odd",
]


def errors(spark, sf) -> DataFrame:
    return _events(spark, sf).filter("event_type = 'error'").select(
        "event_id", "ts", F.col("user_id").alias("context"), _pick(ERROR_NAMES, _k()).alias("category"),
        _pick(ERROR_TEXTS, _k()).alias("message"))


def error_messages(spark, sf) -> DataFrame:
    """An error message and context for every event."""
    return _events(spark, sf).select(
        "event_id", _pick(ERROR_TEXTS, _k()).alias("message"),
        F.when(F.col("event_type") == "click", F.lit("chunking")).otherwise(F.lit("upload")).alias("context"),
        F.when(F.col("event_type") == "view", F.lit("ImportError")).otherwise(F.lit("ValueError")).alias("error_type"))


def requests(spark, sf) -> DataFrame:
    """Every event as a request of a user that may have failed, with its message."""
    return _events(spark, sf).select(
        F.col("user_id").alias("operation"), (F.col("event_type") == "error").alias("failed"), _pick(ERROR_TEXTS, _k()).alias("message"))


def refinements(spark, sf) -> DataFrame:
    return _events(spark, sf).select(
        "event_id", F.col("user_id").alias("content_id"), F.col("event_type").alias("refinement_type"),
        F.least(F.lit(0.5), F.col("value") / 1000).alias("quality_gain"), "ts",
        F.concat(F.lit("text of "), F.repeat(F.lit("word "), F.pmod(_k(), F.lit(7)))).alias("content"))
