"""Queries: sources, intake and exports."""

from pyspark.sql import functions as F

from corpusloom import fixed_values as FV
from corpusloom.functions import text as T
from corpusloom.operators import analysis as AN, chunking as CH, dataset as DS, export as EXP, versions as VS
from corpusloom.registry.core import query
from corpusloom.registry.q_clean import para_chunks
from corpusloom.registry.q_dataset import ALL_FORMATS, RECORDS, REFV, records
from corpusloom.registry.q_score import ANC, CT_PICK
from corpusloom.registry.sqlbits import *  # noqa: F403
from corpusloom.session import scratch
from corpusloom.sources import readers as RD, tables as TB


@query("read_text_corpus", sql="SELECT doc_id, length(text) + 1 AS n_chars, md5(text || chr(10)) AS md5 FROM documents")
def read_text_corpus(spark, sf):
    """Every text written as a file of its own by Spark, then read back file by file."""
    path = scratch(spark, "corpus")
    d = TB.table(spark, sf, "documents").select("doc_id", "text")
    d = d.repartition(2 * spark.sparkContext.defaultParallelism, "doc_id")  # a file costs its making, whatever its size: all cores make them
    RD.write_text_corpus(d, path)
    return RD.corpus_texts(spark, path).select("doc_id", "n_chars", F.md5("text").alias("md5"))


PAGE_NAMES = [".html", ".PDF", ".txt", ".epub", ""]


@query("supported_format_filter", sql=f"""WITH n AS (SELECT page_id, 'site/page' || page_id || {pick(PAGE_NAMES, 'page_id')} AS name FROM pages)
SELECT page_id, name FROM n WHERE list_contains({lst(FV.SUPPORTED_EXTENSIONS)}, lower(regexp_extract(name, '(\\.[^./]+)$', 1)))""")
def supported_format_filter(spark, sf):
    p = TB.table(spark, sf, "pages").select("page_id", F.concat(F.lit("site/page"), F.col("page_id").cast("string"), TB._pick(PAGE_NAMES, F.col("page_id"))).alias("name"))
    return RD.supported_format_filter(p)


def _html(x):
    for p in ("(?s)<!--.*?-->", "(?is)<script[^>]*>.*?</script>", "(?is)<style[^>]*>.*?</style>", "<[^>]*>"):
        x = f"regexp_replace({x}, {q(p)}, '', 'g')"
    for e, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = f"replace({x}, {q(e)}, {q(c)})"
    return x


@query("html_to_text", sql=f"SELECT page_id, {_html('html')} AS text FROM pages")
def html_to_text(spark, sf):
    return TB.text_table(spark, sf, "pages", "page_id", "html").select("page_id", T.html_to_text(F.col("html")).alias("text"))


MIME = "CASE doc_id % 3 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'application/pdf' ELSE 'image/png' END"
BYTES = "CASE WHEN doc_id % 11 = 0 THEN 0 ELSE n_chars * 20000 END"


@query("file_intake_report", sql=f"""WITH f AS (SELECT doc_id, {BYTES} AS b, {MIME} AS k FROM documents), g AS (SELECT *, greatest(5, floor(b / 1000000 * 10)::BIGINT) AS s FROM f)
SELECT doc_id, CASE WHEN b = 0 THEN 'File appears to be empty' ELSE '' END AS errors, array_to_string(list_filter([CASE WHEN b > 50000000 THEN 'Large file - may take longer to process' END,
 CASE WHEN k = 'image/png' THEN 'File type ''image/png'' may not be fully supported' END, CASE WHEN s > 300 THEN 'Large file may take several minutes to process' END], lambda z: z IS NOT NULL), '|') AS warnings,
 array_to_string(list_filter([CASE WHEN b > 50000000 THEN 'Consider splitting into smaller sections for faster processing' END, CASE WHEN k = 'image/png' THEN 'Convert to PDF, TXT, DOCX, or MD for best results' END,
 CASE WHEN s > 300 THEN 'Consider processing during a break or in smaller chunks' END], lambda z: z IS NOT NULL), '|') AS recommendations, s AS estimated_seconds, b > 0 AS is_valid FROM g""")
def file_intake_report(spark, sf):
    d = TB.table(spark, sf, "documents").select("doc_id", F.expr(BYTES).alias("bytes"), F.expr(MIME).alias("mime_type"))
    r = RD.file_intake_report(d).drop("bytes", "mime_type")
    return r.select("doc_id", *[F.array_join(c, "|").alias(c) for c in ("errors", "warnings", "recommendations")], "estimated_seconds", "is_valid")


@query("intake_limits", sql=r"""WITH f AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'a.txt' ELSE 'b.PDF' END AS name, length(html) * 20000 AS b, page_id % 300 AS pages FROM pages)
SELECT page_id, CASE WHEN b / 1048576 > 100 THEN 'File too large (' || printf('%.1f', b / 1048576) || 'MB). Max: 100MB' WHEN name = 'a.txt' THEN 'Only PDF files supported for OCR'
 WHEN pages > 200 THEN 'Too many pages (' || pages || '). Max: 200' ELSE 'File validated successfully' END AS message, b / 1048576 <= 100 AND name <> 'a.txt' AND pages <= 200 AS is_valid FROM f""")
def intake_limits(spark, sf):
    p = TB.table(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 4 == 0, F.lit("a.txt")).otherwise(F.lit("b.PDF")).alias("name"),
                                            (F.length("html").cast("bigint") * 20000).alias("bytes"), (F.col("page_id") % 300).alias("pages"))
    return RD.intake_limits(p).select("page_id", "message", "is_valid")


@query("page_text_assembly", sql=f"""WITH u AS (SELECT conv_id AS doc, turn // 256 AS part_no, turn, text, length({trim('text')}) > 10 AND turn % 5 <> 3 AS ok FROM conversations)
SELECT doc, part_no, coalesce(string_agg('--- Page ' || turn || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) FILTER (ok), '') AS text, any_value(good) AS processed_pages, any_value(every) - any_value(good) AS skipped_pages,
 any_value(every) AS total_pages, {R('any_value(good) / any_value(every)')} AS success_rate FROM (SELECT *, count(*) OVER (PARTITION BY doc) AS every, count(*) FILTER (ok) OVER (PARTITION BY doc) AS good FROM u) GROUP BY 1, 2""")
def page_text_assembly(spark, sf):
    p = TB.doc_pages(spark, sf).withColumn("text", F.when(F.col("page_no") % 5 == 3, F.lit(" ")).otherwise(F.col("text")))
    return RD.page_text_assembly(p)


PG = f"pg AS (SELECT conv_id AS doc, turn, text, length({trim('text')}) > 50 AS tx FROM conversations), ps AS (SELECT doc, count(*) AS page_count, count(*) FILTER (turn < 5 AND tx) AS text_pages, count(*) FILTER (turn < 5 AND NOT tx) AS image_pages, sum(length(text))::BIGINT AS bytes FROM pg GROUP BY 1)"


@query("needs_ocr_flag", sql=f"WITH {PG} SELECT doc, page_count, text_pages, image_pages, image_pages > text_pages AS needs_ocr, {R('page_count * CASE WHEN image_pages > text_pages THEN 2.0 ELSE 0.1 END')} AS estimated_minutes FROM ps")
def needs_ocr_flag(spark, sf):
    return RD.needs_ocr_flag(TB.doc_pages(spark, sf))


@query("intake_confidence", sql=f"""WITH {PG} SELECT doc, text_pages > 0 AS has_text, CASE WHEN bytes > 209715200 THEN 'File too large (>200MB)' WHEN bytes < 100 THEN 'File too small' WHEN page_count > 500 THEN 'PDF too large (>500 pages)' ELSE 'PDF validation passed' END AS message,
 CASE WHEN text_pages > 0 THEN 0.9 WHEN image_pages > 0 THEN 0.7 ELSE 0.3 END::DOUBLE AS confidence_score, bytes BETWEEN 100 AND 209715200 AND page_count <= 500 AS is_valid FROM ps""")
def intake_confidence(spark, sf):
    return RD.intake_confidence(TB.doc_pages(spark, sf)).select("doc", "has_text", "message", "confidence_score", "is_valid")


@query("coerce_content", sql="SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END AS plain, array_to_string(string_split(text, ' '), chr(10)) AS listed, '{\"doc_id\":' || doc_id || ',\"n\":' || n_chars || '}' AS record, n_chars::VARCHAR AS number FROM documents")
def coerce_content(spark, sf):
    d = TB.table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("text")).alias("plain"), F.split("text", " ").alias("listed"),
        F.struct("doc_id", F.col("n_chars").alias("n")).alias("record"), F.col("n_chars").alias("number"))
    return d.select("doc_id", *[RD.coerce_content(d, c).alias(c) for c in ("plain", "listed", "record", "number")])


# --- exports -----------------------------------------------------------------------------------------

def _recs(spark, sf):
    return records(spark, sf).drop("chunk_id")


@query("export_json", sql=f"{RECORDS} SELECT id, format_type, input_text, output_text, quality_score FROM records")
def export_json(spark, sf):
    path = scratch(spark, "export-json")
    EXP.write_json(_recs(spark, sf), path, "gzip")  # a chunk is repeated in every format, so this shrinks it to a fraction
    return spark.read.schema("id string, format_type string, input_text string, output_text string, quality_score double").json(f"{path}/content")


@query("export_jsonl", sql="""SELECT '{"doc_id":' || doc_id || ',"text":' || CAST(to_json(text) AS VARCHAR) || ',"lang":"' || lang || '","n_chars":' || n_chars || '}' AS line FROM documents""")
def export_jsonl(spark, sf):
    return EXP.jsonl(TB.table(spark, sf, "documents").select("doc_id", "text", "lang", "n_chars"))


@query("export_csv", sql=f"SELECT doc_id, text, len(string_split(text, chr(10))) AS lines, to_json({W('text')}[1:3])::VARCHAR AS first_words FROM documents")
def export_csv(spark, sf):
    path = scratch(spark, "export-csv")
    d = TB.documents(spark, sf).withColumn("lines", F.size(F.split("text", "\n"))).withColumn("first_words", F.slice(T.words(F.col("text")), 1, 3))
    EXP.write_csv(d, path)
    return EXP.read_csv(spark, path, "doc_id bigint, text string, lines int, first_words string")


NUM = f"{RECORDS}, nr AS (SELECT *, row_number() OVER (ORDER BY id) AS item_no FROM records)"


@query("export_markdown", sql=f"""{NUM}, b AS (SELECT item_no, '### Item ' || item_no || chr(10) || chr(10) || '**Input:** ' || input_text || chr(10) || chr(10) || '**Output:** ' || output_text || chr(10) || chr(10) || '*Quality Score: ' || printf('%.2f', quality_score) || '*' || chr(10) || chr(10) || '---' || chr(10) AS block FROM nr)
SELECT item_no, length(block) AS n_chars, md5(block) AS md5 FROM b""")
def export_markdown(spark, sf):
    return EXP.render(_recs(spark, sf), "markdown", ["id"]).select("item_no", F.length("block").alias("n_chars"), F.md5("block").alias("md5"))


@query("export_txt", sql=f"""{NUM}, b AS (SELECT item_no, 'ITEM ' || item_no || chr(10) || '--------------------' || chr(10) || chr(10) || 'INPUT: ' || input_text || chr(10) || chr(10) || 'OUTPUT: ' || output_text || chr(10) || chr(10) AS block FROM nr)
SELECT item_no, length(block) AS n_chars, md5(block) AS md5 FROM b""")
def export_txt(spark, sf):
    return EXP.render(_recs(spark, sf), "txt", ["id"], quality=None).select("item_no", F.length("block").alias("n_chars"), F.md5("block").alias("md5"))


@query("export_grouped_markdown", sql=f"""{RECORDS}, g AS (SELECT format_type, id, CASE WHEN row_number() OVER (PARTITION BY format_type ORDER BY id) = 1 THEN '## ' || format_type || chr(10) || chr(10) ELSE '' END || '### ' || id || chr(10) || chr(10) || output_text || chr(10) || chr(10) || '---' || chr(10) || chr(10) AS block FROM records)
SELECT format_type, id, length(block) AS n_chars, md5(block) AS md5 FROM g""")
def export_grouped_markdown(spark, sf):
    return EXP.grouped_markdown(_recs(spark, sf), "format_type", ["id"], "id", "output_text").select(
        "format_type", "id", F.length("block").alias("n_chars"), F.md5("block").alias("md5"))


@query("export_bundle", sql=f"""{NUM}, b AS (SELECT '### Item ' || item_no || chr(10) || chr(10) || '**Input:** ' || input_text || chr(10) || chr(10) || '**Output:** ' || output_text || chr(10) || chr(10) || '*Quality Score: ' || printf('%.2f', quality_score) || '*' || chr(10) || chr(10) || '---' || chr(10) AS md,
 'ITEM ' || item_no || chr(10) || '--------------------' || chr(10) || chr(10) || 'INPUT: ' || input_text || chr(10) || chr(10) || 'OUTPUT: ' || output_text || chr(10) || chr(10) AS tx, id || chr(10) || format_type || chr(10) || input_text || chr(10) || output_text AS fields FROM nr),
l AS (SELECT 'json' AS format, fields AS v FROM b UNION ALL SELECT 'csv', fields FROM b UNION ALL SELECT 'markdown', unnest(string_split(md, chr(10))) FROM b UNION ALL SELECT 'txt', unnest(string_split(tx, chr(10))) FROM b)
SELECT format, count(*) AS lines, sum(('0x' || left(md5(v), 8))::BIGINT)::BIGINT AS checksum FROM l GROUP BY 1""")
def export_bundle(spark, sf):
    """Four formats written, read back and compared by content: rows of json and csv, lines of markdown and text."""
    path = scratch(spark, "bundle")
    # ids begin with the chunk and a bar, so records by id are chunks by these, each with its records in order
    chunks = para_chunks(spark, sf).select("chunk_id", "text", F.concat("chunk_id", F.lit("_")).alias("begins"))
    EXP.write_bundle(chunks, path, ["begins"], rows=DS.training_rows(ALL_FORMATS))
    fields = F.concat_ws("\n", "id", "format_type", "input_text", "output_text")
    kind = "id string, format_type string, input_text string, output_text string, quality_score double"
    back = {"json": spark.read.schema(kind).json(f"{path}/json").select(fields.alias("v")),
            "csv": EXP.read_csv(spark, f"{path}/csv", kind).select(fields.alias("v")),
            **{f: spark.read.text(f"{path}/{f}").select(F.col("value").alias("v")) for f in ("markdown", "txt")}}
    lines = [d.select(F.lit(f).alias("format"), "v") for f, d in back.items()]
    every = lines[0].unionByName(lines[1]).unionByName(lines[2]).unionByName(lines[3])
    return every.groupBy("format").agg(F.count("*").alias("lines"), F.sum(F.conv(F.left(F.md5("v"), F.lit(8)), 16, 10).cast("bigint")).alias("checksum"))


@query("export_history", sql=f"""WITH {REFV} SELECT content_id, version, '## Version ' || version || chr(10) || chr(10) || '**Refinement Type:** ' || refinement_type || chr(10) || chr(10) || '**Quality Improvement:** +' || printf('%.1f', round_even(round(quality_gain * 100, 6), 1)) || '%' || chr(10) || chr(10) || '**Content:**' || chr(10) || content || chr(10) || chr(10) || '---' || chr(10) || chr(10) AS block FROM rv""")
def export_history(spark, sf):
    return EXP.history_rows(VS.assign_versions(TB.refinements(spark, sf)))


@query("export_chunks_for_ai", sql=f"""{ANC} SELECT chunk_id, sm.text, n AS word_count, {CT_PICK} AS content_type, {R('semantic_density')} AS semantic_density, {R('blend')} AS coherence_score, {R('rs')} AS readability_score FROM sm JOIN ct USING (chunk_id)""")
def export_chunks_for_ai(spark, sf):
    a = AN.analyze_chunks(para_chunks(spark, sf)).withColumnRenamed("n_words", "word_count").withColumn(
        "token_count", CH.token_estimate(F.col("word_count"))).withColumn("narrative_position", F.lit(0.0))
    return EXP.chunks_for_ai(a, False).select("chunk_id", "text", "word_count", "content_type", "quality_scores.semantic_density",
                                              "quality_scores.coherence_score", "quality_scores.readability_score")


@query("export_preview", sql="""SELECT doc_id, CASE WHEN length(l) > 1000 THEN substr(l, 1, 1000) || '...' ELSE l END AS preview FROM (SELECT doc_id, '{"doc_id":' || doc_id || ',"text":' || CAST(to_json(text) AS VARCHAR) || ',"lang":"' || lang || '","source":"' || source || '","n_chars":' || n_chars || '}' AS l FROM documents ORDER BY doc_id LIMIT 3)""")
def export_preview(spark, sf):
    return EXP.preview(TB.table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars"), ["doc_id"], 3)


@query("export_size_estimate", sql="""WITH l AS (SELECT length('{"doc_id":' || doc_id || ',"text":' || CAST(to_json(text) AS VARCHAR) || ',"lang":"' || lang || '","n_chars":' || n_chars || '}') AS n FROM documents)
SELECT count(*) AS total_items, sum(n)::BIGINT AS estimated_size, sum(n) > 1048576 AS compression_recommended FROM l""")
def export_size_estimate(spark, sf):
    return EXP.size_estimate(TB.table(spark, sf, "documents").select("doc_id", "text", "lang", "n_chars"))


@query("register_text_functions", sql=f"""SELECT doc_id, {NWORDS('text')} AS words, len({S('text')}) AS sentences, {R(f"{NWORDS('text')} / 200")} AS minutes,
 {grade("(doc_id % 11) / 10")} AS grade, {route("(doc_id % 11) / 10")} AS route, {R("greatest(0.0, 1 - abs((doc_id % 11) / 10 - 1.35) / 1.35)")} AS ratio_score FROM documents""")
def register_text_functions(spark, sf):
    from corpusloom.functions.sqlnames import register_text_functions as register
    register(spark)
    TB.documents(spark, sf).createOrReplaceTempView("loom_documents")
    return spark.sql("""SELECT doc_id, text_word_count(text) AS words, size(text_sentences(text)) AS sentences, text_reading_minutes(text) AS minutes,
        quality_grade(CAST(doc_id % 11 AS DOUBLE) / 10) AS grade, quality_route(CAST(doc_id % 11 AS DOUBLE) / 10) AS route, length_ratio_score(CAST(doc_id % 11 AS DOUBLE) / 10) AS ratio_score FROM loom_documents""")
