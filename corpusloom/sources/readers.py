"""Readers for text corpora and intake checks over file facts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom import fixed_values as FV
from corpusloom.functions import text as T
from corpusloom.sources.files import write_each


def _local(spark: SparkSession, path: str) -> str | None:
    """The path in the file system of the machine, or None where ``path`` lies in another store."""
    kind = re.match(r"([A-Za-z][\w+.-]*):", path)
    if (kind.group(1) if kind else spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:").split(":")[0]) != "file":
        return None
    return re.sub(r"^file:(?://(?=/))?", "", path)


def write_text_corpus(df: DataFrame, path: str) -> None:
    """Every text (doc_id, text) as a file of its own below ``path``, closed by a line end; missing texts lie apart.

    In a folder of the machine the tasks make the files themselves: the writer of Spark starts processes for each file there, to set its rights.
    """
    rows = df.select(F.col("doc_id").alias("_id"), F.col("text").cast("binary").alias("_text"))
    if (root := _local(df.sparkSession, path)) is not None:
        rows.mapInArrow(write_each(root), "n long").agg(F.sum("n")).collect()
    else:
        df.select("doc_id", "text", F.col("text").isNull().alias("missing")).write.partitionBy("missing", "doc_id").text(path)


def corpus_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text, n_chars) of the files that :func:`write_text_corpus` wrote."""
    text = F.when(~F.contains("path", F.lit("/missing=true/")), F.col("text"))
    return read_text_corpus(spark, path).select(F.regexp_extract("path", r"/doc_id=(-?\d+)[./]", 1).cast("bigint").alias("doc_id"), text.alias("text"), F.length(text).alias("n_chars"))


def read_text_corpus(spark: SparkSession, path: str, suffixes=("txt", "md")) -> DataFrame:
    """One document per text or markdown file below ``path``: (path, text, n_chars)."""
    glob = "*.{" + ",".join(suffixes) + "}"
    files = spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.length("value").alias("n_chars"))


def file_facts(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes) of every file below ``path``; the contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("name"), F.col("length").alias("bytes"))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1))


def supported_format_filter(df: DataFrame, name: str = "name", formats=None) -> DataFrame:
    return df.filter(extension(F.col(name)).isin(*(formats or FV.SUPPORTED_EXTENSIONS)))


def coerce_content(df: DataFrame, col: str) -> Column:
    """Any column as text: null as '', arrays joined by newlines, structs and maps as JSON."""
    kind = df.schema[col].dataType.typeName()
    c = F.col(col)
    if kind == "array":
        out = F.array_join(F.transform(c, lambda x: x.cast("string")), "\n", "None")
    elif kind in ("struct", "map", "variant"):
        out = F.to_json(c)
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit(""))


# --- intake ---------------------------------------------------------------------------

def processing_seconds(size: Column) -> Column:
    """Ten seconds per million bytes, at least five."""
    return F.greatest(F.lit(5), F.floor(size / 1_000_000 * 10).cast("int"))


def file_intake_report(df: DataFrame, size: str = "bytes", kind: str = "mime_type") -> DataFrame:
    """Errors, warnings, recommendations and time estimate per file."""
    s, k = F.col(size), F.col(kind)
    big, odd, slow = s > FV.MAX_FILE_BYTES, ~k.isin(*FV.SUPPORTED_MIME_TYPES), processing_seconds(s) > 300
    return (
        df.withColumn("errors", T.present(F.when(s == 0, F.lit("File appears to be empty"))))
        .withColumn("warnings", T.present(
            F.when(big, F.lit("Large file - may take longer to process")),
            F.when(odd, F.concat(F.lit("File type '"), k, F.lit("' may not be fully supported"))),
            F.when(slow, F.lit("Large file may take several minutes to process"))))
        .withColumn("recommendations", T.present(
            F.when(big, F.lit("Consider splitting into smaller sections for faster processing")),
            F.when(odd, F.lit("Convert to PDF, TXT, DOCX, or MD for best results")),
            F.when(slow, F.lit("Consider processing during a break or in smaller chunks"))))
        .withColumn("estimated_seconds", processing_seconds(s)).withColumn("is_valid", s > 0))


def intake_limits(df: DataFrame, max_mb: int = FV.MAX_INTAKE_MB, max_pages: int = FV.MAX_INTAKE_PAGES) -> DataFrame:
    """(is_valid, message) by size, type and page count; needs name, bytes, pages."""
    mb = F.col("bytes") / (1024 * 1024)
    message = (
        F.when(mb > max_mb, F.concat(F.lit("File too large ("), F.format_string("%.1f", F.bround(mb, 1)), F.lit(f"MB). Max: {max_mb}MB")))
        .when(extension(F.col("name")) != ".pdf", F.lit("Only PDF files supported for OCR"))
        .when(F.col("pages") > max_pages, F.concat(F.lit("Too many pages ("), F.col("pages").cast("string"), F.lit(f"). Max: {max_pages}")))
        .otherwise(F.lit("File validated successfully")))
    return df.withColumn("message", message).withColumn("is_valid", F.col("message") == "File validated successfully")


PAGES_PER_PART = 256


def page_text_assembly(pages: DataFrame, min_chars: int = 10, headers: bool = True, part: int = PAGES_PER_PART) -> DataFrame:
    """Page texts joined in order with counts of used and skipped pages.

    A document comes out in parts of ``part`` consecutive page numbers, so that one task never
    holds more than that many pages; documents within the intake limit have a single part.  Counts and rate are
    those of the whole document, on each of its parts.
    """
    t = T.trim_ws(F.coalesce("text", F.lit("")))
    body = F.concat(F.lit("--- Page "), F.col("page_no").cast("string"), F.lit(" ---\n"), "text") if headers else F.col("text")
    used = F.length(t) > min_chars
    rows = pages.withColumn("part_no", F.floor(F.col("page_no") / part)).select(
        "doc", "part_no", "page_no", used.alias("_u"), F.when(used, body).alias("_b"))
    got = rows.groupBy("doc", "part_no").agg(
        F.array_sort(F.collect_list(F.when(F.col("_u"), F.struct("page_no", "_b")))).alias("_p"))
    totals = rows.groupBy("doc").agg(F.count_if("_u").alias("processed_pages"), F.count("*").alias("total_pages"))
    return got.join(totals, "doc").select(
        "doc", "part_no", F.array_join(F.transform("_p", lambda r: r["_b"]), "\n\n").alias("text"), "processed_pages",
        (F.col("total_pages") - F.col("processed_pages")).alias("skipped_pages"), "total_pages",
        T.ratio(F.col("processed_pages"), F.col("total_pages")).alias("success_rate"))


def page_sample(pages: DataFrame, first: int = 5) -> DataFrame:
    """Text and image pages among the first pages, and the page count, per document.

    Pages are numbered from 0, so "the first five" is a filter on the number, not a window.
    """
    head = F.col("page_no") < first
    texty = F.length(T.trim_ws(F.coalesce("text", F.lit("")))) > 50
    return pages.groupBy("doc").agg(F.sum(F.length("text")).alias("bytes"), F.count("*").alias("page_count"), F.count_if(head & texty).alias("text_pages"), F.count_if(head & ~texty).alias("image_pages"))


def needs_ocr_flag(pages: DataFrame) -> DataFrame:
    need = F.col("image_pages") > F.col("text_pages")
    return page_sample(pages).drop("bytes").withColumn("needs_ocr", need).withColumn(
        "estimated_minutes", F.col("page_count") * F.when(F.col("needs_ocr"), F.lit(2.0)).otherwise(F.lit(0.1)))


def intake_confidence(pages: DataFrame) -> DataFrame:
    """Gates on size and page count, and a confidence: text 0.9, readable images 0.7, else 0.3."""
    per, size = page_sample(pages), "bytes"
    has = F.col("text_pages") > 0
    message = (F.when(F.col(size) > 200 * 1024 * 1024, F.lit("File too large (>200MB)")).when(F.col(size) < 100, F.lit("File too small"))
               .when(F.col("page_count") > 500, F.lit("PDF too large (>500 pages)")).otherwise(F.lit("PDF validation passed")))
    return per.withColumn("has_text", has).withColumn("message", message).withColumn(
        "confidence_score", F.when(has, F.lit(0.9)).when(F.col("image_pages") > 0, F.lit(0.7)).otherwise(F.lit(0.3))).withColumn(
        "is_valid", F.col("message") == "PDF validation passed")
