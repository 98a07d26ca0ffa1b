"""Exports: rendered rows and distributed writes with a one-row manifest.

Item numbers come from ``plans.ordered`` when a global numbering is wanted, so
that no task sorts the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.functions import text as T
from corpusloom.plans.ordered import in_order, kept, numbered, remove


def jsonl(df: DataFrame) -> DataFrame:
    """One JSON object per row in column ``line``."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("line"))


def flat_csv(df: DataFrame) -> DataFrame:
    """Complex columns as JSON strings, so that every cell is plain text."""
    cols = []
    for f in df.schema.fields:
        complex_ = f.dataType.typeName() in ("array", "map", "struct", "variant")
        cols.append((F.to_json(f.name) if complex_ else F.col(f.name)).alias(f.name))
    return df.select(*cols)


#: Cell of a missing value; a text that reads so gets one more backslash, which :func:`read_csv` takes away.
CSV_NULL = "\\N"


def _texts(df: DataFrame, pattern: str, to: str) -> DataFrame:
    def one(c):
        return F.when(F.startswith(c, F.lit("\\")) & F.endswith(c, F.lit("N")), F.regexp_replace(c, pattern, to)).otherwise(c)

    return df.withColumns({f.name: one(F.col(f"`{f.name}`")) for f in df.schema.fields if f.dataType.typeName() == "string"})


def markdown_block(n: Column, inp: Column, out: Column, quality: Column | None = None) -> Column:
    parts = [F.concat(F.lit("### Item "), n.cast("string")), F.lit(""), F.concat(F.lit("**Input:** "), inp), F.lit(""), F.concat(F.lit("**Output:** "), out), F.lit("")]
    if quality is not None:
        parts += [F.concat(F.lit("*Quality Score: "), F.format_string("%.2f", F.bround(quality, 2)), F.lit("*")), F.lit("")]
    return F.concat_ws("\n", *parts, F.lit("---"), F.lit(""))


def txt_block(n: Column, inp: Column, out: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("ITEM "), n.cast("string")), F.lit("-" * 20), F.lit(""), F.concat(F.lit("INPUT: "), inp), F.lit(""),
                       F.concat(F.lit("OUTPUT: "), out), F.lit(""), F.lit(""))


def render(df: DataFrame, kind: str, order: list[str], inp: str = "input_text", out: str = "output_text", quality: str | None = "quality_score") -> DataFrame:
    """Numbered blocks (item_no, block) as markdown or plain text."""
    return _blocks(numbered(df, [], order, "item_no"), kind, inp, out, quality)


def _blocks(d: DataFrame, kind: str, inp: str = "input_text", out: str = "output_text", quality: str | None = "quality_score") -> DataFrame:
    n = F.col("item_no")
    block = markdown_block(n, F.col(inp), F.col(out), F.col(quality) if quality else None) if kind == "markdown" else txt_block(n, F.col(inp), F.col(out))
    return d.select("item_no", block.alias("block"))


def grouped_markdown(df: DataFrame, group: str, order: list[str], title: str, body: str) -> DataFrame:
    """Blocks with a group header on the first row of each group.

    Rows sorted by group need a header exactly where the number within the group is 1.
    """
    d = numbered(df, [group], order, "_n")
    head = F.when(F.col("_n") == 1, F.concat(F.lit("## "), F.col(group), F.lit("\n\n"))).otherwise(F.lit(""))
    return d.select(group, *order, F.concat(head, F.lit("### "), F.col(title), F.lit("\n\n"), F.col(body), F.lit("\n\n---\n\n")).alias("block"))


def history_rows(df: DataFrame, key: str = "content_id") -> DataFrame:
    """Refinement history as markdown rows in version order."""
    block = F.concat(F.lit("## Version "), F.col("version").cast("string"), F.lit("\n\n**Refinement Type:** "), "refinement_type",
                     F.lit("\n\n**Quality Improvement:** +"), F.format_string("%.1f", F.bround(F.round(F.col("quality_gain") * 100, 6), 1)), F.lit("%\n\n**Content:**\n"), "content", F.lit("\n\n---\n\n"))
    return df.select(key, "version", block.alias("block"))


def chunks_for_ai(df: DataFrame, include_context: bool = True) -> DataFrame:
    """Nested export record: scores and, when wanted, context structs."""
    cols = ["chunk_id", "text", "word_count", "token_count", "content_type", "narrative_position",
            F.struct("semantic_density", "coherence_score", "readability_score", "dialogue_potential").alias("quality_scores"), "themes", "concepts"]
    if include_context:
        cols.append(F.struct(F.col("preceding_context").alias("preceding"), F.col("following_context").alias("following")).alias("context"))
    return df.select(*cols)


def preview(df: DataFrame, order: list[str], n: int = 3, cut: int = 1000) -> DataFrame:
    """First ``n`` rows (top-k, not a full sort), rendered as JSON and cut."""
    first = df.orderBy(*order).limit(n)
    line = F.to_json(F.struct(*df.columns))
    return first.select(*order, F.when(F.length(line) > cut, F.concat(F.substring(line, 1, cut), F.lit("..."))).otherwise(line).alias("preview"))


def size_estimate(df: DataFrame) -> DataFrame:
    """Characters of all rows as JSON, in one scan; compression is advised above one megabyte."""
    n = F.length(F.to_json(F.struct(*df.columns))).cast("bigint")
    d = df.agg(F.count("*").alias("total_items"), F.coalesce(F.sum(n), F.lit(0)).alias("estimated_size"))
    return d.withColumn("compression_recommended", F.col("estimated_size") > 1024 * 1024)


# --- writes -------------------------------------------------------------------------------

def _packed(compression: str) -> dict[str, str]:
    """Writer options: gzip at its fastest, which still finds what is repeated and takes a fraction of the time."""
    return {"compression": compression, "zlib.compress.level": "BEST_SPEED"}


def manifest(df: DataFrame, formats: list[str], of_row: int = 1) -> DataFrame:
    return df.agg((F.count("*") * of_row).alias("total_items")).select(
        F.current_timestamp().alias("export_timestamp"), "total_items", F.lit(",".join(formats)).alias("formats_included"))


def write_json(df: DataFrame, path: str, compression: str = "none") -> None:
    df.write.mode("overwrite").options(**_packed(compression)).json(f"{path}/content")
    manifest(df, ["json"]).write.mode("overwrite").json(f"{path}/manifest")


def write_jsonl(df: DataFrame, path: str, compression: str = "none") -> None:
    jsonl(df).write.mode("overwrite").options(**_packed(compression)).text(path)


def write_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    """Every cell quoted; an empty text is an empty cell, a missing value the cell ``CSV_NULL``."""
    _texts(flat_csv(df), r"\A(\\+N)\z", r"\\$1").write.mode("overwrite").options(
        **_packed(compression), header=True, quoteAll=True, escape='"', nullValue=CSV_NULL,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)  # the writer trims by default


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What :func:`write_csv` wrote, with empty texts and missing values apart."""
    return _texts(spark.read.options(header=True, multiLine=True, escape='"', nullValue=CSV_NULL).schema(schema).csv(path), r"\A\\(\\+N)\z", "$1")


def write_blocks(df: DataFrame, kind: str, path: str, order: list[str], compression: str = "none", rows: list[Column] | None = None) -> None:
    """Blocks in item order across the part files: rows are shuffled once, to where they are numbered and written."""
    _blocks(in_order(df, order, "item_no", rows=rows), kind).select(F.col("block").alias("value")).write.mode("overwrite").options(**_packed(compression)).text(path)


def write_bundle(df: DataFrame, path: str, order: list[str], formats=("json", "csv", "markdown", "txt"), compression: str = "gzip", rows: list[Column] | None = None) -> None:
    """One folder per format and a manifest.  The rows are computed once and stored beside the folders for as long as these are written.

    With ``rows``, each row of ``df`` stands for the structs made of it, which follow one another by ``order`` and then among themselves.
    """
    df = kept(df, "bundle-rows")
    every = df.select(F.inline(F.array(*rows))) if rows else df
    for f in formats:
        if f in ("markdown", "txt"):
            write_blocks(df, f, f"{path}/{f}", order, compression, rows)
        elif f == "csv":
            write_csv(every, f"{path}/csv", compression)
        elif f == "jsonl":
            write_jsonl(every, f"{path}/jsonl", compression)
        else:
            every.write.mode("overwrite").options(**_packed(compression)).json(f"{path}/json")
    manifest(df, list(formats), len(rows or [1])).write.mode("overwrite").json(f"{path}/manifest")
    remove(df)


def write_routed(df: DataFrame, path: str) -> None:
    """Rows to one folder per route."""
    df.write.mode("overwrite").partitionBy("route").parquet(path)
