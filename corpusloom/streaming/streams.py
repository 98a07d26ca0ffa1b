"""Structured Streaming twins of the scoring and monitoring operators.

The column functions are the batch ones.  Sinks are file sinks or ``foreachBatch``
writes keyed by the batch number, so a batch replayed after a failure overwrites
its own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom import fixed_values as FV
from corpusloom.functions import language as LG, scores as S, text as T
from corpusloom.operators import chunking as CH, monitor as MO


def read_table_stream(spark: SparkSession, sf: str, name: str, files_per_batch: int = 1, parts: int | None = None) -> DataFrame:
    """A table folder as a stream of its parquet files; ``parts`` spreads small batches over tasks."""
    schema = spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet").schema
    d = (spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
         .option("maxFilesPerTrigger", files_per_batch).parquet(sf))
    return d.repartition(parts) if parts else d


def feed(table: DataFrame, order: str, src: str, run: Callable[[DataFrame], object], parts: int = 3) -> None:
    """Hand a table to a stream in ``parts`` pieces by ``order``; rows without an order come first."""
    cuts = table.select(F.percentile_approx(order, [k / parts for k in range(1, parts)], F.lit(10_000))).first()[0] or []
    piece = F.lit(0)
    for c in cuts:
        piece = piece + F.when(F.col(order) > F.lit(c), 1).otherwise(0)
    feed_pieces(table, piece, len(cuts) + 1, src, run)


def feed_pieces(table: DataFrame, piece: Column, parts: int, src: str, run: Callable[[DataFrame], object]) -> list:
    """Hand a table to a stream piece by piece, numbered 0 to ``parts`` - 1.

    After each piece the query runs over what is new; with one checkpoint it goes on from its offsets and its state, as after a restart.
    """
    spark, told = table.sparkSession, []
    for k in range(parts):
        table.filter(piece == k).write.mode("append").parquet(src)
        told.append(run(spark.readStream.schema(table.schema).parquet(src)))
    return told


def run_to_end(df: DataFrame, out: str, mode: str = "append", fmt: str = "parquet") -> StreamingQuery:
    """Process all available input into a file sink with a checkpoint, and wait."""
    q = (df.writeStream.format(fmt).outputMode(mode).option("path", f"{out}/data")
         .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def run_batches(df: DataFrame, handler: Callable[[DataFrame, int], None], out: str, mode: str = "append") -> StreamingQuery:
    q = (df.writeStream.foreachBatch(handler).outputMode(mode)
         .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return q


# --- texts --------------------------------------------------------------------------

def score_texts(df: DataFrame, key: str = "doc_id", budget: int = 1000) -> DataFrame:
    """Semantic score, language, counts and chunk quality per text; works on streams and batches."""
    c = F.col("text")
    d = LG.with_language(df.select(key, "text"))
    d = S.with_semantics(d)
    parts = F.transform(CH.greedy_pack(T.marked_sentences(c), budget), lambda p: p["text"])
    quality = F.transform(parts, lambda p: T.let(T.words(p), lambda w: S.information_density(w)))
    return d.withColumn("_q", quality).select(
        key, "semantic_score", "language", "language_name", "language_confidence", F.length(c).alias("text_length"),
        F.col("n_words").alias("word_count"), F.size("_q").alias("n_chunks"),
        T.ratio(F.aggregate("_q", F.lit(0.0), lambda a, x: a + x), F.size("_q")).alias("mean_chunk_quality"))


def refused(limit: int | None = None):
    """Texts that cannot be scored: missing ones, and those over a limit if the caller sets one."""
    missing = F.col("text").isNull()
    return missing if limit is None else missing | (F.length("text") > limit)


def dead_letters(df: DataFrame, key: str = "doc_id", limit: int | None = None) -> DataFrame:
    n = F.length("text")
    return df.filter(refused(limit)).select(key, n.alias("text_length"), F.when(n.isNull(), F.lit("Text missing")).otherwise(
        F.concat(F.lit("Text too long: "), n.cast("string"), F.lit(f" > {limit}"))).alias("error"))


def split_sink(out: str, parts: dict[str, Callable[[DataFrame], DataFrame]]) -> Callable[[DataFrame, int], None]:
    """A batch handler that writes several derived tables, one folder per batch and table."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            for name, fn in parts.items():
                fn(held).write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")
        finally:
            held.unpersist()

    return handle


def with_hooks(handler: Callable[[DataFrame, int], None], on_result: list | None = None, on_error: list | None = None) -> Callable[[DataFrame, int], None]:
    """Call user hooks with each batch after it is handled, or with the error when it fails."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        try:
            handler(batch, batch_id)
        except Exception as e:
            for hook in on_error or []:
                hook(batch_id, e)
            raise
        for hook in on_result or []:
            hook(batch, batch_id)

    return handle


# --- events ---------------------------------------------------------------------------

def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    return read_table_stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def first_in_time(df: DataFrame, ttl: str = "1 hour", keys=("text_hash",)) -> DataFrame:
    """First row of each key within the time to live; where the results themselves are wanted, :func:`stateful.result_cache` keeps them."""
    return df.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(list(keys))


def interval_metrics(df: DataFrame, interval: str = "60 seconds", late: str = "10 minutes", target: float = 1.0) -> DataFrame:
    """Per interval: throughput, error rate, mean latency and whether it met the target."""
    d = df.withWatermark("ts", late) if df.isStreaming else df
    g = d.groupBy(F.window("ts", interval)).agg(
        F.count("*").alias("processed"), F.count_if("failed").alias("errors"), F.avg("latency").alias("avg_latency"))
    seconds = (F.unix_micros("window.end") - F.unix_micros("window.start")) / 1e6
    return g.select(F.col("window.start").alias("start"), "processed", (F.col("processed") / seconds).alias("throughput"),
                    (F.col("errors") / F.greatest("processed", F.lit(1))).alias("error_rate"), "avg_latency", (F.col("avg_latency") <= target).alias("in_target"))


def sliding_error_counts(df: DataFrame, size: str = "1 hour", step: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    d = df.withWatermark("ts", late) if df.isStreaming else df
    return d.groupBy(F.window("ts", size, step), "category").agg(F.count("*").alias("errors")).select(
        F.col("window.start").alias("start"), "category", "errors")


def routed(df: DataFrame) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Parts for :func:`split_sink`: one table per route."""
    return {name: (lambda b, name=name: b.filter(S.route(F.col("quality_score")) == name)) for name in ("auto_approve", "manual_review", "reject")}


def alert_batches(out: str) -> Callable[[DataFrame, int], None]:
    """A batch handler that writes the alerts on a batch of samples (session_id, content_id, ts, quality_score, processing_time), with batch frames.

    Beside them it keeps the newest samples of each session, which is all that a frame can look back on, for the next batch.
    A batch that runs again reads the same stored samples and overwrites its own output.  Frames run over blocks, so no session is bound to a task.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("_new", F.lit(True))
        if batch_id:
            kept = spark.read.schema(batch.schema).parquet(f"{out}/tail/batch={batch_id - 1}")
            rows = rows.unionByName(kept.withColumn("_new", F.lit(False)))
        rows = rows.persist()
        try:
            MO.alerts(rows, where=F.col("_new")).write.mode("overwrite").parquet(f"{out}/alerts/batch={batch_id}")
            newest = MO.keep_last_n(rows.drop("_new"), FV.KEEP_SAMPLES, MO.ORDER, MO.KEY)
            newest.write.mode("overwrite").parquet(f"{out}/tail/batch={batch_id}")
        finally:
            rows.unpersist()

    return handle


def recent_alerts(alerts: DataFrame, hours: int = 1) -> DataFrame:
    """Alerts younger than ``hours`` before the newest one: the batch form of :func:`stateful.alert_retention`."""
    from corpusloom.plans.skew import attach
    return attach(alerts, alerts.agg(F.max("ts").alias("_last"))).filter(
        F.col("ts") > F.col("_last") - F.make_interval(hours=F.lit(hours))).drop("_last")
