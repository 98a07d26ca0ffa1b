"""Queries: streams run to the end of their input; each has the batch answer as its twin."""

from pyspark.sql import functions as F

from corpusloom.functions import scores as SC
from corpusloom.operators import monitor as MO
from corpusloom.registry.core import query
from corpusloom.registry.q_extract import LANG, LCONF, LNAMES
from corpusloom.registry.q_reports import AL, ERR, SAMP
from corpusloom.registry.q_score import INFO, SEM
from corpusloom.registry.sqlbits import *  # noqa: F403
from corpusloom.session import scratch
from corpusloom.sources import tables as TB
from corpusloom.streaming import stateful as SF, streams as ST


def samples_of(events):
    return events.select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("content_id"), "ts", F.least(F.lit(1.0), F.col("value") / 100).alias("quality_score"),
        F.col("value").alias("processing_time"), F.get_json_object("props", "$.k").cast("int").alias("word_count"))


SCORE = f"""WITH RECURSIVE {DOCS}, it AS (SELECT doc_id, unnest({MS('text')}) AS s, unnest(range(1, len({MS('text')}) + 1)) AS i FROM m), {pack('it', 1000)}, {SEM.replace('SRC', 'm')},
cq AS (SELECT doc_id, count(*) AS n_chunks, avg({INFO}) AS mq FROM c GROUP BY 1), l AS (SELECT doc_id, {LANG} AS language, {LCONF} AS language_confidence FROM m),
sc AS (SELECT sm.doc_id, semantic_score, language, {LNAMES} AS language_name, language_confidence, length(text) AS text_length, n AS word_count, coalesce(n_chunks, 0) AS n_chunks, coalesce(mq, 0) AS mq FROM sm JOIN l USING (doc_id) LEFT JOIN cq USING (doc_id))"""


def documents_of(spark, sf):
    return TB.table(spark, sf, "documents").select("doc_id", "text")


def _tasks(spark):
    return 2 * spark.sparkContext.defaultParallelism


@query("stream_score", sql=f"{SCORE} SELECT doc_id, {R('semantic_score')} AS semantic_score, language, language_name, language_confidence, text_length, word_count, n_chunks, {R('mq')} AS mean_chunk_quality FROM sc")
def stream_score(spark, sf):
    out = scratch(spark, "stream-score")
    ST.feed(documents_of(spark, sf), "doc_id", f"{out}/input", lambda d: ST.run_to_end(ST.score_texts(d.repartition(_tasks(spark)).filter(~ST.refused())), out))
    return spark.read.parquet(f"{out}/data")


@query("stream_dead_letter", sql=f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN NULL ELSE text END AS text FROM documents)
SELECT doc_id, CASE WHEN text IS NULL THEN 'Text missing' END AS error, {NWORDS('text')} AS word_count FROM d""")
def stream_dead_letter(spark, sf):
    """Both sides of the split: scored texts, and the missing ones (every seventh text is taken away first)."""
    out = scratch(spark, "stream-dead")
    d = documents_of(spark, sf).withColumn("text", F.expr("CASE WHEN doc_id % 7 = 3 THEN NULL ELSE text END"))
    sink = ST.split_sink(out, {"dead": ST.dead_letters, "scored": lambda b: ST.score_texts(b.filter(~ST.refused()))})
    ST.feed(d, "doc_id", f"{out}/input", lambda e: ST.run_batches(e.repartition(_tasks(spark)), sink, out))
    dead = spark.read.parquet(f"{out}/dead").select("doc_id", "error", F.lit(None).cast("bigint").alias("word_count"))
    return dead.unionByName(spark.read.parquet(f"{out}/scored").select("doc_id", F.lit(None).cast("string").alias("error"), F.col("word_count").cast("bigint")))


#: A result lives a day; every seventh event arrives a piece late, and a piece is ten days long; 36 hours behind the newest event is too late.
LIVE_HOURS, LATE_HOURS = 24, 36


@query("stream_result_cache", sql=f"""WITH RECURSIVE ev AS (SELECT *, event_id % 7 = 3 AS late, least(2, floor((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 864e9))::INT AS part FROM events),
p AS (SELECT *, part + late::INT AS piece FROM ev), w AS (SELECT piece + 1 AS piece, max(max(ts)) OVER (ORDER BY piece) AS seen FROM p GROUP BY p.piece),
ok AS (SELECT user_id || '/' || event_type AS key, event_id, epoch_us(ts) AS us, least(1.0, value / 100) AS score, piece FROM p LEFT JOIN w USING (piece)
  WHERE seen IS NULL OR ts > date_trunc('millisecond', seen) - INTERVAL {LATE_HOURS} HOUR),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY piece, us, event_id) AS i FROM ok),
r AS (SELECT key, i, event_id, us AS at, score AS result, event_id AS source, false AS hit FROM o WHERE i = 1
  UNION ALL SELECT o.key, o.i, o.event_id, CASE WHEN o.us - r.at < {LIVE_HOURS} * 3600000000 THEN r.at ELSE o.us END, CASE WHEN o.us - r.at < {LIVE_HOURS} * 3600000000 THEN r.result ELSE o.score END,
    CASE WHEN o.us - r.at < {LIVE_HOURS} * 3600000000 THEN r.source ELSE o.event_id END, o.us - r.at < {LIVE_HOURS} * 3600000000 FROM r JOIN o ON o.key = r.key AND o.i = r.i + 1)
SELECT event_id, key, {R('result')} AS result, hit, source FROM r""")
def stream_result_cache(spark, sf):
    """Four batches with a restart before each: repeats get the stored result until it is a day old, late rows too unless they come after the watermark."""
    out = scratch(spark, "stream-cache")
    e = events_of(spark, sf).select("event_id", "ts", F.concat_ws("/", "user_id", "event_type").alias("key"), "value")
    first = e.agg(F.min("ts")).first()[0]
    days = (F.unix_micros("ts") - F.unix_micros(F.lit(first))) / 864e8
    piece = F.least(F.lit(2), F.floor(days / 10)) + F.when(F.col("event_id") % 7 == 3, 1).otherwise(0)
    cached = lambda s: SF.result_cache(s, _score, key="key", live_ms=LIVE_HOURS * 3_600_000, late=f"{LATE_HOURS} hours")
    ST.feed_pieces(e, piece, 4, f"{out}/input", lambda s: ST.run_to_end(cached(s), out))
    return spark.read.parquet(f"{out}/data")


def _score(rows):
    return (rows["value"] / 100).clip(upper=1.0)


def _latency(e):
    return e.select("ts", (F.col("event_type") == "error").alias("failed"), (F.col("value") / 100).alias("latency"))


def events_of(spark, sf):
    return TB.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_metrics", sql=f"""SELECT epoch_us(b) AS start_us, count(*) AS processed, {R('count(*) / 3600')} AS throughput, {R("count(*) FILTER (event_type = 'error') / count(*)")} AS error_rate, {R('avg(value / 100)')} AS avg_latency, avg(value / 100) <= 1 AS in_target
FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS b FROM events) WHERE b + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY b""")
def stream_metrics(spark, sf):
    """Hours are given out once the watermark has passed them; the last, open ones stay in the state."""
    out = scratch(spark, "stream-metrics")
    ST.feed(events_of(spark, sf), "ts", f"{out}/input", lambda e: ST.run_to_end(ST.interval_metrics(_latency(e), "1 hour"), out))
    return spark.read.parquet(f"{out}/data").select(F.unix_micros("start").alias("start_us"), "processed", "throughput", "error_rate", "avg_latency", "in_target")


def _stream_alert_rows(spark, sf, out):
    s = samples_of(events_of(spark, sf))
    ST.feed(s, "ts", f"{out}/input", lambda d: ST.run_batches(d, ST.alert_batches(out), out))
    return spark.read.parquet(f"{out}/alerts").drop("batch")


@query("stream_alerts", sql=f"WITH {AL} SELECT session_id, content_id, type, severity, {R('value')} AS value FROM av")
def stream_alerts(spark, sf):
    return _stream_alert_rows(spark, sf, scratch(spark, "stream-alerts")).drop("ts")


def retained(spark, sf, out, hours):
    """Feed the alerts of a stream into a retention stream, piece by piece; returns the queries that ran."""
    alerts = _stream_alert_rows(spark, sf, out)
    kept = lambda a: SF.alert_retention(a, hours * 3_600_000)
    queries = []
    ST.feed(alerts, "ts", f"{out}/raised", lambda a: queries.append(ST.run_to_end(kept(a), f"{out}/retention")))
    return queries


@query("stream_alert_retention", sql=f"""WITH {AL}, j AS (SELECT av.*, ts FROM av JOIN sa USING (content_id))
SELECT content_id, type, {R('value')} AS value, NOT epoch_ms(ts) + 24 * 3600000 < (SELECT max(epoch_ms(ts)) FROM j) AS active FROM j""")
def stream_alert_retention(spark, sf):
    """Every alert of the stream, and whether it is still open when the stream has ended."""
    out = scratch(spark, "stream-retention")
    retained(spark, sf, out, 24)
    changes = spark.read.parquet(f"{out}/retention/data").groupBy("content_id", "type")
    return changes.agg(F.max("value").alias("value"), (F.count_if(F.col("change") == "retracted") == 0).alias("active"))


@query("stream_routing", sql=f"WITH {SAMP} SELECT content_id, {route('q')} AS route FROM sa")
def stream_routing(spark, sf):
    out = scratch(spark, "stream-routing")
    s = samples_of(events_of(spark, sf))
    ST.feed(s, "ts", f"{out}/input", lambda d: ST.run_batches(d, ST.split_sink(out, ST.routed(d)), out))
    parts = [spark.read.parquet(f"{out}/{n}").select("content_id", F.lit(n).alias("route")) for n in ("auto_approve", "manual_review", "reject")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("stream_audit", sql="SELECT event_id, event_type, user_id AS session_id FROM events")
def stream_audit(spark, sf):
    out = scratch(spark, "stream-audit")
    e = events_of(spark, sf).select("event_id", "ts", "event_type", F.col("user_id").alias("session_id"))
    ST.feed(e, "ts", f"{out}/input", lambda d: ST.run_to_end(d, out, fmt="json"))
    return spark.read.schema("event_id bigint, ts timestamp, event_type string, session_id bigint").json(f"{out}/data").drop("ts")


@query("audit_append", sql="SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def audit_append(spark, sf):
    return stream_audit(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"))


@query("stream_error_rate", sql=f"""WITH {ERR}, w AS (SELECT category, time_bucket(INTERVAL 5 MINUTE, ts) - unnest(range(0, 12)) * INTERVAL 5 MINUTE AS b FROM er)
SELECT epoch_us(b) AS start_us, category, count(*) AS errors FROM w WHERE b + INTERVAL 1 HOUR <= (SELECT max(ts) FROM er) - INTERVAL 10 MINUTE GROUP BY 1, 2""")
def stream_error_rate(spark, sf):
    out = scratch(spark, "stream-errors")
    k = F.get_json_object("props", "$.k").cast("int")
    e = events_of(spark, sf).filter("event_type = 'error'").select("ts", TB._pick(TB.ERROR_NAMES, k).alias("category"))
    ST.feed(e, "ts", f"{out}/input", lambda d: ST.run_to_end(ST.sliding_error_counts(d), out))
    return spark.read.parquet(f"{out}/data").select(F.unix_micros("start").alias("start_us"), "category", "errors")


@query("result_hooks", sql="SELECT count(*) AS rows_seen, 1::BIGINT AS errors_seen FROM events")
def result_hooks(spark, sf):
    """User hooks: one counts the rows of each handled batch, one writes down the failure of a batch, which then runs again."""
    out = scratch(spark, "stream-hooks")
    failed = []

    def handler(batch, batch_id):
        if batch_id == 1 and not failed:
            raise RuntimeError("first try of the second batch")

    def on_result(batch, batch_id):
        batch.agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{out}/seen/batch={batch_id}")

    def on_error(batch_id, error):
        failed.append(batch_id)
        spark.createDataFrame([(batch_id, str(error))], "batch_no long, error string").write.mode("append").parquet(f"{out}/errors")

    hooked = ST.with_hooks(handler, [on_result], [on_error])

    def run(stream):
        try:
            ST.run_batches(stream, hooked, out)
        except Exception:
            if not failed:
                raise
            ST.run_batches(stream, hooked, out)

    ST.feed(events_of(spark, sf), "ts", f"{out}/input", run)
    seen = spark.read.parquet(f"{out}/seen").agg(F.sum("n").alias("rows_seen"))
    from corpusloom.plans.skew import attach
    return attach(seen, spark.read.parquet(f"{out}/errors").agg(F.count("*").alias("errors_seen")))
