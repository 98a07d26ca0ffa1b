"""Operation, error, cost and progress logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corpusloom import fixed_values as FV
from corpusloom.functions import text as T
from corpusloom.plans.ordered import numbered, over_frames
from corpusloom.plans.skew import attach


def classify_errors(df: DataFrame) -> DataFrame:
    """Category, severity and retry advice by the first class whose keyword is in the message."""
    low = F.lower("message")
    known = F.col("context").isin(*FV.PROCESSING_CONTEXTS)
    category = F.when(known, F.lit("processing")).otherwise(F.lit("system"))
    severity = F.when(known, F.lit("medium")).otherwise(F.lit("high"))
    for name, level, keywords in reversed(FV.ERROR_CLASSES):
        hit = T.contains_any(low, keywords)
        category = F.when(hit, F.lit(name)).otherwise(category)
        severity = F.when(hit, F.lit(level)).otherwise(severity)
    own = F.col("category") == "user_input"
    return (df.withColumn("category", category).withColumn("severity", severity)
            .withColumn("recoverable", (F.col("severity") != "critical") & ~own)
            .withColumn("retry_recommended", ~own & ~F.col("error_type").isin(*FV.NEVER_RETRY_TYPES)))


def cost_by_model(df: DataFrame) -> DataFrame:
    return df.groupBy("session_id", "model").agg(F.sum("cost_usd").alias("cost"), F.sum("total_tokens").alias("tokens"), F.count("*").alias("calls"))


def session_summary(df: DataFrame) -> DataFrame:
    """Cost and tokens per session with the cost of each model; models are few, rows are pre-aggregated."""
    per = cost_by_model(df)
    start = df.groupBy("session_id").agg(F.min("ts").alias("session_start"))
    models = F.array_sort(F.collect_list(F.struct("model", F.round("cost", 6).alias("cost"))))
    out = per.groupBy("session_id").agg(F.sum("cost").alias("total_cost"), F.sum("tokens").alias("total_tokens"), models.alias("_m"))
    listed = F.array_join(F.transform("_m", lambda r: r["model"]), "|")
    return out.join(start, "session_id").select("session_id", "total_cost", "total_tokens", listed.alias("models"), "session_start")


def review_approval_rate(df: DataFrame, approved: Column, reviewed: Column, key: str = "session_id") -> DataFrame:
    return df.groupBy(key).agg(F.count_if(reviewed).alias("reviewed"), F.count_if(reviewed & approved).alias("approved")).withColumn(
        "approval_rate", T.ratio(F.col("approved"), F.col("reviewed")))


def quality_log_score(df: DataFrame, scores: str = "scores") -> DataFrame:
    """Mean of a map of named scores per row."""
    total = F.aggregate(F.map_values(scores), F.lit(0.0), lambda a, x: a + x)
    return df.withColumn("overall_score", T.ratio(total, F.size(scores)))


def error_summary(df: DataFrame, recent: int = 10) -> tuple[DataFrame, DataFrame]:
    """Counts by category, and the newest errors."""
    return (df.groupBy("category").agg(F.count("*").alias("n")), df.orderBy(F.desc("ts"), F.desc("event_id")).limit(recent))


def error_statistics(df: DataFrame) -> DataFrame:
    """Per category: all errors and those of the last hour of the log, with their share."""
    last = df.agg(F.max("ts").alias("_last"))
    d = attach(df, last)
    return d.groupBy("category").agg(F.count("*").alias("total"), F.count_if(F.col("ts") > F.col("_last") - F.expr("INTERVAL 1 HOUR")).alias("recent"),
                                     F.max("ts").alias("last_error")).withColumn("error_rate", F.col("recent") / F.greatest(F.col("total"), F.lit(1)))


def network_health(df: DataFrame) -> DataFrame:
    """Requests, failures, timeouts and a health mark per key; needs columns failed and message."""
    low = F.lower("message")
    g = df.groupBy("operation").agg(F.count("*").alias("total_requests"), F.count_if("failed").alias("failed_requests"),
                                    F.count_if(F.col("failed") & (F.contains(low, F.lit("timeout")) | F.contains(low, F.lit("timed out")))).alias("timeout_count"))
    rate = T.ratio(F.col("total_requests") - F.col("failed_requests"), F.col("total_requests"), 1.0)
    return g.withColumn("success_rate", rate).withColumn("health_status", F.when(rate > 0.95, F.lit("good")).when(rate > 0.8, F.lit("degraded")).otherwise(F.lit("poor")))


def operation_suggestions(df: DataFrame) -> DataFrame:
    avg = df.groupBy("name").agg(F.avg("duration").alias("_d"), F.avg("memory_delta").alias("_m"))

    def note(cond, issue, priority, value):
        return F.when(cond, F.struct(F.lit(issue).alias("issue"), F.lit(priority).alias("priority"), value.alias("average")))

    return avg.select("name", F.inline(T.present(note(F.col("_d") > 10, "slow_operation", "high", F.col("_d")), note(F.col("_m") > 100, "high_memory", "medium", F.col("_m")))))


def slow_operations(df: DataFrame) -> DataFrame:
    slow = df.filter(F.col("duration") > F.col("expected_duration") * 2)
    return slow.select("event_id", "name", "duration", (F.col("duration") / F.col("expected_duration")).alias("slowdown_factor"),
                       F.when(F.col("duration") > F.col("expected_duration") * 5, F.lit("high")).otherwise(F.lit("medium")).alias("severity"))


def performance_trend(df: DataFrame, keep: int = 100, recent: int = 10) -> DataFrame:
    """First against second half of the newest ``keep`` operations, and the mean of the newest ten."""
    last = df.orderBy(F.desc("ts"), F.desc("event_id")).limit(keep)
    w = W.orderBy("ts", "event_id")  # at most ``keep`` rows
    d = last.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count("*").over(W.partitionBy()))
    half = F.floor(F.col("_n") / 2)
    g = d.agg(F.count("*").alias("operations"), F.avg("duration").alias("avg_duration"), F.avg("memory_delta").alias("avg_memory_delta"),
              F.avg(F.when(F.col("_i") > F.col("_n") - recent, F.col("duration"))).alias("recent_avg_duration"),
              F.avg(F.when(F.col("_i") <= half, F.col("duration"))).alias("_a"), F.avg(F.when(F.col("_i") > half, F.col("duration"))).alias("_b"))
    return g.withColumn("performance_trend", F.when(F.col("operations") < 10, F.lit("stable")).when(F.col("_b") > F.col("_a") * 1.2, F.lit("degrading")).when(
        F.col("_b") < F.col("_a") * 0.8, F.lit("improving")).otherwise(F.lit("stable"))).drop("_a", "_b")


def progress_eta(df: DataFrame, key: str, total_steps: int) -> DataFrame:
    """Elapsed, mean step and remaining time in microseconds after each step of a session.

    The mean step time is (now - start) / (steps - 1), so a row number and the start
    are enough: no running window over a session.
    """
    start = df.groupBy(key).agg(F.min("ts").alias("_start"))
    d = numbered(df, [key], ["ts", "event_id"], "step").join(start, key)
    elapsed = F.unix_micros("ts") - F.unix_micros("_start")
    done = F.nullif(F.col("step") - 1, F.lit(0))
    mean = F.coalesce(F.floor(elapsed / done).cast("bigint"), F.lit(0))
    left = F.greatest(F.lit(total_steps) - F.col("step"), F.lit(0))
    rest = F.coalesce(F.floor(elapsed * left / done).cast("bigint"), F.lit(0))
    return d.select(key, "event_id", "step", elapsed.alias("elapsed_us"), mean.alias("avg_step_us"), rest.alias("remaining_us"),
                    (F.unix_micros("ts") + rest).alias("completion_us"))


def progress_report(df: DataFrame, key: str, total_steps: int) -> DataFrame:
    """Steps done, percent, and mean, shortest and longest step per session; steps are gaps between rows."""
    def fn(rows, w):
        return rows.withColumn("_gap", (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) / 1e6)

    gaps = over_frames(df, [key], ["ts", "event_id"], 1, fn)
    return gaps.groupBy(key).agg(
        F.count("*").alias("completed_steps"), F.least(F.count("*") / total_steps * 100, F.lit(100.0)).alias("percent"),
        F.avg("_gap").alias("avg_step_s"), F.min("_gap").alias("min_step_s"), F.max("_gap").alias("max_step_s"))


def recent_sessions(df: DataFrame, keep: int = 5, days: int = 7) -> DataFrame:
    """Newest sessions by last activity; sessions idle longer than ``days`` before the end of the log are dropped."""
    s = df.groupBy("session_id").agg(F.max("ts").alias("last_ts"), F.max_by("step", F.struct("ts", "event_id")).alias("step"))
    end = s.agg(F.max("last_ts").alias("_end"))
    live = attach(s, end).filter(F.col("last_ts") >= F.col("_end") - F.make_interval(days=F.lit(days))).drop("_end")
    return live.orderBy(F.desc("last_ts"), "session_id").limit(keep)


def page_result_summary(df: DataFrame) -> DataFrame:
    """Per document: pages, successes, confidence, method and language shares, weak pages."""
    per = df.groupBy("doc").agg(
        F.count("*").alias("pages"), F.count_if(T.trim_ws(F.col("text")) != "").alias("successful"), F.avg("confidence").alias("mean_confidence"),
        *[(F.count_if(F.col("method") == m) * 100 / F.count("*")).alias(f"{m}_pct") for m in ("text", "ocr", "hybrid")],
        F.array_join(F.array_sort(F.collect_set("language")), "|").alias("languages"), F.count_if(F.col("confidence") < 60).alias("low_confidence_pages"))
    return per


def page_result_advice(df: DataFrame) -> DataFrame:
    """Advice per document from confidence, languages, methods and common warnings."""
    g = df.groupBy("doc").agg(F.count("*").alias("_n"), F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))).alias("_c"),
                              F.array_sort(F.collect_set("language")).alias("_l"), F.count_if(F.col("method").isin("ocr", "hybrid")).alias("_o"))
    common = df.select("doc", F.explode("warnings").alias("w")).groupBy("doc", "w").agg(F.count("*").alias("k"))
    common = common.groupBy("doc").agg(F.collect_list(F.struct("w", "k")).alias("_w"))  # distinct warnings of one document
    d = g.join(common, "doc", "left")
    none = F.array().cast("array<string>")
    frequent = F.array_sort(F.transform(F.filter(F.coalesce("_w", F.array().cast("array<struct<w:string,k:bigint>>")), lambda r: r["k"] > F.col("_n") * 0.3),
                                        lambda r: F.concat(F.lit("Common issue: "), r["w"])))
    return d.select("doc", F.concat(
        F.when(F.col("_c") < 50, T.lit_array(LOW_CONFIDENCE)).when(F.col("_c") < 70, T.lit_array(FAIR_CONFIDENCE)).otherwise(none),
        F.when(F.size("_l") > 1, F.array(F.concat(F.lit("Multiple languages detected: "), F.array_join("_l", ", "), F.lit(" - consider processing separately")))).otherwise(none),
        F.when(F.col("_o") > F.col("_n") * 0.8, F.array(F.lit("Most pages required OCR - document may be image-based or low quality"))).otherwise(none),
        frequent).alias("advice"))


# fixed values: advice by recognition confidence
LOW_CONFIDENCE = [
    "Very low OCR confidence detected", "Consider rescanning at higher resolution (600+ DPI)",
    "Ensure good lighting and contrast in original scan", "Try different page segmentation mode (PSM)",
]
FAIR_CONFIDENCE = [
    "Moderate OCR confidence - some improvements possible", "Consider preprocessing options or higher DPI",
    "Check if correct language model is selected",
]
