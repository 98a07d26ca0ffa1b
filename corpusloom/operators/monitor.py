"""Quality monitoring: running samples, alerts, trends, reports.

Samples belong to sessions.  Alerts look back at most 100 samples, so they use
bounded frames over blocks of a range-partitioned sort (``plans.ordered``): a
session that holds a third of all samples is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corpusloom import fixed_values as FV
from corpusloom.functions import scores as S, text as T
from corpusloom.plans.ordered import exact_quantiles, over_frames
from corpusloom.plans.skew import attach

KEY, ORDER = ["session_id"], ["ts", "content_id"]


def with_alert_metrics(df: DataFrame, keys=None) -> DataFrame:
    """All look-back figures of the four alerts in one pass of one sort."""
    q, t = F.col("quality_score"), F.col("processing_time")

    def fn(rows, w):
        def last(n, skip=0):
            return w.rowsBetween(-(n + skip) + 1, -skip)

        a = {k: v[1] for k, v in FV.ALERTS.items()}
        drop = a["quality_drop"]
        return (rows.withColumn("recent_avg", F.avg(q).over(last(drop))).withColumn("previous_avg", F.avg(q).over(last(drop, drop)))
                .withColumn("score_std", F.stddev_samp(q).over(last(a["consistency_issue"])))
                .withColumn("batch_avg", F.avg(q).over(last(a["low_batch_quality"])))
                .withColumn("recent_time", F.avg(t).over(last(a["processing_slowdown"])))
                .withColumn("overall_time", F.avg(t).over(last(FV.KEEP_SAMPLES)))
                .withColumn("std20", F.stddev_samp(q).over(last(20))))

    return over_frames(df, KEY if keys is None else keys, ORDER, FV.KEEP_SAMPLES - 1, fn)


def alert_columns() -> dict[str, tuple[Column, Column]]:
    """type -> (value, condition) over the columns of :func:`with_alert_metrics`."""
    rn = F.col("rn")
    drop = F.coalesce(F.try_divide(F.col("previous_avg") - F.col("recent_avg"), F.col("previous_avg")), F.lit(0.0))
    slow = F.coalesce(F.try_divide(F.col("recent_time"), F.col("overall_time")), F.lit(1.0))
    limit = {k: v[0] for k, v in FV.ALERTS.items()}
    size = {k: v[1] for k, v in FV.ALERTS.items()}
    return {
        "quality_drop": (drop, (rn >= 2 * size["quality_drop"]) & (drop > limit["quality_drop"])),
        "consistency_issue": (F.col("score_std"), (rn >= size["consistency_issue"]) & (F.col("score_std") > limit["consistency_issue"])),
        "low_batch_quality": (F.col("batch_avg"), (rn >= size["low_batch_quality"]) & (F.col("batch_avg") < limit["low_batch_quality"])),
        "processing_slowdown": (slow, (rn >= 2 * size["processing_slowdown"]) & (slow > limit["processing_slowdown"])),
    }


def alerts(df: DataFrame, kinds: list[str] | None = None, keys=None, where: Column | None = None) -> DataFrame:
    """One row per (sample, alert type) that fires; of the samples that meet ``where``, if the others are only there to be looked back on."""
    rows = []
    for kind, (value, cond) in alert_columns().items():
        if kinds is None or kind in kinds:
            rows.append(F.when(cond, F.struct(F.lit(kind).alias("type"), F.lit(FV.ALERTS[kind][2]).alias("severity"), value.alias("value"))))
    rated = with_alert_metrics(df, keys)
    rated = rated if where is None else rated.filter(where)
    return rated.select(*(KEY if keys is None else keys), "content_id", "ts", F.inline(T.present(*rows)))


def quality_consistency(df: DataFrame, keys=None) -> DataFrame:
    """1 - stdev of the last 20 scores over 0.5, from the second sample on."""
    return with_alert_metrics(df, keys).filter("rn > 1").select(
        *(KEY if keys is None else keys), "content_id", (F.lit(1.0) - F.least(F.lit(1.0), F.col("std20") / 0.5)).alias("consistency"))


def keep_last_n(df: DataFrame, n: int, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """Newest ``n`` rows, overall or per key; both forms cut rows before the shuffle."""
    desc = [F.col(c).desc() for c in order]
    if not keys:
        return df.orderBy(*desc).limit(n)
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*desc))).filter(F.col("_r") <= n).drop("_r")


def latest_by_class(df: DataFrame, key: str, limits: dict[str, int], order: list[str]) -> DataFrame:
    """Newest rows per class with a limit of its own per class."""
    most = max(limits.values())
    rank = F.row_number().over(W.partitionBy(key).orderBy(*[F.col(c).desc() for c in order]))
    top = df.filter(F.col(key).isin(*limits)).withColumn("rank", rank).filter(F.col("rank") <= most)
    allowed = F.lit(0)
    for name, n in limits.items():
        allowed = F.when(F.col(key) == name, n).otherwise(allowed)
    return top.filter(F.col("rank") <= allowed)


def processing_stats(df: DataFrame, keep: int = FV.KEEP_SAMPLES) -> DataFrame:
    """Totals over all samples, means and consistency over the newest ones."""
    total = df.agg(F.count("*").alias("total_processed"), F.sum("word_count").alias("total_words"),
                   F.sum("processing_time").alias("total_processing_time"))
    kept = keep_last_n(df, keep, ORDER).withColumn("_r", F.row_number().over(W.orderBy(*[F.col(c).desc() for c in ORDER])))
    recent = kept.agg(F.avg("quality_score").alias("avg_quality"), F.avg("processing_time").alias("avg_processing_time"),
                      F.avg("word_count").alias("avg_word_count"), F.stddev_samp(F.when(F.col("_r") <= 20, F.col("quality_score"))).alias("quality_std"))
    out = attach(total, recent)
    return (out.withColumn("quality_consistency", F.lit(1.0) - F.least(F.lit(1.0), F.col("quality_std") / 0.5))
            .withColumn("quality_delta", F.col("avg_quality") - 0.7).withColumn("consistency_delta", F.col("quality_consistency") - 0.8))


def grade_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(S.quality_grade(F.col("quality_score")).alias("grade")).agg(F.count("*").alias("n"))


def quality_trend_series(df: DataFrame) -> DataFrame:
    return df.select("ts", "content_id", "quality_score", "processing_time", "word_count",
                     S.quality_grade(F.col("quality_score")).alias("grade")).orderBy("ts", "content_id")


def routing_distribution(df: DataFrame) -> DataFrame:
    r = S.route(F.col("quality_score"))
    names = ("auto_approve", "manual_review", "reject")
    g = df.agg(*[F.count_if(r == n).alias(n) for n in names], F.count("*").alias("total"))
    return g.select("*", *[(F.col(n) * 100 / F.col("total")).alias(f"{n}_pct") for n in names])


METRICS = ("quality_score", "processing_time", "word_count")


def metric_profile(df: DataFrame, metrics=METRICS, tie: str = "content_id") -> DataFrame:
    """count, mean, std, min, exact quartiles and max of each metric, from one distributed sort."""
    long = df.select(tie, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))
    stats = long.groupBy("metric").agg(F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                                       F.min("value").alias("min"), F.max("value").alias("max"))
    return stats.join(exact_quantiles(long, ["metric"], "value", tie, [0.25, 0.5, 0.75]), "metric")


def metric_correlation(df: DataFrame, metrics=METRICS) -> DataFrame:
    pairs = [(a, b) for a in metrics for b in metrics]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}") for a, b in pairs])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("metric1"), F.lit(b).alias("metric2"), F.col(f"{a}__{b}").alias("correlation")) for a, b in pairs])))


def quality_by_hour(df: DataFrame) -> DataFrame:
    return df.groupBy(F.hour("ts").alias("hour")).agg(F.avg("quality_score").alias("quality_score"))


LENGTH_BINS = ["Very Short", "Short", "Medium", "Long", "Very Long"]  # fixed values: bin labels


def quality_by_length_bin(df: DataFrame, col: str = "word_count") -> DataFrame:
    """Mean quality in five equal-width, right-closed bins of length.

    Rows are summed by length, and the ends of the bins are read from these sums too, all their columns, so that one exchange serves both and scores are
    worked out once.
    """
    per = df.groupBy(col).agg(F.sum("quality_score").alias("_sum"), F.count("quality_score").alias("_scored"), F.count("*").alias("_n"))
    span = per.agg(F.min(col).cast("double").alias("_lo"), F.max(col).cast("double").alias("_hi"), F.max(F.struct("_sum", "_scored", "_n")).alias("_held"))
    d = attach(per, span)
    label = F.lit(LENGTH_BINS[-1])
    for i in range(len(LENGTH_BINS) - 1, 0, -1):
        edge = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * i / len(LENGTH_BINS)
        label = F.when(F.col(col) <= edge, F.lit(LENGTH_BINS[i - 1])).otherwise(label)
    return d.groupBy(label.alias("length_bin")).agg(
        F.try_divide(F.sum("_sum"), F.sum("_scored").cast("double")).alias("quality_score"), F.sum("_n").alias("n"))


def quality_trends(df: DataFrame, order: list[str], keep: int = 10, assess=None) -> DataFrame:
    """Averages, pass rate and commonest flags of the newest assessments.

    ``df`` holds assessments, or plain pairs with ``assess`` given: then only the newest pairs are assessed.
    """
    recent = keep_last_n(df, keep, order)
    if assess is not None:
        recent = assess(recent)
    top = recent.select(F.explode(F.transform("flags", lambda f: f["name"])).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))
    top = top.orderBy(F.desc("n"), "flag").limit(5).agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct((-F.col("n")).alias("neg"), "flag"))), lambda r: F.concat(r["flag"], F.lit(":"), (-r["neg"]).cast("string"))), "|").alias("common_flags"))
    total = df.agg(F.count("*").alias("total_assessments"))
    stats = recent.agg(F.count("*").alias("recent_assessments"), F.avg("overall_score").alias("avg_overall_score"),
                       F.avg("semantic_similarity").alias("avg_semantic_similarity"), F.avg("hallucination_score").alias("avg_hallucination_score"),
                       F.avg(F.col("passed").cast("int")).alias("pass_rate"))
    return attach(attach(total, stats), top)


def top_flags(df: DataFrame, k: int = 5) -> DataFrame:
    return (df.select(F.explode("flags").alias("_f")).groupBy(F.col("_f.name").alias("flag")).agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), "flag").limit(k))
