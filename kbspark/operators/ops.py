"""Dashboards over jobs, run logs, manifests, vectors and memories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def status_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("jobs"))


def percent(value: Column, target: int) -> Column:
    """Progress towards a target, between 0 and 100 with one decimal."""
    return F.round(F.least(F.greatest(value / max(1, target) * 100.0, F.lit(0.0)), F.lit(100.0)), 1)


def totals(
    manifests: DataFrame, vectors: DataFrame, items: DataFrame,
    target_docs: int = 50, target_vectors: int = 2500, target_memory: int = 400,
) -> DataFrame:
    """One row of counts and progress; each table is read once."""
    one = lambda df: df.withColumn("_one", F.lit(1))
    docs = one(manifests.agg(F.count(F.lit(1)).alias("docs_total")))
    vecs = one(
        vectors.agg(
            F.count(F.lit(1)).alias("vectors_total"),
            F.count_distinct("source_id", "source_version").alias("vectors_docs"),
        )
    )
    mems = one(
        items.agg(
            F.count(F.lit(1)).alias("memory_total"),
            *[
                F.count(F.when(F.col("memory_type") == t, 1)).alias(f"memory_{t}")
                for t in ("session", "working", "long_term")
            ],
        )
    )
    return (
        docs.join(vecs, "_one")
        .join(mems, "_one")
        .drop("_one")
        .withColumn("docs_percent", percent(F.col("docs_total"), target_docs))
        .withColumn("vectors_percent", percent(F.col("vectors_total"), target_vectors))
        .withColumn("memory_percent", percent(F.col("memory_total"), target_memory))
    )


def token_estimate(chars: Column) -> Column:
    return F.when(chars > 0, F.floor((chars + 3) / 4)).otherwise(F.lit(0).cast("long"))


def model_usage(run_log: DataFrame, as_of: Column, window_hours: int = 24) -> DataFrame:
    """Requests, errors, components and estimated tokens per model in the window."""
    hours = max(1, min(24 * 14, window_hours))
    number = lambda path: F.coalesce(F.get_json_object("input_json", path).try_cast("long"), F.lit(0))
    whole = number("$.egress_policy_input_chars")
    prompt = F.when(whole > 0, whole).otherwise(
        number("$.question_len") + number("$.evidence_prompt_chars") + number("$.analysis_prompt_chars")
    )
    listed = lambda name: F.aggregate(
        F.coalesce(F.from_json(F.get_json_object("output_json", f"$.{name}"), "array<string>"), F.array().cast("array<string>")),
        F.lit(0), lambda a, x: a + F.coalesce(F.length(x), F.lit(0)),
    )
    answer = F.coalesce(F.length(F.get_json_object("output_json", "$.answer_text")), F.lit(0))
    recent = run_log.where(F.col("created_at") >= F.timestamp_add("HOUR", F.lit(-hours), as_of))
    rows = recent.select(
        F.trim(F.coalesce("model", F.lit(""))).alias("model"),
        F.coalesce("component", F.lit("")).alias("component"),
        F.when(F.trim(F.coalesce("error", F.lit(""))) != "", 1).otherwise(0).alias("_error"),
        prompt.alias("_prompt"),
        (answer + listed("claims") + listed("timeline") + listed("open_questions")).alias("_done"),
    ).where("model <> ''")
    per_component = rows.groupBy("model", "component").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_error").alias("e"), F.sum("_prompt").alias("p"), F.sum("_done").alias("d")
    )
    counts = F.array_sort(F.collect_list(F.struct("component", "n")))
    return per_component.groupBy("model").agg(
        F.sum("n").alias("requests"),
        F.sum("e").alias("errors"),
        F.round(F.sum("e") / F.sum("n") * 100.0, 2).alias("error_rate_pct"),
        token_estimate(F.sum("p")).alias("prompt_tokens_est"),
        token_estimate(F.sum("d")).alias("completion_tokens_est"),
        F.map_from_entries(counts).alias("components"),
    )


def alerts(jobs: DataFrame, run_log: DataFrame, as_of: Column, stale_minutes: int = 20, error_hours: int = 24) -> DataFrame:
    """One row per active alert, or a single all-clear row."""
    stale = max(1, min(24 * 60, stale_minutes))
    hours = max(1, min(24 * 14, error_hours))
    status = F.col("status")
    count = lambda cond: F.count(F.when(cond, 1))
    queue = jobs.agg(
        count((status == "running") & (F.col("updated_at") < F.timestamp_add("MINUTE", F.lit(-stale), as_of))).alias("stale"),
        count(status == "failed").alias("failed"),
        count(status == "queued").alias("queued"),
        count((status == "queued") & (F.col("attempts") > 0)).alias("retries"),
    ).withColumn("_one", F.lit(1))
    recent = (F.col("created_at") >= F.timestamp_add("HOUR", F.lit(-hours), as_of)) & (F.trim("error") != "")
    errors = run_log.agg(count(recent).alias("errors")).withColumn("_one", F.lit(1))

    def row(order: int, severity: str, code: str, title: str, detail: Column, active: Column) -> Column:
        return F.when(
            active,
            F.struct(
                F.lit(order).alias("position"), F.lit(severity).alias("severity"), F.lit(code).alias("code"),
                F.lit(title).alias("title"), detail.alias("detail"),
            ),
        )

    said = lambda name, text: F.concat(F.col(name).cast("string"), F.lit(text))
    found = F.filter(
        F.array(
            row(1, "critical", "running_jobs_stale", "Stale running jobs",
                said("stale", f" job(s) marked running for more than {stale} minute(s)."), F.col("stale") > 0),
            row(2, "high", "queue_failed_jobs", "Failed jobs in queue",
                said("failed", " failed job(s) require attention."), F.col("failed") > 0),
            row(3, "medium", "queue_backlog", "Queue backlog growing",
                said("queued", " queued job(s) currently waiting."), F.col("queued") >= 50),
            row(4, "medium", "retry_backoff", "Jobs retrying with backoff",
                said("retries", " queued job(s) are on retry attempts."), F.col("retries") > 0),
            row(5, "medium", "recent_errors", "High recent error volume",
                said("errors", f" run errors in last {hours}h."), F.col("errors") >= 20),
        ),
        lambda r: r.isNotNull(),
    )
    clear = F.array(
        row(6, "ok", "all_clear", "No active alerts",
            F.lit("Queue and run logs look healthy for current thresholds."), F.lit(True))
    )
    return queue.join(errors, "_one").select(F.inline(F.when(F.size(found) > 0, found).otherwise(clear)))


COUNTERS = ("docs_ingested", "vectors_built", "memory_written", "jobs_enqueued", "jobs_done", "jobs_failed")


def _epoch(ts: Column) -> Column:
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def timeseries(sources: dict[str, DataFrame], as_of: Column, window_hours: int = 24, bucket_minutes: int = 60) -> DataFrame:
    """Counters per bucket over the window, empty buckets included.

    ``sources`` maps a counter to a frame with one time column ``ts``. Each source is counted
    per bucket before the small results meet the spine of buckets.
    """
    hours = max(1, min(24 * 14, window_hours))
    size = max(5, min(12 * 60, bucket_minutes)) * 60
    spark = next(iter(sources.values())).sparkSession
    end = _epoch(as_of)
    start = F.floor((end - hours * 3600) / size) * size
    parts = []
    for name, df in sources.items():
        inside = df.where((_epoch(F.col("ts")) >= start) & (F.col("ts") <= as_of))
        parts.append(
            inside.groupBy((F.floor(_epoch(F.col("ts")) / size) * size).alias("bucket"))
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumn("counter", F.lit(name))
        )
    counted = reduce(DataFrame.unionByName, parts).groupBy("bucket").agg(
        *[F.sum(F.when(F.col("counter") == c, F.col("n"))).alias(c) for c in COUNTERS]
    )
    spine = spark.range(1).select(F.explode(F.sequence(start, end, F.lit(size).cast("long"))).alias("bucket"))
    zero = F.lit(0).cast("long")
    return spine.join(counted, "bucket", "left").select("bucket", *[F.coalesce(c, zero).alias(c) for c in COUNTERS])
