"""Dashboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.operators import ops
from kbspark.plans import bindings as b
from kbspark.plans import memory_queries
from kbspark.plans.registry import query, table
from kbspark.plans.sql import cte, with_ctes

_AS_OF = memory_queries.AS_OF_SQL


@query("job_status_counts", with_ctes("SELECT status, count(*)::BIGINT AS jobs FROM jobs GROUP BY status", "jobs"))
def job_status_counts(spark, sf_dir):
    return ops.status_counts(b.jobs(spark, sf_dir))


@query(
    "dashboard_stats",
    with_ctes(
        """
        , d AS (SELECT count(*) AS n FROM manifests), v AS (SELECT count(*) AS n, count(DISTINCT label) AS k FROM embeddings JOIN docs ON doc_num = vec_id),
        m AS (SELECT count(*) AS n, count(*) FILTER (type = 'session') AS s, count(*) FILTER (type = 'working') AS w, count(*) FILTER (type = 'long_term') AS l FROM mem)
        SELECT d.n::BIGINT AS docs_total, v.n::BIGINT AS vectors_total, v.k::BIGINT AS vectors_docs, m.n::BIGINT AS memory_total,
          m.s::BIGINT AS memory_session, m.w::BIGINT AS memory_working, m.l::BIGINT AS memory_long_term,
          round(least(d.n / 50.0 * 100.0, 100.0)::DOUBLE, 1) AS docs_percent, round(least(v.n / 2500.0::DOUBLE * 100.0, 100.0), 1) AS vectors_percent,
          round(least(m.n / 400.0 * 100.0, 100.0)::DOUBLE, 1) AS memory_percent FROM d, v, m
        """,
        "manifests",
        "docs",
        "mem",
    ),
)
def dashboard_stats(spark, sf_dir):
    # One version per label stands for the versions of a source.
    vectors = b.stored_vectors(spark, sf_dir).select(
        F.lit("store").alias("source_id"), F.col("label").cast("string").alias("source_version")
    )
    return ops.totals(b.manifests(spark, sf_dir), vectors, b.memory_items(spark, sf_dir))


@query(
    "model_usage",
    with_ctes(
        f"""
        , r AS (SELECT 'model_' || (k % 5) AS model, event_type AS c, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS e,
                  CASE WHEN k % 2 = 0 AND k * 3 > 0 THEN k * 3 WHEN k % 2 = 0 THEN 0 ELSE k + 10 END AS p, length('answer ' || event_type) + 2 + length(event_type) AS d
                FROM event_keys WHERE k % 5 <> 4 AND ts >= {_AS_OF} - INTERVAL 336 HOUR),
        g AS (SELECT model, c, count(*) AS n FROM r GROUP BY ALL), s AS (SELECT model, string_agg(c || '=' || n, ',' ORDER BY c) AS components FROM g GROUP BY 1)
        SELECT model, count(*)::BIGINT AS requests, sum(e)::BIGINT AS errors, round(sum(e) / count(*)::DOUBLE * 100.0, 2) AS error_rate_pct,
               ((sum(p) + 3) // 4)::BIGINT AS prompt_tokens_est, ((sum(d) + 3) // 4)::BIGINT AS completion_tokens_est, any_value(components) AS components
        FROM r JOIN s USING (model) GROUP BY model
        """,
        "event_keys",
    ),
)
def model_usage(spark, sf_dir):
    usage = ops.model_usage(b.run_log(spark, sf_dir), b.as_of(), window_hours=336)
    pairs = F.transform(F.map_entries("components"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return usage.withColumn("components", F.array_join(pairs, ","))


@query(
    "ops_alerts",
    with_ctes(
        f"""
        , c AS (SELECT count(*) FILTER (status = 'running' AND updated_at < {_AS_OF} - INTERVAL 20 MINUTE) AS stale, count(*) FILTER (status = 'failed') AS failed,
                count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'queued' AND attempts > 0) AS retries FROM jobs),
        e AS (SELECT count(*) AS errors FROM events WHERE event_type = 'error' AND ts >= {_AS_OF} - INTERVAL 48 HOUR)
        SELECT 1 AS position, 'critical' AS severity, 'running_jobs_stale' AS code, 'Stale running jobs' AS title, stale || ' job(s) marked running for more than 20 minute(s).' AS detail FROM c WHERE stale > 0
        UNION ALL SELECT 2, 'high', 'queue_failed_jobs', 'Failed jobs in queue', failed || ' failed job(s) require attention.' FROM c WHERE failed > 0
        UNION ALL SELECT 3, 'medium', 'queue_backlog', 'Queue backlog growing', queued || ' queued job(s) currently waiting.' FROM c WHERE queued >= 50
        UNION ALL SELECT 4, 'medium', 'retry_backoff', 'Jobs retrying with backoff', retries || ' queued job(s) are on retry attempts.' FROM c WHERE retries > 0
        UNION ALL SELECT 5, 'medium', 'recent_errors', 'High recent error volume', errors || ' run errors in last 48h.' FROM e WHERE errors >= 20
        """,
        "jobs",
    ),
)
def ops_alerts(spark, sf_dir):
    return ops.alerts(b.jobs(spark, sf_dir), b.run_log(spark, sf_dir), b.as_of(), error_hours=48)


@query(
    "dashboard_timeseries",
    with_ctes(
        f"""
        , p AS (SELECT epoch({_AS_OF})::BIGINT AS e, ((epoch({_AS_OF})::BIGINT - 336 * 3600) // 5400) * 5400 AS s),
        ev AS (SELECT 'd' AS c, updated_at AS ts FROM manifests UNION ALL SELECT 'v', TIMESTAMP '2024-01-20' + to_minutes(vec_id) FROM embeddings UNION ALL SELECT 'm', ts FROM events
               UNION ALL SELECT 'q', created_at FROM jobs UNION ALL SELECT 'k', updated_at FROM jobs WHERE status = 'done' UNION ALL SELECT 'f', updated_at FROM jobs WHERE status = 'failed'),
        n AS (SELECT floor(epoch(ts) / 5400)::BIGINT * 5400 AS bucket, c, count(*) AS n FROM ev WHERE ts <= {_AS_OF} GROUP BY ALL),
        b AS (SELECT unnest(range(s, e + 1, 5400)) AS bucket FROM p)
        SELECT b.bucket, coalesce(sum(n) FILTER (c = 'd'), 0)::BIGINT AS docs_ingested, coalesce(sum(n) FILTER (c = 'v'), 0)::BIGINT AS vectors_built, coalesce(sum(n) FILTER (c = 'm'), 0)::BIGINT AS memory_written,
               coalesce(sum(n) FILTER (c = 'q'), 0)::BIGINT AS jobs_enqueued, coalesce(sum(n) FILTER (c = 'k'), 0)::BIGINT AS jobs_done, coalesce(sum(n) FILTER (c = 'f'), 0)::BIGINT AS jobs_failed
        FROM b LEFT JOIN n USING (bucket) GROUP BY b.bucket
        """,
        "manifests",
        "jobs",
    ),
)
def dashboard_timeseries(spark, sf_dir):
    jobs = b.jobs(spark, sf_dir)
    start = F.lit("2024-01-20").cast("timestamp_ntz")
    ts = lambda df, name: df.select(F.col(name).alias("ts"))
    sources = {
        "docs_ingested": ts(b.manifests(spark, sf_dir), "updated_at"),
        "vectors_built": table(spark, sf_dir, "embeddings").select(F.timestamp_add("MINUTE", "vec_id", start).alias("ts")),
        "memory_written": ts(b.memory_items(spark, sf_dir), "created_at"),
        "jobs_enqueued": ts(jobs, "created_at"),
        "jobs_done": ts(jobs.where("status = 'done'"), "updated_at"),
        "jobs_failed": ts(jobs.where("status = 'failed'"), "updated_at"),
    }
    return ops.timeseries(sources, b.as_of(), window_hours=336, bucket_minutes=90)
