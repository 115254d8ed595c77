"""Streaming queries: each runs over all available input and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.operators.ordered import micros
from kbspark.plans import bindings as b
from kbspark.plans import memory_queries, sessions_queries  # noqa: F401
from kbspark.plans.registry import query, table
from kbspark.plans.sql import with_ctes
from kbspark.streaming import streams


def _stream(spark, sf_dir, name):
    return streams.read_stream(spark, f"{sf_dir}/{name}.parquet")


def _path(df):
    suffix = F.when(F.col("lang") == "fr", ".md.part").when(F.col("lang") == "es", "/.hidden.md").otherwise(".md")
    return df.select(
        F.concat(F.lit("/watch/"), "doc_id", suffix).alias("path"),
        F.concat(F.lit("file:"), "source", F.lit("/"), "doc_id").alias("source_id"),
        F.sha2("text", 256).alias("source_version"),
        "lang",
    )


@query(
    "stream_intake",
    """
    SELECT '/watch/' || doc_id || '.md' AS path, 'file:' || source || '/' || doc_id AS source_id, sha256(text) AS source_version,
           CASE WHEN quality = 1 THEN 'already_ingested' WHEN lang = 'de' THEN 'already_queued' ELSE 'enqueued' END AS reason
    FROM documents LEFT JOIN labels USING (doc_id) WHERE lang NOT IN ('fr', 'es')
    """,
)
def stream_intake(spark, sf_dir):
    stored = table(spark, sf_dir, "documents")
    good = stored.join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    jobs = _path(stored.where("lang = 'de'")).withColumn("status", F.lit("queued"))
    files = _path(_stream(spark, sf_dir, "documents")).drop("lang")
    return streams.intake_stream(files, _path(good), jobs).select("path", "source_id", "source_version", "reason")


_GAP = 1800


@query(
    "stream_debounce",
    f"""
    WITH RECURSIVE e AS (SELECT user_id AS path, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    w AS (SELECT path, event_id, t, n, t AS last, true AS ok FROM e WHERE n = 1
          UNION ALL SELECT e.path, e.event_id, e.t, e.n, CASE WHEN e.t - w.last >= {_GAP}000000 THEN e.t ELSE w.last END, e.t - w.last >= {_GAP}000000
          FROM w JOIN e ON e.path = w.path AND e.n = w.n + 1)
    SELECT path, event_id, t AS ts_us FROM w WHERE ok
    """,
)
def stream_debounce(spark, sf_dir):
    events = _stream(spark, sf_dir, "events").select(
        F.col("user_id").alias("path"), "event_id", F.col("ts").cast("timestamp").alias("ts"), micros(F.col("ts")).alias("ts_us")
    )
    return streams.to_table(streams.debounce(events, "0 seconds", _GAP), "debounce")


@query(
    "debounce_events",
    f"""
    WITH RECURSIVE e AS (SELECT user_id AS path, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    w AS (SELECT path, event_id, t, n, t AS last, true AS ok FROM e WHERE n = 1
          UNION ALL SELECT e.path, e.event_id, e.t, e.n, CASE WHEN e.t - w.last >= {_GAP}000000 THEN e.t ELSE w.last END, e.t - w.last >= {_GAP}000000
          FROM w JOIN e ON e.path = w.path AND e.n = w.n + 1)
    SELECT path, event_id, t AS ts_us FROM w WHERE ok
    """,
)
def debounce_events(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("path"), "event_id", "ts", micros(F.col("ts")).alias("ts_us")
    )
    return streams.debounce_batch(events, _GAP).select("path", "event_id", "ts_us")


@query(
    "stream_buckets",
    """
    WITH b AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, count(*)::BIGINT AS events, count(*) FILTER (event_type = 'error')::BIGINT AS errors FROM events GROUP BY 1)
    SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, events, errors FROM b WHERE s + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)
    """,
)
def stream_buckets(spark, sf_dir):
    events = _stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    counts = streams.to_table(streams.bucket_counts(events, "2 hours"), "buckets")
    return counts.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query(
    "stream_sessions",
    """
    WITH f AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 45 MINUTE, true)::INTEGER AS o FROM events),
    s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM f)
    SELECT user_id AS session_id, count(*)::BIGINT AS turns, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM s GROUP BY user_id, n
    HAVING max(ts) + INTERVAL 45 MINUTE <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)
    """,
)
def stream_sessions(spark, sf_dir):
    events = _stream(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"))
    found = streams.to_table(streams.session_counts(events, "2 hours"), "sessions")
    return found.select("session_id", "turns", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"))


@query("stream_handoff", with_ctes("SELECT conv_id AS session_id, turn_count, digest FROM handoff", "handoff"))
def stream_handoff(spark, sf_dir):
    # A turn is a minute, a conversation an hour, as in the batch form.
    minute = F.col("conv_id") * 60 + F.col("turn")
    rows = _stream(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"), "turn", "role", "text",
        F.timestamp_seconds(F.lit(1_704_067_200) + minute * 60).alias("ts"), ((F.lit(1_704_067_200) + minute * 60) * 1_000_000).alias("ts_us"),
    )
    return streams.handoff_stream(rows, b.as_turns, sessions_queries.AS_OF_TEXT, late="36500 days")


@query(
    "stream_compaction",
    with_ctes("SELECT user_id AS session_id, n::BIGINT AS turn_count, event_id AS turn_no FROM eturns WHERE n % 12 = 0", "eturns"),
)
def stream_compaction(spark, sf_dir):
    turns = _stream(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("turn_no"), F.col("ts").cast("timestamp").alias("ts"), micros(F.col("ts")).alias("ts_us")
    )
    return streams.to_table(streams.compaction_stream(turns, "0 seconds", idle_days=365), "compaction")


@query(
    "stream_expiry",
    with_ctes(
        """
        , l AS (SELECT memory_id, epoch_us(greatest(expires_at, coalesce(pinned_until, expires_at))) // 1000 AS leave_ms FROM mem WHERE expires_at IS NOT NULL)
        SELECT memory_id, leave_ms FROM l WHERE leave_ms < (SELECT max(epoch_us(created_at) // 1000) FROM mem WHERE expires_at IS NOT NULL)
        """,
        "mem",
    ),
)
def stream_expiry(spark, sf_dir):
    # Expiry by type as on writing; purchases become long-term memories and stay.
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.col("event_type")
    days = F.when(kind == "view", 1).when(kind != "purchase", 30)
    expires = micros(F.col("ts")) + days * 86_400_000_000
    pinned = F.when(k % 10 == 0, micros(F.col("ts")) + 60 * 86_400_000_000)
    items = _stream(spark, sf_dir, "events").select(
        F.concat(F.lit("m"), "event_id").alias("memory_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.floor(micros(F.col("ts")) / 1000).alias("ts_ms"),
        F.floor(F.when(expires.isNotNull(), F.greatest(expires, pinned)) / 1000).alias("leave_ms"),
    )
    return streams.to_table(streams.expiry_stream(items, "0 seconds"), "expired")


@query(
    "stream_upsert",
    """
    SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL
    """,
)
def stream_upsert(spark, sf_dir):
    rows = _stream(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return streams.upsert_stream(rows, ["user_id", "event_type"], "event_id")
