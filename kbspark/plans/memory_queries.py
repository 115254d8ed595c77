"""Memory queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark import schemas
from kbspark.functions import routing
from kbspark.functions import text as tx
from kbspark.operators import memory, tables
from kbspark.plans import bindings as b
from kbspark.plans import tables_queries  # noqa: F401  (defines shared tables of the SQL side)
from kbspark.plans.registry import query, table
from kbspark.plans.sql import cte, norm, overlap, toks, with_ctes
from kbspark.session import stored

AS_OF_SQL = "TIMESTAMP '2024-01-31'"


def _count(col: str, hints) -> str:
    return "(" + " + ".join(f"contains({col}, '{h}')::INTEGER" for h in hints) + ")"


def _any(col: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({col}, '{p}')" for p in patterns) + ")"


def route_ctes(source: str, name: str) -> None:
    """CTE ``name``: the rows of ``source`` (norm, type) with kind, reason, slot and value."""
    slot = lambda p: (
        "nullif(regexp_replace(left(regexp_replace(regexp_replace(replace(replace(replace(lower("
        f"left(trim(regexp_extract(norm, '(?i){p}', 1)), 60)), 'å', 'a'), 'ä', 'a'), 'ö', 'o'), '[^a-z0-9]+', '_', 'g'), "
        "'^_+|_+$', '', 'g'), 48), '_+$', ''), '')"
    )
    value = lambda p, g: f"nullif(trim(left(trim(regexp_extract(norm, '(?i){p}', {g})), 280), ' .,;:'), '')"
    s, pref = routing.SLOT_PATTERNS, routing.PREFERENCE_PATTERNS
    hits = [f"({slot(p)} IS NOT NULL AND {value(p, 2)} IS NOT NULL)" for p in s]
    slot_case = " ".join(f"WHEN {h} THEN {slot(p)}" for h, p in zip(hits, s))
    value_case = " ".join(f"WHEN {h} THEN {value(p, 2)}" for h, p in zip(hits, s))
    liked = f"coalesce({value(pref[0], 1)}, {value(pref[1], 1)})"
    cte(
        name,
        f"""
        SELECT *, CASE WHEN type = 'session' THEN 'episodic' WHEN ps >= greatest(2, es + 1) THEN 'procedural'
                    WHEN es >= 2 THEN 'episodic' ELSE 'semantic' END AS memory_kind,
               CASE WHEN type = 'session' THEN 'memory_type_hint=session' WHEN ps >= greatest(2, es + 1) THEN 'procedural_hints'
                    WHEN es >= 2 THEN 'episodic_hints' ELSE 'default_semantic' END AS reason,
               CASE {slot_case} WHEN {liked} IS NOT NULL THEN 'preference' END AS memory_slot,
               CASE {value_case} ELSE {liked} END AS memory_value
        FROM (SELECT *, {_count('lower(norm)', routing.PROCEDURAL_HINTS)} + CASE WHEN {_any('lower(norm)', routing.PROCEDURE_PATTERNS)} THEN 2 ELSE 0 END AS ps,
                     {_count('lower(norm)', routing.EPISODIC_HINTS)} + CASE WHEN {_any('lower(norm)', routing.EPISODE_PATTERNS)} THEN 2 ELSE 0 END AS es
              FROM {source})
        """,
        source,
    )


cte(
    "mem_raw",
    """
    SELECT 'm' || event_id AS memory_id, event_type, k,
      CASE event_type WHEN 'view' THEN 'session' WHEN 'purchase' THEN 'long_term' ELSE 'working' END AS type,
      CASE event_id % 6 WHEN 0 THEN 'My favorite editor is tool_' || (k % 10) WHEN 1 THEN 'Step by step workflow: 1. run job_' || k || ' 2. check'
        WHEN 2 THEN 'we talked about ' || event_type || ' yesterday' WHEN 3 THEN 'todo: review ' || event_type || ' ' || k
        WHEN 4 THEN 'I prefer ' || event_type || ' ' || (k % 7) || '.' ELSE 'note on ' || event_type || ' value ' || k END AS norm,
      [event_type, CASE WHEN event_type = 'signup' AND k % 5 = 0 THEN 'To-Do' ELSE 'topic' END] AS topics, ['user_' || user_id] AS entities,
      CASE event_type WHEN 'error' THEN 'retrieval_feedback' WHEN 'signup' THEN 'context_turn' END AS kind,
      'u' || user_id AS user_id, 'p' || (k % 3) AS project_id,
      least(greatest(value / 50, 0.0), 1.0) AS importance, 0.7::DOUBLE AS confidence, k % 25 AS access_count, ts AS created_at,
      CASE event_type WHEN 'view' THEN ts + INTERVAL 1 DAY WHEN 'purchase' THEN NULL ELSE ts + INTERVAL 30 DAY END AS expires_at,
      CASE WHEN k % 10 = 0 THEN ts + INTERVAL 60 DAY END AS pinned_until,
      CASE WHEN event_type = 'error' AND k % 2 = 0 THEN ['cited', CASE WHEN k % 4 = 0 THEN 'cited' ELSE 'missed' END] END AS signals
    FROM event_keys
    """,
    "event_keys",
)
route_ctes("mem_raw", "mem")


@query(
    "memory_write_batch",
    with_ctes(
        """
        SELECT memory_id, type AS memory_type, norm AS text, array_to_string(topics, '|') AS topics, array_to_string(entities, '|') AS entities,
               kind, memory_kind, reason AS router_reason, memory_slot, memory_value, user_id, project_id, round(importance, 6) AS importance,
               confidence, access_count::BIGINT AS access_count, strftime(expires_at, '%Y-%m-%d %H:%M:%S') AS expires_at FROM mem
        """,
        "mem",
    ),
)
def memory_write_batch(spark, sf_dir):
    return b.memory_items(spark, sf_dir).select(
        "memory_id", "memory_type", "text", F.array_join("topics", "|").alias("topics"),
        F.array_join("entities", "|").alias("entities"), "kind", "memory_kind", "router_reason", "memory_slot",
        "memory_value", "user_id", "project_id", F.round("importance", 6).alias("importance"), "confidence",
        "access_count", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires_at"),
    )


cte(
    "routable",
    f"""
    SELECT conv_id, turn, left({norm('text')}, 4000) AS norm, 'working' AS type FROM conversations
    UNION ALL SELECT event_id + 1000000, 0, 'Remember that my ' || event_type || ' colour is ' || event_type || ';', 'working' FROM events
    """,
)
route_ctes("routable", "routed")


@query(
    "memory_route",
    with_ctes(
        """
        SELECT conv_id, turn, memory_kind, reason, CASE WHEN memory_kind = 'episodic' THEN 'session' ELSE 'working' END AS memory_type,
               memory_slot, memory_value FROM routed
        """,
        "routed",
    ),
)
def memory_route(spark, sf_dir):
    spoken = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    kind = F.col("event_type")
    told = table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1000000).alias("conv_id"),
        F.lit(0).cast("long").alias("turn"),
        F.concat(F.lit("Remember that my "), kind, F.lit(" colour is "), kind, F.lit(";")).alias("text"),
    )
    norm_text = tx.user_text(F.col("text"), 4000)
    rows = spoken.unionByName(told).select("conv_id", "turn", norm_text.alias("text"))
    rows = rows.withColumn("r", routing.route(F.col("text"), F.lit("working"), F.lit(None).cast("string")))
    rows = rows.withColumn("s", routing.slot_and_value(F.col("text")))
    return rows.select(
        "conv_id", "turn", "r.memory_kind", "r.reason",
        F.when(F.col("r.memory_kind") == "episodic", "session").otherwise("working").alias("memory_type"),
        F.col("s.slot").alias("memory_slot"), F.col("s.value").alias("memory_value"),
    )


_REMEMBER = routing.REMEMBER
_KIND = routing.KIND_PREFIX


@query(
    "memory_remember",
    f"""
    WITH q AS (SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'remember this: my ' || event_type || ' is blue'
        WHEN 1 THEN '  Kom ihåg att ' || event_type WHEN 2 THEN 'Remember as Procedural: run ' || event_type ELSE 'what about ' || event_type END AS t FROM events
      UNION ALL SELECT 1000000 + conv_id * 100 + turn, text FROM conversations),
    n AS (SELECT id, left({norm('t')}, 2400) AS t FROM q),
    r AS (SELECT id, regexp_matches(t, '(?is){_REMEMBER}') AS ok, regexp_replace(left(trim(regexp_extract(t, '(?is){_REMEMBER}', 1)), 2000), '^[: -]+', '') AS rest FROM n)
    SELECT id, ok AS is_command, CASE WHEN ok THEN CASE WHEN regexp_matches(rest, '(?is){_KIND}') THEN trim(regexp_extract(rest, '(?is){_KIND}', 2)) ELSE rest END END AS text,
           CASE WHEN ok AND regexp_matches(rest, '(?is){_KIND}') THEN lower(regexp_extract(rest, '(?is){_KIND}', 1)) END AS memory_kind FROM r
    """,
)
def memory_remember(spark, sf_dir):
    kind, form = F.col("event_type"), F.col("event_id") % 4
    asked = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.when(form == 0, F.concat(F.lit("remember this: my "), kind, F.lit(" is blue")))
        .when(form == 1, F.concat(F.lit("  Kom ihåg att "), kind))
        .when(form == 2, F.concat(F.lit("Remember as Procedural: run "), kind))
        .otherwise(F.concat(F.lit("what about "), kind))
        .alias("t"),
    )
    spoken = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn") + 1000000).alias("id"), F.col("text").alias("t")
    )
    return asked.unionByName(spoken).select("id", routing.explicit_remember(F.col("t")).alias("r")).select("id", "r.*")


@query(
    "memory_scope_filter",
    with_ctes(
        """
        , s AS (SELECT DISTINCT user_id AS want FROM mem WHERE project_id = 'p0')
        SELECT memory_id, user_id, project_id FROM mem WHERE project_id = 'p0' AND user_id IN (SELECT want FROM s)
        """,
        "mem",
    ),
)
def memory_scope_filter(spark, sf_dir):
    # Even events keep the scope at the top level of the references, odd ones below "scope".
    items = b.stored_memories(spark, sf_dir)
    flat = F.to_json(F.struct("user_id", "project_id"))
    nested = F.to_json(F.struct(F.struct("user_id", "project_id").alias("scope")))
    even = F.substring("memory_id", -1, 1).isin("0", "2", "4", "6", "8")
    written = items.select("memory_id", F.when(even, flat).otherwise(nested).alias("source_refs"))
    scoped = memory.with_scope(written)
    none = F.lit(None).cast("string")
    asked = items.where("project_id = 'p0'").select("user_id", "project_id").distinct().withColumn("session_id", none)
    return (
        scoped.alias("i")
        .join(asked.alias("q"), F.col("i.user_id") == F.col("q.user_id"))
        .where(memory.in_scope("q", "i"))
        .select("i.memory_id", "i.user_id", "i.project_id")
    )


@query(
    "memory_expired",
    with_ctes(
        f"""
        SELECT memory_id, coalesce(expires_at <= {AS_OF_SQL}, false) AS hidden_from_recall,
               coalesce(expires_at <= {AS_OF_SQL} AND (pinned_until IS NULL OR pinned_until < {AS_OF_SQL}), false) AS deletable
        FROM mem
        """,
        "mem",
    ),
)
def memory_expired(spark, sf_dir):
    items = b.memory_items(spark, sf_dir)
    # Times pass through text, as they are stored there, and are read back leniently.
    text = F.concat(F.date_format("expires_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    items = items.withColumn("expires_at", routing.parse_time(F.coalesce(text, F.lit("never"))))
    hidden = F.col("expires_at") <= b.as_of()
    return items.select(
        "memory_id",
        F.coalesce(hidden, F.lit(False)).alias("hidden_from_recall"),
        F.coalesce(memory.expired(items, b.as_of()), F.lit(False)).alias("deletable"),
    )


@query(
    "memory_todo",
    with_ctes(
        "SELECT memory_id, norm AS text FROM mem WHERE starts_with(norm, 'todo:') OR contains(kind, 'todo')", "mem"
    ),
)
def memory_todo(spark, sf_dir):
    items = b.memory_items(spark, sf_dir)
    todo = memory.is_todo(F.col("text"), F.col("topics"), F.col("kind"))
    return items.where(todo).select("memory_id", "text")


@query(
    "memory_longterm_search",
    with_ctes(
        """
        SELECT memory_id, norm AS text FROM mem WHERE type = 'long_term' AND memory_kind = 'semantic' AND project_id = 'p1'
          AND contains(lower(norm), 'prefer')
        """,
        "mem",
    ),
)
def memory_longterm_search(spark, sf_dir):
    items = memory.long_term_table(b.memory_items(spark, sf_dir))
    refs = F.to_json(F.struct("memory_kind", F.struct("project_id", "user_id").alias("scope")))
    published = memory.parsed_refs(items.withColumn("source_refs", refs).select("memory_id", "text", "source_refs"))
    kind = F.try_variant_get("source_refs", "$.memory_kind", "string")
    return memory.with_scope(stored(published, "long-term")).where(
        F.col("text").ilike("%prefer%") & (kind == "semantic") & (F.col("project_id") == "p1")
    ).select("memory_id", "text")


cte(
    "superseded",
    """
    SELECT mem.memory_id, last.memory_id AS superseded_by, last.created_at AS superseded_at, older.ids AS supersedes, coalesce(older.n, 0) AS n_old,
           coalesce(last.n, 0) AS n_new, older.near.i AS replaced_id, older.near.v AS replaced_value, last.near.i AS replaced_by, last.near.v AS new_value,
           last.near.t AS replaced_at FROM mem
    LEFT JOIN (SELECT o.memory_id AS id, arg_max(n.memory_id, n.p) AS memory_id, arg_max(n.created_at, n.p) AS created_at, count(*) AS n,
                      arg_min({'i': n.memory_id, 'v': n.memory_value, 't': n.created_at}, n.p) AS near
               FROM mem_slots o JOIN mem_slots n ON o.g = n.g AND n.p > o.p AND n.memory_value <> o.memory_value GROUP BY 1) last ON last.id = mem.memory_id
    LEFT JOIN (SELECT n.memory_id AS id, string_agg(o.memory_id, ',' ORDER BY o.p DESC) FILTER (o.p >= n.p - 60) AS ids, count(*) AS n,
                      arg_max({'i': o.memory_id, 'v': o.memory_value}, o.p) AS near
               FROM mem_slots o JOIN mem_slots n ON o.g = n.g AND n.p > o.p AND n.memory_value <> o.memory_value GROUP BY 1) older ON older.id = mem.memory_id
    """,
    "mem",
    "mem_slots",
)
cte(
    "mem_slots",
    """
    SELECT memory_id, memory_value, memory_slot, created_at, concat_ws('/', user_id, project_id, memory_kind, memory_slot) AS g,
           row_number() OVER (PARTITION BY user_id, project_id, memory_kind, memory_slot ORDER BY created_at, memory_id) AS p
    FROM mem WHERE memory_slot IS NOT NULL AND memory_value IS NOT NULL
    """,
    "mem",
)


@query(
    "memory_supersede",
    with_ctes(
        """
        SELECT memory_id, superseded_by, strftime(superseded_at, '%Y-%m-%d %H:%M:%S') AS superseded_at,
               CASE WHEN superseded_by IS NOT NULL THEN 'slot_value_conflict' END AS reason_code, coalesce(supersedes, '') AS supersedes,
               (n_old + n_new)::BIGINT AS revision_events, replaced_id, replaced_by FROM superseded
        """,
        "superseded",
    ),
)
def memory_supersede(spark, sf_dir):
    zero = F.lit(0).cast("long")
    return memory.supersede(b.stored_memories(spark, sf_dir)).select(
        "memory_id",
        "superseded_by",
        F.date_format("superseded_at", "yyyy-MM-dd HH:mm:ss").alias("superseded_at"),
        F.col("supersede_reason_code").alias("reason_code"),
        F.coalesce(F.array_join("supersedes", ","), F.lit("")).alias("supersedes"),
        (F.coalesce("n_supersedes", zero) + F.coalesce("n_superseded", zero)).alias("revision_events"),
        "replaced_id",
        "replaced_by",
    )


@query(
    "memory_revisions",
    with_ctes(
        """
        , s AS (SELECT s.*, m.memory_slot, m.memory_value, m.created_at FROM superseded s JOIN mem_slots m USING (memory_id))
        SELECT memory_id, 'supersedes' AS event, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS at, replaced_id AS counterpart_memory_id, memory_slot,
               replaced_value AS previous_value, memory_value AS new_value FROM s WHERE replaced_id IS NOT NULL
        UNION ALL SELECT memory_id, 'superseded', strftime(replaced_at, '%Y-%m-%d %H:%M:%S'), replaced_by, memory_slot, memory_value, new_value FROM s WHERE replaced_by IS NOT NULL
        """,
        "superseded",
    ),
)
def memory_revisions(spark, sf_dir):
    events = memory.revision_events(b.stored_memories(spark, sf_dir))
    return events.drop("reason_code").withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


_RECENCY = f"(1.0 / (1.0 + greatest(0.0, date_diff('microsecond', created_at, {AS_OF_SQL}) / 86400000000.0) / 14.0))"
_WEIGHT = "CASE type WHEN 'session' THEN 1.0::DOUBLE WHEN 'long_term' THEN 0.8::DOUBLE ELSE 0.9::DOUBLE END"

cte(
    "recall_q",
    """
    SELECT 'u' || user_id AS query_id, 'Review ' || arg_max(event_type, ts) AS query, 'u' || user_id AS want_user FROM events GROUP BY user_id
    UNION ALL SELECT DISTINCT 't-' || event_type, 'prefer ' || event_type, NULL FROM events
    """,
)


def recall_ctes(queries: str, name: str, limit: int, long_term: bool = True) -> None:
    topics = overlap("qt", toks("array_to_string(topics, ' ')"))
    entities = overlap("qt", toks("array_to_string(entities, ' ')"))
    far = f"""
            UNION ALL
            SELECT query_id, memory_id, type, memory_kind, norm, 'long_term',
              round((0.65::DOUBLE * {overlap('qt', toks('norm'))} + 0.35::DOUBLE * {_RECENCY}) * {_WEIGHT}, 6)
            FROM (SELECT *, {toks('query')} AS qt FROM {queries}) q JOIN mem ON (q.want_user IS NULL OR q.want_user = mem.user_id)
              AND contains(lower(norm), lower(query)) WHERE type = 'long_term'"""
    cte(
        name,
        f"""
        SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY recall_score DESC, source, memory_id) AS rank FROM (
            SELECT query_id, memory_id, type, memory_kind, norm AS text, 'local' AS source,
              round((0.50::DOUBLE * {overlap('qt', toks('norm'))} + 0.20::DOUBLE * greatest({topics}, {entities}) + 0.15::DOUBLE * {_RECENCY}
                + 0.10::DOUBLE * importance + 0.05::DOUBLE * confidence) * {_WEIGHT} + least(access_count, 20) / 200.0::DOUBLE
                + CASE WHEN pinned_until >= {AS_OF_SQL} THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END, 6) AS recall_score
            FROM (SELECT *, {toks('query')} AS qt FROM {queries}) q JOIN mem ON (q.want_user IS NULL OR q.want_user = mem.user_id)
              AND (contains(lower(norm), lower(query)) OR contains(lower(topics::VARCHAR), lower(query)) OR contains(lower(entities::VARCHAR), lower(query)))
            WHERE expires_at IS NULL OR expires_at > {AS_OF_SQL}
            {far if long_term else ''}))
        WHERE rank <= {limit}
        """,
        queries,
        "mem",
    )


recall_ctes("recall_q", "recalled", 10)
recall_ctes("recall_q", "recalled_local", 10, long_term=False)


def _recalled(spark, sf_dir):
    items = b.stored_memories(spark, sf_dir)
    return items, memory.recall(
        b.recall_queries(spark, sf_dir), items, b.as_of(), limit=10, long_term=memory.long_term_table(items)
    )


@query(
    "memory_recall_topk",
    with_ctes(
        "SELECT query_id, memory_id, type AS memory_type, memory_kind, text, source, recall_score, rank::BIGINT AS rank FROM recalled",
        "recalled",
    ),
)
def memory_recall_topk(spark, sf_dir):
    _, ranked = _recalled(spark, sf_dir)
    return ranked.select(
        "query_id", "memory_id", "memory_type", "memory_kind", "text", "source", "recall_score",
        F.col("rank").cast("long").alias("rank"),
    )


@query(
    "memory_touch",
    with_ctes(
        f"""
        , hit AS (SELECT memory_id, count(*) AS n FROM recalled_local GROUP BY 1)
        SELECT memory_id, (access_count + coalesce(hit.n, 0))::BIGINT AS access_count,
               CASE WHEN hit.memory_id IS NOT NULL THEN '2024-01-31 00:00:00' END AS last_accessed_at
        FROM mem LEFT JOIN hit USING (memory_id)
        """,
        "recalled_local",
    ),
)
def memory_touch(spark, sf_dir):
    items = b.stored_memories(spark, sf_dir)
    recalled = memory.recall(b.recall_queries(spark, sf_dir), items, b.as_of(), limit=10)
    return memory.touch(items, recalled, b.as_of()).select(
        "memory_id",
        F.col("access_count").cast("long").alias("access_count"),
        F.date_format("last_accessed_at", "yyyy-MM-dd HH:mm:ss").alias("last_accessed_at"),
    )


@query(
    "memory_maintenance",
    with_ctes(
        f"""
        , m AS (SELECT *, coalesce(expires_at <= {AS_OF_SQL} AND (pinned_until IS NULL OR pinned_until < {AS_OF_SQL}), false) AS gone FROM mem),
        f AS (SELECT *, row_number() OVER (PARTITION BY user_id, project_id ORDER BY created_at DESC, memory_id DESC) AS r FROM m WHERE NOT gone AND kind = 'retrieval_feedback'),
        d AS (SELECT memory_id, created_at, 1 AS o, 'expired' AS reason FROM m WHERE gone
              UNION ALL SELECT memory_id, created_at, 2, 'feedback_retention' FROM f WHERE created_at < {AS_OF_SQL} - INTERVAL 7 DAY
              UNION ALL SELECT memory_id, created_at, 3, 'feedback_overflow' FROM f WHERE created_at >= {AS_OF_SQL} - INTERVAL 7 DAY AND r > 2),
        p AS (SELECT *, row_number() OVER (ORDER BY o, created_at DESC, memory_id) AS n FROM d)
        SELECT reason, count(*)::BIGINT AS deleted, sum(count(*)) OVER ()::BIGINT AS deleted_total FROM p WHERE n <= 2500 GROUP BY reason
        """,
        "mem",
    ),
)
def memory_maintenance(spark, sf_dir):
    doomed = memory.maintenance(b.stored_memories(spark, sf_dir), b.as_of(), retention_days=7, keep=2, budget=2500)
    by_reason = memory.deletion_breakdown(doomed)
    total = by_reason.agg(F.sum("deleted").alias("deleted_total")).withColumn("_one", F.lit(1))
    return by_reason.withColumn("_one", F.lit(1)).join(total, "_one").drop("_one")


@query(
    "memory_stats",
    with_ctes(
        f"""
        , x AS (SELECT m.*, s.superseded_by, s.n_old, CASE WHEN s.superseded_at IS NOT NULL THEN s.superseded_at ELSE m.expires_at END AS ends,
                  m.kind = 'retrieval_feedback' AS fb, coalesce(len(signals), 0) AS ns,
                  CASE WHEN signals IS NULL THEN 1 ELSE len(list_filter(signals, lambda z: z = 'cited')) END AS nc,
                  CASE WHEN signals IS NULL THEN 2 ELSE len(list_filter(signals, lambda z: z = 'missed')) END AS nm FROM mem m JOIN superseded s USING (memory_id)),
        g AS (SELECT user_id, count(*)::BIGINT AS memory_items, count(*) FILTER (ends IS NULL OR ends > {AS_OF_SQL})::BIGINT AS active_items,
          count(*) FILTER (ends <= {AS_OF_SQL})::BIGINT AS expired_items,
          count(*) FILTER (type = 'session')::BIGINT AS type_session, count(*) FILTER (type = 'working')::BIGINT AS type_working, count(*) FILTER (type = 'long_term')::BIGINT AS type_long_term,
          count(*) FILTER (memory_kind = 'semantic')::BIGINT AS kind_semantic, count(*) FILTER (memory_kind = 'episodic')::BIGINT AS kind_episodic, count(*) FILTER (memory_kind = 'procedural')::BIGINT AS kind_procedural,
          count(superseded_by)::BIGINT AS superseded_items, count(*) FILTER (n_old > 0)::BIGINT AS supersede_actions, sum(n_old)::BIGINT AS supersede_links,
          count(*) FILTER (fb)::BIGINT AS feedback_items, coalesce(sum(ns) FILTER (fb), 0)::BIGINT AS signals_total,
          coalesce(sum(nc) FILTER (fb), 0)::BIGINT AS cited_signals, coalesce(sum(nm) FILTER (fb), 0)::BIGINT AS missed_signals FROM x GROUP BY user_id)
        SELECT *, round(superseded_items / memory_items::DOUBLE, 6) AS supersede_rate,
               CASE WHEN signals_total > 0 THEN round(cited_signals / signals_total::DOUBLE, 6) ELSE 0.0 END AS hit_rate FROM g
        """,
        "superseded",
    ),
)
def memory_stats(spark, sf_dir):
    signals = b.raw_memories(spark, sf_dir).select("memory_id", "signals", "cited_count", "missed_count")
    items = memory.supersede(b.stored_memories(spark, sf_dir)).join(signals, "memory_id")
    return memory.statistics(items, b.as_of(), ["user_id"])


@query(
    "upsert_memory",
    with_ctes(
        """
        SELECT memory_id, type AS category, norm AS text FROM mem WHERE type = 'long_term'
        UNION ALL SELECT memory_id, 'published', upper(norm) FROM mem WHERE kind = 'context_turn'
        """,
        "mem",
    ),
)
def upsert_memory(spark, sf_dir):
    items = b.stored_memories(spark, sf_dir)
    target = items.where("memory_type = 'long_term' OR kind = 'context_turn'").select(
        "memory_id", F.col("memory_type").alias("category"), "text"
    )
    published = items.where("kind = 'context_turn'").select(
        "memory_id", F.lit("published").alias("category"), F.upper("text").alias("text")
    )
    return tables.upsert(target, published, schemas.KEYS["memory"])
