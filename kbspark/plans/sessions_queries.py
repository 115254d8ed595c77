"""Session digest, snapshot and resume queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.operators import sessions
from kbspark.plans import bindings as b
from kbspark.plans import tables_queries  # noqa: F401  (defines shared tables of the SQL side)
from kbspark.plans.registry import query
from kbspark.plans.sql import cte, with_ctes
from kbspark.session import stored

_STRIP = r"'^[\s\x0b\x1c-\x1f\x85\p{Z}]+|[\s\x0b\x1c-\x1f\x85\p{Z}]+$', '', 'g'"
AS_OF_TEXT = "2024-01-31T00:00:00"

cte(
    "qa",
    f"""
    SELECT u.conv_id, u.turn, rtrim(left(regexp_replace(u.text, {_STRIP}), 1200), ' ' || chr(10)) AS q,
           rtrim(left(regexp_replace(n.text, {_STRIP}), 3000), ' ' || chr(10)) AS a
    FROM conversations u JOIN conversations n ON n.conv_id = u.conv_id AND n.turn = u.turn + 1
    WHERE u.role = 'user' AND n.role = 'assistant'
    """,
)
_HINTS = "|".join(sessions.ACTION_HINTS)
cte(
    "handoff",
    f"""
    SELECT conv_id, turn_count, array_to_string(list_concat(['# Session Handoff', 'Updated: {AS_OF_TEXT}', '', 'Current focus:', '- ' || qs[1], '', 'Recent threads:'],
        list_transform(threads, lambda x: '- ' || x), ['', 'Latest answer snapshot:', left(a, 800), '', 'Next actions:'],
        list_transform(list_slice(CASE WHEN len(hinted) > 0 THEN hinted ELSE [left(a, 180)] END, 1, 6), lambda x: '- ' || x),
        ['', 'Evidence anchors:'], list_transform(anchors, lambda x: '- ' || x), ['']), chr(10)) AS digest
    FROM (
      SELECT conv_id, count(*)::BIGINT AS turn_count, list(q ORDER BY turn DESC) AS qs, arg_max(a, turn) AS a,
        list_slice(list('d' || conv_id || ':seg_' || turn ORDER BY turn DESC), 1, 8) AS anchors,
        list_transform(list_filter(list_transform(regexp_split_to_array(arg_max(a, turn), '[.\\n!?]+'), lambda s: trim(s, ' -' || chr(9))),
          lambda s: s <> '' AND regexp_matches(lower(s), '{_HINTS}')), lambda s: left(s, 180)) AS hinted,
        (SELECT list(q ORDER BY t DESC) FROM (SELECT q, max(turn) AS t FROM
           (SELECT * FROM qa i WHERE i.conv_id = o.conv_id ORDER BY turn DESC LIMIT 6) GROUP BY q)) AS threads
      FROM qa o WHERE q <> '' AND a <> '' GROUP BY conv_id)
    """.replace("\\\\", "\\"),
    "qa",
)


@query("session_handoff", with_ctes("SELECT conv_id AS session_id, turn_count, digest FROM handoff", "handoff"))
def session_handoff(spark, sf_dir):
    return sessions.handoff(b.conversation_turns(spark, sf_dir), AS_OF_TEXT)


cte(
    "eturns",
    """
    SELECT user_id, ts, event_id, 'ask ' || event_type || ' ' || (k % 4) AS q, 'answer ' || event_type || ' ' || k AS a,
           row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM event_keys
    """,
    "event_keys",
)
cte(
    "snaps",
    """
    SELECT user_id, (g + 1) * 12 AS turn_count, 'Session pre-compaction snapshot at ' || ((g + 1) * 12) || ' turns.' || chr(10) || 'Latest focus:' || chr(10) || '- ' || arg_max(q, n)
           || chr(10) || 'Recent threads:' || chr(10) || (SELECT string_agg('- ' || q, chr(10) ORDER BY m DESC) FROM (SELECT q, max(n) AS m FROM eturns i
                WHERE i.user_id = o.user_id AND i.n > (g + 1) * 12 - 6 AND i.n <= (g + 1) * 12 GROUP BY q))
           || chr(10) || 'Latest answer snapshot:' || chr(10) || arg_max(a, n) AS summary
    FROM (SELECT *, (n - 1) // 12 AS g FROM eturns) o GROUP BY user_id, g HAVING count(*) = 12
    """,
    "eturns",
)


@query(
    "session_compaction",
    with_ctes("SELECT user_id AS session_id, turn_count::BIGINT AS turn_count, summary FROM snaps", "snaps"),
)
def session_compaction(spark, sf_dir):
    return sessions.snapshots(b.event_turns(spark, sf_dir))


cte(
    "opened",
    """
    SELECT user_id, event_id, q, opens, sum(opens::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session_no FROM (
      SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL 45 MINUTE, true) AS opens FROM eturns WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    """,
    "eturns",
)


@query(
    "session_resume_turns",
    with_ctes(
        """
        SELECT event_id AS turn_id, session_no, 'doc' AS doc_id, 0.5::DOUBLE AS score, 1 AS rank, q AS text_snippet FROM opened
        UNION ALL SELECT event_id, session_no, 'context:auto_handoff', 1.05::DOUBLE, 0, left(digest, 1800) FROM opened JOIN handoff ON handoff.conv_id = opened.user_id WHERE opens
        """,
        "opened",
        "handoff",
    ),
)
def session_resume_turns(spark, sf_dir):
    turns = b.event_turns(spark, sf_dir).drop("answer")
    opened = stored(sessions.resume_turns(turns).withColumnRenamed("turn_no", "turn_id").drop("ts"), "opened")
    evidence = opened.select(
        "turn_id", F.lit("doc").alias("doc_id"), F.lit("state").alias("segment_id"),
        F.col("question").alias("text_snippet"), F.lit(0.5).alias("score"), F.lit(1).alias("rank"),
    )
    digests = stored(sessions.handoff(b.conversation_turns(spark, sf_dir), AS_OF_TEXT), "digests")
    return sessions.resume_evidence(opened, evidence, digests, ["session_no"]).select(
        "turn_id", "session_no", "doc_id", "score", "rank", "text_snippet"
    )
