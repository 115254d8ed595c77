"""Caption, transcript, speaker and voice-gallery queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.operators import chunking, speech, tables
from kbspark.plans import bindings as b
from kbspark.plans.registry import query, table
from kbspark.plans.sql import cte, with_ctes

_STRIP = r"'^[\s\x0b\x1c-\x1f\x85\p{Z}]+|[\s\x0b\x1c-\x1f\x85\p{Z}]+$', '', 'g'"
_CLOCK = "printf('%02d:%02d:%02d{m}%03d', {x} // 3600000, ({x} // 60000) % 60, ({x} // 1000) % 60, {x} % 1000)"

cte(
    "segs",
    """
    SELECT conv_id AS doc_id, turn AS seq, 'seg_' || (turn + 1) AS segment_id, turn * 10000 AS start_ms,
           turn * 10000 + 9000 AS end_ms, CASE role WHEN 'user' THEN 'UNKNOWN' WHEN 'system' THEN 'host' END AS speaker_local_id,
           role, text FROM conversations
    """,
)


def _caption_sql(mark: str, number: str, head: str) -> str:
    block = f"{number} || {_CLOCK.format(m=mark, x='start_ms')} || ' --> ' || {_CLOCK.format(m=mark, x='end_ms')} || chr(10) || t"
    return f"""
    SELECT doc_id, {head} || string_agg({block}, chr(10) || chr(10) ORDER BY seq) || chr(10) AS caption
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS n FROM
          (SELECT *, regexp_replace(text, {_STRIP}) AS t FROM segs) WHERE t <> '') GROUP BY doc_id
    """


@query(
    "caption_render",
    with_ctes(
        f"SELECT 'srt' AS format, * FROM ({_caption_sql(',', 'n || chr(10)', chr(39) * 2)}) "
        f"UNION ALL SELECT 'vtt', * FROM ({_caption_sql('.', chr(39) * 2, chr(39) + 'WEBVTT' + chr(39) + ' || chr(10) || chr(10)')})",
        "segs",
    ),
)
def caption_render(spark, sf_dir):
    segments = b.transcript_segments(spark, sf_dir)
    both = [speech.render_captions(segments, f).withColumn("format", F.lit(f)) for f in ("srt", "vtt")]
    return both[0].unionByName(both[1])


@query(
    "caption_parse",
    with_ctes(
        f"""
        , t AS (SELECT doc_id, seq, start_ms, end_ms, array_to_string(list_filter(list_transform(string_split(text, chr(10)),
                  lambda x: regexp_replace(x, {_STRIP})), lambda x: x <> ''), ' ') AS text FROM segs)
        SELECT doc_id, 'seg_' || row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS segment_id, start_ms, end_ms,
               'UNKNOWN' AS speaker_local_id, text FROM t WHERE text <> ''
        """,
        "segs",
    ),
)
def caption_parse(spark, sf_dir):
    # One caption file per segment would hide the counter, so whole documents are rendered first.
    segments = b.transcript_segments(spark, sf_dir)
    one_block = segments.withColumn("text", F.regexp_replace("text", r"\n\s*\n", "\n"))
    return speech.parse_captions(speech.render_captions(one_block)).select(
        "doc_id", "segment_id", "start_ms", "end_ms", "speaker_local_id", "text"
    )


cte(
    "packed",
    """
    SELECT * FROM (
      WITH RECURSIVE s AS (SELECT *, length(text) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS r FROM segs WHERE text <> ''),
      p AS (SELECT doc_id, r, seq, n AS carry, 1::BIGINT AS chunk_no FROM s WHERE r = 1
            UNION ALL SELECT s.doc_id, s.r, s.seq, CASE WHEN p.carry + s.n > 800 THEN s.n ELSE p.carry + s.n END,
                   CASE WHEN p.carry + s.n > 800 THEN p.chunk_no + 1 ELSE p.chunk_no END
            FROM p JOIN s ON s.doc_id = p.doc_id AND s.r = p.r + 1)
      SELECT p.chunk_no, s.* FROM p JOIN s USING (doc_id, r))
    """,
    "segs",
)


@query(
    "chunk_transcripts",
    with_ctes(
        f"""
        SELECT doc_id, 'tchunk_' || chunk_no AS segment_id, arg_min(start_ms, seq) AS start_ms, arg_max(end_ms, seq) AS end_ms,
               CASE WHEN count(DISTINCT coalesce(speaker_local_id, '-')) > 1 THEN 'MIXED' ELSE min(speaker_local_id) END AS speaker,
               regexp_replace(string_agg(text, ' ' ORDER BY seq), {_STRIP}) AS text,
               string_agg(segment_id, ',' ORDER BY seq) AS segment_ids
        FROM packed GROUP BY doc_id, chunk_no
        """,
        "packed",
    ),
)
def chunk_transcripts(spark, sf_dir):
    return speech.chunk_transcripts(b.transcript_segments(spark, sf_dir)).withColumn(
        "segment_ids", F.array_join("segment_ids", ",")
    )


@query(
    "transcript_context",
    with_ctes(
        f"""
        , c AS (SELECT doc_id, 'tchunk_' || chunk_no AS segment_id, arg_min(start_ms, seq) AS s, arg_max(end_ms, seq) AS e,
                       CASE WHEN count(DISTINCT coalesce(speaker_local_id, '-')) > 1 THEN 'MIXED' ELSE min(speaker_local_id) END AS speaker,
                       regexp_replace(string_agg(text, ' ' ORDER BY seq), {_STRIP}) AS text,
                       CASE WHEN doc_id % 3 = 0 THEN 'Organization: org_' || doc_id || ', Date: 2024-01-01' ELSE '' END AS ctx
                FROM packed GROUP BY doc_id, chunk_no)
        SELECT doc_id, segment_id, CASE WHEN coalesce(speaker, '') <> '' AND speaker <> 'MIXED' THEN
                 'Speaker: ' || speaker || ', Time: ' || (s // 1000) || 's-' || (e // 1000) || 's' || CASE WHEN ctx <> '' THEN ', ' || ctx ELSE '' END ELSE ctx END AS context_line,
               CASE WHEN doc_id % 2 = 0 THEN 'Summary: about ' || doc_id || chr(10) || text ELSE text END AS text_to_embed FROM c
        """,
        "packed",
    ),
)
def transcript_context(spark, sf_dir):
    # A third of the conversations have intake metadata, half of them a summary by the model.
    chunks = speech.chunk_transcripts(b.transcript_segments(spark, sf_dir))
    known, none = F.col("doc_id") % 3 == 0, F.lit(None).cast("string")
    context = chunking.source_context(none, F.when(known, F.concat(F.lit("org_"), "doc_id")), F.when(known, F.lit("2024-01-01")))
    summary = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("about "), "doc_id"))
    return chunks.select(
        "doc_id", "segment_id", chunking.transcript_context(F.col("speaker"), F.col("start_ms"), F.col("end_ms"), context).alias("context_line"),
        chunking.text_to_embed(summary, F.col("text")).alias("text_to_embed"),
    )


@query(
    "plain_transcript",
    with_ctes(
        f"""
        , t AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY seq) AS j FROM
                (SELECT *, regexp_replace(text, {_STRIP}) AS t FROM segs) WHERE t <> '' GROUP BY doc_id)
        SELECT doc_id, left(j, 4000) AS transcript, length(j)::BIGINT AS total_chars, length(j) > 4000 AS clipped FROM t
        """,
        "segs",
    ),
)
def plain_transcript(spark, sf_dir):
    return speech.plain_transcripts(b.transcript_segments(spark, sf_dir), 4000)


cte(
    "turns",
    """
    SELECT doc_id, seq AS turn_no, start_ms + CASE WHEN role = 'user' THEN 4000 ELSE 4500 END AS start_ms,
           end_ms + CASE WHEN length(text) > 300 THEN 4000 ELSE -6000 END AS end_ms, 'spk_' || role AS speaker
    FROM segs WHERE doc_id NOT IN (SELECT doc_id FROM segs WHERE role = 'system')
    """,
    "segs",
)
cte(
    "assigned",
    """
    SELECT s.*, coalesce(b.speaker, CASE WHEN h.doc_id IS NOT NULL THEN coalesce(s.speaker_local_id, 'UNKNOWN')
             WHEN coalesce(s.speaker_local_id, 'UNKNOWN') = 'UNKNOWN' THEN 'SPEAKER_1' ELSE s.speaker_local_id END) AS speaker
    FROM segs s LEFT JOIN (
      SELECT s.doc_id, s.segment_id, t.speaker,
             row_number() OVER (PARTITION BY s.doc_id, s.segment_id ORDER BY least(s.end_ms, t.end_ms) - greatest(s.start_ms, t.start_ms) DESC, t.turn_no) AS r
      FROM segs s JOIN turns t ON s.doc_id = t.doc_id AND s.start_ms < t.end_ms AND t.start_ms < s.end_ms) b
      ON b.doc_id = s.doc_id AND b.segment_id = s.segment_id AND b.r = 1
    LEFT JOIN (SELECT DISTINCT doc_id FROM turns) h ON h.doc_id = s.doc_id
    """,
    "turns",
)


def _assigned(spark, sf_dir):
    segments = b.transcript_segments(spark, sf_dir)
    hosted = segments.where("role = 'system'").select("doc_id").distinct()
    turns = segments.join(hosted, "doc_id", "left_anti").select(
        "doc_id",
        F.col("seq").alias("turn_no"),
        (F.col("start_ms") + F.when(F.col("role") == "user", 4000).otherwise(4500)).alias("start_ms"),
        (F.col("end_ms") + F.when(F.length("text") > 300, 4000).otherwise(-6000)).alias("end_ms"),
        F.concat(F.lit("spk_"), "role").alias("speaker"),
    )
    return speech.assign_speakers(segments, turns)


@query("assign_speakers", with_ctes("SELECT doc_id, segment_id, speaker AS speaker_local_id FROM assigned", "assigned"))
def assign_speakers(spark, sf_dir):
    return _assigned(spark, sf_dir).select("doc_id", "segment_id", "speaker_local_id")


@query(
    "speaker_enroll",
    with_ctes(
        """
        SELECT doc_id AS source_id, speaker AS speaker_local_id, count(*)::BIGINT AS segment_count,
               sha256(doc_id || ':' || speaker) AS voiceprint_id FROM assigned GROUP BY doc_id, speaker
        """,
        "assigned",
    ),
)
def speaker_enroll(spark, sf_dir):
    return speech.enroll_speakers(_assigned(spark, sf_dir))


@query(
    "voiceprint_match",
    with_ctes(
        """
        SELECT a.doc_id, segment_id, speaker AS speaker_local_id, sha256(a.doc_id || ':' || speaker) AS voiceprint_id,
               0.5::DOUBLE AS confidence, (count(*) OVER (PARTITION BY a.doc_id))::BIGINT AS matches
        FROM assigned a WHERE speaker <> 'host'
        """,
        "assigned",
    ),
)
def voiceprint_match(spark, sf_dir):
    segments = _assigned(spark, sf_dir)
    prints = speech.enroll_speakers(segments).where("speaker_local_id <> 'host'")
    stale = prints.withColumn("voiceprint_id", F.sha2("voiceprint_id", 256)).withColumn("position", F.lit(1))
    matches = speech.match_voiceprints(segments, stale.unionByName(prints.withColumn("position", F.lit(2))))
    return matches.join(speech.match_counts(matches), "doc_id")


cte(
    "gallery",
    """
    SELECT 'vp_' || s_suppkey AS voiceprint_id, CASE WHEN s_acctbal > 2000 THEN s_name END AS display_name, n_name AS org
    FROM supplier JOIN nation ON s_nationkey = n_nationkey
    """,
)
cte(
    "updates",
    """
    SELECT 'vp_' || c_custkey AS voiceprint_id, c_name AS display_name, n_name AS org, c_mktsegment AS seg
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    """,
)
cte(
    "merged",
    """
    SELECT mode, voiceprint_id,
           CASE WHEN o.voiceprint_id IS NULL OR n.voiceprint_id IS NULL OR o.org = n.org THEN coalesce(o.org, n.org) ELSE o.org || ', ' || n.org END AS organizations,
           CASE WHEN n.voiceprint_id IS NULL THEN 'supplier' WHEN o.voiceprint_id IS NULL THEN 'auto, ' || seg ELSE 'supplier, auto, ' || seg END AS tags,
           CASE WHEN mode = 'upsert' THEN coalesce(n.display_name, o.display_name) ELSE coalesce(o.display_name, n.display_name) END AS display_name,
           CASE WHEN (mode = 'upsert' AND n.voiceprint_id IS NOT NULL) OR o.voiceprint_id IS NULL THEN 'Channel' ELSE 'CEO' END AS title,
           'person_' || voiceprint_id AS person_id,
           CASE WHEN n.voiceprint_id IS NULL OR (mode = 'suggest' AND o.voiceprint_id IS NOT NULL) THEN 'table=supplier'
                ELSE 'segment=' || seg || ', table=customer' END AS refs
    FROM gallery o FULL JOIN updates n USING (voiceprint_id), (VALUES ('upsert'), ('suggest')) m(mode)
    """,
    "gallery",
    "updates",
)


def _merged(spark, sf_dir, overwrite):
    old, new = b.gallery_entries(spark, sf_dir), b.gallery_updates(spark, sf_dir)
    empty = F.lit(None).cast("string")
    return speech.merge_gallery(old.withColumn("person_id", empty), new, overwrite)


@query("gallery_merge", with_ctes("SELECT * FROM merged", "merged"))
def gallery_merge(spark, sf_dir):
    parts = [
        _merged(spark, sf_dir, overwrite).withColumn("mode", F.lit(mode))
        for mode, overwrite in (("upsert", True), ("suggest", False))
    ]
    pairs = F.transform(
        F.array_sort(F.map_entries("source_refs")), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return parts[0].unionByName(parts[1]).select(
        "mode",
        "voiceprint_id",
        F.array_join("organizations", ", ").alias("organizations"),
        F.array_join("tags", ", ").alias("tags"),
        "display_name",
        "title",
        "person_id",
        F.array_join(pairs, ", ").alias("refs"),
    )


@query(
    "gallery_text",
    with_ctes(
        """
        , t AS (SELECT voiceprint_id, concat_ws(chr(10), 'display_name: ' || display_name, 'title: ' || title, 'organizations: ' || organizations,
                  'tags: ' || tags) AS text FROM merged WHERE mode = 'upsert')
        SELECT voiceprint_id, text, sha256(text) AS text_hash FROM t
        """,
        "merged",
    ),
)
def gallery_text(spark, sf_dir):
    return speech.gallery_text(_merged(spark, sf_dir, True).drop("source_refs"))
