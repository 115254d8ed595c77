"""Scans, sinks, keyed tables, library and model-output queries."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark import schemas
from kbspark.functions import ids
from kbspark.functions import text as tx
from kbspark.operators import deletion, intake, model, tables
from kbspark.plans import bindings as b
from kbspark.plans.registry import query, table
from kbspark.plans.sql import WS, cte, norm, with_ctes
from kbspark.session import work_path
from kbspark.sources import files

cte(
    "manifests",
    """
    SELECT d.doc_num, d.doc_id AS source_id, 'v' || v || '-' || sha256(d.text) AS source_version, d.source, d.lang,
           l.doc_id IS NOT NULL AS chunked, e.vec_id IS NOT NULL AS embedded,
           TIMESTAMP '2024-01-01' + to_minutes(d.doc_num + v * 7) AS updated_at
    FROM (SELECT *, unnest(CASE WHEN lang = 'en' THEN [1, 2] ELSE [1] END) AS v FROM docs) d
    LEFT JOIN labels l ON l.doc_id = d.doc_num LEFT JOIN embeddings e ON e.vec_id = d.doc_num
    """,
    "docs",
)
cte("event_keys", "SELECT *, (props->>'$.k')::BIGINT AS k FROM events")
cte(
    "jobs",
    """
    SELECT 'j' || event_id AS job_id, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed'
             WHEN 'view' THEN 'running' ELSE 'queued' END AS status,
           CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS attempts, user_id AS doc_num,
           ts AS created_at, ts + to_minutes(k) AS updated_at FROM event_keys
    """,
    "event_keys",
)


@query("jsonl_roundtrip", with_ctes("SELECT doc_id, segment_id, text FROM chunks", "chunks"))
def jsonl_roundtrip(spark, sf_dir):
    path = work_path(spark, "chunks-jsonl")
    rows = b.chunks(spark, sf_dir).select("source", "lang", "doc_id", "segment_id", "text")
    tables.write_partitioned(rows, path, "source", "lang")
    return files.read_jsonl(spark, path, schemas.CHUNKS).select("doc_id", "segment_id", "text")


@query(
    "folder_scan",
    "SELECT 'lang=' || lang AS root, sum(strlen(text) + 1)::BIGINT AS bytes, false AS truncated "
    "FROM documents GROUP BY lang",
)
def folder_scan(spark, sf_dir):
    path = work_path(spark, "folder")
    table(spark, sf_dir, "documents").select("lang", "text").write.partitionBy("lang").text(path)
    listing = files.scan_folder(spark, path)
    return listing.groupBy("root").agg(F.sum("bytes").alias("bytes"), F.max("truncated").alias("truncated"))


@query(
    "path_allowlist",
    r"""
    WITH roots AS (SELECT DISTINCT regexp_extract(url, '^https?://[^/?#]+/en') AS root FROM pages)
    SELECT page_id, url FROM pages WHERE EXISTS (SELECT 1 FROM roots
      WHERE root <> '' AND (url = root OR starts_with(url, root || '/')))
    """,
)
def path_allowlist(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    roots = pages.select(F.regexp_extract("url", r"^https?://[^/?#]+/en", 0).alias("root"))
    return intake.allowed_paths(pages, roots, "url")


@query(
    "notes_frontmatter",
    """
    SELECT '/notes/' || CASE WHEN lang = 'de' THEN 'Inbox' ELSE lang END || '/' || doc_id || '.md' AS path,
           CASE WHEN lang <> 'fr' THEN 'ingest' END AS command,
           CASE WHEN lang <> 'fr' THEN 'title=doc: ' || doc_id ELSE '' END AS params,
           lang IN ('en', 'de') AS auto, regexp_replace(text, '^\\n+', '') AS body
    FROM documents
    """.replace("\\\\", "\\"),
)
def notes_frontmatter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    note = files.render_note(
        {"command": F.lit("ingest"), "title": F.concat(F.lit("doc: "), "doc_id"), "auto": F.col("lang") == "en"},
        F.col("text"),
    )
    notes = docs.select(
        F.concat(
            F.lit("/notes/"), F.when(F.col("lang") == "de", "Inbox").otherwise(F.col("lang")), F.lit("/"), "doc_id",
            F.lit(".md"),
        ).alias("path"),
        F.when(F.col("lang") == "fr", F.regexp_replace("text", r"^\n+", "")).otherwise(note).alias("text"),
    )
    entries = F.map_entries(F.map_filter("params", lambda k, _: k != "auto"))
    return files.parse_notes(notes).select(
        "path",
        "command",
        F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("params"),
        "auto",
        "body",
    )


@query(
    "voice_gallery_scan",
    """
    WITH v AS (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL)
    SELECT sha256(role || ':' || n) AS voiceprint_id, arg_min(role, lpad(conv_id::VARCHAR, 12, '0')) AS speaker_local_id,
           arg_min(n, lpad(conv_id::VARCHAR, 12, '0'))::BIGINT AS segment_count, min(lpad(conv_id::VARCHAR, 12, '0')) AS source_id
    FROM v GROUP BY sha256(role || ':' || n)
    """,
)
def voice_gallery_scan(spark, sf_dir):
    path = work_path(spark, "gallery")
    prints = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("n"))
    tables.write_partitioned(
        prints.select(
            F.sha2(F.concat_ws(":", "role", "n"), 256).alias("voiceprint_id"),
            F.col("role").alias("speaker_local_id"),
            F.col("n").alias("segment_count"),
            F.lpad(F.col("conv_id").cast("string"), 12, "0").alias("source_id"),
            F.col("role").alias("folder"),
        ),
        path,
        "folder",
    )
    return files.read_voice_gallery(spark, path, "*.json")


@query(
    "upsert_segments",
    with_ctes(
        """
        SELECT doc_id, segment_id, CASE WHEN lang = 'en' THEN 'EN ' || text ELSE text END AS text FROM chunks
        UNION ALL SELECT doc_id, 'summary', norm FROM docs WHERE lang = 'en'
        """,
        "chunks",
    ),
)
def upsert_segments(spark, sf_dir):
    target = b.stored_chunks(spark, sf_dir).select("lang", "doc_id", "segment_id", "text")
    english = target.where("lang = 'en'")
    older = english.withColumn("text", F.lower("text")).withColumn("updated", F.lit(1))
    newer = english.withColumn("text", F.concat(F.lit("EN "), "text")).withColumn("updated", F.lit(2))
    added = b.source_documents(spark, sf_dir).where("lang = 'en'").select(
        "lang", "doc_id", F.lit("summary").alias("segment_id"),
        tx.normalize_space(F.col("text")).alias("text"), F.lit(1).alias("updated"),
    )
    source = older.unionByName(newer).unionByName(added)
    merged = tables.upsert(target, source, schemas.KEYS["kb_segments"], F.col("updated").desc())
    return merged.select("doc_id", "segment_id", "text")


@query(
    "delete_sources",
    with_ctes(
        """
        SELECT 'manifests' AS table_name, count(*) FILTER (lang = 'de')::BIGINT AS deleted, count(*) FILTER (lang <> 'de')::BIGINT AS kept FROM manifests
        UNION ALL SELECT 'segments', count(*) FILTER (lang = 'de')::BIGINT, count(*) FILTER (lang <> 'de')::BIGINT FROM chunks
        """,
        "manifests",
        "chunks",
    ),
)
def delete_sources(spark, sf_dir):
    doomed = b.source_documents(spark, sf_dir).where("lang = 'de'").select(F.col("doc_id").alias("source_id"))
    parts = []
    targets = {
        "manifests": b.manifests(spark, sf_dir).select("source_id", "source_version"),
        "segments": b.stored_chunks(spark, sf_dir).select(F.col("doc_id").alias("source_id"), "segment_id"),
    }
    for name, df in targets.items():
        kept, gone = tables.delete_keys(df, doomed, ["source_id"])
        left = kept.agg(F.count(F.lit(1)).alias("kept")).withColumn("table_name", F.lit(name))
        parts.append(gone.withColumn("table_name", F.lit(name)).join(left, "table_name"))
    return parts[0].unionByName(parts[1])


@query(
    "delete_cascade",
    with_ctes(
        """
        , rows AS (
          SELECT 'manifests' AS table_name, source_id, lang FROM manifests
          UNION ALL SELECT 'jobs', d.doc_id, d.lang FROM jobs JOIN docs d USING (doc_num)
          UNION ALL SELECT 'embeddings', d.doc_id, d.lang FROM embeddings JOIN docs d ON d.doc_num = vec_id
          UNION ALL SELECT 'kb_segments', doc_id, lang FROM chunks
          UNION ALL SELECT 'relations', doc_id, lang FROM docs)
        SELECT table_name, source_id, count(*)::BIGINT AS kept, (SELECT count(*) FROM rows g WHERE g.table_name = rows.table_name AND g.lang = 'de')::BIGINT AS deleted
        FROM rows WHERE lang <> 'de' GROUP BY table_name, source_id
        """,
        "manifests",
        "jobs",
        "docs",
        "chunks",
    ),
)
def delete_cascade(spark, sf_dir):
    """German documents are gone from their folder; what belongs to them goes from all tables."""
    docs = b.source_documents(spark, sf_dir)
    names = docs.select("doc_num", F.col("doc_id").alias("source_id"))
    frames = {
        "manifests": b.manifests(spark, sf_dir).select("source_id", "source_version", "updated_at"),
        "jobs": b.jobs(spark, sf_dir).join(names, "doc_num").drop("doc_num"),
        "embeddings": b.stored_vectors(spark, sf_dir).drop("doc_id"),
        "kb_segments": b.chunks(spark, sf_dir).select("doc_id", "segment_id", "text"),
        "relations": docs.select(F.concat("doc_id", F.lit("-has_topic-"), "lang").alias("rel_id"), "doc_id", F.col("lang").alias("obj_entity_id")),
    }
    base = work_path(spark, "store")
    folders = {name: f"{base}/{name}" for name in frames}
    for name, df in frames.items():
        deletion.write_table(df, folders[name], deletion.SOURCE_KEYS[name])
    listing = docs.select(F.concat("source", F.lit("/"), "doc_num").alias("path"), F.sha2("text", 256).alias("source_version"), "lang")
    doomed = deletion.deleted_sources(listing.drop("lang"), listing.where("lang <> 'de'").drop("lang"))
    counts = deletion.delete_sources(spark, folders, doomed, f"{base}/run")
    left = [
        spark.read.parquet(folders[n]).groupBy(F.col(deletion.SOURCE_KEYS[n]).alias("source_id")).agg(F.count(F.lit(1)).alias("kept")).withColumn("table_name", F.lit(n))
        for n in frames
    ]
    return reduce(DataFrame.unionByName, left).join(counts.drop("rewritten"), "table_name")


@query(
    "segments_filtered",
    with_ctes(
        """
        SELECT c.doc_id, c.segment_id, c.text FROM chunks c
        WHERE c.lang = 'en' AND c.source = 'src1' AND contains(lower(c.text), 'the')
          AND TIMESTAMP '2024-01-01' + to_minutes(c.doc_num + 14) BETWEEN TIMESTAMP '2024-01-01 01:00:00' AND TIMESTAMP '2024-01-01 16:00:00'
        """,
        "chunks",
    ),
)
def segments_filtered(spark, sf_dir):
    segments = b.chunks(spark, sf_dir).select(
        "doc_id", "segment_id", "text", F.array("lang", "source").alias("topics"),
        F.array(F.upper("lang")).alias("entities"),
    )
    documents = b.manifests(spark, sf_dir).select(
        F.col("source_id").alias("doc_id"), "source_version", "source_type", F.col("updated_at").alias("created_at")
    )
    joined = tables.segments_with_documents(segments, documents)
    return tables.filter_segments(
        joined, topics=["en", "src1"], entities=["EN"], source_type="src1",
        date_from="2024-01-01 01:00:00", date_to="2024-01-01 16:00:00", text_like="the",
    ).select("doc_id", "segment_id", "text")


@query(
    "publish_rows",
    with_ctes(
        """
        SELECT c.doc_id, c.segment_id, c.text, CASE WHEN l.doc_id IS NULL THEN '' ELSE c.lang || '|' || c.source END AS topics,
               CASE WHEN l.quality = 1 THEN c.text ELSE '' END AS summary_short
        FROM chunks c LEFT JOIN labels l ON l.doc_id = c.doc_num
        """,
        "chunks",
    ),
)
def publish_rows(spark, sf_dir):
    chunks = b.stored_chunks(spark, sf_dir).select("doc_num", "doc_id", "segment_id", "text", "lang", "source")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("doc_num"), "quality")
    enriched = chunks.join(labels, "doc_num").withColumn("topics", F.array("lang", "source"))
    enriched = enriched.withColumn("entities", F.array(F.upper("lang")))
    segments = tables.segment_rows(chunks, enriched.drop("quality"))
    documents = tables.document_rows(
        segments.select(F.col("doc_id").alias("source_id"), F.col("segment_id").alias("source_version"), "text", "topics"),
        enriched.where("quality = 1").select(
            F.col("doc_id").alias("source_id"),
            F.col("segment_id").alias("source_version"),
            F.col("text").alias("summary_short"),
            F.lit(None).cast("string").alias("summary_long"),
        ),
    )
    return documents.select(
        "doc_id",
        F.col("source_version").alias("segment_id"),
        "text",
        F.array_join("topics", "|").alias("topics"),
        "summary_short",
    )


@query(
    "library_status",
    with_ctes(
        """
        , latest AS (SELECT * FROM manifests QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY updated_at DESC, source_version DESC) = 1),
        vec AS (SELECT vec_id AS doc_num, count(*) AS n FROM embeddings GROUP BY 1),
        failed AS (SELECT doc_num, count(*) AS n FROM jobs WHERE status = 'failed' GROUP BY 1)
        SELECT l.source_id, l.source_version, strftime(l.updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at,
               (CASE WHEN chunked THEN 3 ELSE 0 END)::BIGINT AS chunks, coalesce(vec.n, 0)::BIGINT AS embeddings,
               CASE WHEN failed.n > 0 THEN 'failed' WHEN embedded THEN 'embeddings done' WHEN chunked THEN 'chunks done' ELSE 'ingest done' END AS status
        FROM latest l LEFT JOIN vec USING (doc_num) LEFT JOIN failed USING (doc_num)
        """,
        "manifests",
        "jobs",
    ),
)
def library_status(spark, sf_dir):
    names = b.source_documents(spark, sf_dir).select("doc_num", F.col("doc_id").alias("source_id"))
    jobs = b.jobs(spark, sf_dir).join(names, "doc_num")
    status = tables.library_status(b.manifests(spark, sf_dir), b.stored_vectors(spark, sf_dir), jobs)
    return status.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


@query(
    "intake_dedupe",
    """
    SELECT 'file:' || source || '/' || doc_id AS source_id, sha256(text) AS source_version,
           CASE WHEN lang = 'en' THEN 'already_ingested' WHEN lang = 'de' THEN 'already_queued' ELSE 'enqueued' END AS reason
    FROM documents
    """,
)
def intake_dedupe(spark, sf_dir):
    listed = b.source_documents(spark, sf_dir).select(
        F.col("doc_id").alias("source_id"), F.sha2("text", 256).alias("source_version"), "lang"
    )
    manifests = listed.where("lang = 'en'")
    status = F.when(F.col("lang") == "de", "running").otherwise("done")
    jobs = listed.withColumn("status", status)
    return intake.new_file_versions(listed.drop("lang"), manifests, jobs)


@query(
    "listing_diff",
    """
    SELECT '/docs/' || doc_id AS path, CASE lang WHEN 'de' THEN 'deleted' WHEN 'fr' THEN 'changed' END AS change
    FROM documents WHERE lang IN ('de', 'fr')
    UNION ALL SELECT '/pages/' || page_id, 'created' FROM pages
    """,
)
def listing_diff(spark, sf_dir):
    previous = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/docs/"), "doc_id").alias("path"), F.sha2("text", 256).alias("source_version"), "lang"
    )
    edited = F.when(F.col("lang") == "fr", F.sha2("source_version", 256)).otherwise(F.col("source_version"))
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("/pages/"), "page_id").alias("path"), F.sha2("html", 256).alias("source_version")
    )
    current = previous.where("lang <> 'de'").select("path", edited.alias("source_version")).unionByName(pages)
    return intake.listing_changes(previous, current).select("path", "change")


@query(
    "intake_metadata",
    """
    WITH j AS (SELECT d.doc_id, d.lang, d.source, l.doc_id IS NOT NULL AS fresh, l.quality FROM documents d LEFT JOIN labels l USING (doc_id))
    SELECT doc_id, CASE WHEN fresh THEN lang || '|' || source || '|Quality' ELSE lang || '|' || source END AS tags,
           CASE WHEN fresh THEN 'seen ' || lang ELSE 'c8' END AS context,
           CASE WHEN fresh THEN 'c2|c3|c4|c5|c6|c7|c8|seen ' || lang ELSE 'c1|c2|c3|c4|c5|c6|c7|c8' END AS contexts,
           CASE WHEN fresh AND quality = 1 THEN 'rev_' || doc_id ELSE 'sp_' || lang END AS speaker,
           'org_' || source AS organization,
           CASE WHEN fresh AND quality = 1 THEN '2024-01-02' ELSE '2024-01-01' END AS event_date
    FROM j
    """,
)
def intake_metadata(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    old = docs.select(
        F.col("doc_id").alias("source_id"),
        F.array("lang", "source").alias("tags"),
        F.lit("c8").alias("context"),
        F.array(*[F.lit(f"c{i}") for i in range(1, 9)]).alias("contexts"),
        F.concat(F.lit("sp_"), "lang").alias("speaker"),
        F.concat(F.lit("org_"), "source").alias("organization"),
        F.lit("2024-01-01").alias("event_date"),
    )
    good = F.col("quality") == 1
    new = docs.join(table(spark, sf_dir, "labels"), "doc_id").select(
        F.col("doc_id").alias("source_id"),
        F.array(F.concat(F.upper("source"), F.lit(", Quality")), F.upper("lang")).alias("tags"),
        F.concat(F.lit(" seen "), "lang").alias("context"),
        F.when(good, F.concat(F.lit("rev_"), "doc_id")).alias("speaker"),
        F.lit(None).cast("string").alias("organization"),
        F.when(good, "2024-01-02").otherwise("2 Jan").alias("event_date"),
    )
    return intake.merge_intake_metadata(old, new).select(
        F.col("source_id").alias("doc_id"),
        F.array_join("tags", "|").alias("tags"),
        "context",
        F.array_join("contexts", "|").alias("contexts"),
        "speaker",
        "organization",
        "event_date",
    )


@query(
    "report_top_initiatives",
    """
    SELECT row_number() OVER (ORDER BY p_size DESC, p_partkey)::BIGINT AS position,
           '- ' || p_name || ' (score ' || (p_size::DOUBLE)::VARCHAR || ') — ' || p_type AS line
    FROM part QUALIFY position <= 5
    """,
)
def report_top_initiatives(spark, sf_dir):
    scores = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("initiative_id"),
        F.col("p_name").alias("title"),
        F.col("p_size").cast("double").alias("overall_score"),
        F.col("p_type").alias("rationale"),
    )
    from kbspark.operators.initiatives import top_lines

    path = work_path(spark, "reports")
    tables.append_rows(top_lines(scores), path)
    return spark.read.parquet(path).select("position", "line")


@query(
    "initiative_validate",
    """
    SELECT p_partkey AS initiative_id, p_size % 7 <> 0 AND p_size % 11 <> 0 AND p_size <> 13 AS valid,
           CASE WHEN p_size = 13 THEN NULL ELSE concat_ws(',', CASE WHEN p_size % 7 = 0 THEN 'title' END,
                CASE WHEN p_size % 11 = 0 THEN 'time_to_value' END) END AS missing FROM part
    """,
)
def initiative_validate(spark, sf_dir):
    size = F.col("p_size")
    body = F.to_json(
        F.struct(
            F.col("p_partkey").cast("string").alias("initiative_id"),
            F.when(size % 7 != 0, F.col("p_name")).alias("title"),
            F.col("p_type").alias("problem_statement"),
            F.col("p_brand").alias("users_affected"),
            F.array("p_brand").alias("data_sources"),
            F.lit("high").alias("feasibility"),
            F.lit("low").alias("risk_compliance"),
            F.lit("value").alias("expected_value"),
            F.array("p_type").alias("dependencies"),
            F.when(size % 11 != 0, F.lit("3m")).alias("time_to_value"),
            F.lit("fit").alias("strategic_alignment"),
        )
    )
    raw = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("initiative_id"),
        F.when(size == 13, F.lit("no json here")).otherwise(body).alias("payload"),
    )
    return model.validate_initiatives(raw, schemas.INITIATIVE_INPUT).select(
        "initiative_id", "valid", F.array_join("missing", ",").alias("missing")
    )


@query(
    "sanitize_plans",
    f"""
    WITH w AS (SELECT doc_id, lang, source, list_filter(regexp_split_to_array({norm('text')}, ' '), lambda x: x <> '') AS w, n_chars FROM documents),
    u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
    f AS (SELECT doc_id, CASE WHEN length(word) <= 80 THEN word ELSE left(word, 80) END AS word, min(i) AS i FROM u GROUP BY ALL),
    t AS (SELECT doc_id, string_agg(word, '|' ORDER BY i) AS topics FROM
          (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM f) WHERE r <= 10 GROUP BY 1)
    SELECT doc_id AS plan_id, 'ask' AS intent, coalesce(t.topics, '') AS topics, source AS source_type,
           CASE lang WHEN 'en' THEN 'semantic' WHEN 'de' THEN 'procedural' END AS memory_kind,
           CASE WHEN lang <> 'de' THEN '2024-01-01' END AS date_from,
           least(greatest(n_chars - 50, 1), 20)::INTEGER AS retrieve_top_k, lang = 'fr' AS need_strong_model
    FROM w LEFT JOIN t USING (doc_id)
    """,
)
def sanitize_plans(spark, sf_dir):
    lang = F.col("lang")
    none = F.lit(None).cast("string")
    plans = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("plan_id"),
        F.lit("  ").alias("intent"),
        tx.words(F.col("text")).alias("topics"),
        F.array(lang).alias("entities"),
        F.concat(F.lit(" "), "source", F.lit("\n")).alias("source_type"),
        none.alias("memory_type"),
        F.when(lang == "en", "Semantic").when(lang == "de", "PROCEDURAL ").otherwise("other").alias("memory_kind"),
        none.alias("user_id"),
        F.when(lang == "de", "Jan 2024").otherwise(" 2024-01-01 ").alias("date_from"),
        none.alias("date_to"),
        (F.col("n_chars") - 50).cast("string").alias("retrieve_top_k"),
        (lang == "fr").alias("need_strong_model"),
    )
    return model.sanitize_plans(plans).select(
        "plan_id", "intent", F.array_join("topics", "|").alias("topics"), "source_type", "memory_kind", "date_from",
        "retrieve_top_k", "need_strong_model",
    )


@query(
    "parse_model_output",
    """
    SELECT doc_id, lang IN ('en', 'de') AS valid,
           CASE lang WHEN 'en' THEN 'short ' || doc_id WHEN 'de' THEN 'kurz' END AS summary_short,
           CASE lang WHEN 'en' THEN lang || '|' || source END AS topics
    FROM documents
    """,
)
def parse_model_output(spark, sf_dir):
    lang = F.col("lang")
    english = F.to_json(
        F.struct(
            F.concat(F.lit("short "), "doc_id").alias("summary_short"),
            F.lit("long } text").alias("summary_long"),
            F.array("lang", "source").alias("topics"),
        )
    )
    raw = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(lang == "en", F.concat(F.lit("Sure, here it is:\n"), english, F.lit("\nDone.")))
        .when(lang == "de", '{"summary_short": "kurz", "summary_long": "lang"}')
        .when(lang == "fr", '{"summary_short": "court"')
        .otherwise("no json")
        .alias("raw"),
    )
    parsed = model.parse_output(
        raw, "raw", schemas.MODEL_OUTPUT["enrich_doc"], required=("summary_short", "summary_long")
    )
    return parsed.select(
        "doc_id",
        "valid",
        F.col("parsed.summary_short").alias("summary_short"),
        F.array_join("parsed.topics", "|").alias("topics"),
    )


@query(
    "run_log_cap",
    """
    WITH p AS (SELECT doc_id, '{"doc_id":' || doc_id || ',"words":"' || regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g') || '"}' AS e FROM documents)
    SELECT doc_id, length(e) > 20000 AS truncated, CASE WHEN length(e) <= 20000 THEN e ELSE
      '{"field":"input_json","note":"input_json truncated to 20000 chars","preview":' || to_json(left(e, 19780))::VARCHAR ||
      ',"raw_chars":' || length(e) || ',"truncated":true}' END AS payload FROM p
    """,
)
def run_log_cap(spark, sf_dir):
    encoded = F.to_json(F.struct("doc_id", F.regexp_replace("text", "[^A-Za-z0-9 ]", "").alias("words")))
    docs = table(spark, sf_dir, "documents").select("doc_id", encoded.alias("e"))
    return docs.select(
        "doc_id",
        (F.length("e") > 20000).alias("truncated"),
        model.capped_payload(F.col("e"), 20000, "input_json").alias("payload"),
    )


def _longest_words(texts: pd.Series) -> pd.Series:
    """A stand-in model: the first word as summary, the word count as topic."""
    import json

    parts = texts.str.split(" ")
    return parts.map(lambda w: "Result: " + json.dumps({"topics": [str(len(w))], "entities": [w[0]]}))


@query(
    "model_apply",
    with_ctes(
        """
        SELECT doc_id, segment_id, true AS valid, len(string_split(text, ' '))::VARCHAR AS topics,
               split_part(text, ' ', 1) AS entities FROM chunks
        """,
        "chunks",
    ),
)
def model_apply(spark, sf_dir):
    chunks = b.chunks(spark, sf_dir).select("doc_id", "segment_id", "text")
    parsed = model.parse_output(
        model.apply_model(chunks, _longest_words), "raw_output", schemas.MODEL_OUTPUT["enrich_chunk"]
    )
    return parsed.select(
        "doc_id",
        "segment_id",
        "valid",
        F.array_join("parsed.topics", ",").alias("topics"),
        F.array_join("parsed.entities", ",").alias("entities"),
    )
