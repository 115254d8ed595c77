"""Text, id, link and chunk queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.functions import ids
from kbspark.functions import text as tx
from kbspark.operators import chunking, intake
from kbspark.plans import bindings as b
from kbspark.plans.registry import query, table
from kbspark.session import work_path
from kbspark.sources import files
from kbspark.plans.sql import WS, norm, overlap, toks, with_ctes


@query(
    "scan_documents",
    with_ctes(
        "SELECT doc_id AS source_id, sha256(norm) AS source_version, norm AS text FROM docs", "docs"
    ),
)
def scan_documents(spark, sf_dir):
    # Every document becomes a text file of its own, and the files are scanned.
    path = work_path(spark, "documents")
    files.write_text_documents(b.source_documents(spark, sf_dir).select("doc_id", "text"), path)
    clean = files.split_heads(files.read_text_documents(spark, path)).withColumnRenamed("doc_id", "source_id")
    return clean.withColumn("source_version", ids.text_version(F.col("text")))


@query(
    "normalize_text",
    with_ctes(
        "SELECT doc_num AS doc_id, norm AS text, "
        "CASE WHEN length(norm) <= 2400 THEN norm ELSE rtrim(left(norm, 2400)) END AS question_text, "
        "CASE WHEN length(norm) <= 120 THEN norm ELSE rtrim(left(norm, 120)) END AS identifier FROM docs",
        "docs",
    ),
)
def normalize_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", tx.normalize_space(F.col("text")).alias("text"))
    return docs.select(
        "doc_id",
        "text",
        tx.cut(F.col("text"), 2400).alias("question_text"),
        tx.cut(F.col("text"), 120).alias("identifier"),
    )


@query(
    "document_stats",
    f"SELECT doc_id, length(text)::BIGINT AS text_chars, "
    f"len(list_filter(regexp_split_to_array(text, '{WS}'), lambda x: x <> ''))::BIGINT AS text_words FROM documents",
)
def document_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.length("text").cast("long").alias("text_chars"),
        tx.word_count(F.col("text")).cast("long").alias("text_words"),
    )


@query(
    "token_overlap",
    f"""
    WITH p AS (SELECT a.conv_id, a.turn, {toks('a.text')} AS q, {toks('b.text')} AS h
               FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)
    SELECT conv_id, turn, len(q)::BIGINT AS query_tokens, round({overlap('q', 'h')}, 6) AS overlap_score,
           round(CASE WHEN len(q) = 0 OR len(h) = 0 THEN 0.0 ELSE
             len(list_intersect(list_distinct(q), list_distinct(h))) / len(list_distinct(q))::DOUBLE END, 6) AS set_overlap
    FROM p
    """,
)
def token_overlap(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.tokens(F.col("text")).alias("q"))
    replies = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("q").alias("h"))
    q, h = F.col("q"), F.col("h")
    return turns.join(replies, ["conv_id", "turn"]).select(
        "conv_id",
        "turn",
        F.size(q).cast("long").alias("query_tokens"),
        F.round(tx.overlap_score(q, h), 6).alias("overlap_score"),
        F.round(tx.set_overlap(q, h), 6).alias("set_overlap"),
    )


_READABLE = norm(
    "replace(replace(replace(replace(replace(replace(replace(replace("
    + "regexp_replace(" * 8
    + "html, "
    + r"'(?s)<!--.*?-->', '', 'g'), "
    + r"'(?is)<script(?:[\s/][^>]*)?>.*?(?:</script\s*>|\z)', '', 'g'), "
    + r"'(?is)<style(?:[\s/][^>]*)?>.*?(?:</style\s*>|\z)', '', 'g'), "
    + r"'(?is)<noscript(?:[\s/][^>]*)?>.*?(?:</noscript\s*>|\z)', '', 'g'), "
    + r"'(?is)<svg(?:[\s/][^>]*)?>.*?(?:</svg\s*>|\z)', '', 'g'), "
    + r"'(?is)<head(?:[\s/][^>]*)?>.*?(?:</head\s*>|\z)', '', 'g'), "
    + rf"'(?i)</?(?:{'|'.join(tx.BLOCK_TAGS)})(?:[\s/][^>]*)?>', chr(10), 'g'), "
    + r"'<[a-zA-Z/!?][^>]*>', '', 'g'), "
    + "'&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), "
    + "'&nbsp;', chr(160)), '&#39;', ''''), '&amp;', '&')"
)


@query("readable_text", f"SELECT page_id, {_READABLE} AS text FROM pages")
def readable_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.readable_text(F.col("html")).alias("text"))


@query(
    "ingest_pages",
    f"""
    WITH t AS (SELECT page_id, url, {_READABLE} AS text FROM pages)
    SELECT 'url:' || url AS source_id, sha256(text) AS source_version, url AS source_uri,
           length(text)::BIGINT AS text_chars,
           len(list_filter(string_split(text, ' '), lambda x: x <> ''))::BIGINT AS text_words,
           length(html)::BIGINT AS html_chars
    FROM t JOIN pages USING (page_id, url)
    """,
)
def ingest_pages(spark, sf_dir):
    return intake.page_sources(table(spark, sf_dir, "pages")).select(
        "source_id", "source_version", "source_uri", "text_chars", "text_words", "html_chars"
    )


@query(
    "pick_best_text",
    f"""
    WITH t AS (SELECT page_id, {_READABLE} AS a, {norm("regexp_replace(html, '<[^>]*>', ' ', 'g')")} AS b FROM pages)
    SELECT page_id, length(a) < 200 AS thin,
           CASE WHEN length(a) < 200 AND length(b) > length(a) THEN b ELSE a END AS text FROM t
    """,
)
def pick_best_text(spark, sf_dir):
    both = table(spark, sf_dir, "pages").select(
        "page_id",
        tx.readable_text(F.col("html")).alias("a"),
        tx.normalize_space(F.regexp_replace("html", "<[^>]*>", " ")).alias("b"),
    )
    return both.select(
        "page_id",
        (F.length("a") < 200).alias("thin"),
        intake.prefer_longer(F.col("a"), F.col("b"), minimum=200).alias("text"),
    )


@query(
    "classify_links",
    r"""
    WITH t AS (SELECT page_id, url, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host,
                      regexp_matches(url, '^https?://[^/?#]+') AS valid FROM pages)
    SELECT page_id, url, host, valid,
           CASE WHEN NOT valid THEN 'unknown'
                WHEN contains(host, 'youtube.com') OR contains(host, 'youtu.be') THEN 'youtube' ELSE 'url' END AS kind
    FROM t
    """,
)
def classify_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id",
        "url",
        intake.url_host(F.col("url")).alias("host"),
        intake.is_web_url(F.col("url")).alias("valid"),
        intake.link_kind(F.col("url")).alias("kind"),
    )


@query(
    "extract_links",
    r"""
    WITH m AS (SELECT page_id, regexp_extract_all('See ' || url || '). Also (' || url || '; and ' || url || '/next!' || chr(10) || html,
                'https?://[^\s\x0b\x1c-\x1f\x85\p{Z}]+') AS found FROM pages),
    u AS (SELECT page_id, unnest(found) AS raw, generate_subscripts(found, 1) AS i FROM m),
    c AS (SELECT page_id, i, regexp_replace(raw, '[.,);:!?\]]+$', '') AS link FROM u)
    SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY min(i))::BIGINT AS position
    FROM c WHERE link <> '' GROUP BY page_id, link
    """,
)
def extract_links(spark, sf_dir):
    text = F.concat(
        F.lit("See "), "url", F.lit("). Also ("), "url", F.lit("; and "), "url", F.lit("/next!\n"), "html"
    )
    return (
        table(spark, sf_dir, "pages")
        .select("page_id", F.posexplode(tx.links(text)).alias("p", "link"))
        .select("page_id", "link", (F.col("p") + 1).cast("long").alias("position"))
    )


@query(
    "source_ids",
    r"""
    WITH s AS (SELECT doc_id, 'file:' || source || '/' || doc_id AS sid FROM documents
               UNION ALL SELECT page_id, 'url:' || url FROM pages)
    SELECT sid AS source_id, split_part(sid, ':', 1) AS kind, substr(sid, instr(sid, ':') + 1) AS value,
           left(regexp_replace(sid, '[^a-zA-Z0-9._-]', '_', 'g'), 200) AS safe_id FROM s
    """,
)
def source_ids(spark, sf_dir):
    files = b.source_documents(spark, sf_dir).select(F.col("doc_id").alias("source_id"))
    pages = table(spark, sf_dir, "pages").select(ids.source_id("url", F.col("url")).alias("source_id"))
    sid = F.col("source_id")
    return files.unionByName(pages).select(
        sid,
        ids.source_kind(sid).alias("kind"),
        ids.source_value(sid).alias("value"),
        ids.safe_source_id(sid).alias("safe_id"),
    )


@query(
    "stable_ids",
    """
    SELECT s_suppkey AS supplier, sha256(s_name || '-' || 'Supplier') AS entity_id,
           sha256(s_name || ' has balance ' || s_nationkey) AS claim_id,
           sha256(s_name || '-' || 'located_in' || '-' || n_name) AS rel_id,
           sha256('org:' || s_name) AS org_id, sha256('nation:' || n_name || ':' || s_name) AS voiceprint_id
    FROM supplier JOIN nation ON s_nationkey = n_nationkey
    """,
)
def stable_ids(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier")
    nations = table(spark, sf_dir, "nation")
    joined = suppliers.join(nations, suppliers.s_nationkey == nations.n_nationkey)
    return joined.select(
        F.col("s_suppkey").alias("supplier"),
        ids.keyed_id(F.col("s_name"), "Supplier").alias("entity_id"),
        ids.text_version(F.concat("s_name", F.lit(" has balance "), "s_nationkey")).alias("claim_id"),
        ids.keyed_id(F.col("s_name"), "located_in", F.col("n_name")).alias("rel_id"),
        ids.text_version(F.concat(F.lit("org:"), "s_name")).alias("org_id"),
        ids.text_version(F.concat(F.lit("nation:"), "n_name", F.lit(":"), "s_name")).alias("voiceprint_id"),
    )


@query(
    "normalize_tags",
    """
    WITH raw AS (SELECT doc_id, lang || ',' || upper(lang) || ', ' || source || chr(10) || text || ',' || upper(source) AS r FROM documents),
    parts AS (SELECT doc_id, unnest(string_split(replace(r, chr(10), ','), ',')) AS p,
                     generate_subscripts(string_split(replace(r, chr(10), ','), ','), 1) AS i FROM raw),
    tags AS (SELECT doc_id, i, left(regexp_replace(p, '^[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+|[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+$', '', 'g'), 64) AS tag FROM parts),
    firsts AS (SELECT doc_id, arg_min(tag, i) AS tag, min(i) AS i FROM tags WHERE tag <> '' GROUP BY doc_id, lower(tag))
    SELECT doc_id, string_agg(tag, '|' ORDER BY i) AS tags FROM firsts GROUP BY doc_id
    """.replace("\\\\", "\\"),
)
def normalize_tags(spark, sf_dir):
    raw = F.array(
        F.concat_ws(",", "lang", F.upper("lang")),
        F.concat(F.lit(" "), "source", F.lit("\n"), "text"),
        F.upper("source"),
    )
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", raw.alias("raw"))
        .select("doc_id", F.array_join(tx.normalize_tags(F.col("raw")), "|").alias("tags"))
    )


@query(
    "chunk_documents",
    with_ctes("SELECT doc_id, segment_id, chunk_index::BIGINT AS chunk_index, text FROM chunks", "chunks"),
)
def chunk_documents(spark, sf_dir):
    return b.chunks(spark, sf_dir).select("doc_id", "segment_id", "chunk_index", "text")


@query(
    "first_chunks",
    with_ctes("SELECT doc_id, segment_id, text FROM chunks WHERE chunk_index <= 20", "chunks"),
)
def first_chunks(spark, sf_dir):
    return chunking.first_chunks(b.chunks(spark, sf_dir)).select("doc_id", "segment_id", "text")


@query(
    "incremental_chunks",
    with_ctes(
        """
        SELECT doc_id, segment_id, sha256(text) AS text_hash FROM chunks c
        WHERE NOT EXISTS (SELECT 1 FROM chunks s WHERE s.doc_id = c.doc_id AND s.segment_id = c.segment_id
              AND s.lang = 'en'
              AND sha256(CASE WHEN s.chunk_index % 2 = 0 THEN s.text || ' old' ELSE s.text END) = sha256(c.text))
        """,
        "chunks",
    ),
)
def incremental_chunks(spark, sf_dir):
    # The stored side: English chunks, the even ones from an older text.
    now = b.stored_chunks(spark, sf_dir)
    stored = now.where("lang = 'en'").withColumn(
        "text", F.when(F.col("chunk_index") % 2 == 0, F.concat("text", F.lit(" old"))).otherwise(F.col("text"))
    )
    hashed = [df.withColumn("text_hash", ids.text_version(F.col("text"))) for df in (now, stored)]
    return chunking.changed_chunks(*hashed).select("doc_id", "segment_id", "text_hash")


@query(
    "chunk_enrich_join",
    with_ctes(
        """
        , enr AS (SELECT 'x')
        SELECT c.doc_id, c.segment_id,
               CASE WHEN c.chunk_index % 2 = 1 THEN 'Summary: ' || split_part(c.text, ' ', 1) || chr(10) || c.text ELSE c.text END AS text_to_embed,
               CASE WHEN l.doc_id IS NULL THEN '' ELSE left('context ' || repeat(c.lang || ' ', 120), 280) END AS intake_context,
               CASE WHEN l.doc_id IS NULL THEN '' ELSE
                 concat_ws(', ', CASE WHEN l.quality = 1 THEN 'Speaker: sp_' || c.doc_num END, 'Organization: ' || c.source, 'Date: 2024-01-01') END AS context_line,
               CASE WHEN c.chunk_index % 2 = 1 THEN c.lang || '|' || c.source END AS topics
        FROM chunks c LEFT JOIN labels l ON l.doc_id = c.doc_num
        """.replace(", enr AS (SELECT 'x')", ""),
        "chunks",
    ),
)
def chunk_enrich_join(spark, sf_dir):
    all_chunks = b.stored_chunks(spark, sf_dir)
    # Model output exists for odd chunks, intake metadata for labelled documents.
    enrichment = all_chunks.where("chunk_index % 2 = 1").select(
        "doc_id",
        "segment_id",
        F.substring_index("text", " ", 1).alias("summary"),
        F.array("lang", "source").alias("topics"),
    )
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "doc_num")
    intake_meta = (
        b.source_documents(spark, sf_dir)
        .drop("text")
        .join(labels, "doc_num")
        .select(
            "doc_id",
            F.concat(F.lit("context "), F.repeat(F.concat("lang", F.lit(" ")), F.lit(120))).alias("context"),
            F.when(F.col("quality") == 1, F.concat(F.lit("sp_"), "doc_num")).alias("speaker"),
            F.col("source").alias("organization"),
            F.lit("2024-01-01").alias("event_date"),
        )
    )
    base = all_chunks.select("doc_id", "segment_id", "text")
    return chunking.add_enrichment(base, enrichment, intake_meta).select(
        "doc_id",
        "segment_id",
        "text_to_embed",
        "intake_context",
        "context_line",
        F.array_join("topics", "|").alias("topics"),
    )
