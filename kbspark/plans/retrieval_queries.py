"""Keyword, vector and hybrid retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.functions import text as tx
from kbspark.operators import feedback, retrieval, sessions
from kbspark.operators.matching import contained_pairs
from kbspark.operators.vectors import label_centroids, top_vectors
from kbspark.plans import bindings as b
from kbspark.plans import memory_queries, sessions_queries
from kbspark.plans.registry import query, table
from kbspark.plans.sql import cte, norm, overlap, toks, with_ctes
from kbspark.session import stored


@query(
    "keyword_search",
    with_ctes(
        f"""
        SELECT q.item_id, d.doc_num AS doc_id FROM (SELECT item_id, lower({norm('text')}) AS q FROM benchmark) q
        JOIN docs d ON contains(lower(d.norm), q.q)
        """,
        "docs",
    ),
)
def keyword_search(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select("item_id", tx.normalize_space(F.col("text")).alias("query"))
    docs = table(spark, sf_dir, "documents").select("doc_id", tx.normalize_space(F.col("text")).alias("text"))
    return contained_pairs(asked, docs, "item_id", ["doc_id"])


@query(
    "vector_topk",
    """
    WITH parts AS (SELECT label, i, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL),
    q AS (SELECT label AS query_label, list(x ORDER BY i) AS v FROM parts GROUP BY label),
    s AS (SELECT query_label, vec_id, list_cosine_similarity(v, embedding::DOUBLE[]) AS c FROM q, embeddings)
    SELECT query_label, vec_id, round(c, 6) AS score, row_number() OVER (PARTITION BY query_label ORDER BY c DESC, vec_id)::BIGINT AS rank
    FROM s QUALIFY rank <= 5
    """,
)
def vector_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")
    )
    centroids = label_centroids(vectors, "label").withColumnRenamed("label", "query_label")
    found = top_vectors(centroids, vectors, 5, "query_label", "vec_id")
    return found.select("query_label", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


cte(
    "questions",
    f"""
    SELECT 'b' || item_id AS question_id, {norm('text')} AS query, item_id AS vec, item_id AS session, 'p' || (item_id % 3) AS project, NULL::VARCHAR AS want_user FROM benchmark
    UNION ALL SELECT DISTINCT 'm-' || event_type, 'Review ' || event_type, NULL, NULL, NULL, NULL FROM events
    UNION ALL SELECT 'n-' || event_type, 'Review ' || event_type, NULL, NULL, NULL, 'u' || min(user_id) FROM events GROUP BY event_type
    """,
)
cte(
    "vtop",
    """
    SELECT * FROM (SELECT question_id, d.doc_id, v.vec_id, c AS score, row_number() OVER (PARTITION BY question_id ORDER BY c DESC, v.vec_id) AS rank
      FROM (SELECT q.question_id, v.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS c
            FROM questions q JOIN embeddings e ON e.vec_id = q.vec, embeddings v JOIN docs dd ON dd.doc_num = v.vec_id) v JOIN docs d ON d.doc_num = v.vec_id) WHERE rank <= 20
    """,
    "questions",
    "docs",
)
cte("recall_hq", "SELECT question_id AS query_id, query, want_user FROM questions", "questions")
memory_queries.recall_ctes("recall_hq", "recalled_h", 4)
cte(
    "fb_history",
    f"""
    SELECT e.event_id AS fid, e.ts AS created_at, q.project, list_slice({toks('q.query')}, 1, 10) AS tokens, v.doc_id,
           CASE WHEN e.event_type IN ('purchase', 'click') THEN 'cited' ELSE 'missed' END AS outcome
    FROM event_keys e JOIN vtop v ON v.question_id = 'b' || e.k AND v.rank = e.event_id % 5 + 1 JOIN questions q ON q.question_id = v.question_id
    """,
    "event_keys",
    "vtop",
    "questions",
)
cte(
    "fb_delta",
    f"""
    SELECT question_id, doc_id, sum(CASE outcome WHEN 'cited' THEN 0.08::DOUBLE ELSE -0.03::DOUBLE END * overlap * power(0.5::DOUBLE,
             greatest(0.0, date_diff('microsecond', created_at, {memory_queries.AS_OF_SQL}) / 86400000000.0 * 24.0) / 96.0)) AS delta
    FROM (
      SELECT *, row_number() OVER (PARTITION BY question_id, cluster ORDER BY created_at DESC, fid DESC) AS c FROM (
        SELECT q.question_id, h.*, array_to_string(list_slice(h.tokens, 1, 4), '|') AS cluster,
               len(list_intersect(list_distinct(q.qt), list_distinct(h.tokens))) / len(list_distinct(q.qt))::DOUBLE AS overlap
        FROM (SELECT question_id, project, {toks('query')} AS qt FROM questions) q
        JOIN (SELECT p.key AS pkey, h.*, row_number() OVER (PARTITION BY p.key ORDER BY h.created_at DESC, h.fid DESC) AS r
              FROM fb_history h JOIN (SELECT DISTINCT coalesce(project, '*') AS key FROM questions) p ON p.key = '*' OR p.key = h.project) h
          ON h.pkey = coalesce(q.project, '*') AND h.r <= 80) WHERE overlap >= 0.2) WHERE c <= 4
    GROUP BY question_id, doc_id
    """,
    "fb_history",
)
cte(
    "hybrid",
    f"""
    SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id, segment_id) AS rank FROM (
        SELECT b.question_id, b.doc_id, b.segment_id, b.text_snippet, b.source,
          CASE WHEN abs(coalesce(1.5 * f.delta, 0)) >= 1e-9 THEN round(greatest(0.0, b.fs + 1.5::DOUBLE * f.delta), 6) ELSE b.fs END AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY question_id, doc_id, segment_id ORDER BY fs DESC, so) AS d FROM (
          SELECT c.question_id, doc_id, segment_id, text_snippet, source, so,
                 round(bias + 0.52::DOUBLE * least(greatest(sc, 0.0), 1.5) + 0.30::DOUBLE * {overlap('q.qt', toks("coalesce(text_snippet, '')"))}, 6) AS fs
          FROM (
            SELECT v.question_id, v.doc_id, 'chunk_1' AS segment_id, ch.text AS text_snippet, 'embedding' AS source, 1 AS so, 0.28::DOUBLE AS bias, v.score AS sc
              FROM vtop v LEFT JOIN chunks ch ON ch.doc_id = v.doc_id AND ch.chunk_index = 1
            UNION ALL SELECT question_id, doc_id, segment_id, text, 'keyword', 2, 0.18::DOUBLE, lex FROM (
              SELECT q.question_id, ch.doc_id, ch.segment_id, ch.text, {overlap(toks('q.query'), toks('ch.text'))} AS lex,
                     row_number() OVER (PARTITION BY q.question_id ORDER BY lex DESC, ch.doc_id, ch.segment_id) AS kr
              FROM questions q JOIN chunks ch ON contains(lower(ch.text), lower(q.query))) WHERE kr <= 20
            UNION ALL SELECT q.question_id, 'context:auto_handoff', 'state', left(h.digest, 1800), 'context', 3, 0.16::DOUBLE, x.lex
              FROM questions q JOIN handoff h ON h.conv_id = q.session, LATERAL (SELECT {overlap(toks('q.query'), toks('h.digest'))} AS lex) x WHERE x.lex > 0
            UNION ALL SELECT query_id, 'memory:' || memory_id, 'memory', text, 'memory', 4, 0.24::DOUBLE, recall_score FROM recalled_h) c
          JOIN (SELECT question_id, {toks('query')} AS qt FROM questions) q ON q.question_id = c.question_id)) b
        LEFT JOIN fb_delta f ON f.question_id = b.question_id AND f.doc_id = b.doc_id AND b.segment_id = 'chunk_1'
        WHERE d = 1))
    WHERE rank <= 10
    """,
    "vtop",
    "chunks",
    "handoff",
    "recalled_h",
    "fb_delta",
)


def hybrid(spark, sf_dir):
    asked = stored(b.questions(spark, sf_dir), "questions").withColumnRenamed("session_id_num", "session_id")
    asked_scope = asked.withColumn("session_id", F.lit(None).cast("string"))
    segments = b.stored_chunks(spark, sf_dir).select("doc_id", "segment_id", "chunk_index", "text")
    digests = sessions.handoff(b.conversation_turns(spark, sf_dir), sessions_queries.AS_OF_TEXT)
    evidence = retrieval.retrieve(
        asked,
        b.as_of(),
        vectors=stored(b.evidence_vectors(spark, sf_dir, segments), "vectors"),
        segments=segments.drop("chunk_index"),
        digests=digests,
        items=b.recallable_memories(spark, sf_dir),
        history=stored(b.feedback_history(spark, sf_dir), "feedback"),
        scopes=asked_scope,
    )
    return asked, evidence


@query(
    "retrieve_hybrid",
    with_ctes(
        """
        SELECT q.question_id, coalesce(h.rank, 1)::BIGINT AS rank, coalesce(doc_id, 'N/A') AS doc_id, coalesce(segment_id, 'N/A') AS segment_id,
               CASE WHEN doc_id IS NULL THEN q.query ELSE text_snippet END AS text_snippet, coalesce(score, 0.0) AS score, source AS retrieval_source
        FROM questions q LEFT JOIN hybrid h USING (question_id)
        """,
        "hybrid",
    ),
)
def retrieve_hybrid(spark, sf_dir):
    _, evidence = hybrid(spark, sf_dir)
    return evidence.select(
        "question_id", F.col("rank").cast("long").alias("rank"), "doc_id", "segment_id", "text_snippet", "score", "retrieval_source"
    )


cte(
    "dated_segments",
    """
    SELECT doc_id, segment_id, text, [lang, source] AS topics, [upper(lang)] AS entities, source AS source_type,
           TIMESTAMP '2024-01-01' + to_minutes(doc_num) AS created_at, NULL::BIGINT AS start_ms, NULL::BIGINT AS end_ms, NULL::VARCHAR AS speaker FROM chunks
    UNION ALL SELECT 'conv:' || conv_id, 'seg_' || (turn + 1), text, ['talk', role], [], 'conversation', TIMESTAMP '2024-01-01' + to_minutes(conv_id),
           turn * 10000, turn * 10000 + 9000, role FROM conversations
    """,
    "chunks",
)
cte(
    "filtered_questions",
    f"""
    SELECT 'b' || item_id || '-' || v AS question_id, query,
           CASE v WHEN 1 THEN ['en'] WHEN 2 THEN ['en', 'src' || (item_id % 20)] WHEN 4 THEN ['talk', 'assistant'] WHEN 5 THEN ['en', 'unheard of'] ELSE [] END AS topics,
           CASE v WHEN 2 THEN ['EN'] ELSE [] END AS entities, CASE v WHEN 3 THEN 'conversation' END AS source_type,
           CASE v WHEN 4 THEN TIMESTAMP '2024-01-01 00:30:00' END AS date_from, CASE v WHEN 3 THEN TIMESTAMP '2024-01-01 01:40:00' END AS date_to
    FROM (SELECT item_id, array_to_string(list_slice(string_split({norm('text')}, ' '), 1, 2), ' ') AS query, unnest(range(0, 6)) AS v FROM benchmark)
    """,
)


@query(
    "retrieve_filtered",
    with_ctes(
        f"""
        , found AS (
          SELECT q.question_id, s.*, {overlap(toks('q.query'), toks('s.text'))} AS lex FROM filtered_questions q JOIN dated_segments s
            ON contains(lower(s.text), lower(q.query)) AND list_has_all(s.topics, q.topics) AND list_has_all(s.entities, q.entities)
           AND (q.source_type IS NULL OR s.source_type = q.source_type) AND (q.date_from IS NULL OR s.created_at >= q.date_from) AND (q.date_to IS NULL OR s.created_at <= q.date_to)),
        scored AS (SELECT *, round(0.18::DOUBLE + 0.52::DOUBLE * least(lex, 1.5) + 0.30::DOUBLE * lex, 6) AS fs FROM found),
        best AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY fs DESC, doc_id, segment_id) AS rank FROM scored QUALIFY rank <= 10)
        SELECT q.question_id, coalesce(b.rank, 1)::BIGINT AS rank, coalesce(doc_id, 'N/A') AS doc_id, coalesce(segment_id, 'N/A') AS segment_id,
               coalesce(b.text, q.query) AS text_snippet, coalesce(fs, 0.0) AS score, CASE WHEN doc_id IS NOT NULL THEN 'keyword' END AS retrieval_source,
               start_ms, end_ms, speaker
        FROM filtered_questions q LEFT JOIN best b USING (question_id)
        """,
        "dated_segments",
        "filtered_questions",
    ),
)
def retrieve_filtered(spark, sf_dir):
    segments = stored(b.dated_segments(spark, sf_dir), "segments")
    evidence = retrieval.retrieve(b.filtered_questions(spark, sf_dir), b.as_of(), segments=segments)
    return evidence.select(
        "question_id", F.col("rank").cast("long").alias("rank"), "doc_id", "segment_id", "text_snippet", "score", "retrieval_source",
        "start_ms", "end_ms", "speaker",
    )


@query(
    "feedback_rerank",
    with_ctes(
        """
        SELECT v.question_id, v.doc_id, round(v.score, 6) AS score, CASE WHEN abs(1.5 * f.delta) >= 1e-9 THEN round(1.5::DOUBLE * f.delta, 6) END AS feedback_boost,
               CASE WHEN abs(coalesce(1.5 * f.delta, 0)) >= 1e-9 THEN round(greatest(0.0, round(v.score, 6) + 1.5::DOUBLE * f.delta), 6) ELSE round(v.score, 6) END AS final_score
        FROM vtop v LEFT JOIN fb_delta f USING (question_id, doc_id)
        """,
        "vtop",
        "fb_delta",
    ),
)
def feedback_rerank(spark, sf_dir):
    asked = stored(b.questions(spark, sf_dir), "questions").withColumn("session_id", F.lit(None).cast("string"))
    vectors = b.stored_vectors(spark, sf_dir).withColumnRenamed("vec_id", "vector_id")
    near = top_vectors(asked.where("embedding IS NOT NULL"), vectors, 20, "question_id", "vector_id")
    candidates = near.join(vectors.select("vector_id", "doc_id", "segment_id"), "vector_id").select(
        "question_id", "doc_id", "segment_id", F.round("score", 6).alias("score"), F.round("score", 6).alias("final_score")
    )
    history = stored(b.feedback_history(spark, sf_dir), "feedback")
    ranked = feedback.rerank(candidates, asked, history, b.as_of())
    return ranked.select("question_id", "doc_id", "score", "feedback_boost", "final_score")


@query(
    "feedback_signals",
    with_ctes(
        f"""
        , s AS (SELECT v.question_id, v.rank, v.doc_id, d.lang = 'en' AS cited FROM vtop v JOIN docs d ON d.doc_id = v.doc_id WHERE v.rank <= 8),
        g AS (SELECT question_id, count(*) FILTER (cited)::BIGINT AS c, count(*)::BIGINT AS n, string_agg(doc_id || '=' || CASE WHEN cited THEN 'cited' ELSE 'missed' END, ',' ORDER BY rank) AS signals FROM s GROUP BY 1),
        t AS (SELECT g.*, q.query, list_slice({toks('q.query')}, 1, 10) AS tk FROM g JOIN questions q USING (question_id))
        SELECT question_id, 'Retrieval feedback for question: ' || left(query, 240) || '. Cited=' || c || ', missed=' || (n - c) || ', evidence_considered=' || n || '. Answer snapshot: answer' AS text,
               array_to_string(list_concat(['retrieval_feedback'], list_slice(tk, 1, 3)), '|') AS topics, array_to_string(list_slice(tk, 1, 4), '|') AS query_cluster, signals,
               c AS cited_count, n - c AS missed_count, round(0.58 + 0.22 * (c / n::DOUBLE), 6) AS importance FROM t
        """,
        "vtop",
    ),
)
def feedback_signals(spark, sf_dir):
    asked = b.questions(spark, sf_dir)
    vectors = b.stored_vectors(spark, sf_dir).withColumnRenamed("vec_id", "vector_id")
    near = top_vectors(asked.where("embedding IS NOT NULL"), vectors, 20, "question_id", "vector_id")
    evidence = near.join(vectors.select("vector_id", "doc_id", "segment_id"), "vector_id").withColumn(
        "retrieval_source", F.lit("embedding")
    )
    english = b.source_documents(spark, sf_dir).where("lang = 'en'").select("doc_id")
    citations = evidence.join(english, "doc_id", "left_semi").select("question_id", "doc_id", "segment_id")
    rows = feedback.feedback_rows(
        feedback.signals(evidence, citations), asked.withColumn("answer", F.lit("answer"))
    )
    return rows.select(
        "question_id", "text", F.array_join("topics", "|").alias("topics"), "query_cluster",
        F.array_join(F.transform("signals", lambda s: F.concat_ws("=", s["doc_id"], s["outcome"])), ",").alias("signals"),
        "cited_count", "missed_count", F.round("importance", 6).alias("importance"),
    )


@query(
    "fallback_answers",
    with_ctes(
        """
        , e AS (SELECT question_id, count(*) AS n, string_agg(left(trim(text_snippet), 220), ' ' ORDER BY rank) FILTER (rank <= 3 AND coalesce(trim(text_snippet), '') <> '') AS body,
                string_agg(doc_id || ':' || segment_id, ',' ORDER BY rank) FILTER (rank <= 3) AS citations FROM hybrid GROUP BY 1)
        SELECT q.question_id, 'Fallback answer (model unavailable). Question: ' || left(q.query, 240) || '. Evidence snapshot: ' || coalesce(e.body, 'No evidence snippets available.') || '. Error: timeout' AS answer_text,
               coalesce(citations, '') AS citations, q.question_id = 'b0' OR coalesce(n, 0) < 2 AS strong_path
        FROM questions q LEFT JOIN e USING (question_id)
        """,
        "hybrid",
    ),
)
def fallback_answers(spark, sf_dir):
    asked, evidence = hybrid(spark, sf_dir)
    plans = asked.withColumn("need_strong_model", F.col("question_id") == "b0")
    return retrieval.fallback_answers(evidence, plans, "timeout")


_ITEM = (
    "'{{\"doc_id\":' || to_json(doc_id)::VARCHAR || ',\"rank\":' || rank || ',\"retrieval_source\":' || to_json(source)::VARCHAR || "
    "',\"segment_id\":' || to_json(segment_id)::VARCHAR || ',\"text_snippet\":' || to_json(CASE WHEN length(t) <= {n} THEN t ELSE rtrim(left(t, {n} - 14)) || '...<truncated>' END)::VARCHAR || '}}'"
)


@query(
    "pack_evidence",
    with_ctes(
        f"""
        , e AS (SELECT *, coalesce({norm('text_snippet')}, '') AS t FROM hybrid),
        p AS (SELECT question_id, '[' || string_agg({_ITEM.format(n=700)}, ',' ORDER BY rank) || ']' AS wide, '[' || string_agg({_ITEM.format(n=350)}, ',' ORDER BY rank) || ']' AS tight FROM e GROUP BY 1)
        SELECT question_id, CASE WHEN length(wide) <= 6000 THEN wide ELSE tight END AS payload,
               length(CASE WHEN length(wide) <= 6000 THEN wide ELSE tight END)::BIGINT AS chars_final FROM p
        """,
        "hybrid",
    ),
)
def pack_evidence(spark, sf_dir):
    _, evidence = hybrid(spark, sf_dir)
    rows = evidence.where("doc_id <> 'N/A'").withColumn("text_snippet", F.coalesce("text_snippet", F.lit("")))
    packed = retrieval.pack_evidence(
        rows, ["doc_id", "rank", "retrieval_source", "segment_id", "text_snippet"], max_chars=6000
    )
    return packed.select("question_id", "payload", "chars_final")
