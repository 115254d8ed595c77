"""Hybrid retrieval for a table of questions, evidence packing, fallback answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.functions import routing
from kbspark.functions import text as tx
from kbspark.operators import feedback, memory
from kbspark.operators.matching import contained_pairs, text_matches
from kbspark.operators.ordered import newest
from kbspark.operators.sessions import CONTEXT_DOC
from kbspark.operators.tables import first_per_key
from kbspark.operators.vectors import top_vectors
from kbspark.session import stored

# The head start of each source, and its place when scores tie.
SOURCE_BIAS = {"embedding": 0.28, "memory": 0.24, "keyword": 0.18, "context": 0.16}
SOURCE_ORDER = {"embedding": 1, "keyword": 2, "context": 3, "memory": 4}


# Filters of the memory search by the columns of a question that give them. A question's own
# session_id names its running session, whose digest is evidence, not a filter.
MEMORY_FILTERS = {
    "want_type": "memory_type", "want_kind": "memory_kind", "user_id": "memory_user_id",
    "project_id": "memory_project_id", "session_id": "memory_session_id",
}


# Filters of the segment search: columns of a question, each null (or an empty list) for no filter.
SEGMENT_FILTERS = {
    "topics": "array<string>", "entities": "array<string>", "source_type": "string",
    "date_from": "timestamp_ntz", "date_to": "timestamp_ntz",
}
# A member is common if more than one in so many segments has it.
COMMON_SHARE = 64
# What else is known of a piece of evidence; null where its source does not tell.
EVIDENCE_FIELDS = {
    "start_ms": "long", "end_ms": "long", "speaker": "string", "source_refs": "string",
    "memory_type": "string", "memory_kind": "string", "memory_id": "string",
}


def _have(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind).alias(name)


def candidate_score(source: str, score: Column, lexical: Column) -> Column:
    bounded = F.least(F.greatest(F.coalesce(score, F.lit(0.0)), F.lit(0.0)), F.lit(1.5))
    return F.round(SOURCE_BIAS.get(source, 0.15) + 0.52 * bounded + 0.30 * lexical, 6)


def _evidence(rows: DataFrame, source: str, score: Column, snippet: str) -> DataFrame:
    lexical = tx.overlap_score(F.col("_qt"), tx.tokens(F.col(snippet)))
    return rows.select(
        "question_id",
        "doc_id",
        "segment_id",
        F.col(snippet).alias("text_snippet"),
        F.least(F.greatest(score, F.lit(0.0)), F.lit(1.5)).alias("score"),
        F.lit(source).alias("retrieval_source"),
        F.lit(SOURCE_ORDER[source]).alias("_source"),
        candidate_score(source, score, lexical).alias("final_score"),
        *[_have(rows, n, kind) for n, kind in EVIDENCE_FIELDS.items()],
    )


def vector_candidates(questions: DataFrame, vectors: DataFrame, limit: int) -> DataFrame:
    """``vectors(vector_id, embedding, doc_id, segment_id, text)`` nearest to each question."""
    asked = questions.where(F.col("embedding").isNotNull())
    near = top_vectors(asked, vectors, 2 * limit, "question_id", "vector_id")
    rows = near.join(vectors.drop("embedding"), "vector_id").join(questions.select("question_id", "_qt"), "question_id")
    return _evidence(rows, "embedding", F.col("score"), "text")


def _in_window(created: str, since: str, until: str) -> Column:
    """A date filter; a segment of unknown date is in no window."""
    after = F.col(since).isNull() | F.coalesce(F.col(created) >= F.col(since), F.lit(False))
    return after & (F.col(until).isNull() | F.coalesce(F.col(created) <= F.col(until), F.lit(False)))


def _members(topics: Column, entities: Column) -> Column:
    """The members of both lists, each with the list it is of."""
    none = F.array().cast("array<string>")
    marked = lambda kind, values: F.transform(F.coalesce(values, none), lambda v: F.struct(F.lit(kind).alias("list"), v.alias("value")))
    return F.array_distinct(F.filter(F.concat(marked("t", topics), marked("e", entities)), lambda m: m["value"].isNotNull()))


def filtered_pairs(questions: DataFrame, segments: DataFrame, keep: tuple[str, ...], derived: dict[str, Column] | None = None) -> DataFrame:
    """All (question, segment) where the segment contains the question's text and passes its filters.

    ``questions(question_id, query)`` with the columns of ``SEGMENT_FILTERS`` under ``want_`` names;
    ``segments(doc_id, segment_id, text, topics, entities, source_type, created_at)`` and ``keep``. The columns
    ``derived`` from those of a segment come along, worked out once for a segment that many questions meet.

    A question that asks for topics or entities is looked up by one of them, the one that fewest segments
    have, if these are few: the lists of segments by member are joined with that, and all other members, the
    text and the ranges are tested on the rows found. So a common topic costs nothing where a rarer one is
    asked for too. Questions without members, or with common ones only, are looked up by their text, all in
    one pass over the segments, the source type being part of the key, and their members are tested on the
    rows found.
    """
    derived = derived or {}
    wanted = questions.withColumn("_wanted", _members(F.col("want_topics"), F.col("want_entities")))
    with_members = segments.withColumn("_held", _members(F.col("topics"), F.col("entities")))
    held = with_members.withColumn("_member", F.explode("_held"))
    members = wanted.where((F.size("_wanted") > 0) & (F.col("query") != "")).select("question_id", F.explode("_wanted").alias("_member"))
    used = members.select("_member").distinct()
    count = held.select("_member").join(used, "_member", "left_semi").groupBy("_member").agg(F.count(F.lit(1)).alias("_n"))
    rated = members.join(count, "_member", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    rarest = stored(first_per_key(rated, ["question_id"], F.col("_n"), F.col("_member")), "rarest")
    common = F.col("_n") * COMMON_SHARE > segments.count()

    by_text = wanted.where(F.size("_wanted") == 0).unionByName(wanted.join(rarest.where(common).select("question_id"), "question_id", "left_semi"))
    by_text = by_text.select("question_id", "query", "_wanted", "want_source_type", "want_date_from", "want_date_to")
    carried = tuple(dict.fromkeys((*keep, *derived, "created_at", "topics", "entities")))
    pairs = contained_pairs(by_text, segments.withColumns(derived), "question_id", ["doc_id", "segment_id"], carried, scope={"want_source_type": "source_type"})
    window = by_text.select("question_id", "_wanted", "want_date_from", "want_date_to")
    out = ["question_id", "doc_id", "segment_id", *keep, *derived]
    in_window = _in_window("created_at", "want_date_from", "want_date_to")
    has_all = lambda have: F.size(F.array_except("_wanted", have)) == 0
    found = pairs.join(window, "question_id").where(in_window & has_all(_members(F.col("topics"), F.col("entities")))).select(*out)

    asked = wanted.join(rarest.where((F.col("_n") > 0) & ~common).select("question_id", "_member"), "question_id")
    asked = asked.select("question_id", F.lower("query").alias("_q"), "_wanted", "_member", "want_source_type", "want_date_from", "want_date_to")
    asked = stored(asked, "by-member")
    met = held.select("doc_id", "segment_id", *dict.fromkeys((*keep, "text")), "_held", "_member", "source_type", "created_at").join(asked, "_member")
    passes = (
        has_all("_held")
        & (F.col("want_source_type").isNull() | F.coalesce(F.col("source_type") == F.col("want_source_type"), F.lit(False)))
        & in_window
        & text_matches(F.lower("text"), F.col("_q"))
    )
    return found.unionByName(met.where(passes).withColumns(derived).select(*out))


def keyword_candidates(questions: DataFrame, segments: DataFrame, limit: int) -> DataFrame:
    """Segments that contain the question's text and pass its filters, best token overlap first."""
    keep = ("text", *[n for n in EVIDENCE_FIELDS if n in segments.columns])
    words = {"_words": F.array_distinct(tx.tokens(F.col("text")))}
    if any(f"want_{n}" in questions.columns for n in SEGMENT_FILTERS):
        asked = questions.select("question_id", "query", *[_have(questions, f"want_{n}", kind) for n, kind in SEGMENT_FILTERS.items()])
        kinds = {"topics": "array<string>", "entities": "array<string>", "source_type": "string", "created_at": "timestamp_ntz"}
        have = segments.select("doc_id", "segment_id", *keep, *[_have(segments, n, kind) for n, kind in kinds.items()])
        pairs = filtered_pairs(asked, have, keep, words)
    else:
        # Whole questions are in few segments, so the words are worked out for those alone.
        pairs = contained_pairs(questions, segments, "question_id", ["doc_id", "segment_id"], keep).withColumns(words)
    rows = pairs.join(questions.select("question_id", "_qt"), "question_id")
    rows = rows.withColumn("_lex", tx.overlap_score(F.col("_qt"), F.col("_words"))).drop("_words")
    best = newest(rows, ["question_id"], 2 * limit, F.col("_lex").desc(), F.col("doc_id"), F.col("segment_id"))
    return _evidence(best, "keyword", F.col("_lex"), "text")


def context_candidates(questions: DataFrame, digests: DataFrame) -> DataFrame:
    """The digest of the question's session, when it shares a word or context is asked for."""
    rows = questions.join(digests.select("session_id", "digest"), "session_id")
    rows = rows.withColumn("_lex", tx.overlap_score(F.col("_qt"), tx.tokens(F.col("digest"))))
    hint = routing.is_context_question(F.col("query"))
    score = F.when(hint, F.greatest("_lex", F.lit(0.15))).otherwise(F.col("_lex"))
    rows = rows.where((F.col("_lex") > 0) | hint).select(
        "question_id", "_qt", F.lit(CONTEXT_DOC).alias("doc_id"), F.lit("state").alias("segment_id"),
        F.substring("digest", 1, 1800).alias("text"), score.alias("_score"),
        F.lit("context").alias("speaker"), F.lit('{"kind":"auto_handoff"}').alias("source_refs"),
    )
    return _evidence(rows, "context", F.col("_score"), "text")


def memory_candidates(questions: DataFrame, items: DataFrame, as_of: Column, limit: int) -> DataFrame:
    """Recalled memories as evidence, within the type, kind and scope a question asks for."""
    have = set(questions.columns)
    asked = questions.select(
        F.col("question_id").alias("query_id"), "query",
        *[(F.col(c) if c in have else F.lit(None).cast("string")).alias(n) for n, c in MEMORY_FILTERS.items()],
    )
    recalled = memory.recall(asked, items, as_of, limit, memory.long_term_table(items))
    rows = recalled.withColumnRenamed("query_id", "question_id").join(questions.select("question_id", "_qt"), "question_id")
    rows = rows.withColumn("doc_id", F.concat(F.lit("memory:"), "memory_id")).withColumn("segment_id", F.lit("memory"))
    rows = rows.withColumn("speaker", F.col("memory_type"))
    if "source_refs" in items.columns:
        refs = items.select("memory_id", F.to_json("source_refs").alias("source_refs") if dict(items.dtypes)["source_refs"] != "string" else "source_refs")
        rows = rows.join(refs, "memory_id", "left")
    return _evidence(rows, "memory", F.col("recall_score"), "text")


def retrieve(
    questions: DataFrame,
    as_of: Column,
    vectors: DataFrame | None = None,
    segments: DataFrame | None = None,
    digests: DataFrame | None = None,
    items: DataFrame | None = None,
    history: DataFrame | None = None,
    scopes: DataFrame | None = None,
    limit: int = 10,
    memory_limit: int = 4,
) -> DataFrame:
    """The best ``limit`` pieces of evidence for every question, over all sources given.

    ``questions(question_id, query, embedding, session_id, scope...)``, and if there the columns
    named in ``MEMORY_FILTERS`` and, under ``want_`` names, in ``SEGMENT_FILTERS``, null for no filter;
    ``segments`` and ``vectors`` may carry the columns of ``EVIDENCE_FIELDS``, which evidence returns, and
    ``segments`` those that are filtered by. ``scopes`` may give the questions with another scope for the
    feedback lookup. A question without evidence gets one placeholder row.
    """
    asked = questions.withColumn("_qt", tx.tokens(F.col("query")))
    parts = []
    if vectors is not None:
        parts.append(vector_candidates(asked, vectors, limit))
    if segments is not None:
        parts.append(keyword_candidates(asked, segments, limit))
    if digests is not None:
        parts.append(context_candidates(asked, digests))
    if items is not None:
        parts.append(memory_candidates(asked, items, as_of, max(1, min(memory_limit, limit))))
    if not parts:
        raise ValueError("at least one evidence source is needed")
    candidates = reduce(DataFrame.unionByName, parts)
    best = first_per_key(
        candidates, ["question_id", "doc_id", "segment_id"], F.col("final_score").desc(), F.col("_source")
    ).drop("_source")
    if history is not None:
        best = feedback.rerank(best, questions if scopes is None else scopes, history, as_of)
    top = newest(
        best, ["question_id"], limit, F.col("final_score").desc(), F.col("doc_id"), F.col("segment_id")
    ).withColumnRenamed("_rank", "rank")
    found = questions.select("question_id", "query").join(top, "question_id", "left")
    blank = F.col("doc_id").isNull()
    return found.select(
        "question_id",
        F.coalesce("rank", F.lit(1)).alias("rank"),
        F.coalesce("doc_id", F.lit("N/A")).alias("doc_id"),
        F.coalesce("segment_id", F.lit("N/A")).alias("segment_id"),
        F.when(blank, F.col("query")).otherwise(F.col("text_snippet")).alias("text_snippet"),
        F.coalesce("final_score", F.lit(0.0)).alias("score"),
        "retrieval_source",
        *EVIDENCE_FIELDS,
    )


def fallback_answers(evidence: DataFrame, questions: DataFrame, error: str = "") -> DataFrame:
    """A plain answer per question from its three best snippets, with citations, and whether
    a stronger model is called for. Placeholder rows do not count as evidence."""
    real = evidence.where("doc_id <> 'N/A'")
    counts = real.groupBy("question_id").agg(F.count(F.lit(1)).alias("evidence_rows"))
    best = real.where(F.col("rank") <= 3).groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "doc_id", "segment_id", tx.strip(F.coalesce("text_snippet", F.lit(""))).alias("text")))).alias("e")
    )
    joined = questions.join(best, "question_id", "left").join(counts, "question_id", "left")
    snippets = F.transform(
        F.filter(F.coalesce("e", F.array().cast("array<struct<rank:int,doc_id:string,segment_id:string,text:string>>")), lambda x: x["text"] != ""),
        lambda x: F.substring(x["text"], 1, 220),
    )
    body = F.when(F.size("_s") > 0, F.array_join("_s", " ")).otherwise("No evidence snippets available.")
    answer = F.concat(
        F.lit("Fallback answer (model unavailable). Question: "), F.substring("query", 1, 240),
        F.lit(". Evidence snapshot: "), body, F.lit(f". Error: {error[:200]}"),
    )
    return joined.withColumn("_s", snippets).select(
        "question_id",
        answer.alias("answer_text"),
        F.coalesce(
            F.array_join(F.transform("e", lambda x: F.concat_ws(":", x["doc_id"], x["segment_id"])), ","), F.lit("")
        ).alias("citations"),
        (F.coalesce(F.col("need_strong_model"), F.lit(False)) | (F.coalesce("evidence_rows", F.lit(0)) < 2)).alias("strong_path"),
    )


# Keys whose text may be long.
LARGE_TEXT_KEYS = ("text", "snippet", "summary", "answer", "content", "reason")


def pack_evidence(evidence: DataFrame, columns: list[str], max_chars: int = 12000, max_items: int = 24, max_text: int = 700) -> DataFrame:
    """Evidence of each question as one JSON list within ``max_chars``.

    Two levels of caps are rendered; the tighter one is used when the first is too long, and a
    clipped preview when both are. ``evidence`` is ranked, and only rows within the list cap
    are gathered.
    """
    tight_items, tight_text = max(6, max_items // 2), max(220, max_text // 2)

    def item(limit: int) -> Column:
        fields = []
        for name in sorted(columns):
            value = F.col(name)
            if dict(evidence.dtypes)[name] == "string":
                large = any(hint in name.lower() for hint in LARGE_TEXT_KEYS)
                value = tx.truncate_marked(tx.clean_space(value), limit if large else min(220, limit))
            fields.append(value.alias(name))
        return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})

    counts = evidence.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.length(F.to_json(F.struct(*sorted(columns)))) + 1).alias("_raw")
    )
    rows = evidence.where(F.col("rank") <= max_items).select(
        "question_id", "rank", item(max_text).alias("wide"), item(tight_text).alias("tight")
    )
    lists = rows.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "wide", "tight"))).alias("_e"))

    def render(items: Column, cap: int) -> Column:
        hidden = F.when(
            F.col("_n") > cap, F.array(F.concat(F.lit('{"_truncated_items":'), F.col("_n") - cap, F.lit("}")))
        ).otherwise(F.array().cast("array<string>"))
        return F.concat(F.lit("["), F.array_join(F.concat(F.slice(items, 1, cap), hidden), ","), F.lit("]"))

    packed = lists.join(counts, "question_id").select(
        "question_id",
        (F.col("_raw") + 1).alias("chars_raw"),
        render(F.transform("_e", lambda e: e["wide"]), max_items).alias("_wide"),
        render(F.transform("_e", lambda e: e["tight"]), tight_items).alias("_tight"),
    )

    def clipped(keep: Column) -> Column:
        return F.to_json(
            F.struct(
                F.concat(F.lit("payload clipped for prompt (raw_chars="), "chars_raw", F.lit(")")).alias("note"),
                F.substring(F.col("_tight"), F.lit(1), keep).alias("preview"),
                F.lit(True).alias("truncated"),
            )
        )

    room = max(40, max_chars - 220)
    # Quotes in the preview are escaped, so the cut shrinks in steps of 40 by what escaping added.
    packed = packed.withColumn("_first", clipped(F.lit(room)))
    over = F.greatest(F.length("_first") - max_chars, F.lit(0))
    keep = F.greatest(F.lit(40), F.lit(room) - F.ceil(over / 40).cast("int") * 40)
    rendered = (
        F.when(F.length("_wide") <= max_chars, F.col("_wide"))
        .when(F.length("_tight") <= max_chars, F.col("_tight"))
        .otherwise(F.when(over == 0, F.col("_first")).otherwise(clipped(keep)))
    )
    return packed.withColumn("payload", rendered).select(
        "question_id",
        "payload",
        F.length("payload").cast("long").alias("chars_final"),
        ((F.length("_wide") > max_chars) | (F.col("chars_raw") != F.length("payload"))).alias("truncated"),
    )
