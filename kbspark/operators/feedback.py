"""Retrieval feedback: capture, decayed reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions import routing
from kbspark.functions import text as tx
from kbspark.operators.memory import SCOPE
from kbspark.operators.ordered import newest

SIGNALS = "array<struct<doc_id:string,segment_id:string,outcome:string>>"


def cluster_key(tokens: Column) -> Column:
    """The first four tokens of a question."""
    clean = F.filter(F.transform(tokens, lambda t: F.lower(tx.strip(t))), lambda t: t != "")
    return F.when(F.size(clean) == 0, "cluster:unknown").otherwise(F.array_join(F.slice(clean, 1, 4), "|"))


def signals(evidence: DataFrame, citations: DataFrame, limit: int = 8) -> DataFrame:
    """Ranked evidence ``(question_id, rank, doc_id, segment_id, retrieval_source)`` marked as
    cited or missed by ``citations(question_id, doc_id, segment_id)``."""
    ranked = evidence.where((F.col("rank") <= limit) & (F.coalesce("doc_id", F.lit("")) != ""))
    keys = ["question_id", "doc_id", "segment_id"]
    cited = citations.select(*keys).distinct().withColumn("_cited", F.lit(True))
    return ranked.join(cited, keys, "left").withColumn(
        "outcome", F.when(F.col("_cited"), "cited").otherwise("missed")
    ).drop("_cited")


def feedback_rows(marked: DataFrame, questions: DataFrame) -> DataFrame:
    """One feedback memory per question ``(question_id, query, answer)`` from its signals.

    A question has as many signals as its evidence has ranks, so they meet in one row.
    """
    per = marked.groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "doc_id", "segment_id", "retrieval_source", "outcome"))).alias("signals"),
        F.sum(F.when(F.col("outcome") == "cited", 1).otherwise(0)).alias("cited_count"),
        F.count(F.lit(1)).alias("_n"),
    )
    joined = per.join(questions, "question_id").withColumn("_q", tx.user_text(F.col("query"), 2400))
    joined = joined.withColumn("query_tokens", F.slice(tx.tokens(F.col("_q")), 1, 10))
    missed = F.col("_n") - F.col("cited_count")
    text = F.concat(
        F.lit("Retrieval feedback for question: "), F.substring("_q", 1, 240), F.lit(". Cited="), "cited_count",
        F.lit(", missed="), missed, F.lit(", evidence_considered="), "_n", F.lit(". Answer snapshot: "),
        tx.user_text(F.col("answer"), 220),
    )
    return joined.select(
        "question_id",
        text.alias("text"),
        F.concat(F.array(F.lit("retrieval_feedback")), F.slice("query_tokens", 1, 3)).alias("topics"),
        "query_tokens",
        cluster_key(F.col("query_tokens")).alias("query_cluster"),
        "signals",
        "cited_count",
        missed.alias("missed_count"),
        (0.58 + 0.22 * (F.col("cited_count") / F.col("_n"))).alias("importance"),
    )


def _scope_keys() -> Column:
    """All generalisations of a row's scope: each field kept or left open."""
    keys = [F.lit("")]
    for name in SCOPE:
        value = F.coalesce(name, F.lit(""))
        keys = [F.concat(k, F.lit("\u0001"), v) for k in keys for v in (F.lit("*"), value)]
    return F.array_distinct(F.array(*keys))


def _scope_key() -> Column:
    return F.concat(*[F.concat(F.lit("\u0001"), F.coalesce(n, F.lit("*"))) for n in SCOPE])


def boosts(
    questions: DataFrame,
    history: DataFrame,
    as_of: Column,
    history_limit: int = 80,
    cited_boost: float = 0.08,
    missed_penalty: float = 0.03,
    min_overlap: float = 0.2,
    half_life_hours: float = 96.0,
    cluster_cap: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """Sums of decayed feedback per (question, segment) and per (question, document).

    ``history(feedback_id, created_at, scope..., query_tokens, signals)``. A question looks at
    the newest rows of its scope; a scope field it leaves open matches any value, so each
    history row is filed under every generalisation of its scope and found by equality. The
    token overlap is an equality join on (scope, token).
    """
    asked = questions.select("question_id", _scope_key().alias("_scope"), F.array_distinct(tx.tokens(F.col("query"))).alias("_q"))
    asked = asked.where(F.size("_q") > 0)
    scopes = asked.select("_scope").distinct()
    filed = history.withColumn("_scope", F.explode(_scope_keys())).join(scopes, "_scope", "left_semi")
    recent = newest(
        filed.select("_scope", "feedback_id", "created_at", "query_tokens", "signals"),
        ["_scope"], history_limit, F.col("created_at").desc(), F.col("feedback_id").desc(),
    ).drop("_rank")
    q_tokens = asked.select("question_id", "_scope", F.size("_q").alias("_size"), F.explode_outer("_q").alias("_token"))
    h_tokens = recent.select(
        "_scope", "feedback_id", F.explode_outer(F.array_distinct(F.transform("query_tokens", lambda t: F.lower(t)))).alias("_token")
    )
    near = (
        q_tokens.join(h_tokens, ["_scope", "_token"])
        .groupBy("question_id", "_scope", "feedback_id", "_size")
        .agg(F.count(F.lit(1)).alias("_common"))
        .withColumn("overlap", F.col("_common") / F.col("_size"))
        .where(F.col("overlap") >= min_overlap)
    )
    usable = near.join(recent, ["_scope", "feedback_id"]).where("signals IS NOT NULL")
    usable = usable.withColumn("_cluster", cluster_key(F.col("query_tokens")))
    window = Window.partitionBy("question_id", "_cluster").orderBy(F.col("created_at").desc(), F.col("feedback_id").desc())
    capped = usable.withColumn("_r", F.row_number().over(window)).where(F.col("_r") <= cluster_cap)
    weight = F.col("overlap") * routing.decay(F.col("created_at"), as_of, half_life_hours)
    each = capped.select("question_id", weight.alias("_w"), F.inline(F.col("signals").cast(SIGNALS)))
    delta = F.when(F.col("outcome") == "cited", cited_boost * F.col("_w")).when(
        F.col("outcome") == "missed", -missed_penalty * F.col("_w")
    )
    valued = each.withColumn("_d", delta).where(F.col("_d").isNotNull() & (F.coalesce("doc_id", F.lit("")) != ""))
    by_segment = (
        valued.where(F.coalesce("segment_id", F.lit("")) != "")
        .groupBy("question_id", "doc_id", "segment_id")
        .agg(F.sum("_d").alias("_segment_boost"))
    )
    by_doc = valued.groupBy("question_id", "doc_id").agg(F.sum(0.5 * F.col("_d")).alias("_doc_boost"))
    return by_segment, by_doc


def rerank(candidates: DataFrame, questions: DataFrame, history: DataFrame, as_of: Column, **settings) -> DataFrame:
    """Candidates with ``feedback_boost`` added to ``final_score``, never below zero."""
    by_segment, by_doc = boosts(questions, history, as_of, **settings)
    joined = candidates.join(by_segment, ["question_id", "doc_id", "segment_id"], "left").join(
        by_doc, ["question_id", "doc_id"], "left"
    )
    total = F.coalesce("_doc_boost", F.lit(0.0)) + F.coalesce("_segment_boost", F.lit(0.0))
    counts = F.abs(total) >= 1e-9
    return (
        joined.withColumn("feedback_boost", F.when(counts, F.round(total, 6)))
        .withColumn(
            "final_score",
            F.when(counts, F.round(F.greatest(F.lit(0.0), F.col("final_score") + total), 6)).otherwise(F.col("final_score")),
        )
        .drop("_doc_boost", "_segment_boost")
    )
