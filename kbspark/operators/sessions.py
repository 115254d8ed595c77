"""Question and answer turns: sessions, digests, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.functions import text as tx
from kbspark.operators.ordered import newest, number_rows, previous_time, running_sum

# Fixed values.
ACTION_HINTS = ("next", "todo", "follow up", "action", "plan", "nasta", "fortsatt")
CONTEXT_DOC = "context:auto_handoff"


def turn_text(question: Column, answer: Column) -> Column:
    """The stored form of a turn; null unless both sides say something."""
    q, a = tx.cut(tx.strip(question), 1200), tx.cut(tx.strip(answer), 3000)
    return F.when((q != "") & (a != ""), F.concat(F.lit("Q: "), q, F.lit("\nA: "), a))


def parse_turn(text: Column) -> Column:
    """Struct (question, answer) of a stored turn, null when it is none."""
    pattern = r"(?s)Q:\s*(.*?)\nA:\s*(.*)"
    body = tx.strip(text)
    question = tx.cut(tx.strip(F.regexp_extract(body, pattern, 1)), 1200)
    answer = tx.cut(tx.strip(F.regexp_extract(body, pattern, 2)), 3000)
    return tx.let(
        F.struct(question.alias("question"), answer.alias("answer")), lambda s: F.when(s["question"] != "", s)
    )


def action_lines(answer: Column) -> Column:
    """Sentences that hint at work to do, else the head of the answer."""
    trimmed = F.transform(F.split(answer, r"[.\n!?]+"), lambda s: F.regexp_replace(s, r"^[ \-\t]+|[ \-\t]+$", ""))
    hinted = F.filter(trimmed, lambda s: (s != "") & F.lower(s).rlike("|".join(ACTION_HINTS)))
    fallback = F.filter(F.array(F.substring(tx.strip(answer), 1, 180)), lambda s: s != "")
    return tx.let(
        F.transform(hinted, lambda s: F.substring(s, 1, 180)),
        lambda found: F.when(F.size(found) > 0, found).otherwise(fallback),
    )


def handoff(turns: DataFrame, as_of_text: str, limit: int = 20, key: str = "session_id") -> DataFrame:
    """One digest per session from its newest ``limit`` turns.

    ``turns(session_id, ts, turn_no, text, citations)`` with ``text`` in stored form and
    citations as ``array<struct<doc_id, segment_id>>``. Ranking cuts every session to its
    newest turns before they meet, so the digest never sees a whole long session.
    """
    recent = newest(turns, [key], limit, F.col("ts").desc(), F.col("turn_no").desc())
    parsed = recent.withColumn("_p", parse_turn(F.col("text"))).where("_p IS NOT NULL")
    row = F.struct("_rank", "_p.question", "_p.answer", "citations")
    per = parsed.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("t"))
    bullets = lambda items: F.transform(items, lambda x: F.concat(F.lit("- "), x))
    questions = F.array_distinct(F.filter(F.transform(F.slice("t", 1, 6), lambda r: r["question"]), lambda q: q != ""))
    answer = F.col("t")[0]["answer"]
    cited = F.flatten(F.transform(F.slice("t", 1, 8), lambda r: F.coalesce(r["citations"], F.array().cast("array<struct<doc_id:string,segment_id:string>>"))))
    anchors = F.transform(
        F.filter(cited, lambda c: F.coalesce(c["doc_id"], F.lit("")) != ""),
        lambda c: F.when(F.coalesce(c["segment_id"], F.lit("")) != "", F.concat_ws(":", c["doc_id"], c["segment_id"])).otherwise(c["doc_id"]),
    )
    staged = per.select(
        key,
        F.size("t").cast("long").alias("turn_count"),
        F.col("t")[0]["question"].alias("focus"),
        questions.alias("threads"),
        answer.alias("answer"),
        F.slice(action_lines(answer), 1, 6).alias("actions"),
        F.slice(F.array_distinct(anchors), 1, 8).alias("anchors"),
    )
    line = lambda text: F.array(F.lit(text))
    none = F.array().cast("array<string>")
    default_action = "- Continue from latest focus and refine scope in the next ask."
    lines = F.concat(
        F.array(
            F.lit("# Session Handoff"), F.lit(f"Updated: {as_of_text}"), F.lit(""), F.lit("Current focus:"),
            F.concat(F.lit("- "), "focus"), F.lit(""), F.lit("Recent threads:"),
        ),
        bullets(F.col("threads")),
        line(""),
        F.when(
            F.col("answer") != "",
            F.array(F.lit("Latest answer snapshot:"), F.substring("answer", 1, 800), F.lit("")),
        ).otherwise(none),
        line("Next actions:"),
        F.when(F.size("actions") > 0, bullets(F.col("actions"))).otherwise(line(default_action)),
        line(""),
        F.when(
            F.size("anchors") > 0, F.concat(line("Evidence anchors:"), bullets(F.col("anchors")), line(""))
        ).otherwise(none),
    )
    return staged.select(key, "turn_count", F.array_join(lines, "\n").alias("digest"))


def snapshots(turns: DataFrame, every: int = 12, key: str = "session_id") -> DataFrame:
    """A snapshot after every ``every`` turns of a session, over those turns.

    Turns are numbered without gathering a session, and every snapshot groups ``every`` rows.
    """
    placed = number_rows(turns, [key], "ts", ["turn_no"], "position")
    group = F.floor((F.col("position") - 1) / every)
    rows = F.reverse(F.array_sort(F.collect_list(F.struct("position", "question", "answer"))))
    full = (
        placed.groupBy(key, group.alias("_g"))
        .agg(rows.alias("t"))
        .where(F.size("t") == every)
        .withColumn("turn_count", ((F.col("_g") + 1) * every).cast("long"))
    )
    questions = F.array_distinct(F.filter(F.transform(F.slice("t", 1, 6), lambda r: tx.strip(r["question"])), lambda q: q != ""))
    answer = tx.strip(F.col("t")[0]["answer"])
    lines = F.concat(
        F.array(
            F.concat(F.lit("Session pre-compaction snapshot at "), "turn_count", F.lit(" turns.")),
            F.lit("Latest focus:"),
            F.concat(F.lit("- "), tx.strip(F.col("t")[0]["question"])),
            F.lit("Recent threads:"),
        ),
        F.transform(questions, lambda q: F.concat(F.lit("- "), q)),
        F.when(answer != "", F.array(F.lit("Latest answer snapshot:"), F.substring(answer, 1, 420))).otherwise(
            F.array().cast("array<string>")
        ),
    )
    return full.select(key, "turn_count", tx.strip(F.array_join(lines, "\n")).alias("summary"))


def resume_turns(turns: DataFrame, gap_minutes: int = 45, key: str = "session_id") -> DataFrame:
    """Flag turns that open a session: the first of a key, or one after ``gap_minutes`` idle;
    ``session_no`` counts them."""
    timed = previous_time(turns, [key], "ts", ["turn_no"])
    idle = F.timestamp_diff("MICROSECOND", F.col("previous"), F.col("ts")) >= gap_minutes * 60_000_000
    opens = F.col("previous").isNull() | (idle if gap_minutes > 0 else F.lit(False))
    flagged = timed.withColumn("opens_session", opens).withColumn("_one", F.col("opens_session").cast("int"))
    return running_sum(flagged, [key], "ts", ["turn_no"], "_one", "session_no").drop("_one", "previous")


def resume_evidence(opened: DataFrame, evidence: DataFrame, digests: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Evidence of each turn, led by the session digest on turns that open a session.

    ``opened(turn_id, session_id, opens_session)``, ``evidence(turn_id, doc_id, segment_id,
    text_snippet, score, rank)``. A digest already among the evidence is lifted to 1.05 instead.
    The columns ``carry`` of a turn come along. Digests are long and every opening turn gets one, so
    they join last and no later step moves them.
    """
    carry = carry or []
    known = digests.select("session_id", F.lit(True).alias("_known"))
    turns = opened.join(known, "session_id", "left").select(
        "turn_id", "session_id", (F.col("opens_session") & F.col("_known").isNotNull()).alias("_start"), *carry
    )
    is_context = F.col("doc_id") == CONTEXT_DOC
    lifted = evidence.join(turns.drop("session_id"), "turn_id", "left").withColumn(
        "score", F.when(is_context & F.col("_start"), F.greatest("score", F.lit(1.05))).otherwise(F.col("score"))
    )
    present = evidence.where(is_context).select("turn_id").distinct()
    starts = turns.where("_start").join(present, "turn_id", "left_anti")
    injected = starts.join(digests.select("session_id", "digest"), "session_id").select(
        "turn_id", F.lit(CONTEXT_DOC).alias("doc_id"), F.lit("state").alias("segment_id"),
        F.substring("digest", 1, 1800).alias("text_snippet"), F.lit(1.05).alias("score"), F.lit(0).alias("rank"), *carry,
    )
    return lifted.drop("_start").unionByName(injected)
