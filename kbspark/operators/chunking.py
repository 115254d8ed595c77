"""Word-window chunks of documents and their enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.functions import text as tx


def chunk_documents(docs: DataFrame, size: int = 200, overlap: int = 20) -> DataFrame:
    """``docs(doc_id, text, ...)`` to one row per window of ``size`` words.

    Windows share ``overlap`` words and the last one stops at the end of the text. Every
    document is cut inside its own row, so no shuffle takes place.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must lie in [0, size)")
    step = size - overlap
    keep = [c for c in docs.columns if c != "text"]
    split = docs.select(*keep, tx.words(F.col("text")).alias("_words"))
    extra = F.ceil(F.greatest(F.size("_words") - size, F.lit(0)) / F.lit(step)).cast("int")
    windows = F.transform(
        F.sequence(F.lit(0), extra),
        lambda i: F.array_join(F.slice(F.col("_words"), i * step + 1, F.lit(size)), " "),
    )
    # The outer form: for the inner one Spark would test the array, and so build it, once more.
    return split.select(*keep, F.posexplode_outer(windows).alias("_pos", "text")).select(
        *keep,
        (F.col("_pos") + 1).cast("long").alias("chunk_index"),
        F.concat(F.lit("chunk_"), F.col("_pos") + 1).alias("segment_id"),
        "text",
    ).where("text <> ''")  # a text without words has one empty window


def text_to_embed(summary, text):
    """Text handed to an embedding model: the summary, when there is one, leads."""
    return F.when(
        F.coalesce(summary, F.lit("")) != "", F.concat(F.lit("Summary: "), summary, F.lit("\n"), text)
    ).otherwise(text)


def source_context(speaker, organization, event_date):
    """One line of speaker, organisation and date, absent parts left out."""

    def part(label, value):
        value = tx.strip(F.coalesce(value, F.lit("")))
        return F.when(value != "", F.concat(F.lit(f"{label}: "), value))

    return F.concat_ws(
        ", ", part("Speaker", speaker), part("Organization", organization), part("Date", event_date)
    )


def transcript_context(speaker, start_ms, end_ms, context):
    """The context line of a transcript chunk: speaker and time span lead the source's own line, unless the chunk
    has no speaker or several."""
    seconds = lambda ms: F.concat(F.floor(ms / 1000).cast("string"), F.lit("s"))
    time = F.when(start_ms.isNotNull() & end_ms.isNotNull(), F.concat(F.lit("Time: "), seconds(start_ms), F.lit("-"), seconds(end_ms)))
    named = F.concat_ws(", ", F.concat(F.lit("Speaker: "), speaker), time, F.nullif(context, F.lit("")))
    one = (F.coalesce(speaker, F.lit("")) != "") & (speaker != "MIXED")
    return F.when(one, named).otherwise(F.coalesce(context, F.lit("")))


def add_enrichment(chunks: DataFrame, enrichment: DataFrame, intake: DataFrame) -> DataFrame:
    """Chunks with model output (doc_id, segment_id) and intake metadata (doc_id) where known."""
    return (
        chunks.join(enrichment, ["doc_id", "segment_id"], "left")
        .join(intake, "doc_id", "left")
        .withColumn("intake_context", F.substring(tx.strip(F.coalesce("context", F.lit(""))), 1, 280))
        .withColumn("text_to_embed", text_to_embed(F.col("summary"), F.col("text")))
        .withColumn(
            "context_line", source_context(F.col("speaker"), F.col("organization"), F.col("event_date"))
        )
        .drop("context")
    )


def changed_chunks(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks whose (doc_id, segment_id, text_hash) is not stored yet."""
    return chunks.join(
        stored.select("doc_id", "segment_id", "text_hash"), ["doc_id", "segment_id", "text_hash"], "left_anti"
    )


def first_chunks(chunks: DataFrame, limit: int = 20) -> DataFrame:
    """The first ``limit`` chunks of each document: a bound on the chunk's own number."""
    return chunks.where(F.col("chunk_index") <= limit)
