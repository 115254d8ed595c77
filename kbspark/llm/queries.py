"""Registered queries of the subpackage, and their SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm import centroids, chat, context_tree, decontaminate, jaccard, line_dedup, line_quality, merkle, pieces, simhash, token_counts, toxicity, warc


def small_batches(spark: SparkSession) -> None:
    """Texts differ much in length: Python is given few bytes at a time, not a number of rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of only control strings, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat.read_back(chat.format_turns(rows))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all windows of the benchmark."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded to piece ids and decoded again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.decode(pieces.encode(docs))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip"),
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fingerprint and the component of their near-duplicates."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, each document encoded as a whole."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op6_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by the trees and the word counts of the training part."""
    return context_tree.score(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that repeat an earlier one."""
    cut = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    return cut.select("doc_id", F.length("text").cast("long").alias("n_chars"), "n_lines_dropped", "n_lines_near", kept)


def op8_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their base counts and the verdict by line frequency."""
    return line_quality.judge(table(spark, sf_dir, "documents")).drop("content")


def op9_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as ARC archives, converted to WARC archives and read back."""
    rows = warc.archive_pages(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of the training part of ``labels``."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as leaves of one manifest, with their proofs, where some texts are tampered with."""
    docs = table(spark, sf_dir, "documents")
    return merkle.verify(merkle.manifest(docs, altered={"text": merkle.altered_text(docs["text"], docs["doc_id"])}))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors with the nearest of 16 centroids after three rounds."""
    return centroids.summed(*centroids.cluster(table(spark, sf_dir, "embeddings")))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the component of those whose shingle sets are alike."""
    return jaccard.near_sets(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_decontaminate": op2_decontaminate,
    "op3_pieces": op3_pieces,
    "op4_simhash": op4_simhash,
    "op5_token_counts": op5_token_counts,
    "op6_context_tree": op6_context_tree,
    "op7_line_dedup": op7_line_dedup,
    "op8_line_quality": op8_line_quality,
    "op9_warc_archive": op9_warc_archive,
    "op10_toxicity": op10_toxicity,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_centroids": op12_centroids,
    "op13_jaccard_join": op13_jaccard_join,
}

ORACLE: dict[str, str] = {
    "op1_chat_format": chat.OP1_SQL,
    "op2_decontaminate": decontaminate.OP2_SQL,
    "op8_line_quality": line_quality.OP8_SQL,
    "op9_warc_archive": warc.OP9_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
    "op12_centroids": centroids.OP12_SQL,
}
