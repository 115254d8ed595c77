"""Corpus pipeline: filtering, deduplication, decontamination and encoding of ``documents``.

Each stage takes what the stage before kept and returns the columns of ``documents``, the last one
with the piece ids besides. Stages that drop documents look only at small tables of ids, which
are joined to the documents without regard to their columns.

Defined results: rows with a null text go in the first stage, as they have no words; a document
without a word left after line dedup goes there, for all its lines were repeats; of a group of
near-duplicates the one with the smallest id stays (null last, then by the hash of the text); rows
are copies only if id and text are equal, and each is judged by its own text; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm import decontaminate, line_dedup, line_quality, pieces, simhash
from kbspark.llm.queries import small_batches
from kbspark.session import drop_work, stored, work_mark


def keyed(docs: DataFrame) -> DataFrame:
    """``key, text``: rows of one id but different texts have different keys, null ids the last."""
    return docs.select(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64("text").alias("content")).alias("key"), "text")


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` but for those with a key in ``keys(gone)``."""
    gone = stored(keys.select(F.col("gone.doc_id").alias("gone"), F.col("gone.content").alias("content")).distinct(), "pipeline-gone")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone"]) & (F.xxhash64(docs["text"]) == gone["content"]), "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not depleted, without their boilerplate lines."""
    small_batches(spark)
    cut = line_quality.remove_lines(docs)
    size = F.when(F.col("n_lines_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", size).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines, those without a word left dropped."""
    small_batches(spark)
    cut = line_dedup.dedup_lines(docs)
    kept = cut.filter((F.col("n_lines_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    size = F.when(F.col("n_lines_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", size).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    small_batches(spark)
    groups = simhash.near_duplicates(keyed(docs), doc="key")
    kept = without(docs, groups.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("gone")))
    # Only rows whose id and text occur again have to meet.
    again = docs.groupBy(F.col("doc_id").alias("again"), F.xxhash64("text").alias("content")).count().filter("count > 1").select("again", "content")
    again = stored(again, "pipeline-again")
    same = kept["doc_id"].eqNullSafe(again["again"]) & (F.xxhash64(kept["text"]) == again["content"])
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    small_batches(spark)
    found = decontaminate.contamination(keyed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc="key")
    return without(docs, found.filter("contaminated").select(F.col("doc_id").alias("gone")))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids, and whether these decode to the text."""
    small_batches(spark)
    coded = pieces.decode(pieces.encode(docs, out="ids"), out="decoded")
    return coded.withColumn("round_trip", F.col("decoded").eqNullSafe(F.col("text"))).drop("decoded")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

# Component and edit-distance decisions have no SQL; tests compare every stage with its operator, and those with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``, each written and read again.

    Once a stage is written, the one before and all that was stored on the way to it are deleted.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = work_mark()
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_work(spark, since, work_mark() - 1)
    return docs
