"""Keyed upsert, delete, latest version and publish rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.session import path_exists


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in ``order``. Spark prunes each partition to its own first
    row before the shuffle, so a hot key sends one row per task."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """``target`` with ``source`` merged in: matched keys are replaced, new keys added.

    The source is deduped by ``order``. Target rows only meet the source's keys, so a small
    source is broadcast by its measured size and the target is not shuffled.
    """
    fresh = first_per_key(source, keys, *order) if order else source
    untouched = target.join(source.select(*keys).distinct(), keys, "left_anti")
    return untouched.unionByName(fresh, allowMissingColumns=True)


def merge_buckets(rows: DataFrame, target: str, staged: str, keys: list[str], order: list[Column], buckets: int = 64) -> None:
    """Upsert ``rows`` into the table in the folder ``target``, which is partitioned into buckets by key.

    Only the buckets with a key of ``rows`` are read and rewritten; of the rows of one key the first in
    ``order`` stays, which may use ``_fresh``, 1 for those of ``rows``. The new buckets are first written to
    ``staged`` as a whole. If a run is cut off while they replace the old ones, running it again with the same
    arguments finds them complete and replaces them again.
    """
    spark = rows.sparkSession
    if not path_exists(spark, f"{staged}/_SUCCESS"):
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        fresh = rows.withColumn("bucket", bucket).withColumn("_fresh", F.lit(1))
        touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # ``buckets`` at most
        if not touched:
            return
        if path_exists(spark, target):
            held = spark.read.parquet(target).where(F.col("bucket").isin(touched)).withColumn("_fresh", F.lit(0))
            fresh = fresh.unionByName(held, allowMissingColumns=True)
        merged = first_per_key(fresh, keys, *order).drop("_fresh")
        write_partitioned(merged, staged, "bucket", fmt="parquet")
    write_partitioned(spark.read.parquet(staged), target, "bucket", fmt="parquet")


def delete_keys(table: DataFrame, doomed: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows that stay, and a one-row frame with the number deleted."""
    doomed = doomed.select(*keys).distinct()
    kept = table.join(doomed, keys, "left_anti")
    gone = table.join(doomed, keys, "left_semi").agg(F.count(F.lit(1)).alias("deleted"))
    return kept, gone


def latest_version(manifests: DataFrame) -> DataFrame:
    """The most recently updated version of every source."""
    return first_per_key(manifests, ["source_id"], F.col("updated_at").desc(), F.col("source_version").desc())


def segments_with_documents(segments: DataFrame, documents: DataFrame) -> DataFrame:
    """Segments left-joined to the latest version of their document."""
    latest = first_per_key(documents, ["doc_id"], F.col("created_at").desc(), F.col("source_version").desc())
    return segments.join(latest.select("doc_id", "source_type", "created_at"), "doc_id", "left")


def filter_segments(
    joined: DataFrame,
    topics: list[str] | None = None,
    entities: list[str] | None = None,
    source_type: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    text_like: str | None = None,
) -> DataFrame:
    """The search filters over ``segments_with_documents``; every given one must hold."""
    out = joined
    for name, wanted in (("topics", topics), ("entities", entities)):
        for value in wanted or []:
            out = out.where(F.array_contains(name, value))
    if source_type:
        out = out.where(F.col("source_type") == source_type)
    if date_from:
        out = out.where(F.col("created_at") >= F.lit(date_from).cast("timestamp_ntz"))
    if date_to:
        out = out.where(F.col("created_at") <= F.lit(date_to).cast("timestamp_ntz"))
    if text_like:
        out = out.where(F.col("text").ilike(f"%{text_like}%"))
    return out


def document_rows(manifests: DataFrame, summaries: DataFrame) -> DataFrame:
    return manifests.join(summaries, ["source_id", "source_version"], "left").select(
        F.col("source_id").alias("doc_id"),
        *manifests.columns,
        F.coalesce("summary_short", F.lit("")).alias("summary_short"),
        F.coalesce("summary_long", F.lit("")).alias("summary_long"),
    )


def segment_rows(chunks: DataFrame, enriched: DataFrame) -> DataFrame:
    """Segment rows of the enriched chunks where a source has them, else of the raw chunks."""
    sources = enriched.select("doc_id").distinct()
    raw = chunks.join(sources, "doc_id", "left_anti")
    empty = F.array().cast("array<string>")
    rows = enriched.unionByName(raw, allowMissingColumns=True)
    return rows.withColumn("topics", F.coalesce("topics", empty)).withColumn(
        "entities", F.coalesce("entities", empty)
    )


# Step-name parts in order of rank, and the status each gives.
STATUS_ORDER = (("embed", "embeddings done"), ("chunk", "chunks done"), ("ingest", "ingest done"))


def step_status(steps: Column) -> Column:
    """Status of a source from its steps map."""
    names = F.map_keys(F.map_filter(steps, lambda _, v: v.getField("status") == "done"))
    first, second, third = STATUS_ORDER

    def has(part: str) -> Column:
        return F.exists(names, lambda k: k.contains(part))

    return (
        F.when(has(first[0]), first[1]).when(has(second[0]), second[1]).when(has(third[0]), third[1]).otherwise("partial")
    )


def library_status(manifests: DataFrame, embeddings: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row per source: latest version, chunk and vector counts, status."""
    vectors = embeddings.groupBy("source_id").agg(F.count(F.lit(1)).alias("embeddings"))
    failed = jobs.where("status = 'failed'").groupBy("source_id").agg(F.count(F.lit(1)).alias("failed_jobs"))
    counts = F.transform(F.map_values("steps"), lambda v: F.coalesce(v.getField("chunk_count"), F.lit(0)))
    zero = F.lit(0).cast("long")
    return (
        latest_version(manifests)
        .join(vectors, "source_id", "left")
        .join(failed, "source_id", "left")
        .select(
            "source_id",
            "source_version",
            "updated_at",
            F.aggregate(counts, zero, lambda a, v: a + v).alias("chunks"),
            F.coalesce("embeddings", zero).alias("embeddings"),
            F.when(F.col("failed_jobs") > 0, "failed").otherwise(step_status(F.col("steps"))).alias("status"),
        )
    )


def write_partitioned(df: DataFrame, path: str, *by: str, fmt: str = "json") -> None:
    """Write artifacts below ``path``, replacing only the partitions present in ``df``.

    Rows are rebalanced by the partition columns: small partitions share a task and become one
    file each, and a partition with much of the data is split over several tasks.
    """
    (
        df.hint("rebalance", *by)
        .write.format(fmt)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .mode("overwrite")
        .save(path)
    )


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
