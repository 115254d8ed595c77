"""Deletion of sources with all that belongs to them, from stored tables.

A stored table is cut into buckets by the column that names its source, so the rows of one source are in
one bucket of each table and a deletion reads and rewrites only the buckets that the deleted sources are in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.functions import ids
from kbspark.operators.intake import listing_changes
from kbspark.operators.tables import write_partitioned
from kbspark.session import delete_path, path_exists

# The column of each table that names the source a row belongs to.
SOURCE_KEYS = {
    "manifests": "source_id", "jobs": "source_id", "embeddings": "source_id", "documents": "doc_id",
    "kb_segments": "doc_id", "relations": "doc_id", "claims": "doc_id", "memory": "source_id",
}


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def write_table(df: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Write a table in buckets by the column that names its source."""
    write_partitioned(df.withColumn("bucket", _bucket(key, buckets)), path, "bucket", fmt="parquet")


def deleted_sources(previous: DataFrame, current: DataFrame) -> DataFrame:
    """``source_id`` of the files that a listing has no longer; a file source of a stream cannot see that."""
    gone = listing_changes(previous, current).where("change = 'deleted'")
    return gone.select(ids.source_id("file", F.col("path")).alias("source_id"))


def delete_rows(spark: SparkSession, target: str, key: str, doomed: DataFrame, archive: str, buckets: int = 64) -> DataFrame:
    """Take the rows of ``doomed(source_id)`` out of a bucketed table; ``deleted`` and ``rewritten`` (rows that
    were moved because they shared a bucket).

    All rows of the buckets in question first go to ``archive``, marked as gone or not, so nothing is lost
    if the run is cut off: running it again with the same arguments starts from the archive. Afterwards
    the archive holds what was deleted.
    """
    keys = doomed.select(F.col("source_id").cast("string").alias("_doomed")).where("_doomed IS NOT NULL").distinct()
    if not path_exists(spark, f"{archive}/_SUCCESS"):
        near = [r["b"] for r in keys.select(_bucket("_doomed", buckets).alias("b")).distinct().collect()]  # ``buckets`` at most
        held = spark.read.parquet(target).where(F.col("bucket").isin(near))
        marked = held.join(keys, F.col(key).cast("string") == F.col("_doomed"), "left").withColumn("gone", F.col("_doomed").isNotNull()).drop("_doomed")
        marked.write.mode("overwrite").parquet(archive)
    rows = spark.read.parquet(archive)
    kept = {r["bucket"]: r for r in rows.groupBy("bucket").agg(F.count_if(F.col("gone")).alias("gone"), F.count_if(~F.col("gone")).alias("kept")).collect()}
    hit = [b for b, r in kept.items() if r["gone"]]
    left = rows.where(~F.col("gone") & F.col("bucket").isin(hit)).drop("gone")
    if any(kept[b]["kept"] for b in hit):
        write_partitioned(left, target, "bucket", fmt="parquet")
    for b in hit:
        if not kept[b]["kept"]:  # overwriting partitions leaves those alone that get no row
            delete_path(spark, f"{target}/bucket={b}")
    counts = [(sum(r["gone"] for r in kept.values()), sum(kept[b]["kept"] for b in hit))]
    return spark.createDataFrame(counts, "deleted long, rewritten long")


def delete_sources(spark: SparkSession, tables: dict[str, str], doomed: DataFrame, run: str, buckets: int = 64) -> DataFrame:
    """Delete sources from every table of ``tables`` (name to folder); one row per table: ``table_name, deleted,
    rewritten``.

    ``run`` is the folder of this deletion: the deleted ids are written there first as ``tombstones``, so a run
    that is cut off between two tables is finished by the next one with the same ids, whatever
    ``doomed`` would give by then.
    """
    tombstones = f"{run}/tombstones"
    if not path_exists(spark, f"{tombstones}/_SUCCESS"):
        doomed.select(F.col("source_id").cast("string").alias("source_id")).distinct().write.mode("overwrite").parquet(tombstones)
    keys = spark.read.parquet(tombstones)
    out = None
    for name, folder in tables.items():
        counts = delete_rows(spark, folder, SOURCE_KEYS[name], keys, f"{run}/{name}", buckets).select(F.lit(name).alias("table_name"), "*")
        out = counts if out is None else out.unionByName(counts)
    return out


def without_deleted(rows: DataFrame, tombstones: DataFrame, key: str = "source_id") -> DataFrame:
    """Rows that come late, such as finished jobs of a source that has been deleted meanwhile, are left out."""
    return rows.join(tombstones.select(F.col("source_id").alias(key)), key, "left_anti")
