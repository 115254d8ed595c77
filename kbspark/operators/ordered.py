"""Ordered work per key that does not put a whole key into one task.

Rows are cut into time buckets. The inner step runs per (key, bucket); the outer step runs over
one row per bucket, so even a key with most of the data is ordered by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Microseconds of a zone-less timestamp since 1970."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def _bucketed(df: DataFrame, ts: str, seconds: int) -> DataFrame:
    return df.withColumn("_bucket", F.floor(micros(F.col(ts)) / (seconds * 1_000_000)))


def number_rows(
    df: DataFrame, keys: list[str], ts: str, tie: list[str], name: str = "position", seconds: int = 60
) -> DataFrame:
    """Add the 1-based position of every row within its key by ``ts`` and ``tie``."""
    cut = _bucketed(df, ts, seconds)
    inner = Window.partitionBy(*keys, "_bucket").orderBy(ts, *tie)
    outer = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        cut.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(outer), F.lit(0)))
        .drop("_n")
    )
    return (
        cut.withColumn("_inner", F.row_number().over(inner))
        .join(before, [*keys, "_bucket"])
        .withColumn(name, (F.col("_before") + F.col("_inner")).cast("long"))
        .drop("_bucket", "_before", "_inner")
    )


def previous_time(
    df: DataFrame, keys: list[str], ts: str, tie: list[str], name: str = "previous", seconds: int = 60
) -> DataFrame:
    """Add the time of the preceding row of the same key, null on the first."""
    cut = _bucketed(df, ts, seconds)
    inner = Window.partitionBy(*keys, "_bucket").orderBy(ts, *tie)
    outer = Window.partitionBy(*keys).orderBy("_bucket")
    last = (
        cut.groupBy(*keys, "_bucket")
        .agg(F.max(ts).alias("_last"))
        .withColumn("_carried", F.lag("_last").over(outer))
        .drop("_last")
    )
    return (
        cut.withColumn("_inner", F.lag(ts).over(inner))
        .join(last, [*keys, "_bucket"])
        .withColumn(name, F.coalesce("_inner", "_carried"))
        .drop("_bucket", "_inner", "_carried")
    )


def newest(df: DataFrame, keys: list[str], limit: int, *order: Column) -> DataFrame:
    """The first ``limit`` rows per key; Spark cuts each task to ``limit`` before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= limit)


def beyond_newest(df: DataFrame, keys: list[str], limit: int, ts: str, tie: str) -> DataFrame:
    """The rows after the newest ``limit`` of each key.

    Only the boundary row of a key is ranked; the others are compared with it.
    """
    edge = newest(df.select(*keys, ts, tie), keys, limit, F.col(ts).desc(), F.col(tie).desc())
    edge = edge.where(F.col("_rank") == limit).select(
        *keys, F.col(ts).alias("_edge_ts"), F.col(tie).alias("_edge_tie")
    )
    older = (F.col(ts) < F.col("_edge_ts")) | ((F.col(ts) == F.col("_edge_ts")) & (F.col(tie) < F.col("_edge_tie")))
    return df.join(edge, keys).where(older).drop("_edge_ts", "_edge_tie")


def running_sum(
    df: DataFrame, keys: list[str], ts: str, tie: list[str], value: str, name: str, seconds: int = 60
) -> DataFrame:
    """Add the running total of ``value`` within the key, the row itself included."""
    cut = _bucketed(df, ts, seconds)
    inner = Window.partitionBy(*keys, "_bucket").orderBy(ts, *tie).rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        cut.groupBy(*keys, "_bucket")
        .agg(F.sum(value).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(outer), F.lit(0)))
        .drop("_n")
    )
    return (
        cut.withColumn("_inner", F.sum(value).over(inner))
        .join(before, [*keys, "_bucket"])
        .withColumn(name, F.col("_before") + F.col("_inner"))
        .drop("_bucket", "_before", "_inner")
    )
