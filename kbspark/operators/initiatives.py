"""Initiative reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_lines(scores: DataFrame, limit: int = 5) -> DataFrame:
    """The best ``limit`` initiatives as numbered report lines."""
    best = scores.orderBy(F.col("overall_score").desc(), F.col("initiative_id")).limit(limit)
    order = Window.orderBy(F.col("overall_score").desc(), F.col("initiative_id"))
    return best.select(
        F.row_number().over(order).cast("long").alias("position"),
        F.concat(
            F.lit("- "), "title", F.lit(" (score "), F.col("overall_score").cast("string"), F.lit(") — "),
            F.coalesce("rationale", F.lit("")),
        ).alias("line"),
    )
