"""Connected components of an edge table, by alternating large and small stars.

Each round replaces edges by edges to smaller nodes with one aggregation and one join per star;
all of them are partial aggregations and equality joins, so a node with very many neighbours is
summed up before it is shuffled and its join is split. Rounds end when the edges stop changing,
after about the logarithm of the longest chain. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.session import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    met = both.filter("v > u").join(least, F.col("u") == F.col("w"))
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    met = edges.join(least, F.col("u") == F.col("w"))
    moved = met.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(u, v)``; ``root`` is the component's least node.

    Null ends and loops are left out; repeated and two-way edges count once.
    """
    now = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = stored(now, "edges")
    before, state = None, _state(now)
    while state != before and state[0]:
        now = stored(_small_star(_large_star(now)), "edges")
        before, state = state, _state(now)
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))
