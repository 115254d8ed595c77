"""Rows that a table of hashes may name, told from the others by a bitmap of fixed size.

A stage that changes some documents joins its findings with those that the bitmap marks; the others,
for which nothing was found, stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.session import stored

BITMAP = 26


def split_marked(df: DataFrame, own: Column, found: DataFrame, hashed: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose hash ``own`` may be in the column ``hashed`` of ``found``, and those where it is not.

    Both are joins with at most 2**(BITMAP - 6) rows that go to all tasks, so no row of ``df`` moves. Rows
    marked by chance find nothing in ``found``.
    """
    place = lambda h: F.shiftrightunsigned(h, 64 - BITMAP + 6)
    bit = lambda h: F.shiftrightunsigned(h, 64 - BITMAP).bitwiseAND(F.lit(63)).cast("int")
    held = found.select(place(hashed).alias("_place"), F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col(hashed))).alias("_bit"))
    bits = stored(held.groupBy("_place").agg(F.bit_or("_bit").alias("_bits")), "marked")
    marks = (place(own) == bits["_place"]) & F.call_function("shiftright", bits["_bits"], bit(own)).bitwiseAND(F.lit(1)).cast("boolean")
    return df.join(F.broadcast(bits), marks, "left_semi"), df.join(F.broadcast(bits), marks, "left_anti")
