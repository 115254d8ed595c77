"""Exact nearest vectors for a table of query vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark.operators.ordered import newest

MAX_BROADCAST_QUERIES = 4096
MAX_BROADCAST_VALUES = 4_000_000


def _matrix(vectors: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows as float64 padded with zeros, and the mask of their real positions."""
    out, mask = np.zeros((len(vectors), width)), np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
        mask[i, : len(v)] = 1.0
    return out, mask


def _scores(left: list, right: list) -> np.ndarray:
    """Cosine of every left with every right vector over their common length, zero where a
    vector is zero there."""
    width = max(max(map(len, left)), max(map(len, right)))
    (a, a_mask), (b, b_mask) = _matrix(left, width), _matrix(right, width)
    norms = np.sqrt((a * a) @ b_mask.T) * np.sqrt(a_mask @ (b * b).T)
    return np.divide(a @ b.T, norms, out=np.zeros((len(a), len(b))), where=norms > 0)


def _tiles(wanted: list, rows: list, values: int = 1 << 21) -> Iterator[tuple[int, np.ndarray]]:
    """Position of each wanted vector and its scores, at most ``values`` scores at a time."""
    step = max(1, values // max(1, len(rows)))
    for at in range(0, len(wanted), step):
        for i, row in enumerate(_scores(wanted[at : at + step], rows)):
            yield at + i, row


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best by score, then by id; ties at the edge are weighed by id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= edge)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]


def top_vectors(
    queries: DataFrame, vectors: DataFrame, k: int, query_id: str, vector_id: str, embedding: str = "embedding"
) -> DataFrame:
    """The ``k`` vectors nearest to each query by cosine, as (query, vector, score, rank).

    A query side of proven small size goes to every task; each task then keeps its own ``k``
    best per query while it streams through its vectors, so the vectors are never shuffled. A
    larger query side is cut into blocks, and each block of queries meets each block of
    vectors in one task.
    """
    q_type, v_type = queries.schema[query_id].dataType, vectors.schema[vector_id].dataType
    schema = T.StructType(
        [T.StructField(query_id, q_type), T.StructField(vector_id, v_type), T.StructField("score", T.DoubleType())]
    )
    queries = queries.select(query_id, embedding).where(F.col(embedding).isNotNull())
    vectors = vectors.select(vector_id, embedding).where(F.col(embedding).isNotNull())
    head = queries.limit(MAX_BROADCAST_QUERIES + 1).collect()
    small = len(head) <= MAX_BROADCAST_QUERIES and sum(len(r[1]) for r in head) <= MAX_BROADCAST_VALUES
    if small:
        found = _broadcast_search(head, vectors, k, schema)
    else:
        found = _block_search(queries, vectors, k, schema, query_id, vector_id)
    return newest(found, [query_id], k, F.col("score").desc(), F.col(vector_id)).withColumnRenamed("_rank", "rank")


def _broadcast_search(head: list, vectors: DataFrame, k: int, schema: T.StructType) -> DataFrame:
    query_ids = [r[0] for r in head]
    query_vectors = [np.asarray(r[1], dtype=np.float64) for r in head]
    shared = vectors.sparkSession.sparkContext.broadcast((query_ids, query_vectors))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, wanted = shared.value
        best = [(np.empty(0), np.empty(0, dtype=object)) for _ in names]
        for batch in batches:
            ids, rows = batch.iloc[:, 0].to_numpy(), batch.iloc[:, 1].tolist()
            if not names or not len(rows):
                continue
            for i, scores in _tiles(wanted, rows):
                pick = _best(scores, ids, k)
                s = np.concatenate([best[i][0], scores[pick]])
                v = np.concatenate([best[i][1], ids[pick]])
                keep = _best(s, v, k)
                best[i] = (s[keep], v[keep])
        sizes = [len(s) for s, _ in best]
        if any(sizes):
            columns = (
                [name for name, n in zip(names, sizes) for _ in range(n)],
                np.concatenate([v for _, v in best]),
                np.concatenate([s for s, _ in best]),
            )
            yield pd.DataFrame(dict(zip(schema.names, columns)))

    return vectors.mapInPandas(search, schema)


def _block_search(
    queries: DataFrame, vectors: DataFrame, k: int, schema: T.StructType, query_id: str, vector_id: str,
    query_block: int = 8192, vector_block: int = 16384,
) -> DataFrame:
    q_blocks = max(1, -(-queries.count() // query_block))
    v_blocks = max(1, -(-vectors.count() // vector_block))
    q = queries.withColumn("_q", F.pmod(F.xxhash64(query_id), F.lit(q_blocks))).withColumn(
        "_v", F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1)))
    )
    v = vectors.withColumn("_v", F.pmod(F.xxhash64(vector_id), F.lit(v_blocks)).cast("int")).withColumn(
        "_q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long")))
    )

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=schema.names)
        ids, rows, wanted = right.iloc[:, 0].to_numpy(), right.iloc[:, 1].tolist(), left.iloc[:, 1].tolist()
        best = [(ids[pick], row[pick]) for _, row in _tiles(wanted, rows) for pick in [_best(row, ids, k)]]
        columns = (
            [name for name, (v, _) in zip(left.iloc[:, 0], best) for _ in v],
            np.concatenate([v for v, _ in best]),
            np.concatenate([s for _, s in best]),
        )
        return pd.DataFrame(dict(zip(schema.names, columns)))

    q = q.select(query_id, queries.columns[1], F.col("_q").cast("long").alias("_q"), F.col("_v").cast("int").alias("_v"))
    v = v.select(vector_id, vectors.columns[1], "_q", "_v")
    return q.groupBy("_q", "_v").cogroup(v.groupBy("_q", "_v")).applyInPandas(search, schema)


def label_centroids(vectors: DataFrame, label: str, embedding: str = "embedding") -> DataFrame:
    """Mean vector per label, merged position by position."""
    parts = vectors.select(label, F.posexplode(embedding).alias("_i", "_x"))
    means = parts.groupBy(label, "_i").agg(F.avg("_x").alias("_x"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"])
    return means.groupBy(label).agg(ordered.alias(embedding))
