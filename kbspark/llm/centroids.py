"""Centroid clustering with zone maps of vectors in Hilbert order.

Vectors become whole numbers, ``floor(scale * x)``, so every distance and mean is exact. They are
sorted along a Hilbert curve and cut into blocks of ``BLOCK`` rows, each one row of a stored table:
its vectors in one binary, and a zone map of the least and largest value of each component and the
sum of its vectors. As a curve through all components at once would hardly get past the first bit
of each, it runs through the ``AXES`` main axes of a bounded sample, on a grid with as many sample
vectors in each cell; only the order of rows depends on that, never a result.

Over a block's box ``|x - c|^2 - |x - d|^2`` is linear in ``x``, so its least value is found exactly
from the box. A centroid that is farther than another one all over the box is no candidate; those
that are left are compared with each vector, in one matrix product. A block with one candidate is
assigned whole, and its sum comes from the zone map. Each round reads the blocks once and shuffles
one sum per task, centroid and component; the centroids (``k`` rows) go through the driver.

The sort is by range, ties cut by row, so that one vector in a third of all rows is spread.

Defined results: vectors with another number of components, or a null or non-finite one, and null
vectors are left out; so are those with a whole number beyond ``WIDEST``, as no long holds their
squared distances; a null id is none of the first centroids unless others are too few; repeated rows
are vectors of their own; ties go to the smaller centroid number; with fewer vectors than centroids
there are as many centroids as vectors; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.session import stored

BLOCK = 256
WIDEST = 1 << 27
SAMPLE = 4096  # vectors that fit the curve's axes
AXES, BITS = 7, 9  # 63 bits of rank
EXACT = 1 << 52  # sums of whole numbers that doubles hold


# --- the curve -----------------------------------------------------------------------------


def hilbert_rank(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of grid cells on the Hilbert curve; ``cells`` has one row per axis.

    From the highest bit down, each axis turns or mirrors the part of the curve that the lower bits
    run through; the turned coordinates in Gray order are the digits of the rank.
    """
    x = cells.astype(np.uint64)
    axes = len(x)
    for bit in range(bits - 1, 0, -1):
        high, low = np.uint64(1 << bit), np.uint64((1 << bit) - 1)
        for a in range(axes):
            mirrored = (x[a] & high) != 0
            swap = np.where(mirrored, np.uint64(0), (x[0] ^ x[a]) & low)
            x[0] ^= np.where(mirrored, low, swap)
            x[a] ^= swap
    for a in range(1, axes):
        x[a] ^= x[a - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> np.uint64(bit)) & np.uint64(1) == 1, np.uint64((1 << bit) - 1), np.uint64(0))
    x ^= turn
    rank = np.zeros(x.shape[1], np.uint64)
    for bit in range(bits - 1, -1, -1):
        for a in range(axes):
            rank = (rank << np.uint64(1)) | ((x[a] >> np.uint64(bit)) & np.uint64(1))
    return rank.astype(np.int64)


class Grid:
    """The cells of the curve: main axes of a sample, each cut where the sample's quantiles are."""

    def __init__(self, sample: np.ndarray):
        self.axes = min(AXES, sample.shape[1])
        self.bits = BITS
        centred = sample - sample.mean(axis=0)
        _, self.turned = np.linalg.eigh(centred.T @ centred)
        self.turned = self.turned[:, ::-1][:, : self.axes]
        places = np.linspace(0, 1, (1 << BITS) + 1)[1:-1]
        self.cuts = np.quantile(sample @ self.turned, places, axis=0).T

    def rank(self, vectors: np.ndarray) -> np.ndarray:
        along = vectors @ self.turned
        return hilbert_rank(np.stack([np.searchsorted(cut, along[:, a], "right") for a, cut in enumerate(self.cuts)]), self.bits)


# --- bounds and distances --------------------------------------------------------------------


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to some point of the box."""
    square = (centroids * centroids).sum(axis=1)
    keep = np.ones(len(centroids), bool)
    # Rivals from the one nearest to the box's middle on; they are the ones that rule out most.
    for d in np.argsort(((low + high - 2 * centroids) ** 2).sum(axis=1), kind="stable").tolist():
        if not keep[d]:
            continue
        apart = centroids - centroids[d]
        most = np.where(apart > 0, apart * high, apart * low).sum(axis=1)
        least = square - square[d] - 2 * most
        out = (least > 0) | ((least == 0) & (np.arange(len(centroids)) > d))
        out[d] = False
        keep &= ~out
    return np.flatnonzero(keep)


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all vectors to all centroids, exact."""
    widest = max(int(np.abs(vectors).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * widest * widest * vectors.shape[1] < EXACT:  # every partial sum is a whole number that doubles hold
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        return ((v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((vectors - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def nearest(vectors: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each vector of a block, and the squared distance."""
    own = candidates(low, high, centroids)
    far = distances(vectors, centroids[own])
    first = far.argmin(axis=1)  # the first of equal ones
    return own[first], far[np.arange(len(far)), first]


# --- blocks --------------------------------------------------------------------------------


def whole_vectors(df: DataFrame, vec: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: int = 64) -> DataFrame:
    """``vec_id, v``: the vectors that are kept, as whole numbers."""
    values = df.select(df[vec].alias("vec_id"), df[vector].cast("array<double>").alias("x")).filter(F.size("x") == dims)
    # NaN is the largest double, so the range test leaves it out too; a null one is not within.
    within = F.forall("x", lambda x: F.coalesce((F.floor(x * scale) >= -WIDEST) & (F.floor(x * scale) <= WIDEST), F.lit(False)))
    finite = F.forall("x", lambda x: F.coalesce((x > float("-inf")) & (x < float("inf")), F.lit(False)))
    bounded = F.forall("x", lambda x: F.abs(x) <= float(WIDEST))  # so that floor does not overflow
    kept = values.filter(finite).filter(bounded).filter(within)
    return kept.select("vec_id", F.transform("x", lambda x: F.floor(x * scale).cast("int")).alias("v"))


def first_vectors(vectors: DataFrame, count: int) -> np.ndarray:
    """The ``count`` vectors with the smallest hash of their id."""
    order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.select(order.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(count).collect()
    return np.array([r["v"] for r in rows], np.int64)


def as_matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


BLOCKS = "n int, low binary, high binary, total binary, vectors binary"


def blocks_of(vectors: DataFrame, grid: Grid, dims: int) -> DataFrame:
    """``n, low, high, total, vectors, ids`` of each block of vectors in the order of the curve."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(grid)  # AXES axes and cuts, whatever the input
    kind = dict(vectors.dtypes)["vec_id"]

    @F.arrow_udf("struct<rank:bigint,packed:binary>")
    def filed(column: pa.Array) -> pa.Array:
        if not len(column):
            return pa.StructArray.from_arrays([pa.array([], pa.int64()), pa.array([], pa.binary())], ["rank", "packed"])
        rows = as_matrix(column, dims).astype(np.int32)
        return pa.StructArray.from_arrays([pa.array(shared.value.rank(rows)), pa.array([r.tobytes() for r in rows], pa.binary())], ["rank", "packed"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0

        def close(table: pa.Table) -> pa.RecordBatch:
            rows = np.frombuffer(b"".join(table["packed"].to_pylist()), np.int32).reshape(-1, dims)
            wide = rows.astype(np.int64)
            parts = [[rows.min(axis=0).tobytes()], [rows.max(axis=0).tobytes()], [wide.sum(axis=0).tobytes()], [rows.tobytes()]]
            ids = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), table["vec_id"].combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int32()), *(pa.array(p, pa.binary()) for p in parts), ids], ["n", "low", "high", "total", "vectors", "ids"])

        for batch in batches:
            held.append(batch)
            waiting += len(batch)
            if waiting >= BLOCK:
                table = pa.Table.from_batches(held)
                full = waiting // BLOCK * BLOCK
                for a in range(0, full, BLOCK):
                    yield close(table.slice(a, BLOCK))
                held, waiting = table.slice(full).to_batches(), waiting - full
        if waiting:
            yield close(pa.Table.from_batches(held))

    placed = vectors.select("vec_id", filed("v").alias("f")).select("vec_id", "f.*").withColumn("copy", F.monotonically_increasing_id())
    placed = stored(placed, "centroids-ranked")  # sorted by samples, so read twice
    ordered = placed.repartitionByRange("rank", "copy").sortWithinPartitions("rank", "copy").select("vec_id", "packed")
    return stored(ordered.mapInArrow(cut, f"{BLOCKS}, ids array<{kind}>"), "centroids-blocks")


def cluster_sums(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``cluster, part, n, total`` of the vectors nearest to each centroid: per component, one row per task."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, object)
        for batch in batches:
            for n, low, high, summed, packed in zip(*(c.to_pylist() for c in batch.columns)):
                low, high = (np.frombuffer(b, np.int32).astype(np.int64) for b in (low, high))
                own = candidates(low, high, centroids)
                if len(own) == 1:
                    count[own[0]] += n
                    total[own[0]] += np.frombuffer(summed, np.int64).astype(object)
                    continue
                rows = np.frombuffer(packed, np.int32).reshape(n, dims).astype(np.int64)
                at = own[distances(rows, centroids[own]).argmin(axis=1)]
                for c in np.unique(at).tolist():
                    count[c] += int((at == c).sum())
                    total[c] += rows[at == c].sum(axis=0).astype(object)
        for c in np.flatnonzero(count).tolist():
            sums = [str(x) for x in total[c]]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dims, c, np.int32)), pa.array(np.arange(dims, dtype=np.int32)), pa.array(np.full(dims, count[c])), pa.array(sums)], ["cluster", "part", "n", "total"])

    rows = blocks.select("n", "low", "high", "total", "vectors").mapInArrow(run, "cluster int, part int, n bigint, total string")
    return rows.groupBy("cluster", "part").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def next_centroids(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of the mean of each centroid's vectors; those without any stay."""
    out = centroids.copy()
    for r in cluster_sums(blocks, centroids).collect():  # one row per centroid and component
        out[r["cluster"], r["part"]] = int(r["total"]) // r["n"]
    return out


def assign(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector."""
    dims = centroids.shape[1]
    kind = dict(blocks.dtypes)["ids"][len("array<") : -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                low, high, packed = (np.frombuffer(batch.column(c)[row].as_py(), np.int32).astype(np.int64) for c in range(3))
                at, far = nearest(packed.reshape(-1, dims), low, high, centroids)
                yield pa.RecordBatch.from_arrays([batch.column(3)[row].values, pa.array(at.astype(np.int32)), pa.array(far)], ["vec_id", "cluster", "distance"])

    return blocks.select("low", "high", "vectors", "ids").mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint")


RESULT = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def cluster(df: DataFrame, k: int = 16, rounds: int = 3, vec: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: int = 64) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` of every kept vector after ``rounds`` rounds, and the centroids."""
    vectors = whole_vectors(df, vec, vector, dims, scale)
    kind = dict(vectors.dtypes)["vec_id"]
    centroids = first_vectors(vectors, k)
    if not len(centroids):
        return df.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance bigint"), np.zeros((0, dims), np.int64)
    blocks = blocks_of(vectors, Grid(first_vectors(vectors, SAMPLE).astype(float)), dims)
    for _ in range(rounds):
        centroids = next_centroids(blocks, centroids)
    return stored(assign(blocks, centroids), "centroids-assigned"), centroids


def summed(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The rows of ``cluster`` with the inertia of their cluster and of all, and the hash of their centroid."""
    each = assigned.groupBy(F.col("cluster").alias("c")).agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("i")).collect()  # a row per centroid
    inertia = {r["c"]: int(r["i"]) for r in each}
    named = [(c, str(inertia[c]), str(sum(inertia.values())), ",".join(map(str, centroids[c].tolist()))) for c in sorted(inertia)]
    rows = assigned.sparkSession.createDataFrame(named, "c int, cluster_inertia string, inertia string, parts string")
    out = assigned.join(F.broadcast(rows), F.col("cluster") == F.col("c"))  # k rows
    long = [F.col(c).try_cast("bigint").alias(c) for c in ("cluster_inertia", "inertia")]
    return out.select("vec_id", "cluster", "distance", *long, F.sha2(F.col("parts").cast("binary"), 256).alias("centroid_sha256"))


# --- SQL -----------------------------------------------------------------------------------


def _sql(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> str:
    parts = [
        f"""x AS (SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE) AS e FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: isfinite(e) AND abs(e::DOUBLE) <= {WIDEST})) = {dims}),
v AS (SELECT vec_id, v FROM (SELECT vec_id, list_transform(e, lambda y: floor({scale} * y)::BIGINT) AS v FROM x) WHERE list_max(list_transform(v, lambda y: abs(y))) <= {WIDEST}),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR) NULLS LAST, v) - 1 AS c, v AS m FROM v QUALIFY c < {k})"""
    ]
    far = "list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    for r in range(rounds + 1):
        parts.append(f"a{r} AS (SELECT *, row_number() OVER () AS row FROM v), d{r} AS (SELECT row, any_value(vec_id) AS vec_id, any_value(v) AS v, min(({far}, c)) AS best FROM a{r}, c{r} GROUP BY row)")
        if r < rounds:
            parts.append(
                f"""s{r} AS (SELECT c, p, sum(y)::HUGEINT AS total, count(*)::HUGEINT AS n FROM (SELECT best[2] AS c, unnest(v) AS y, generate_subscripts(v, 1) AS p FROM d{r}) GROUP BY c, p),
n{r} AS (SELECT c, list(((total - ((total % n) + n) % n) // n)::BIGINT ORDER BY p) AS m FROM s{r} GROUP BY c),
c{r + 1} AS (SELECT c0.c, coalesce(n{r}.m, c0.m) AS m FROM c{r} c0 LEFT JOIN n{r} USING (c))"""
            )
    last = f"d{rounds}"
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, best[2]::INTEGER AS cluster, best[1]::BIGINT AS distance, sum(best[1]) OVER (PARTITION BY best[2])::BIGINT AS cluster_inertia, sum(best[1]) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256
FROM {last} JOIN c{rounds} ON best[2] = c"""
    )


OP12_SQL = _sql()
