"""Merkle manifest of a dataset, stored as blocks in van Emde Boas layout.

Every row is a leaf, a digest of its fields. The leaves of one source, by document id, are hashed
together ``FAN`` at a time, run by run, until one node is left, the source's subroot; subroots by
source give the root the same way.

A tree is cut into aligned subtrees of ``HEIGHT`` levels of runs. One subtree is one row, its nodes
in one binary: the tree of ``LEVELS`` levels is split at half height into a top tree and the bottom
trees below it, the top laid out first, each part split again. All bottom trees but the last are
full, so the place of a node follows from its level, its number and the number of leaves, without
pointers; the same arithmetic places nodes while a block is built and finds the siblings of a leaf.
The roots of the blocks of one tier are the leaves of the next tier.

Ranks come from one sort by range: a row's place in its partition, less the source's first place
there, plus what the partitions before hold of the source. So a source with a third of all rows is
spread like any other, and no task holds more than one block of ``LEAVES`` leaves at a time. Going
down again, each block is given the siblings above it once, not once per leaf.

Defined results: null fields are ``-``, so they differ from empty ones; a null source is a source
of its own, the first; null ids come first; rows of one source and id are ordered by their leaf, and
repeated rows are leaves of their own; rows with a null id are never altered; an empty table gives
an empty result and has no root. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.session import stored

FAN = 16
HEIGHT = 3  # runs above each other in a block
LEVELS = HEIGHT + 1
LEAVES = FAN**HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# --- addresses in a block ----------------------------------------------------------------


def ceil_div(n, d):
    return -(-n // d)


def nodes_in(n, levels: int):
    """Nodes of a subtree of ``levels`` levels over ``n`` leaves."""
    return sum(ceil_div(n, FAN**k) for k in range(levels))


def place(number: np.ndarray, level: int, n, levels: int) -> np.ndarray:
    """Place of the nodes ``number`` of ``level`` (0: leaves) in a subtree of ``levels`` levels over
    ``n`` leaves, which may differ by node."""
    if levels == 1:
        return np.zeros(len(number), np.int64)
    low = levels // 2
    top = ceil_div(n, FAN**low)
    if level >= low:
        return place(number, level - low, top, levels - low)
    full = FAN ** (low - 1)
    tree = number // FAN ** (low - 1 - level)
    own = np.minimum(full, n - tree * full)
    before = nodes_in(top, levels - low) + tree * nodes_in(full, low)
    return before + place(number - tree * FAN ** (low - 1 - level), level, own, low)


def levels_of(n: int, total: int) -> int:
    """Levels of a block of ``n`` leaves: all of them if its tree has other blocks."""
    if total > LEAVES:
        return LEVELS
    return 1 + next(h for h in range(LEVELS) if FAN**h >= n)


def digest(text: str) -> bytes:
    return hashlib.sha256(text.encode()).digest()


def build_block(leaves: list[bytes], total: int) -> np.ndarray:
    """The nodes over ``leaves``, one row of 32 bytes each, at their places."""
    n = len(leaves)
    levels = levels_of(n, total)
    nodes = np.zeros((nodes_in(n, levels), 32), np.uint8)
    nodes[place(np.arange(n), 0, n, levels)] = np.frombuffer(b"".join(leaves), np.uint8).reshape(n, 32)
    for level in range(1, levels):
        below = level_text(nodes, level - 1, n, levels)
        made = [digest(below[at : at + 64 * FAN]) for at in range(0, len(below), 64 * FAN)]
        nodes[place(np.arange(len(made)), level, n, levels)] = np.frombuffer(b"".join(made), np.uint8).reshape(-1, 32)
    return nodes


def level_text(nodes: np.ndarray, level: int, n: int, levels: int) -> str:
    """The digests of a level in order, as hex text."""
    return nodes[place(np.arange(ceil_div(n, FAN**level)), level, n, levels)].tobytes().hex()


def sibling_texts(nodes: np.ndarray, n: int, total: int) -> list[list[tuple[str, str]]]:
    """For each leaf, level by level, the digests of its run on the left and on the right."""
    levels = levels_of(n, total)
    texts = [level_text(nodes, level, n, levels) for level in range(levels - 1)]
    out = []
    for leaf in range(n):
        own = []
        for level, text in enumerate(texts):
            node = leaf // FAN**level
            first = node // FAN * FAN * 64
            own.append((text[first : node * 64], text[node * 64 + 64 : first + FAN * 64]))
        out.append(own)
    return out


# --- leaves and ranks ----------------------------------------------------------------------


def field(value: Column) -> Column:
    """``-`` for null, else the number of bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, values)).cast("binary"), 256))


def altered_text(text: Column, doc: Column, one_in: int = 5) -> Column:
    """Whether a row's text is tampered with (one id in ``one_in``, by its checksum), and the text then."""
    return F.when(F.crc32(doc.cast("string").cast("binary")) % one_in == 0, F.translate(text, UPPER, LOWER))


def leaves(df: DataFrame, doc: str = "doc_id", source: str = "source", fields: tuple[str, ...] = FIELDS, altered: dict[str, Column] | None = None) -> DataFrame:
    """``source, doc_id, leaf``, and ``altered``, the leaf with the columns of ``altered`` in place of
    its own; null where one of these is null and the row's own is not."""
    own = {f: df[f] for f in fields}
    other = F.lit(None).cast("binary")
    if altered:
        changed = F.lit(True)
        for name, value in altered.items():
            changed = changed & (value.isNotNull() | own[name].isNull())
        other = F.when(changed, leaf(*[altered.get(f, v) for f, v in own.items()]))
    return df.select(df[source].alias("source"), df[doc].alias("doc_id"), leaf(*own.values()).alias("leaf"), other.alias("altered"))


def ranked(rows: DataFrame, group: str, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``at``, and ``of, part, first, before, total``: where the rows of a group start in
    each partition of the sort, how many are in those before, and how many there are."""
    again = stored(rows.withColumn("copy", F.monotonically_increasing_id()), name)  # sorted by samples, so read twice
    order = [*order, "copy"]
    sorted_ = again.repartitionByRange(*order).sortWithinPartitions(*order).drop("copy")
    placed = stored(sorted_.withColumn("at", F.monotonically_increasing_id()), f"{name}-sorted")
    runs = placed.groupBy(F.col(group).alias("of"), F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("of")  # one row per partition of the sort
    earlier = F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return placed, runs.select("of", "part", "first", F.coalesce(earlier, F.lit(0)).alias("before"), F.sum("n").over(whole).alias("total"))


# --- blocks --------------------------------------------------------------------------------


def pack(rows: DataFrame, carried: list[str]) -> DataFrame:
    """Blocks of ``rows(tree, rank, total, digest)``: ``tree, block, total, n, nodes, root`` and, for each
    column of ``carried``, the list of the leaves' values."""
    kinds = dict(rows.dtypes)
    schema = "tree bigint, block bigint, total bigint, n int, nodes binary, root binary" + "".join(f", {c} array<{kinds[c]}>" for c in carried)

    def close(table: pa.Table) -> pa.RecordBatch:
        total = table["total"][0].as_py()
        nodes = build_block(table["digest"].to_pylist(), total)
        root = nodes[int(place(np.zeros(1, np.int64), levels_of(len(table), total) - 1, len(table), levels_of(len(table), total))[0])]
        whole = pa.array([0, len(table)], pa.int32())
        lists = [pa.ListArray.from_arrays(whole, table[c].combine_chunks()) for c in carried]
        own = [table["tree"][:1].combine_chunks(), table["block"][:1].combine_chunks(), pa.array([total]), pa.array([len(table)], pa.int32()), pa.array([nodes.tobytes()]), pa.array([root.tobytes()])]
        return pa.RecordBatch.from_arrays([*own, *lists], ["tree", "block", "total", "n", "nodes", "root", *carried])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the block that is open, LEAVES at most
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if not len(held):
                continue
            tree, block = held["tree"].to_numpy(), held["block"].to_numpy()
            starts = np.flatnonzero(np.append(True, (np.diff(tree) != 0) | (np.diff(block) != 0)))
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                yield close(held.slice(a, b - a))
            held = held.slice(int(starts[-1]))
        if held is not None and len(held):
            yield close(held)

    cut = rows.select("tree", F.floor(F.col("rank") / LEAVES).alias("block"), "rank", "total", "digest", *carried)
    return cut.repartition("tree", "block").sortWithinPartitions("tree", "block", "rank").mapInArrow(run, schema)


def build(rows: DataFrame, carried: list[str], name: str) -> list[DataFrame]:
    """The tiers of blocks over ``rows(tree, rank, total, digest)``, the lowest first."""
    tiers = []
    while True:
        tiers.append(stored(pack(rows, carried), name))
        below = tiers[-1].filter(F.col("total") > LEAVES)
        if below.isEmpty():
            return tiers
        rows = below.select("tree", F.col("block").alias("rank"), F.ceil(F.col("total") / LEAVES).alias("total"), F.col("root").alias("digest"))
        carried = []


def roots(tiers: list[DataFrame]) -> DataFrame:
    """``tree, root`` of every tree: the root of its only block of a tier."""
    out = [t.filter(F.col("total") <= LEAVES).select("tree", "root") for t in tiers]
    for more in out[1:]:
        out[0] = out[0].union(more)
    return out[0]


STEPS = "array<struct<l:string,r:string>>"
STEP_TYPE = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))


def open_blocks(blocks: DataFrame) -> DataFrame:
    """``tree, rank, path`` of every leaf of ``blocks(tree, block, total, n, nodes, path)``: the siblings from
    the leaf to the outermost root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                tree, block, total, n, nodes, path = (batch.column(c)[row].as_py() for c in range(6))
                found = sibling_texts(np.frombuffer(nodes, np.uint8).reshape(-1, 32), n, total)
                for a in range(0, n, 256):
                    steps = [[{"l": left, "r": right} for left, right in own] + path for own in found[a : a + 256]]
                    ranks = block * LEAVES + np.arange(a, a + len(steps))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(steps), tree)), pa.array(ranks), pa.array(steps, STEP_TYPE)], ["tree", "rank", "path"])

    return blocks.select("tree", "block", "total", "n", "nodes", "path").mapInArrow(run, f"tree bigint, rank bigint, path {STEPS}")


def with_paths(tiers: list[DataFrame], tops: DataFrame, name: str) -> DataFrame:
    """The blocks of the lowest tier with ``path``, the siblings from their root on. ``tops(of, path)``
    has those above the root of each tree."""
    above = None
    for tier in reversed(tiers):
        only = tier.filter(F.col("total") <= LEAVES)
        found = only.join(tops, only["tree"] == tops["of"]).drop("of")
        if above is not None:
            of = above.select(F.col("tree").alias("of"), F.col("rank").alias("at"), "path")
            more = tier.filter(F.col("total") > LEAVES)
            found = found.unionByName(more.join(of, (more["tree"] == of["of"]) & (more["block"] == of["at"])).drop("of", "at"))
        above = found if tier is tiers[0] else stored(open_blocks(found), name)
    return above


def fold(blocks: DataFrame, kind: str) -> DataFrame:
    """One row per leaf of ``blocks(tree, total, n, nodes, path, doc_id, altered)``: the leaf, the hash of its
    proof, and the root that follows from the altered leaf, else the leaf, and the proof."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                tree, total, n, nodes, path = (batch.column(c)[row].as_py() for c in range(5))
                nodes = np.frombuffer(nodes, np.uint8).reshape(-1, 32)
                own = level_text(nodes, 0, n, levels_of(n, total))
                own = [own[at : at + 64] for at in range(0, len(own), 64)]
                other = batch.column(6)[row].as_py()
                above = [(s["l"], s["r"]) for s in path]
                rest = "".join(left + right for left, right in above)
                proofs, folded = [], []
                for steps, now, tampered in zip(sibling_texts(nodes, n, total), own, other):
                    now = now if tampered is None else tampered.hex()
                    for left, right in steps + above:
                        now = hashlib.sha256((left + now + right).encode()).hexdigest()
                    proofs.append(hashlib.sha256(("".join(left + right for left, right in steps) + rest).encode()).hexdigest())
                    folded.append(now)
                ids = batch.column(5)[row].values
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, tree)), ids, pa.array(own), pa.array(proofs), pa.array(folded)], ["tree", "doc_id", "leaf", "proof_sha256", "folded_root"])

    rows = blocks.select("tree", "total", "n", "nodes", "path", "doc_id", "altered")
    return rows.mapInArrow(run, f"tree bigint, doc_id {kind}, leaf string, proof_sha256 string, folded_root string")


def manifest(df: DataFrame, doc: str = "doc_id", source: str = "source", fields: tuple[str, ...] = FIELDS, altered: dict[str, Column] | None = None) -> dict[str, list[DataFrame] | DataFrame]:
    """The stored manifest: ``documents`` and ``sources``, the tiers of blocks of the source trees and of the
    tree over their subroots, and ``trees`` (source, tree, total)."""
    placed, runs = ranked(leaves(df, doc, source, fields, altered), "source", ["source", "doc_id", "leaf"], "manifest-leaves")
    runs = stored(runs, "manifest-runs")
    # Trees are numbered in the order of their sources; all sources are leaves of tree 0.
    each = runs.groupBy("of").agg(F.first("total").alias("total")).select(F.col("of").alias("source"), "total", F.lit(0).cast("long").alias("all"))
    numbered, spans = ranked(each, "all", ["source"], "manifest-trees")
    # One row per partition of the sort of the sources.
    numbered = numbered.join(spans.withColumnRenamed("total", "n_trees"), (F.shiftright("at", 33) == F.col("part")) & (F.col("all") == F.col("of")))
    numbered = stored(numbered.select("source", "total", (F.col("at") - F.col("first") + F.col("before")).alias("tree"), "n_trees"), "manifest-numbered")
    tree_of = numbered.select(F.col("source").alias("named"), "tree")
    spans = runs.join(tree_of, runs["of"].eqNullSafe(tree_of["named"])).drop("named")
    met = placed.join(spans, placed["source"].eqNullSafe(spans["of"]) & (F.shiftright(placed["at"], 33) == spans["part"]))
    rows = met.select("tree", (F.col("at") - F.col("first") + F.col("before")).alias("rank"), "total", F.col("leaf").alias("digest"), "doc_id", "altered")
    documents = build(rows, ["doc_id", "altered"], "manifest-blocks")
    tops = roots(documents).withColumnRenamed("tree", "of").join(numbered, F.col("of") == F.col("tree"))
    sources = build(tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"), F.col("n_trees").alias("total"), F.col("root").alias("digest")), [], "manifest-sources")
    return {"documents": documents, "sources": sources, "trees": numbered}


def verify(made: dict[str, list[DataFrame] | DataFrame]) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every leaf."""
    spark = made["trees"].sparkSession
    kind = dict(made["documents"][0].dtypes)["doc_id"][len("array<") : -1]
    top = roots(made["sources"]).first()  # one row
    root = F.lit(top["root"].hex() if top else None).cast("string")
    start = spark.createDataFrame([(0, [])], f"of bigint, path {STEPS}")
    opened = stored(open_blocks(with_paths(made["sources"], start, "manifest-source-paths")), "manifest-source-paths")
    tops = opened.select(F.col("rank").alias("of"), "path")
    subroots = roots(made["documents"]).select(F.col("tree").alias("of"), F.lower(F.hex("root")).alias("subroot"))
    rows = fold(with_paths(made["documents"], tops, "manifest-paths"), kind)
    out = rows.join(subroots, rows["tree"] == subroots["of"])
    return out.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


# --- SQL -----------------------------------------------------------------------------------


def _sql(depth: int = 6, source_depth: int = 6) -> str:
    """The same in SQL, for sources of up to ``FAN ** depth`` documents."""
    value = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    changed = f"translate(text, '{UPPER}', '{LOWER}')"
    hashed = lambda text: "sha256(" + " || ".join(value(c) for c in FIELDS[:-1]) + f" || {value(text)})"
    step = "CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END"
    byte = f"list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda r, z: {step})"
    code = "list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)"
    crc = f"xor(list_reduce(list_prepend(4294967295, {code}), lambda c, b: {byte}), 4294967295)"
    parts = [
        f"""rows_ AS (SELECT source, doc_id, {hashed('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {hashed(changed)} ELSE {hashed('text')} END AS now FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM rows_),
d0 AS (SELECT source AS tree, i, leaf AS h FROM numbered),
f0 AS (SELECT source AS tree, i AS i0, doc_id, leaf, now, '' AS proof FROM numbered)"""
    ]

    def climb(kind: str, levels: int, shown: str) -> None:
        n, f = kind, "f" if kind == "d" else "g"
        for k in range(levels):
            parts.append(f"{n}c{k} AS (SELECT tree, count(*) AS n FROM {n}{k} GROUP BY tree)")
            parts.append(
                f"{n}{k + 1} AS (SELECT a.tree, CASE WHEN n > 1 THEN i // {FAN} ELSE i END AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h "
                f"FROM {n}{k} a JOIN {n}c{k} c ON a.tree IS NOT DISTINCT FROM c.tree GROUP BY a.tree, CASE WHEN n > 1 THEN i // {FAN} ELSE i END)"
            )
            # Siblings of each node, left and right.
            parts.append(
                f"{n}s{k} AS (SELECT a.tree, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r, any_value(c.n) AS n "
                f"FROM {n}{k} a JOIN {n}{k} b ON a.tree IS NOT DISTINCT FROM b.tree AND a.i // {FAN} = b.i // {FAN} JOIN {n}c{k} c ON a.tree IS NOT DISTINCT FROM c.tree GROUP BY a.tree, a.i)"
            )
            parts.append(
                f"{f}{k + 1} AS (SELECT {shown}, x.tree, CASE WHEN n > 1 THEN i0 // {FAN} ELSE i0 END AS i0, CASE WHEN n > 1 THEN sha256(l || now || r) ELSE now END AS now, proof || l || r AS proof "
                f"FROM {f}{k} x JOIN {n}s{k} s ON x.tree IS NOT DISTINCT FROM s.tree AND x.i0 = s.i)"
            )

    climb("d", depth, "doc_id, leaf")
    parts.append(f"e0 AS (SELECT 0 AS tree, tree AS source, row_number() OVER (ORDER BY encode(tree) NULLS FIRST) - 1 AS i, h FROM d{depth})")
    parts.append(f"g0 AS (SELECT 0 AS tree, e.i AS i0, x.doc_id, x.leaf, e.h AS subroot, x.now, x.proof FROM f{depth} x JOIN e0 e ON x.tree IS NOT DISTINCT FROM e.source)")
    climb("e", source_depth, "doc_id, leaf, subroot")
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = t.h AS verified FROM g{source_depth} g JOIN e{source_depth} t ON g.tree = t.tree"
    )


OP11_SQL = _sql()
