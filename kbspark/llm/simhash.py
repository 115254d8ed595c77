"""SimHash near-duplicates by a hierarchical index over fingerprints in Gray order.

Fingerprints that differ in at most ``BITS`` of 64 bits agree on two of five blocks, so each is
filed ten times, with one pair of blocks moved to the front. A filing is sorted by Gray rank,
which keeps words with a common front together and puts similar words side by side; words with
an equal front form a bucket. Over each run of up to ``CHUNK`` words of a bucket a tree is built,
eight to a node, every node holding the bits that all below it share (a mask and a pattern). Pairs
of nodes are followed from the top: differences on shared bits only add up on the way down, so
a pair of nodes with more than ``BITS`` of them is dropped with all below it, and so is one
whose words are known to be connected already.

Runs are cut from a range-partitioned sort, so a bucket of any size is spread over many tasks;
runs of one bucket meet pairwise, unless their roots already differ too much. Only distinct
fingerprints are filed, and from each run only a star per group of linked words is kept, never
its pairs. Groups of the stars are joined up by ``components``.

Defined results: a null or empty text and one of white space only have fingerprint 0 and are
linked like any other; repeated rows are kept and share their component; a null id is never the
name of a component unless the component has no other; an empty table gives an empty result.
Columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.components import components
from kbspark.session import stored

BITS = 3
SHINGLE = 3
SEED = 42
# Blocks of the fingerprint as (lowest bit, width), and the pairs of them that are moved to the front.
BLOCKS = [(51, 13), (38, 13), (25, 13), (12, 13), (0, 12)]
FRONTS = list(combinations(range(len(BLOCKS)), 2))
CHUNK = 4096
FAN = 3  # a node has 2**FAN children
PAIRS = 1 << 20  # node pairs that are looked at together


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lowered; both work on ASCII alone in bytes."""
    return (text or "").encode().lower().split()


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    words = words_of(text)
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, doc: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """``doc_id`` and its fingerprint as a signed 64-bit number."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t, size) for t in texts.to_pylist()], np.uint64).view(np.int64))

    return df.select(F.col(doc).alias("doc_id"), run(F.col(text)).alias("fp"))


# --- the index of one run of words -----------------------------------------------------


def gray_rank(words: np.ndarray) -> np.ndarray:
    """Position of each word in the sequence of Gray codes."""
    for shift in (1, 2, 4, 8, 16, 32):
        words = words ^ (words >> np.uint64(shift))
    return words


def moved(words: np.ndarray, front: tuple[int, int]) -> np.ndarray:
    """The words with the blocks of ``front`` first and the others after them, in order."""
    out = np.zeros_like(words)
    for i in [*front, *(i for i in range(len(BLOCKS)) if i not in front)]:
        low, width = BLOCKS[i]
        out = (out << np.uint64(width)) | ((words >> np.uint64(low)) & np.uint64((1 << width) - 1))
    return out


def front_width(front: tuple[int, int]) -> int:
    return sum(BLOCKS[i][1] for i in front)


class Forest:
    """Trees over groups of consecutive words, one per group, all of the same height."""

    def __init__(self, words: np.ndarray, groups: np.ndarray, labels: np.ndarray):
        """``groups`` are the positions where a group starts; ``labels`` name known components
        by the position of one of their words."""
        self.words, self.labels = words, labels
        size = np.diff(np.append(groups, len(words)))
        own = np.repeat(np.arange(len(groups)), size)
        inside = np.arange(len(words)) - np.repeat(groups, size)
        # starts[level]: first word of each node; below[level]: first child of each node.
        self.starts, self.below = [np.arange(len(words))], [np.arange(len(words) + 1)]
        while True:
            level = len(self.starts)
            last = self.starts[-1]
            place = inside[last] >> (FAN * level)
            new = np.flatnonzero(np.append(True, (np.diff(own[last]) != 0) | (np.diff(place) != 0)))
            self.starts.append(last[new])
            self.below.append(np.append(new, len(last)))
            if len(new) == len(groups):
                break
        self.pattern, self.mask = [words], [np.full(len(words), ~np.uint64(0))]
        for at in self.starts[1:]:
            both, some = np.bitwise_and.reduceat(words, at), np.bitwise_or.reduceat(words, at)
            self.pattern.append(both)
            self.mask.append(~(both ^ some))

    def root(self, i: np.ndarray) -> np.ndarray:
        while True:
            up = self.labels[i]
            if (up == i).all():
                return i
            i = up

    def settle(self) -> None:
        while True:
            up = self.labels[self.labels]
            if (up == self.labels).all():
                return
            self.labels = up

    def unite(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.labels[i], self.labels[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.labels, np.maximum(a, b), np.minimum(a, b))
            self.settle()

    def joined(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pairs of nodes all of whose words are in one component already."""
        low = np.minimum.reduceat(self.labels, self.starts[level])
        high = np.maximum.reduceat(self.labels, self.starts[level])
        return (low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b])

    def link(self, a: np.ndarray, b: np.ndarray, bits: int = BITS) -> None:
        """Join up all words within ``bits`` below the pairs of roots ``a`` and ``b``."""
        waiting = [(len(self.starts) - 1, a, b)]
        while waiting:
            level, a, b = waiting.pop()
            if len(a) > PAIRS:
                half = len(a) // 2
                waiting += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
                continue
            apart = np.bitwise_count((self.pattern[level][a] ^ self.pattern[level][b]) & self.mask[level][a] & self.mask[level][b])
            near = apart <= bits
            if level:
                near &= (a == b) | ~self.joined(level, a, b)
                near &= ~((a == b) & self.joined(level, a, a))
            a, b = a[near], b[near]
            if not len(a):
                continue
            if not level:
                self.unite(a, b)
                continue
            below = self.below[level]
            na, nb = below[a + 1] - below[a], below[b + 1] - below[b]
            n = na * nb
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            wide = np.repeat(nb, n)
            x, y = np.repeat(below[a], n) + k // wide, np.repeat(below[b], n) + k % wide
            once = x < y if level == 1 else x <= y
            keep = once | np.repeat(a != b, n)
            waiting.append((level - 1, x[keep], y[keep]))


def link_groups(words: np.ndarray, groups: np.ndarray, bits: int = BITS) -> np.ndarray:
    """For each word the position of the first word of its component within its group."""
    forest = Forest(words, groups, np.arange(len(words)))
    every = np.arange(len(groups))
    forest.link(every, every, bits)
    return forest.labels


def link_runs(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Components of two runs, given those of each."""
    forest = Forest(np.concatenate([a, b]), np.array([0, len(a)]), np.concatenate([of_a, of_b + len(a)]))
    forest.link(np.array([0]), np.array([1]), bits)
    return forest.labels


# --- the index over all fingerprints -----------------------------------------------------

RUNS = "u bigint, v bigint, front int, bucket bigint, run bigint, pattern bigint, mask bigint, words binary, labels binary"
RUNS_SCHEMA = pa.schema(
    [
        ("u", pa.int64()), ("v", pa.int64()), ("front", pa.int32()), ("bucket", pa.int64()), ("run", pa.int64()),
        ("pattern", pa.int64()), ("mask", pa.int64()), ("words", pa.binary()), ("labels", pa.binary()),
    ]
)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def file_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint under every front, with its Gray rank there."""
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        n = len(fp)
        ranks = np.concatenate([signed(gray_rank(moved(fp, f))) for f in FRONTS])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(FRONTS), dtype=np.int32), n)), pa.array(ranks), pa.array(signed(np.tile(fp, len(FRONTS))))],
            ["front", "rank", "fp"],
        )


def stars(fp: np.ndarray, labels: np.ndarray, before: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows that tie each word to the first of its component, those of ``before`` left out."""
    changed = labels != (np.arange(len(labels)) if before is None else before)
    u, v = fp[changed] if before is None else fp[before[changed]], fp[labels[changed]]
    rows = pa.table({"u": signed(u), "v": signed(v)}).group_by(["u", "v"]).aggregate([])
    empty = [pa.nulls(len(rows), f.type) for f in RUNS_SCHEMA][2:]
    return pa.RecordBatch.from_arrays([rows["u"].combine_chunks(), rows["v"].combine_chunks(), *empty], schema=RUNS_SCHEMA)


def cut_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of the words of one task in the order of front and rank, and runs of those buckets
    that may go on in another run: the first and last of the task and those longer than a run."""
    front, rank, fp = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
    first, open_bucket = True, False

    def bucket_of(front: np.ndarray, fp: np.ndarray) -> np.ndarray:
        out = np.zeros(len(fp), np.int64)
        for f in np.unique(front):
            here = front == f
            out[here] = signed(moved(fp[here].view(np.uint64), FRONTS[f]) >> np.uint64(64 - front_width(FRONTS[f])))
        return out

    def close(front, fp, last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal first, open_bucket
        bucket = bucket_of(front, fp)
        cut = np.flatnonzero(np.append(True, (np.diff(front) != 0) | (np.diff(bucket) != 0)))
        size = np.diff(np.append(cut, len(fp)))
        # Long buckets become several runs.
        groups = np.concatenate([np.arange(c, c + s, CHUNK) for c, s in zip(cut[size > CHUNK], size[size > CHUNK])] + [cut[size <= CHUNK]])
        groups.sort()
        words = fp.view(np.uint64)
        labels = link_groups(words, groups)
        yield stars(words, labels)
        sizes = np.diff(np.append(groups, len(fp)))
        kept = set(np.flatnonzero(np.isin(groups, np.concatenate([np.arange(c, c + s, CHUNK) for c, s in zip(cut[size > CHUNK], size[size > CHUNK])] + [np.empty(0, np.int64)]))))
        if first or open_bucket:
            kept.add(0)
        if last:
            kept.add(len(groups) - 1)
        first = False
        rows = []
        for g in sorted(kept):
            at, end = groups[g], groups[g] + sizes[g]
            part = words[at:end]
            both, some = np.bitwise_and.reduce(part), np.bitwise_or.reduce(part)
            rows.append(
                {
                    "front": int(front[at]), "bucket": int(bucket[at]), "run": int(signed(part[:1])[0]),
                    "pattern": int(signed(np.array([both]))[0]), "mask": int(signed(np.array([~(both ^ some)]))[0]),
                    "words": part.tobytes(), "labels": (labels[at:end] - at).astype(np.int32).tobytes(),
                }
            )
        for r in range(0, len(rows), 64):
            yield pa.RecordBatch.from_pylist(rows[r : r + 64], RUNS_SCHEMA)

    for b in batches:
        front = np.concatenate([front, b.column(0).to_numpy()])
        fp = np.concatenate([fp, b.column(2).to_numpy()])
        if len(fp) < 16 * CHUNK:
            continue
        bucket = bucket_of(front, fp)
        ends = np.flatnonzero((np.diff(front) != 0) | (np.diff(bucket) != 0)) + 1
        if len(ends):  # up to the last bucket, which may go on
            yield from close(front[: ends[-1]], fp[: ends[-1]], False)
            open_bucket = False
            front, fp = front[ends[-1] :], fp[ends[-1] :]
        if len(fp) >= 16 * CHUNK:  # one bucket alone
            full = len(fp) // CHUNK * CHUNK
            yield from close(front[:full], fp[:full], True)
            open_bucket = True
            front, fp = front[full:], fp[full:]
    if len(fp):
        yield from close(front, fp, True)


def meet_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars across two runs of a bucket."""
    for b in batches:
        for wa, la, wb, lb in zip(*(b.column(i).to_pylist() for i in range(4))):
            a, c = np.frombuffer(wa, np.uint64), np.frombuffer(wb, np.uint64)
            of_a, of_c = np.frombuffer(la, np.int32).astype(np.int64), np.frombuffer(lb, np.int32).astype(np.int64)
            labels = link_runs(a, c, of_a, of_c)
            made = stars(np.concatenate([a, c]), labels, np.concatenate([of_a, of_c + len(a)]))
            yield made.select(["u", "v"])


def links(words: DataFrame) -> DataFrame:
    """Edges ``u, v`` that connect exactly the fingerprints of ``words(fp)``, all distinct,
    which a chain of steps of at most ``BITS`` differing bits connects."""
    filed = words.mapInArrow(file_words, "front int, rank bigint, fp bigint")
    ordered = filed.repartitionByRange("front", "rank").sortWithinPartitions("front", "rank")
    runs = stored(ordered.mapInArrow(cut_runs, RUNS), "simhash-runs")
    own = runs.filter("u is not null").select("u", "v")
    part = runs.filter("u is null")
    a, b = part.alias("a"), part.alias("b")
    meet = a.join(b, (F.col("a.front") == F.col("b.front")) & (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.run") < F.col("b.run")))
    differ = F.col("a.pattern").bitwiseXOR(F.col("b.pattern")).bitwiseAND(F.col("a.mask")).bitwiseAND(F.col("b.mask"))
    meet = meet.filter(F.bit_count(differ) <= BITS).select("a.words", "a.labels", F.col("b.words").alias("w"), F.col("b.labels").alias("l"))
    return own.union(meet.mapInArrow(meet_runs, "u bigint, v bigint"))


def near_duplicates(df: DataFrame, doc: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """``doc_id, fingerprint, component_id``, one row per row of ``df``.

    The component's name is the smallest id that a chain of links reaches.
    """
    prints = stored(fingerprints(df, doc, text, size), "simhash-prints")
    # Copies share a fingerprint: only one of each goes on.
    words = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-words")
    groups = components(links(words.select("fp")))
    member = words.join(groups, F.col("fp") == F.col("node")).select("fp", "root", "least")
    name = member.groupBy("root").agg(F.min("least").alias("name")).withColumnRenamed("root", "r")
    grouped = member.join(name, F.col("root") == F.col("r")).select(F.col("fp").alias("node"), "name")
    named = words.join(grouped, F.col("fp") == F.col("node"), "left")
    named = stored(named.select(F.col("fp").alias("node"), F.coalesce("name", "least").alias("component_id")), "simhash-named")
    out = prints.join(named, F.col("fp") == F.col("node"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
