"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions, each made in the context of the ``DEPTH`` bytes before it and of
the bits already known. Every decision has its own context tree: a node per suffix of the context,
with a Krichevsky-Trofimov estimate of its counts. A node's weighted probability is the mean of
its own estimate and the product of its children's weighted probabilities, so the share that each
depth has in a prediction follows from how well it predicted the training text.

Training counts all ``DEPTH + 1`` byte sequences of the training texts (lowered A-Z, after ``DEPTH``
zero bytes, closed by the byte 0xFF, which UTF-8 never has) and grows with them. The distinct
sequences of all texts, those without a training count too, are dealt by the last ``NEAR`` bytes of
their context. Below such a context all nodes lie in one task, which works on whole contexts one
after another; what it holds at once is bounded by the bytes there are, not by the rows. The
levels above are one aggregation each, and a second pass over the sequences gives each its
probability. No node is lost. Predictions mix all depths that the training text has reached; a text's
score is the sum over all its bytes and its end.

The base score is that of single words with one added to each count. The counts of words with
more than 1 in ``2**FREQUENT`` of all tokens (fewer than that many words, whatever the data) are sent
to all tasks, and so are the probabilities of the most frequent sequences, at most
``2**(FREQUENT + 2)``; other words and sequences are looked up by a join, with the same result.

Defined results: a null text is empty and has one token, its end; a null id is trained on and not
held out; repeated rows count and are scored each; without training text every bit is even and
the base score is 0. Columns that are not named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.byte_words import LOWER, NOT_SPACE, slices
from kbspark.session import stored

DEPTH, NEAR = 5, 3
SLOTS = 24
FREQUENT = 20
CACHE = 20
GRAM, WORD, HELD = 0, 1, 2
END = 255
MIX = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc: str):
    return F.coalesce(F.crc32(F.col(doc).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All sequences of ``DEPTH + 1`` bytes of some texts that end in the text or on its end, and
    where the sequences of each text begin."""
    pad, stop = bytes(DEPTH), bytes([END])
    data = LOWER[np.frombuffer(b"".join([x for t in texts for x in (pad, t, stop)]), np.uint8)].astype(np.uint64)
    size = np.array([len(t) + 1 for t in texts])
    first = np.cumsum(size + DEPTH) - size - DEPTH
    out = np.zeros(len(data) - DEPTH, np.uint64)
    for k in range(DEPTH + 1):
        out = (out << np.uint64(8)) | data[k : len(data) - DEPTH + k]
    # The sequences that end on the padding of the next text are between two texts.
    begin = np.cumsum(size) - size
    return out[np.repeat(first - begin, size) + np.arange(size.sum())], begin


def groups(texts: list, most: int = 1 << 19) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as bytes, in groups of about ``most``, and the number of the first of each."""
    held, size, at = [], 0, 0
    for i, t in enumerate(texts):
        held.append((t or "").encode())
        size += len(held[-1])
        if size >= most:
            yield at, held
            held, size, at = [], 0, i + 1
    if held:
        yield at, held


class Counter:
    """Sums of counts by key, in sorted arrays."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        keys, counts = np.unique(keys, return_counts=True)
        self.keys, place = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        self.counts = np.bincount(place, np.concatenate([self.counts, counts]), len(self.keys)).astype(np.int64)

    def rows(self, kind: int) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.keys), 1 << 16):
            keys, counts = self.keys[at : at + (1 << 16)].view(np.int64), self.counts[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(counts)], ["kind", "key", "n"])


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Byte sequences of ``t, held_out``, apart for training and held-out texts, and words of
    training texts, with their counts, summed up in the task as far as they fit."""
    held = {GRAM: Counter(), WORD: Counter(), HELD: Counter()}
    for batch in batches:
        aside = batch.column(1)
        for kind, column in ((GRAM, batch.column(0).filter(pc.invert(aside))), (HELD, batch.column(0).filter(aside))):
            for _, texts in groups(column.to_pylist()):
                held[kind].add(grams(texts)[0])
            if kind == GRAM:
                for _, _, words in slices(column, NOT_SPACE):
                    held[WORD].add(words.hash)
        for kind, own in held.items():
            if len(own.keys) > 1 << 20:
                yield from own.rows(kind)
                held[kind] = Counter()
    for kind, own in held.items():
        yield from own.rows(kind)


def log_gamma(x):
    """Stirling's series after eight steps of the recurrence."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y)
    return series - F.log(x * (x + 1) * (x + 2) * (x + 3)) - F.log((x + 4) * (x + 5) * (x + 6) * (x + 7))


def estimate(n0, n1):
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(n0 + F.lit(0.5)) + log_gamma(n1 + F.lit(0.5)) - log_gamma(n0 + n1 + F.lit(1.0)) - F.lit(float(np.log(np.pi)))


HALF = float(np.log(0.5))


def estimates(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """``estimate`` over arrays, exactly zero without counts."""

    def log_gamma(x):
        y = x + 8
        out = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) - np.log(x * (x + 1) * (x + 2) * (x + 3))
        return out - np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))

    return np.where(n0 + n1 > 0, log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - np.log(np.pi), 0.0)


def decisions(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eight prefixes of each byte, and the bit that follows each."""
    k = np.arange(8)
    return (1 << k) | (byte[:, None] >> (8 - k)), (byte[:, None] >> (7 - k)) & 1


def whole(batches: Iterator[pa.RecordBatch], most: int = 1 << 16) -> Iterator[pa.Table]:
    """Rows in order of their first column, some ``most`` at a time, never parting equal ones."""
    held, size, need = [], 0, most
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size < need:
            continue
        table = pa.Table.from_batches(held)
        group = table.column(0).to_numpy()
        cut = int(np.searchsorted(group, group[-1]))
        if cut:
            yield table.slice(0, cut)
        held, size = table.slice(cut).to_batches(), len(table) - cut
        need = max(most, 2 * size)
    if size:
        yield pa.Table.from_batches(held)


SUBTREES = "near bigint, prefix int, n0 bigint, n1 bigint, log_w double, key bigint, often bigint, mixed array<double>"
NODE_END = 256  # in place of a prefix: a sequence, after the nodes of its context


def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ``near, key, n, often``: the nodes of depth ``NEAR``, and of each sequence what the depths
    from ``NEAR`` on give for each bit, NaN where none of them has a count."""
    for table in whole(batches):
        near, key, n, often = (table.column(i).to_numpy() for i in range(4))
        prefix, bit = decisions(key & 255)
        nodes = ((key >> 8)[:, None] << 8 | prefix).ravel()
        n, bit = np.repeat(n, 8), bit.ravel()
        n0, n1, below, at = n * (1 - bit), n * bit, None, np.arange(len(nodes))
        levels = []
        for depth in range(DEPTH, NEAR - 1, -1):
            nodes, of = np.unique(nodes & ((1 << (8 * depth + 8)) - 1), return_inverse=True)
            n0, n1 = np.bincount(of, n0, len(nodes)), np.bincount(of, n1, len(nodes))
            log_w, stop = estimates(n0, n1), np.ones(len(nodes))
            if below is not None:
                own, other = log_w + HALF, np.bincount(of, below, len(nodes)) + HALF
                log_w = np.where(n0 + n1 > 0, np.logaddexp(own, other), 0.0)
                stop = np.exp(own - log_w)
            below, at = log_w, of[at]
            levels.append((at, n0 + n1 > 0, (n1 + 0.5) / (n0 + n1 + 1), stop))
        mixed = np.full(len(at), np.nan)
        for at, seen, one, stop in levels:
            mixed = np.where(np.isnan(mixed), np.where(seen, one, np.nan)[at], stop[at] * one[at] + (1 - stop[at]) * mixed)
        for first in range(0, len(nodes), 1 << 15):
            c = slice(first, first + (1 << 15))
            size = len(nodes[c])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(nodes[c] >> 8), pa.array((nodes[c] & 255).astype(np.int32)), pa.array(n0[c].astype(np.int64)), pa.array(n1[c].astype(np.int64)),
                    pa.array(log_w[c]), pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.list_(pa.float64())),
                ],
                ["near", "prefix", "n0", "n1", "log_w", "key", "often", "mixed"],
            )
        for first in range(0, len(key), 1 << 15):
            c = slice(first, first + (1 << 15))
            size = len(key[c])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 8 * size + 1, 8, dtype=np.int32)), pa.array(mixed[8 * first : 8 * (first + size)]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(near[c]), pa.array(np.full(size, NODE_END, np.int32)), pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.float64()),
                    pa.array(key[c]), pa.array(often[c]), lists,
                ],
                ["near", "prefix", "n0", "n1", "log_w", "key", "often", "mixed"],
            )


def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, often`` and log10 probability of sequences, from ``near, prefix, base, factor, less,
    key, often, mixed``: nodes of a context, then its sequences."""
    for table in whole(batches):
        is_node = table.column(1).to_numpy() < NODE_END
        nodes, rows = table.filter(pa.array(is_node)), table.filter(pa.array(~is_node))
        known = (nodes.column(0).to_numpy() << 8) | nodes.column(1).to_numpy()
        base, factor, less = (nodes.column(i).to_numpy() for i in (2, 3, 4))
        key = rows.column(5).to_numpy()
        prefix, bit = decisions(key & 255)
        at = np.searchsorted(known, (rows.column(0).to_numpy() << 8)[:, None] | prefix)
        mixed = rows.column(7).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, 8)
        one = np.where(np.isnan(mixed), less[at], base[at] + factor[at] * mixed)
        value = np.log10(np.where(bit == 1, one, 1 - one)).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(key), rows.column(6).combine_chunks(), pa.array(value)], ["key", "often", "value"])


def sequence_values(sequences: DataFrame) -> DataFrame:
    """``key, often, value`` of ``sequences(key, n, often)``: the log10 probability of the last byte."""
    dealt = sequences.select(F.shiftright("key", 8).bitwiseAND((1 << (8 * NEAR)) - 1).alias("near"), "key", "n", "often")
    made = stored(dealt.repartition("near").sortWithinPartitions("near").mapInArrow(subtrees, SUBTREES), "ctw-subtrees")
    deep = made.filter(F.col("prefix") < NODE_END).select(F.col("near").alias("context"), "prefix", "n0", "n1", "log_w")
    levels, level, seen = [], deep, F.col("n0") + F.col("n1") > 0
    for depth in range(NEAR - 1, -1, -1):
        cut = F.col("context").bitwiseAND((1 << (8 * depth)) - 1)
        level = level.groupBy(cut.alias("parent"), "prefix").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("log_w").alias("below"))
        level = level.withColumn("own", estimate(F.col("n0"), F.col("n1")) + HALF).withColumn("other", F.col("below") + HALF)
        top = F.greatest("own", "other")
        level = level.withColumn("log_w", F.when(seen, top + F.log(F.exp(F.col("own") - top) + F.exp(F.col("other") - top))).otherwise(0.0))
        level = level.withColumn("stop", F.exp(F.col("own") - F.col("log_w")))
        level = stored(level.select(F.col("parent").alias("context"), "prefix", "n0", "n1", "stop", "log_w"), f"ctw-{depth}")
        levels.append(level)
    # Downwards: a child's mixture is ``base + factor * its own``; without a count it is ``less``.
    one = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)
    above = None
    for depth in range(NEAR):
        level = levels.pop()
        if above is None:
            level = level.withColumn("base", F.lit(0.0)).withColumn("factor", F.lit(1.0)).withColumn("less", F.lit(0.5))
        else:
            same = (level["context"].bitwiseAND((1 << (8 * depth - 8)) - 1) == above["up"]) & (level["prefix"] == above["of"])
            level = level.join(above, same)
        above = level.select(
            F.col("context").alias("up"), F.col("prefix").alias("of"), (F.col("base") + F.col("factor") * F.col("stop") * one).alias("base"),
            (F.col("factor") * (1 - F.col("stop"))).alias("factor"), F.when(seen, F.col("base") + F.col("factor") * one).otherwise(F.col("less")).alias("less"),
        )
    same = (deep["context"].bitwiseAND((1 << (8 * NEAR - 8)) - 1) == above["up"]) & (deep["prefix"] == above["of"])
    nodes = deep.join(above, same).select(F.col("context").alias("near"), "prefix", "base", "factor", "less")
    rows = nodes.unionByName(made.filter(F.col("prefix") == NODE_END).select("near", "prefix", "key", "often", "mixed"), allowMissingColumns=True)
    rows = rows.repartition("near").sortWithinPartitions("near", "prefix")
    return stored(rows.mapInArrow(values, "key bigint, often bigint, value double"), "ctw-values")


class Frequent:
    """The values of the most frequent sequences, the same places tried first for all."""

    def __init__(self, keys: np.ndarray, often: np.ndarray, value: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], value[order]
        self.first = np.zeros(1 << CACHE, np.int32)
        rise = np.argsort(often[order], kind="stable")
        self.first[self.place(self.keys[rise])] = rise  # of several for a place the most frequent

    @staticmethod
    def place(keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * MIX) >> np.uint64(64 - CACHE)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, zero where there are none, and where there are."""
        if not len(self.keys):
            return np.zeros(len(keys)), np.zeros(len(keys), bool)
        at = self.first[self.place(keys)]
        miss = np.flatnonzero(self.keys[at] != keys)
        new, which = np.unique(keys[miss], return_inverse=True)
        at[miss] = np.minimum(np.searchsorted(self.keys, new), len(self.keys) - 1)[which]
        found = self.keys[at] == keys
        return np.where(found, self.values[at], 0.0), found


def most_frequent(table: DataFrame) -> tuple[Frequent, DataFrame]:
    """At most ``2**(FREQUENT + 2)`` sequences, and the others."""
    rank = F.floor(4 * F.log2("often"))
    left, least = 1 << (FREQUENT + 2), 1 << 10
    for r in sorted(table.groupBy(rank.alias("rank")).count().collect(), reverse=True):  # 256 at most
        left -= r["count"]
        if left < 0:
            break
        least = r["rank"]
    taken = table.filter(rank >= least).toArrow()
    return Frequent(*(taken[c].to_numpy() for c in ("key", "often", "value"))), table.filter(rank < least).select("key", "value")


def slot(depth: int | np.ndarray, context: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of a node in the table, and a byte of its hash that tells it from others there."""
    key = (context * np.uint64(8) + np.uint64(depth) if np.isscalar(depth) else context * np.uint64(8) + depth.astype(np.uint64)) * MIX
    key ^= key >> np.uint64(32)
    key = (key + prefix.astype(np.uint64)) * MIX
    key ^= key >> np.uint64(29)
    key *= MIX
    return (key >> np.uint64(64 - SLOTS)).astype(np.int64), (key >> np.uint64(56 - SLOTS)).astype(np.uint8)


class Scorer:
    """Log10 probability of the last byte of sequences from a table of ``2**SLOTS`` places, with a
    cache of fixed size. ``score`` does not use it: nodes that share a place are lost there."""

    def __init__(self, one: np.ndarray, stop: np.ndarray, tag: np.ndarray):
        self.one, self.stop, self.tag = one, stop, tag
        self.keys, self.values = np.full(1 << CACHE, ~np.uint64(0)), np.zeros(1 << CACHE)

    def predict(self, sequences: np.ndarray) -> np.ndarray:
        context, byte = sequences >> np.uint64(8), (sequences & np.uint64(255)).astype(np.int64)
        at_depth = [context & np.uint64((1 << (8 * d)) - 1) for d in range(DEPTH + 1)]
        out = np.zeros(len(sequences))
        for k in range(8):
            prefix, bit = (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1
            p = None
            for d in range(DEPTH, -1, -1):
                at, tag = slot(d, at_depth[d], prefix)
                odds = self.one[at].astype(float)
                seen = (odds == odds) & (self.tag[at] == tag)
                one = 1 / (1 + np.exp(-odds))
                if p is None:
                    p = one
                else:
                    share = self.stop[at].astype(float)
                    p = np.where(below & seen, share * one + (1 - share) * p, one)
                below = seen
            p = np.where(below, p, 0.5)
            out += np.log10(np.where(bit == 1, p, 1 - p))
        return out

    def __call__(self, sequences: np.ndarray) -> np.ndarray:
        place = ((sequences * MIX) >> np.uint64(64 - CACHE)).astype(np.int64)
        out = self.values[place]
        miss = np.flatnonzero(self.keys[place] != sequences)
        if len(miss):
            new, which = np.unique(sequences[miss], return_inverse=True)
            value = np.concatenate([self.predict(new[i : i + (1 << 17)]) for i in range(0, len(new), 1 << 17)])
            out[miss] = value[which]
            to = ((new * MIX) >> np.uint64(64 - CACHE)).astype(np.int64)
            # Of several for a place the last is kept, key and value alike.
            _, last = np.unique(to[::-1], return_index=True)
            last = len(to) - 1 - last
            self.keys[to[last]], self.values[to[last]] = new[last], value[last]
        return out


SCORED = "struct<n_tokens:bigint,n_bytes:bigint,score:double,base:double,known:bigint,rare:array<bigint>,sought:array<struct<key:bigint,n:bigint>>>"


def score(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``,
    one row per row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc).alias("doc_id"), held_out(doc).alias("held_out"), F.col(text).alias("t"))
    train = rows.filter(~F.col("held_out"))
    counts = rows.select("t", "held_out").mapInArrow(count, "kind int, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counts = stored(counts, "ctw-counts")
    ends = train.count()
    words = counts.filter(F.col("kind") == WORD)
    n_words, n_kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, kinds = n_words + ends, n_kinds + (ends > 0)
    trained = F.sum(F.when(F.col("kind") == GRAM, F.col("n")).otherwise(0)).alias("n")
    sequences = counts.filter(F.col("kind") != WORD).groupBy("key").agg(trained, F.sum("n").alias("often"))
    usual, unusual = most_frequent(sequence_values(sequences))
    is_frequent = F.col("n") * (1 << FREQUENT) > total  # fewer than 2**FREQUENT words are
    frequent = words.filter(is_frequent).select("key", "n").toArrow()
    keys, n = frequent["key"].to_numpy(), frequent["n"].to_numpy()
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((usual, keys[order], n[order]))  # of bounded size

    @F.arrow_udf(SCORED)
    def run(texts: pa.Array) -> pa.Array:
        usual, known, often = shared.value
        size = len(texts)
        scores, n_bytes = np.zeros(size), np.zeros(size, np.int64)
        tokens, base, seen = np.ones(size, np.int64), np.zeros(size), np.zeros(size, np.int64)
        sought_of, sought, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at, group in groups(texts.to_pylist()):
            sequences, begin = grams(group)
            sequences = sequences.view(np.int64)
            value, found = usual(sequences)
            scores[at : at + len(group)] = np.add.reduceat(value, begin)
            n_bytes[at : at + len(group)] = [len(t) for t in group]
            left = np.flatnonzero(~found)
            own = np.searchsorted(begin, left, "right") - 1
            order = np.lexsort((sequences[left], own))
            own, left = own[order], sequences[left][order]
            new = np.flatnonzero(np.append(True, (np.diff(own) != 0) | (np.diff(left) != 0))[: len(own)])
            sought_of.append(at + own[new])
            sought.append(left[new])
            times.append(np.diff(np.append(new, len(own))))
        rare_of, rare = [], []
        for at, _, words in slices(texts, NOT_SPACE):
            hashes, own = words.hash.view(np.int64), at + words.text
            np.add.at(tokens, own, 1)
            place = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
            hit = known[place] == hashes if len(known) else np.zeros(len(hashes), bool)
            np.add.at(base, own[hit], np.log10(often[place[hit]] + 1.0) if len(known) else 0.0)
            np.add.at(seen, own[hit], 1)
            rare_of.append(own[~hit])
            rare.append(hashes[~hit])
        own = np.concatenate([np.zeros(0, np.int64), *rare_of])
        ends = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=size))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *rare])))
        ends = np.concatenate([[0], np.cumsum(np.bincount(np.concatenate(sought_of), minlength=size))]).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(sought)), pa.array(np.concatenate(times))], ["key", "n"])
        return pa.StructArray.from_arrays(
            [pa.array(tokens), pa.array(n_bytes), pa.array(scores), pa.array(base), pa.array(seen), lists, pa.ListArray.from_arrays(pa.array(ends), pairs)],
            ["n_tokens", "n_bytes", "score", "base", "known", "rare", "sought"],
        )

    done = rows.select("doc_id", "held_out", run("t").alias("r")).select("doc_id", "held_out", "r.*")
    done = stored(done.withColumn("uid", F.monotonically_increasing_id()), "ctw-scored")
    asked = done.select("uid", F.explode("rare").alias("word"))
    found = asked.join(words.filter(~is_frequent).select("key", "n"), F.col("word") == F.col("key"))
    found = found.groupBy(F.col("uid").alias("row")).agg(F.sum(F.log10(F.col("n") + 1.0)).alias("more"), F.count(F.lit(1)).alias("also"))
    asked = done.select("uid", F.explode("sought").alias("s")).select("uid", F.col("s.key").alias("sequence"), "s.n")
    scored = asked.join(unusual, F.col("sequence") == F.col("key")).groupBy(F.col("uid").alias("of")).agg(F.sum(F.col("n") * F.col("value")).alias("rest"))
    out = done.drop("rare", "sought").join(found, F.col("uid") == F.col("row"), "left").join(scored, F.col("uid") == F.col("of"), "left")
    out = out.na.fill(0, ["more", "also", "rest"]).withColumn("score", F.col("score") + F.col("rest"))
    end_known, end_base = int(ends > 0), float(np.log10(ends + 1.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.col("also") + end_known).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("more") + end_base - F.col("n_tokens") * float(np.log10(total + kinds + 1.0))).alias("base_score"), "score",
        (-F.col("score") * float(np.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
