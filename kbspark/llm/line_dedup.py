r"""Line dedup by a deletion-neighbourhood join.

A ``\n``-split line is its words (by white space, A-Z lowered). It goes if the same words are an
earlier line, or, having ``MIN_WORDS`` words or more, if one word put in, taken out or exchanged
makes it an earlier line. Lines are in the order of document id, then line number.

1. One pass hashes the lines; equal lines become one, with the place of the first.
2. Two lines one edit apart agree on their first or last half (rounded down, of the longer one's
   words less one). Lines none of whose halves another line has are left out; the others are
   marked in a bitmap of fixed size, and their words fetched by a second pass.
3. Each emits its deletion variants as hashed keys, for gaps outside of a half that another line has
   too: with the place of the gap, equal variants are lines one exchange apart; without, they are equal
   to a line one word shorter. Of every group
   of equal variants only the earliest line is kept, so no pairs are made however large it is,
   and every other line of the group is paired with that one.
4. Pairs are verified word by word before a line is dropped.

Defined results: a null text stays null, an empty one empty; lines without a word always stay;
a null id sorts last; rows with equal id and text are treated alike, and lines at the same place
of rows with one id do not drop each other; a document whose lines all go has an empty text;
an empty table gives an empty result. Other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.byte_words import BASE, NOT_SPACE, STEP, Words, powers, slices
from kbspark.session import drop_work, stored, work_mark

MIN_WORDS = 10
BITMAP = 26
SECOND = 0xD6E8FEB86659FD93
LAST = (1 << 63) - 1


class Lines:
    """Lines with a word of some texts, and hashes of any run of their words."""

    def __init__(self, words: Words):
        self.words, n = words, len(words.hash)
        breaks = np.concatenate([[0], np.cumsum(words.low == 10)])
        number = breaks[words.start]
        new = np.flatnonzero(np.append(n > 0, (np.diff(number) != 0) | (np.diff(words.text) != 0))) if n else np.zeros(0, np.int64)
        self.first, self.last = new, np.append(new[1:], n)[: len(new)]
        self.text = words.text[new]
        self.number = number[new] - breaks[words.first[self.text]]
        self.size = self.last - self.first
        self.sums, self.inverse = [], []
        for base in (STEP, SECOND):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(words.hash * powers(base, n), out=total[1:])
            self.sums.append(total)
            self.inverse.append(powers(pow(base, -1, 1 << 64), n + 1))

    def run(self, first: np.ndarray, last: np.ndarray, which: int = 0) -> np.ndarray:
        total, inverse = self.sums[which], self.inverse[which]
        return (total[last] - total[first]) * inverse[first]


def mixed(*parts) -> np.ndarray:
    """One hash of several numbers."""
    out = np.zeros(1, np.uint64)
    for p in parts:
        out = (out ^ np.asarray(p).astype(np.uint64)) * np.uint64(BASE)
        out = out ^ (out >> np.uint64(32))
    return out


def half_keys(lines: Lines, own: np.ndarray) -> np.ndarray:
    """Four keys for each of the lines ``own``: both halves, as the longer or the shorter line."""
    first, last, size = lines.first[own], lines.last[own], lines.size[own]
    keys = []
    for length in (size, size + 1):
        half = (length - 1) // 2
        keys += [mixed(1, length, lines.run(first, first + half)), mixed(2, length, lines.run(last - half, last))]
    return np.stack(keys, axis=1)


LINE = "line:int,n_words:int,h1:bigint,h2:bigint,halves:array<bigint>"
VARIANTS = "id bigint, kind int, variant bigint, other bigint"


def hash_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash`` and one row per line with a word."""

    @F.arrow_udf(f"array<struct<{LINE}>>")
    def run(texts: pa.Array) -> pa.Array:
        parts, counts = [], np.zeros(len(texts), np.int64)
        for a, _, words in slices(texts, NOT_SPACE):
            lines = Lines(words)
            if not len(lines.first):
                continue
            np.add.at(counts, a + lines.text, 1)
            long = lines.size >= MIN_WORDS
            halves = np.where(long, 4, 0)
            keys = half_keys(lines, np.flatnonzero(long)).ravel()
            ends = np.concatenate([[0], np.cumsum(halves)]).astype(np.int32)
            parts.append(
                pa.StructArray.from_arrays(
                    [
                        pa.array(lines.number.astype(np.int32)), pa.array(lines.size.astype(np.int32)),
                        pa.array(mixed(lines.size, lines.run(lines.first, lines.last)).view(np.int64)),
                        pa.array(mixed(lines.size, lines.run(lines.first, lines.last, 1)).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.view(np.int64))),
                    ],
                    ["line", "n_words", "h1", "h2", "halves"],
                )
            )
        ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        kind = pa.struct([("line", pa.int32()), ("n_words", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("halves", pa.list_(pa.int64()))])
        return pa.ListArray.from_arrays(ends, pa.concat_arrays(parts) if parts else pa.array([], kind))

    # Called nondeterministic, or Spark has texts without a line filtered out by a run of its own, in further workers.
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), run.asNondeterministic()("text").alias("lines"))
    return hashed.select("doc_id", "text_hash", F.explode("lines").alias("l")).select("doc_id", "text_hash", "l.*")


def fetch_lines(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """``h1, h2, words`` of the long lines that the bitmap marks."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for _, _, words in slices(batch.column(0), NOT_SPACE):
                lines = Lines(words)
                h1 = mixed(lines.size, lines.run(lines.first, lines.last))
                h2 = mixed(lines.size, lines.run(lines.first, lines.last, 1))
                bit = h1 >> np.uint64(64 - BITMAP)
                marked = (bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1
                own = np.flatnonzero((marked == 1) & (lines.size >= MIN_WORDS))
                found = [words.string(f, e) for f, e in zip(lines.first[own].tolist(), lines.last[own].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(h1[own].view(np.int64)), pa.array(h2[own].view(np.int64)), pa.array(found, pa.string())], ["h1", "h2", "words"])

    return docs.select("text").mapInArrow(run, "h1 bigint, h2 bigint, words string")


EXCHANGED, LONGER, SHORTER = 0, 1, 2


def variants(lines: DataFrame) -> DataFrame:
    """Hashed variants of ``lines(id, shared, words)``: kind, and a key in two parts.

    The bits of ``shared`` say which of a line's four half keys another line has too. Lines one edit apart
    agree on the half that the gap is not in, so only gaps outside of a shared half make a variant.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bits = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for a, _, words in slices(batch.column(2), NOT_SPACE):
                lines = Lines(words)
                held = bits[a + lines.text]
                own = np.repeat(np.arange(len(lines.first)), lines.size)
                gap = np.arange(len(own))
                # Bits 0 and 1: the first and the last half of a line of this length.
                behind = gap - lines.first[own] >= ((lines.size - 1) // 2)[own]
                made = np.where(behind, held[own] & 1, held[own] & 2) > 0
                own, gap = own[made], gap[made]
                first, last, size = lines.first[own], lines.last[own], lines.size[own]
                rest = []
                for k, base in ((0, STEP), (1, SECOND)):
                    # The words after the gap move up by one place.
                    shift = powers(base, int(size.max(initial=0)) + 1)[gap - first]
                    rest.append(lines.run(first, gap, k) + lines.run(gap + 1, last, k) * shift)
                # Bits 2 and 3: the halves as those of a line one word longer.
                whole = np.flatnonzero(held & 12)
                short = [lines.run(lines.first[whole], lines.last[whole], k) for k in (0, 1)]
                rows = [
                    (own, EXCHANGED, mixed(size, gap - first, rest[0]), mixed(size, gap - first, rest[1])),
                    (own, LONGER, mixed(size - 1, rest[0]), mixed(size - 1, rest[1])),
                    (whole, SHORTER, mixed(lines.size[whole], short[0]), mixed(lines.size[whole], short[1])),
                ]
                for of, kind, one, two in rows:
                    at = a + lines.text[of]
                    for cut in range(0, len(at), 1 << 15):
                        c = slice(cut, cut + (1 << 15))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[at[c]]), pa.array(np.full(len(at[c]), kind, np.int32)), pa.array(one[c].view(np.int64)), pa.array(two[c].view(np.int64))],
                            ["id", "kind", "variant", "other"],
                        )

    return lines.mapInArrow(run, VARIANTS)


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether at most one word put in, taken out or exchanged makes ``a`` to ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


def near_lines(docs: DataFrame, first: DataFrame) -> DataFrame:
    """``h1, h2`` of the distinct lines that are one edit from an earlier line."""
    since = work_mark()
    halves = first.select("h1", "h2", F.posexplode("halves").alias("i", "half"))
    both = halves.groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b").select(F.col("half").alias("k"))
    held = halves.join(both, F.col("half") == F.col("k"), "left_semi").groupBy(F.col("h1").alias("m1"), F.col("h2").alias("m2"))
    held = stored(held.agg(F.bit_or(F.expr("shiftleft(1, i)")).alias("shared")), "lines-shared")
    bits = held.select(F.shiftrightunsigned("m1", 64 - BITMAP).alias("b")).selectExpr("shiftright(b, 6) as at", "shiftleft(1L, cast(b & 63 as int)) as bits")
    bitmap = np.zeros(1 << (BITMAP - 6), np.int64)
    for r in bits.groupBy("at").agg(F.bit_or("bits").alias("bits")).toLocalIterator():  # at most 2**BITMAP bits
        bitmap[r["at"]] = r["bits"]
    text = fetch_lines(docs, bitmap.view(np.uint8)).groupBy("h1", "h2").agg(F.min("words").alias("words"))
    place = first.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), "place")
    lines = text.join(held, (F.col("h1") == F.col("m1")) & (F.col("h2") == F.col("m2"))).join(place, (F.col("h1") == F.col("p1")) & (F.col("h2") == F.col("p2")))
    lines = stored(lines.select("h1", "h2", "shared", "words", "place"), "lines-text")  # sorted by samples, so read twice
    # Numbers in the order of places: one number stands for a line and tells which is earlier.
    ordered = lines.repartitionByRange("place", "h1").sortWithinPartitions("place", "h1")
    lines = stored(ordered.withColumn("id", F.monotonically_increasing_id()), "lines-numbered")
    drop_work(docs.sparkSession, since, work_mark() - 1)
    made = variants(lines.select("id", "shared", "words"))
    group = made.groupBy((F.col("kind") != EXCHANGED).alias("moved"), "variant", "other").agg(
        F.min(F.when(F.col("kind") != SHORTER, F.col("id"))).alias("long"), F.min(F.when(F.col("kind") == SHORTER, F.col("id"))).alias("short"),
        F.min("id").alias("a"), F.max("id").alias("b"),
    )
    # A lone line pairs with nothing; of the others either the earliest long or the short one is the partner.
    group = stored(group.filter("a <> b and (not moved or (long is not null and short is not null))"), "lines-groups")
    group = group.select("moved", F.col("variant").alias("v"), F.col("other").alias("o"), "long", "short")
    met = made.join(group, ((F.col("kind") != EXCHANGED) == F.col("moved")) & (F.col("variant") == F.col("v")) & (F.col("other") == F.col("o")))
    partner = F.when(F.col("kind") == LONGER, F.col("short")).otherwise(F.col("long"))
    pairs = met.select("id", partner.alias("q")).filter("q < id").distinct()
    a = lines.select(F.col("id").alias("i"), "h1", "h2", F.col("place").alias("px"), F.col("words").alias("x"))
    b = lines.select(F.col("id").alias("j"), F.col("place").alias("py"), F.col("words").alias("y"))
    pairs = pairs.join(a, F.col("id") == F.col("i")).join(b, F.col("q") == F.col("j")).filter("py < px")

    @F.arrow_udf("boolean")
    def verified(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([within_one(p.split(" "), q.split(" ")) for p, q in zip(x.to_pylist(), y.to_pylist())], pa.bool_())

    return pairs.filter(verified("x", "y")).select(F.col("h1").alias("n1"), F.col("h2").alias("n2")).distinct()


def dedup_lines(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with ``text`` cut to the lines that stay, and ``n_lines_dropped``, ``n_lines_near``
    (of them, those one edit from an earlier line)."""
    docs = df.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    spark, since = df.sparkSession, work_mark()
    hashed = stored(hash_lines(docs), "lines-hashed")
    place = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "line")
    first = stored(hashed.groupBy("h1", "h2").agg(F.min(place).alias("place"), F.first("halves").alias("halves")), "lines-first")
    lines = stored(hashed.drop("n_words", "halves"), "lines")
    drop_work(spark, since, since + 1)  # hashed
    near = stored(near_lines(docs, first), "lines-near")
    drop_work(spark, since + 2, work_mark() - 1)  # all but first, lines and near
    known = first.select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), "place")
    known = known.join(near, (F.col("f1") == F.col("n1")) & (F.col("f2") == F.col("n2")), "left").select("f1", "f2", "place", F.col("n1").isNotNull().alias("near"))
    judged = lines.select("doc_id", "text_hash", "line", "h1", "h2").join(known, (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")))
    gone = judged.filter(F.col("near") | (F.col("place") != place)).select("doc_id", "text_hash", "line", (F.col("near") & (F.col("place") == place)).alias("near"))
    # One list per document, of its own line numbers.
    drops = gone.groupBy(F.col("doc_id").alias("_of_doc"), F.col("text_hash").alias("_of_text")).agg(F.collect_set("line").alias("_drop"), F.collect_set(F.when(F.col("near"), F.col("line"))).alias("_near"))
    # Columns are named by their table, whatever columns ``df`` has besides.
    rows = df.join(drops, df[doc].eqNullSafe(drops["_of_doc"]) & (F.xxhash64(df[text]) == drops["_of_text"]), "left")

    @F.arrow_udf("string")
    def cut(texts: pa.Array, dropped: pa.Array) -> pa.Array:
        out = []
        for t, numbers in zip(texts.to_pylist(), dropped.to_pylist()):
            if t is not None and numbers:
                gone = set(numbers)
                t = "\n".join([x for i, x in enumerate(t.split("\n")) if i not in gone])
            out.append(t)
        return pa.array(out, pa.string())

    count = {"n_lines_dropped": drops["_drop"], "n_lines_near": drops["_near"]}
    counts = [F.greatest(F.coalesce(F.size(v), F.lit(0)), F.lit(0)).cast("long").alias(k) for k, v in count.items()]
    once = cut.asNondeterministic()  # or a filter of the text has it cut twice
    kept = [once(df[c], drops["_drop"]).alias(c) if c == text else df[c] for c in df.columns if c not in count]
    return rows.select(*kept, *counts)
