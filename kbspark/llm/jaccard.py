"""N-gram Jaccard join by a size-aware heavy-light join.

A document is the set of its word shingles, as hashes; documents with equal sets are one set from
then on. Two sets link if they share at least ``PERCENT`` of their union, so a set of ``n`` shingles
lacks at most ``n - t`` of a partner's, ``t`` being ``PERCENT`` of ``n`` rounded up.

1. Necessary part. Of two linked sets the first ``n - t + c`` shingles by hash share ``c`` or more
   (``c`` is half of what may be lacking, two at least). Only this part of a set is filed at first;
   shingles no other set has are dropped, and then sets with fewer than ``c`` left, twice over. A second
   pass over the texts fetches the whole sets of those that are left, and the same is done with them: a set
   goes on if ``t`` of its shingles are in other sets too.
2. Heavy and light. What is left of a set is ordered by rarity. Sets up to a size are light: they file every
   pair of shingles among the first few, as linked sets agree on such a pair. Larger ones are heavy: they scan
   the inverted lists of their first few single shingles, in which light sets are listed too if they are large
   enough to link with a heavy one. Pairs of a set grow with the square of its size but meet few others; list
   entries grow with the size, and a list costs a step for each entry (see 3), not for each pair. So the
   size is the one up to which a set files ``PAIRS`` pairs at most, whatever the number of sets.
3. Groups of one key are not paired off. First each member meets one pivot, the member whose shingles are
   most common; sets linked by then have one label. Groups of one label are done. In the others only
   members of different labels meet, and these all do, but within the join parity sketches of the sets rule
   out pairs that are too far apart, so few are made. So a group of copies costs a step for each, and no
   link between two components is missed. All pairs are verified on the whole sets.

Defined results: null and empty texts and those of white space only have no shingles and are their
own component; shorter texts have one shingle, the whole sequence; repeated rows and equal sets are
one component; a null id names a component only if it has no other; an empty table gives an empty
result. Equal 64-bit hashes count as equal shingles. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm.byte_words import BASE, NOT_SPACE, STEP, slices
from kbspark.llm.components import components
from kbspark.session import drop_work, stored, work_mark

SIZE, PERCENT = 4, 85
BITMAP = 26  # bits of the table that marks the sets to fetch
MARKS = 6
SKETCH = 16
PAIRS = 10  # that a light set files


# --- bounds; for numbers, arrays and columns alike ------------------------------------------


def least_overlap(n, percent: int):
    """Shingles of a set of ``n`` that any linked set shares: ``percent`` of ``n``, rounded up."""
    return (n * percent + 99) // 100


def common(n, percent: int):
    """How many shingles of the parts filed two linked sets share, if ``n`` is the smaller's size."""
    return np.maximum(2, (n - least_overlap(n, percent)) // 2)


def part_size(n, percent: int):
    return np.minimum(n, n - least_overlap(n, percent) + common(n, percent))


def needed(n, percent: int):
    """Shingles of its part that a set shares with any set it links with."""
    return common(least_overlap(n, percent), percent)


def overlap_column(n: Column, percent: int) -> Column:
    return F.floor((n * percent + 99) / 100).cast("int")


def needed_column(n: Column, percent: int) -> Column:
    least = overlap_column(n, percent)
    return F.greatest(F.lit(2), F.floor((least - overlap_column(least, percent)) / 2)).cast("int")


def alike(n: Column, m: Column, percent: int) -> Column:
    """Whether sets of these sizes can link."""
    return (n * 100 >= m * percent) & (m * 100 >= n * percent)


# --- sets ----------------------------------------------------------------------------------


def remixed(x: np.ndarray, by: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(by)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(BASE)
    return x ^ (x >> np.uint64(31))


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For some texts at a time that have words: their numbers, where each one's shingles start and end, and the
    shingles, distinct and in ascending order; then two hashes of each set."""
    for a, b, words in slices(column, NOT_SPACE):
        count = np.bincount(words.text, minlength=b - a)
        first = np.cumsum(count) - count
        hashes, whole = words.shingles(size)
        at = np.flatnonzero(whole)
        own, found = words.text[at], hashes[at]
        for short in range(1, size):  # texts of fewer words are one shingle
            texts = np.flatnonzero(count == short)
            if len(texts):
                own = np.append(own, texts)
                found = np.append(found, remixed(words.shingles(short)[0][first[texts]] + np.uint64(short), STEP))
        if not len(own):
            continue
        order = np.lexsort((found, own))
        own, found = own[order], found[order]
        new = np.append(True, (np.diff(own) != 0) | (found[1:] != found[:-1]))
        own, found = own[new], found[new]
        start = np.flatnonzero(np.append(True, np.diff(own) != 0))
        sums = [np.add.reduceat(remixed(found, by), start) for by in (STEP, 0xD6E8FEB86659FD93)]
        yield a + own[start], start, np.append(start[1:], len(own)), found, np.stack(sums)


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.view(np.int64)))


def hashed_sets(df: DataFrame, doc: str, text: str, size: int, percent: int) -> DataFrame:
    """``doc_id, n, s1, s2, part`` of every document: the set's size, hashes, and the part to file."""

    @F.arrow_udf("struct<n:bigint,s1:bigint,s2:bigint,part:array<bigint>>")
    def run(texts: pa.Array) -> pa.Array:
        n, hashes, filed, kept = np.zeros(len(texts), np.int64), np.zeros((2, len(texts)), np.uint64), np.zeros(len(texts), np.int64), []
        for own, start, end, found, sums in shingle_sets(texts, size):
            n[own] = end - start
            hashes[:, own] = sums
            # A set so small that only its equals link with it files nothing.
            alone = n[own] * 100 // percent == n[own]
            filed[own] = np.where(alone, 0, part_size(n[own], percent))
            place = np.arange(len(found)) - np.repeat(start, end - start)
            kept.append(found[place < np.repeat(filed[own], end - start)])
        parts = lists(np.concatenate(kept) if kept else np.zeros(0, np.uint64), filed)
        return pa.StructArray.from_arrays([pa.array(n), pa.array(hashes[0].view(np.int64)), pa.array(hashes[1].view(np.int64)), parts], ["n", "s1", "s2", "part"])

    return df.select(df[doc].alias("doc_id"), run(df[text]).alias("s")).select("doc_id", "s.*")


def whole_sets(df: DataFrame, text: str, size: int, bitmap: np.ndarray) -> DataFrame:
    """``s1, s2, shingles`` of the sets that the bitmap marks, and few others."""
    shared = df.sparkSession.sparkContext.broadcast(bitmap)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for _, start, end, found, sums in shingle_sets(batch.column(0), size):
                bit = sums[0] >> np.uint64(64 - BITMAP)
                marked = (bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                values = found[np.repeat(marked, end - start)]
                columns = [pa.array(s[marked].view(np.int64)) for s in sums]
                yield pa.RecordBatch.from_arrays([*columns, lists(values, (end - start)[marked])], ["s1", "s2", "shingles"])

    return df.select(df[text]).mapInArrow(run, "s1 bigint, s2 bigint, shingles array<bigint>")


def bitmap_of(sets: DataFrame) -> np.ndarray:
    """A bit for every ``s1`` of ``sets``: at most 2**BITMAP bits come to the driver, 64 to a row."""
    rows = sets.select(F.shiftrightunsigned("s1", 64 - BITMAP).alias("b")).selectExpr("shiftright(b, 6) as at", "shiftleft(1L, cast(b & 63 as int)) as bits")
    out = np.zeros(1 << (BITMAP - 6), np.int64)
    for r in rows.groupBy("at").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        out[r["at"]] = r["bits"]
    return out.view(np.uint8)


# --- keys ----------------------------------------------------------------------------------


def shared(filed: DataFrame, sizes: DataFrame, enough: Column, each: Column) -> DataFrame:
    """``id, n, all``: what is left of ``filed(id, shingle)`` when shingles of one set only are dropped, and then sets with
    fewer than ``enough`` of them. ``all`` holds ``each`` of a set's shingles, made of ``shingle`` and ``held_by``, the number
    of sets that have it. ``sizes(id, n)`` tells the size of each set."""
    held = filed.groupBy(F.col("shingle").alias("s")).agg(F.count(F.lit(1)).alias("held_by")).filter("held_by > 1")
    left = filed.join(held, F.col("shingle") == F.col("s")).groupBy("id").agg(F.collect_list(each).alias("all"))
    left = left.join(sizes.select(F.col("id").alias("i"), "n"), F.col("id") == F.col("i")).drop("i")
    return left.filter(F.size("all") >= enough)


def shared_twice(filed: DataFrame, sizes: DataFrame, enough: Column) -> DataFrame:
    """The same twice over, as the sets left out leave more shingles with one set only; each with ``held_by``."""
    once = stored(shared(filed, sizes, enough, F.col("shingle")), "jaccard-shared")
    return shared(once.select("id", F.explode("all").alias("shingle")), sizes, enough, F.struct("held_by", "shingle"))


def by_rarity(left: DataFrame, percent: int) -> DataFrame:
    """``id, n, q, first, fame``: for each set of ``left(id, n, all)`` the first ``q + 1`` shared shingles, rarest first; linked
    sets have one of the first ``q`` and two of the first ``q + 1`` in common. ``fame`` is how many sets have its shingles, on
    average."""
    rated = left.withColumn("all", F.sort_array("all"))
    q = F.size("all") - overlap_column(F.col("n"), percent) + 1
    fame = F.aggregate("all", F.lit(0.0), lambda total, s: total + s["held_by"]) / F.col("n")
    return rated.withColumn("q", q).filter("q > 0").select("id", "n", "q", F.slice("all", F.lit(1), F.col("q") + 1).alias("first"), fame.alias("fame"))


def cheapest_bound(rated: DataFrame, percent: int) -> int:
    """The size up to which sets are light: none of them files more than ``PAIRS`` pairs, however many sets there are."""
    many = F.col("q").cast("long") * (F.col("q") + 1) / 2 > PAIRS
    least, most = rated.agg(F.min(F.when(many, F.col("n"))), F.max("n")).first()
    return (most or 0) if least is None else least - 1


def members(rated: DataFrame, bound: int, percent: int) -> DataFrame:
    """``key, listed, id, n, heavy, fame``: the groups that sets are filed in. In a list (``listed``) only pairs with a
    heavy set count."""
    heavy = F.col("n") > bound

    @F.arrow_udf("array<bigint>")
    def pairs(firsts: pa.Array) -> pa.Array:
        out = []
        for values in firsts:
            x = values.values.to_numpy(zero_copy_only=False).view(np.uint64)
            i, j = np.triu_indices(len(x), 1)
            low, high = np.minimum(x[i], x[j]), np.maximum(x[i], x[j])
            out.append(remixed(remixed(low, STEP) + high, BASE).view(np.int64))
        return lists(np.concatenate(out) if out else np.zeros(0, np.int64), np.array([len(x) for x in out], np.int64))

    light = rated.filter(~heavy).select(F.explode(pairs(F.transform("first", lambda s: s["shingle"]))).alias("key"), F.lit(False).alias("listed"), "id", "n", F.lit(False).alias("heavy"), "fame")
    listed = rated.filter(F.col("n") * 100 >= percent * (bound + 1))
    entry = F.explode(F.transform(F.slice("first", F.lit(1), F.col("q")), lambda s: s["shingle"]))
    return light.unionByName(listed.select(entry.alias("key"), F.lit(True).alias("listed"), "id", "n", heavy.alias("heavy"), "fame"))


# --- pairs ---------------------------------------------------------------------------------


def sketches(whole: DataFrame) -> DataFrame:
    """``of`` and ``SKETCH`` columns of 64 parity bits: each shingle of a set changes one of them, so two sets differ in at
    least as many shingles as their sketches in bits."""

    @F.arrow_udf("array<bigint>")
    def run(sets: pa.Array) -> pa.Array:
        out = np.zeros((len(sets), SKETCH), np.int64)
        for i, s in enumerate(sets):
            at = remixed(s.values.to_numpy(zero_copy_only=False).view(np.uint64), STEP) % np.uint64(64 * SKETCH)
            out[i] = np.packbits((np.bincount(at.astype(np.int64), minlength=64 * SKETCH) & 1).astype(bool), bitorder="little").view(np.int64)
        return lists(out.ravel(), np.full(len(sets), SKETCH))

    made = whole.select(F.col("id").alias("of"), run("shingles").alias("s"))
    return made.select("of", *[F.col("s")[i].alias(f"s{i}") for i in range(SKETCH)])


def verified(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """The pairs ``u, v`` that link, by the sets in ``whole(id, shingles)``."""

    @F.arrow_udf("boolean")
    def link(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(x, y):
            a, b = (s.values.to_numpy(zero_copy_only=False) for s in (a, b))
            both = np.concatenate([a, b])
            both.sort(kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            out.append(100 * shared >= percent * (len(both) - shared))
        return pa.array(out, pa.bool_())

    a = whole.select(F.col("id").alias("i"), F.col("shingles").alias("x"))
    b = whole.select(F.col("id").alias("j"), F.col("shingles").alias("y"))
    met = pairs.join(a, F.col("u") == F.col("i")).drop("i").join(b, F.col("v") == F.col("j"))
    return met.filter(link("x", "y")).select("u", "v")


def to_pivots(groups: DataFrame, percent: int) -> DataFrame:
    """``u, v``: each member of a group with the group's pivot, the one of most fame, as others are likely made from it; a
    heavy set if there is one."""
    pivot = groups.groupBy(F.col("key").alias("k"), F.col("listed").alias("l")).agg(F.max(F.struct("heavy", "fame", "id", "n")).alias("p"))
    met = groups.join(pivot, (F.col("key") == F.col("k")) & (F.col("listed") == F.col("l")))
    met = met.filter((F.col("id") != F.col("p.id")) & alike(F.col("n"), F.col("p.n"), percent) & (~F.col("listed") | F.col("heavy") | F.col("p.heavy")))
    return met.select(F.greatest("id", "p.id").alias("u"), F.least("id", "p.id").alias("v")).distinct()


def with_labels(groups: DataFrame, links: DataFrame) -> DataFrame:
    """The groups of more than one label, with ``label``: the component of each member so far."""
    of = components(links).select(F.col("node").alias("of"), "root")
    named = groups.join(of, F.col("id") == F.col("of"), "left").select("key", "listed", "id", "n", "heavy", F.coalesce("root", "id").alias("label"))
    named = stored(named, "jaccard-labels")
    mixed = named.groupBy(F.col("key").alias("k"), F.col("listed").alias("l")).agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").select("k", "l")
    return named.join(mixed, (F.col("key") == F.col("k")) & (F.col("listed") == F.col("l")), "left_semi")


def across_labels(groups: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """``u, v``: all pairs of members of one group that have different labels and may link, by their sizes and sketches.

    In each group the members outside its most frequent label meet all others, so the members of that label do
    not meet each other. A pair is in many groups; each member names ``MARKS`` of its keys, the least ones by
    as many hashes, and a pair that agrees on one of them is made there only.
    """
    marks = [f"m{i}" for i in range(MARKS)]
    named = groups.groupBy(F.col("id").alias("by"), F.col("listed").alias("in")).agg(*[F.min_by("key", F.xxhash64("key", F.lit(i))).alias(m) for i, m in enumerate(marks)])
    cell = groups.groupBy("key", "listed", "label").agg(F.count(F.lit(1)).alias("c"))
    most = cell.groupBy(F.col("key").alias("k"), F.col("listed").alias("l")).agg(F.max_by("label", F.struct("c", "label")).alias("most"))
    named = named.join(sketches, F.col("by") == F.col("of")).drop("of")
    met = groups.join(named, (F.col("id") == F.col("by")) & (F.col("listed") == F.col("in"))).drop("by", "in", "fame")
    met = met.join(most, (F.col("key") == F.col("k")) & (F.col("listed") == F.col("l"))).drop("k", "l")
    met = stored(met.withColumn("few", F.col("label") != F.col("most")).drop("most"), "jaccard-cells")
    a, b = met.filter("few").alias("a"), met.alias("b")
    cond = (F.col("a.key") == F.col("b.key")) & (F.col("a.listed") == F.col("b.listed")) & (F.col("a.label") != F.col("b.label"))
    cond = cond & (~F.col("b.few") | (F.col("a.id") < F.col("b.id"))) & (~F.col("a.listed") | F.col("a.heavy") | F.col("b.heavy"))
    here = F.when(F.col(f"a.{marks[0]}") == F.col(f"b.{marks[0]}"), F.col("a.key") == F.col(f"a.{marks[0]}"))
    for m in marks[1:]:
        here = here.when(F.col(f"a.{m}") == F.col(f"b.{m}"), F.col("a.key") == F.col(f"a.{m}"))
    apart = sum((F.bit_count(F.col(f"a.s{i}").bitwiseXOR(F.col(f"b.s{i}"))) for i in range(1, SKETCH)), F.bit_count(F.col("a.s0").bitwiseXOR(F.col("b.s0"))))
    near = apart * (100 + percent) <= (F.col("a.n") + F.col("b.n")) * (100 - percent)
    pairs = a.join(b, cond & alike(F.col("a.n"), F.col("b.n"), percent) & here.otherwise(True) & near)
    return pairs.select(F.greatest("a.id", "b.id").alias("u"), F.least("a.id", "b.id").alias("v")).distinct()


def may_link(sets: DataFrame, percent: int) -> DataFrame:
    """``id, n, s1, s2`` of those of ``sets(id, n, s1, s2, part)`` whose part does not rule out a link."""
    since = work_mark()
    parts = sets.select("id", F.explode("part").alias("shingle"))
    left = shared_twice(parts, sets, needed_column(F.col("n"), percent)).select(F.col("id").alias("i"))
    marked = stored(sets.select("id", "n", "s1", "s2").join(left, F.col("id") == F.col("i"), "left_semi"), "jaccard-marked")
    drop_work(sets.sparkSession, since, work_mark() - 1)
    return marked


def links_of(marked: DataFrame, docs: DataFrame, text: str, size: int, percent: int) -> DataFrame:
    """``u, v``: links that connect exactly the sets of ``marked(id, n, s1, s2)`` that a chain of links connects.
    Links of two sets that others connect may be missing."""
    spark, since = docs.sparkSession, work_mark()
    found = whole_sets(docs, text, size, bitmap_of(marked)).groupBy(F.col("s1").alias("h1"), F.col("s2").alias("h2")).agg(F.first("shingles").alias("shingles"))
    all_sets = stored(marked.join(found, (F.col("s1") == F.col("h1")) & (F.col("s2") == F.col("h2"))).select("id", "n", "shingles"), "jaccard-whole")
    left = shared_twice(all_sets.select("id", F.explode("shingles").alias("shingle")), all_sets, overlap_column(F.col("n"), percent))
    rated = stored(by_rarity(left, percent), "jaccard-rated")
    own = rated.select(F.col("id").alias("i"))
    whole = stored(all_sets.join(own, F.col("id") == F.col("i"), "left_semi"), "jaccard-left-whole")
    drop_work(spark, since, work_mark() - 2)
    groups = members(rated, cheapest_bound(rated, percent), percent)
    # Groups of one member, and lists without a heavy set, make no pairs.
    more = groups.groupBy(F.col("key").alias("k"), F.col("listed").alias("l")).agg(F.min("id").alias("a"), F.max("id").alias("b"), F.max("heavy").alias("h"))
    more = more.filter("a <> b and (h or not l)").select("k", "l")
    groups = stored(groups.join(more, (F.col("key") == F.col("k")) & (F.col("listed") == F.col("l")), "left_semi"), "jaccard-groups")
    links = stored(verified(to_pivots(groups, percent), whole, percent), "jaccard-links")
    mixed = stored(with_labels(groups, links), "jaccard-mixed")
    near = stored(across_labels(mixed, stored(sketches(whole), "jaccard-sketches"), percent), "jaccard-near")
    return links.union(verified(near, whole, percent))


def near_sets(df: DataFrame, doc: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id``, one row per row of ``df``; the component's name is the smallest id that a
    chain of links reaches."""
    spark, since = df.sparkSession, work_mark()
    hashed = stored(hashed_sets(df, doc, text, size, percent), "jaccard-hashed")
    filed = hashed.filter("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("part").alias("part"))
    filed = stored(filed.withColumn("id", F.monotonically_increasing_id()), "jaccard-filed")
    rows = stored(hashed.drop("part"), "jaccard-rows")
    sets = stored(filed.drop("part"), "jaccard-sets")
    drop_work(spark, since, since + 1)  # hashed
    marked = may_link(filed, percent)
    drop_work(spark, since, since + 1)  # filed
    groups = components(links_of(marked, df, text, size, percent))
    drop_work(spark, since + 2, work_mark() - 1)  # all but rows, sets and the last edges
    named = sets.select("id", "s1", "s2", "least").join(groups, F.col("id") == F.col("node"), "left").select("s1", "s2", "least", F.coalesce("root", "id").alias("root"))
    name = named.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("name"))
    named = named.join(name, F.col("root") == F.col("r")).select(F.col("s1").alias("h1"), F.col("s2").alias("h2"), "name")
    out = rows.select("doc_id", "n", "s1", "s2").join(named, (F.col("n") > 0) & (F.col("s1") == F.col("h1")) & (F.col("s2") == F.col("h2")), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("doc_id")).alias("component_id"))
