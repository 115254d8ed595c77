"""Substring search for whole tables of queries: one automaton over all of them, or equality joins on anchors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark.operators.tables import first_per_key
from kbspark.session import stored, work_path

GRAM_SIZES = (6, 3, 1)


def grams(text: Column, size: int) -> Column:
    """Distinct runs of ``size`` characters, found in one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), 1))


def whole_words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)[^\s\x1c-\x1f]+"), 0))


def inner_words(piece: Column) -> Column:
    """Words of a piece with white space on both sides: each is a whole word of any text
    that contains the piece."""
    return F.array_distinct(
        F.regexp_extract_all(piece, F.lit(r"(?U)(?<=[\s\x1c-\x1f])[^\s\x1c-\x1f]+(?=[\s\x1c-\x1f])"), 0)
    )


def like_regex(query: Column) -> Column:
    """A contains-pattern in which ``%`` and ``_`` of the query act as wildcards. They do not
    cross the character U+0001, which parts the fields of a text."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(query, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    wild = F.replace(F.replace(quoted, F.lit("%"), F.lit(r"\E[^\x01]*\Q")), F.lit("_"), F.lit(r"\E[^\x01]\Q"))
    return F.concat(F.lit("(?s)"), wild)


def text_matches(text: Column, query: Column) -> Column:
    """Whether a lowered text holds a lowered query, whose ``%`` and ``_`` are wildcards."""
    return F.when(query.rlike("[%_]"), F.call_function("rlike", text, like_regex(query))).otherwise(F.contains(text, query))


def _choose(candidates: DataFrame, query_id: str) -> DataFrame:
    """One anchor per query: the one fewest queries share, then the longest."""
    shared = candidates.groupBy("_anchor").agg(F.count(F.lit(1)).alias("_shared"))
    ranked = candidates.join(shared, "_anchor")
    best = first_per_key(ranked, [query_id], F.col("_shared"), F.length("_anchor").desc(), F.col("_anchor"))
    return best.drop("_shared")


# Up to this many distinct query texts, and characters in them, every task searches for all of them at once.
MAX_PATTERNS = 30_000
MAX_PATTERN_CHARS = 32_000_000
MAX_BROADCAST_ANCHORS = 200_000
MAX_BROADCAST_CHARS = 32_000_000
KEY_CHARS = 32  # of a pattern that are searched for; the rest is tested where these are found
SHORT = 3  # patterns this short are everywhere, and looked up one by one


class Patterns:
    """Many query texts, searched for in one pass over each text."""

    def __init__(self, queries: list[str], wildcards: bool):
        self.queries, self.regex = queries, {}
        self.loose: list[int] = []
        by_key: dict[str, list[int]] = {}
        for number, query in enumerate(queries):
            key = query
            if wildcards and re.search("[%_]", query):
                parts = re.split("([%_])", query)
                wild = {"%": "[^\x01]*", "_": "[^\x01]"}
                self.regex[number] = re.compile("".join(wild.get(p) or re.escape(p) for p in parts), re.DOTALL)
                key = max(parts, key=lambda p: (p not in wild, len(p)))
                key = "" if key in wild else key
            if len(key) <= SHORT:
                self.loose.append(number)
            else:
                by_key.setdefault(key[:KEY_CHARS], []).append(number)
        self.machine = ahocorasick.Automaton()
        for key, numbers in by_key.items():
            self.machine.add_word(key, numbers)
        if by_key:
            self.machine.make_automaton()
        self.any_key = bool(by_key)

    def held(self, number: int, text: str) -> bool:
        regex = self.regex.get(number)
        return self.queries[number] in text if regex is None else regex.search(text) is not None

    def found(self, text: str) -> list[int]:
        """Numbers of the queries that the lowered text holds."""
        seen = {tuple(numbers) for _, numbers in self.machine.iter(text)} if self.any_key else ()
        return [n for numbers in (*seen, self.loose) for n in numbers if self.held(n, text)]


def holds(texts: DataFrame, queries: list[str], wildcards: bool) -> DataFrame:
    """The rows of ``texts`` once for each query that ``_text`` holds, with its number ``_no`` in place of it."""
    shared = texts.sparkSession.sparkContext.broadcast(queries)  # of checked size
    names = [c for c in texts.columns if c != "_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = Patterns(shared.value, wildcards)
        for batch in batches:
            rows, numbers = [], []
            for i, text in enumerate(batch.column("_text").to_pylist()):
                found = patterns.found(text) if text is not None else []
                rows += [i] * len(found)
                numbers += found
            taken = batch.select(names).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(numbers, pa.int32())], [*names, "_no"])

    schema = T.StructType([*[texts.schema[n] for n in names], T.StructField("_no", T.IntegerType())])
    return texts.select(*names, "_text").mapInArrow(run, schema)


def contained_pairs(
    queries: DataFrame,
    texts: DataFrame,
    query_id: str,
    text_id: list[str],
    keep: tuple[str, ...] = (),
    wildcards: bool = True,
    scope: dict[str, str] | None = None,
) -> DataFrame:
    """All (query, text) with the query's text inside the other text, ignoring case.

    ``queries(query_id, query)`` and ``texts(text_id..., text)``; ``keep`` names further columns
    of the texts to return. The distinct query texts are counted first. Up to a bound every task gets
    them all and reads each text once, with one automaton for all of them, so nothing of a text is
    exploded or shuffled and only matches go on. Beyond it see ``_by_anchor``.

    ``scope`` maps columns of the queries to columns of the texts that must be equal where the
    query has a value. A query's mask says which it has; a match meets the queries of its text under
    each mask that is in use, with its own values of that mask, so these too are part of the join's key.
    """
    scope = scope or {}
    mask = reduce(lambda a, b: a + b, [F.when(F.col(q).isNull(), 0).otherwise(1 << i) for i, q in enumerate(scope)], F.lit(0))
    named = F.to_json(F.array(*[F.col(q).cast("string") for q in scope])) if scope else F.lit("")
    asked = queries.select(query_id, F.lower("query").alias("_q"), mask.alias("_mask"), named.alias("_scope")).where("_q <> ''")
    asked = stored(asked, "asked")
    distinct = asked.select("_q").distinct()
    rows, chars = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("_q")), F.lit(0))).first()
    if rows > MAX_PATTERNS or chars > MAX_PATTERN_CHARS:
        return _by_anchor(asked, texts, query_id, text_id, keep, wildcards, scope)
    patterns = sorted(r["_q"] for r in distinct.collect())
    masks = [r["_mask"] for r in asked.select("_mask").distinct().collect()]  # one per set of fields
    fields = list(scope.values())
    lowered = texts.select(*dict.fromkeys([*text_id, *keep, *fields]), F.lower("text").alias("_text"))
    own = [
        F.to_json(F.array(*[F.col(c).cast("string") if m >> i & 1 else F.lit(None).cast("string") for i, c in enumerate(fields)])) if scope else F.lit("")
        for m in masks
    ]
    numbered = asked.sparkSession.createDataFrame(list(enumerate(patterns)), "_no int, _q string")
    # Stored, as the size of a join is overrated and the matches, with all they carry, would be shuffled.
    wanted = stored(asked.join(numbered, "_q").drop("_q"), "wanted")
    filed = F.array(*[F.struct(F.lit(m).alias("_mask"), o.alias("_scope")) for m, o in zip(masks, own)]).cast("array<struct<_mask:int,_scope:string>>")
    found = holds(lowered, patterns, wildcards)
    placed = found.select("*", F.explode(filed).alias("_place")).select("*", "_place._mask", "_place._scope").drop("_place")
    return placed.join(wanted, ["_no", "_mask", "_scope"]).select(query_id, *text_id, *keep)


def _by_anchor(
    asked: DataFrame, texts: DataFrame, query_id: str, text_id: list[str], keep: tuple[str, ...], wildcards: bool, scope: dict[str, str]
) -> DataFrame:
    """The same for any number of ``asked(query_id, _q, _mask, _scope)``, as an equality join.

    Each query is looked up by one anchor that any match must hold: a whole word from its inside, else a
    short run of its characters; a query without a literal character has the empty anchor and matches any
    text its wildcards fit. Up to a bound anchors are broadcast; beyond it (id, anchor) pairs are shuffled.
    A text is filed once under each mask in use.
    """
    wild = F.col("_q").rlike("[%_]") if wildcards else F.lit(False)
    pieces = F.split("_q", "[%_]") if wildcards else F.array("_q")
    longest = F.element_at(
        F.array_sort(F.transform("_p", lambda p: F.struct(F.length(p).alias("n"), p.alias("p")))), -1
    )["p"]
    split = asked.withColumn("_wild", wild).withColumn("_p", pieces).select(
        query_id, "_q", "_wild", "_mask", "_scope", F.flatten(F.transform("_p", inner_words)).alias("_inner"), longest.alias("_long")
    )
    # Tier 0 looks up whole words, tier n runs of n characters, tier -1 the empty anchor.
    tier = F.when(F.size("_inner") > 0, 0)
    keys = F.when(F.col("_tier") == 0, F.col("_inner"))
    for size in GRAM_SIZES:
        tier = tier.when(F.length("_long") >= size, size)
        keys = keys.when(F.col("_tier") == size, grams(F.col("_long"), size))
    keyed = split.withColumn("_tier", tier.otherwise(-1)).withColumn(
        "_anchor", F.explode(keys.otherwise(F.array(F.lit(""))))
    )
    chosen = _choose(keyed.select(query_id, "_q", "_wild", "_mask", "_scope", "_tier", "_anchor"), query_id)
    spark = asked.sparkSession
    path = work_path(spark, "anchors")
    chosen.withColumn("_regex", F.when(F.col("_wild"), like_regex(F.col("_q")))).write.parquet(path)
    anchors = spark.read.parquet(path)
    used = anchors.select("_tier", "_mask").distinct().collect()  # five tiers, a mask per set of fields
    tiers = {t: sorted(m for u, m in used if u == t) for t, _ in used}
    rows, chars = anchors.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("_q")), F.lit(0))).first()
    small = rows <= MAX_BROADCAST_ANCHORS and chars <= MAX_BROADCAST_CHARS

    fields = list(scope.values())
    lowered = texts.select(*dict.fromkeys([*text_id, *keep, *fields]), F.lower("text").alias("_text"))
    out = [query_id, *text_id, *keep]
    held_by = {0: whole_words, -1: lambda _: F.array(F.lit(""))}
    match = F.when(F.col("_wild"), F.expr("_text rlike _regex")).otherwise(F.contains(F.col("_text"), F.col("_q")))
    # The outer explode keeps Spark from building the arrays twice; its null rows find no anchor.
    found = []
    key = ["_anchor", "_mask", "_scope"]
    for t, masks in tiers.items():
        of_text = held_by.get(t) or (lambda text, n=t: grams(text, n))
        wanted = anchors.where(F.col("_tier") == t).drop("_tier")
        own = [
            F.to_json(F.array(*[F.col(c).cast("string") if m >> i & 1 else F.lit(None).cast("string") for i, c in enumerate(fields)])) if scope else F.lit("")
            for m in masks
        ]
        filed = F.array(*[F.struct(F.lit(m).alias("_mask"), o.alias("_scope")) for m, o in zip(masks, own)])
        placed = lowered.select("*", F.explode(filed).alias("_place")).select("*", "_place._mask", "_place._scope").drop("_place")
        if small:
            held = placed.select("*", F.explode_outer(of_text(F.col("_text"))).alias("_anchor"))
            found.append(held.join(F.broadcast(wanted), key).where(match).select(*out))
        else:
            held = placed.select(*text_id, "_mask", "_scope", F.explode_outer(of_text(F.col("_text"))).alias("_anchor"))
            hits = held.join(wanted, key).drop(*key)
            found.append(hits.join(lowered, text_id).where(match).select(*out))
    if not found:  # no query has any text
        kind = asked.schema[query_id].dataType
        return lowered.where(F.lit(False)).select(F.lit(None).cast(kind).alias(query_id), *text_id, *keep)
    return reduce(DataFrame.unionByName, found)
