r"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of ``WINDOW`` consecutive words; an item of fewer words is one
window. A window is the set of its shingles of ``SHINGLE`` words (of a shorter window, itself), each
with its place. A document holds a window if it holds all its shingles at the right distances,
so it must hold the rarest one: that one token is the window's prefix, and only it is joined.

1. One pass over the documents keeps runs of words whose every shingle is one of the benchmark's,
   as many in a row as the shortest window has (the length bound). The benchmark's shingles are
   looked up in a bitmap of fixed size, so what is sent to all tasks does not grow with it.
2. Equal runs of different documents are one run from here on. Shingles are ordered by how many
   documents hold them, each window's rarest is its prefix, and runs and windows meet on it.
3. Pairs must fit (the window may not begin before or end after the run), and are then compared
   word by word.
4. Words inside windows are counted per run, and documents add up their runs. Windows that belong
   to the same items form one set; a list of items is built once for each combination of sets.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the text with A-Z lowered.

Defined results: a null or empty text has no words and is not contaminated, nor does an item
without words occur anywhere; repeated rows of a document each have their result; repeated items
count once per id, and a null item id is ignored; an empty benchmark contaminates nothing. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm.byte_words import Words, slices
from kbspark.session import stored

WINDOW, SHINGLE = 10, 5
BITMAP = 26  # the bitmap has 2**BITMAP bits


def spans(words: Words, bitmap: np.ndarray, sizes: dict[int, int]) -> np.ndarray:
    """Bounds of the runs of words whose shingles are all in the bitmap; ``sizes`` has for each
    size of shingle how many in a row a window has at least."""
    found = []
    for size, least in sizes.items():
        hashes, whole = words.shingles(size)
        bit = hashes >> np.uint64(64 - BITMAP)
        hit = ((bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1).astype(bool) & whole
        edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
        first, last = edge[::2], edge[1::2]
        long = last - first >= least
        found.append(np.stack([first[long], last[long] + size - 1], axis=1))
    out = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    out = out[np.argsort(out[:, 0], kind="stable")]
    if not len(out):
        return out
    # Overlapping runs become one, so no word is in two. Those of different texts never overlap.
    reach = np.maximum.accumulate(out[:, 1])
    new = np.append(True, out[1:, 0] >= reach[:-1])
    return np.stack([out[new, 0], np.append(reach[:-1][new[1:]], reach[-1])], axis=1)


LOWERED = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def windows_of(items: DataFrame, item: str, text: str) -> DataFrame:
    """``item_id, win`` of every window, its words joined by blanks; each once per item."""
    rows = items.select(F.col(item).alias("item_id"), F.col(text).alias("t")).filter("item_id is not null and t is not null")
    words = rows.select("item_id", F.expr(rf"regexp_extract_all({LOWERED.format('t')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', 0)").alias("w"))
    starts = words.filter(F.size("w") > 0).withColumn("i", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - WINDOW + 1, F.lit(1)))))
    return starts.select("item_id", F.array_join(F.slice("w", F.col("i"), WINDOW), " ").alias("win")).distinct()


TOKENS = "key bigint, size int, place int, n int, token bigint, around string, skip int"


def tokens(df: DataFrame, around: bool, sizes: list[int] = range(1, SHINGLE + 1)) -> DataFrame:
    """Shingles of the texts in ``df(key, string)``: their size, place, hash, the text's number of
    words, and if asked for the up to ``WINDOW - size`` words on either side (``skip`` before)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for a, _, words in slices(batch.column(1)):
                count = np.bincount(words.text, minlength=1)
                begin = np.cumsum(count) - count
                for size in sizes:
                    hashes, whole = words.shingles(size)
                    # Shorter shingles are those of texts of just that length, unless it is a run.
                    if size < SHINGLE and not around:
                        whole &= count[words.text[: len(whole)]] == size
                    at = np.flatnonzero(whole)
                    if not len(at):
                        continue
                    own = words.text[at]
                    skip = np.minimum(at - begin[own], WINDOW - size)
                    end = np.minimum(at + WINDOW, begin[own] + count[own])
                    near = [words.string(s, e) for s, e in zip((at - skip).tolist(), end.tolist())] if around else [None] * len(at)
                    for cut in range(0, len(at), 8192):
                        c = slice(cut, cut + 8192)
                        n = len(at[c])
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(keys[a + own[c]].astype(np.int64)), pa.array(np.full(n, size, np.int32)),
                                pa.array((at - begin[own])[c].astype(np.int32)), pa.array(count[own[c]].astype(np.int32)),
                                pa.array(hashes[at[c]].view(np.int64)), pa.array(near[c], pa.string()), pa.array(skip[c].astype(np.int32)),
                            ],
                            ["key", "size", "place", "n", "token", "around", "skip"],
                        )

    return df.mapInArrow(run, TOKENS)


def bitmap_of(own: DataFrame) -> np.ndarray:
    """The bitmap of all tokens: at most 2**BITMAP bits come to the driver, 64 to a row."""
    bit = F.shiftrightunsigned("token", 64 - BITMAP)
    rows = own.select(bit.alias("b")).selectExpr("shiftright(b, 6) as at", "shiftleft(1L, cast(b & 63 as int)) as bits")
    out = np.zeros(1 << (BITMAP - 6), np.int64)
    for r in rows.groupBy("at").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        out[r["at"]] = r["bits"]
    return out.view(np.uint8)


def find_runs(docs: DataFrame, bitmap: np.ndarray, sizes: dict[int, int], doc: str, text: str) -> DataFrame:
    """``doc_id, n_words, runs`` of every document; the only pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast((bitmap, sizes))  # of fixed size

    @F.arrow_udf("struct<n_words:bigint,runs:array<string>>")
    def run(texts: pa.Array) -> pa.Array:
        bits, least = shared.value
        count, runs = np.zeros(len(texts), np.int64), [[] for _ in range(len(texts))]
        for a, _, words in slices(texts):
            np.add.at(count, a + words.text, 1)
            for first, last in spans(words, bits, least).tolist():
                runs[a + int(words.text[first])].append(words.string(first, last))
        return pa.StructArray.from_arrays([pa.array(count), pa.array(runs, pa.list_(pa.string()))], ["n_words", "runs"])

    return docs.select(F.col(doc).alias("doc_id"), run(F.col(text)).alias("r")).select("doc_id", "r.*")


def contamination(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``, one row per row of ``docs``."""
    held = stored(windows_of(items, item, item_text), "decontam-windows")
    # Windows of the same items have the same signature.
    hashed = held.select("win", F.xxhash64(F.col("item_id").cast("string")).alias("a"), F.xxhash64(F.lit(7), F.col("item_id").cast("string")).alias("b"))
    signed = hashed.groupBy("win").agg(F.concat_ws(":", F.count(F.lit(1)), F.bit_xor("a"), F.bit_xor("b")).alias("sig"))
    wins = stored(signed.withColumn("key", F.monotonically_increasing_id()), "decontam-distinct")
    own = stored(tokens(wins.select("key", "win"), False).drop("around", "skip"), "decontam-tokens")
    sizes = {r["size"]: r["least"] for r in own.groupBy("size").agg(F.min(F.col("n") - F.col("size") + 1).alias("least")).collect()}
    found = stored(find_runs(docs, bitmap_of(own), sizes, doc, text).withColumn("uid", F.monotonically_increasing_id()), "decontam-runs")

    each = found.filter(F.size("runs") > 0).select("uid", F.explode("runs").alias("run"))
    runs = each.groupBy("run").agg(F.count(F.lit(1)).alias("n_docs"))
    runs = stored(runs.withColumn("key", F.monotonically_increasing_id()), "decontam-distinct-runs")
    # Only the benchmark's sizes and tokens matter; the rest of a run's shingles go at once.
    known = own.select(F.col("size").alias("s"), F.col("token").alias("t")).distinct()
    at = tokens(runs.select("key", "run"), True, sorted(sizes)).join(known, (F.col("token") == F.col("t")) & (F.col("size") == F.col("s")), "left_semi")
    at = stored(at, "decontam-places")
    # Rarity of a shingle: how many documents' runs it is in.
    places = at.select("key", "size", "token").distinct().join(runs.select(F.col("key").alias("k"), "n_docs"), F.col("key") == F.col("k"))
    rarity = places.groupBy(F.col("size").alias("s"), F.col("token").alias("t")).agg(F.sum("n_docs").alias("held_by"))
    rated = own.join(rarity, (F.col("token") == F.col("t")) & (F.col("size") == F.col("s")), "left").na.fill(0, ["held_by"])
    prefix = rated.groupBy(F.col("key").alias("win_key")).agg(F.min(F.struct("held_by", "token", "place", "size", "n")).alias("p"))
    prefix = prefix.filter("p.held_by > 0").select("win_key", F.col("p.token").alias("t"), F.col("p.size").alias("s"), F.col("p.place").alias("offset"), F.col("p.n").alias("length"))
    pairs = at.join(prefix, (F.col("token") == F.col("t")) & (F.col("size") == F.col("s")))
    pairs = pairs.withColumn("start", F.col("place") - F.col("offset")).filter("start >= 0 and start + length <= n")
    pairs = pairs.join(wins.select(F.col("key").alias("wk"), "win", "sig"), F.col("win_key") == F.col("wk"))
    same = F.array_join(F.slice(F.split("around", " "), F.col("skip") - F.col("offset") + 1, F.col("length")), " ") == F.col("win")
    hits = pairs.filter(same).select("key", "start", (F.col("start") + F.col("length")).alias("stop"), "sig")

    order = Window.partitionBy("key").orderBy("start", "stop")  # of one run
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(before, F.lit(0))))
    counted = hits.select("key", "start", "stop").distinct().withColumn("new", new).groupBy("key").agg(F.sum("new").alias("n_hit"))
    sets = hits.groupBy(F.col("key").alias("k")).agg(F.collect_set("sig").alias("sigs"))
    rated = runs.join(counted, "key").join(sets, F.col("key") == F.col("k")).select(F.col("run").alias("r"), "n_hit", "sigs")
    hit = each.join(rated, F.col("run") == F.col("r"))
    hit = hit.groupBy(F.col("uid").alias("row")).agg(F.sum("n_hit").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sigs")))).alias("sigs"))
    hit = stored(hit, "decontam-hits")

    # The items of each combination of sets, once; a set's items are those of one of its windows.
    member = wins.groupBy(F.col("sig").alias("of")).agg(F.min("win").alias("w")).join(held, F.col("w") == F.col("win")).select("of", "item_id")
    combined = hit.select("sigs").distinct().select("sigs", F.explode("sigs").alias("sig")).join(member, F.col("sig") == F.col("of"))
    listed = combined.select("sigs", F.col("item_id").cast("string").alias("item")).groupBy("sigs").agg(F.array_sort(F.collect_set("item")).alias("items"))
    listed = listed.select(F.col("sigs").alias("in"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    hit = hit.join(listed, F.col("sigs") == F.col("in")).select("row", "n_hit", "n_items", "items_sha256")
    out = found.select("doc_id", "n_words", "uid").join(hit, F.col("uid") == F.col("row"), "left")
    out = out.withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long")).withColumn("n_items", F.coalesce("n_items", F.lit(0)).cast("long"))
    out = out.withColumn("items_sha256", F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k+9], ' ') AS win
  FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS k FROM i WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, k, n, array_to_string(w[k:k+n-1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM iw))
), hit AS (
  SELECT doc_id, k, n, item_id FROM dw JOIN iw USING (n, win)
), words AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS j FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
