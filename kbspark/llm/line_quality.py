r"""Quality rules with cross-document line frequency.

Lines are lowered (A-Z), their white space is made single blanks, and hashed. For each host the
distinct documents that hold a line are counted; a line is above the limit if more than
``LEAST_LIMIT`` of them and more than ``SHARE`` of the host's documents do. Such lines are
boilerplate and removed, and a document that loses more than ``DEPLETED`` of its words by it is
rejected. Whole copies of one document count as one document, since finding copies is not this
rule's work, and the earliest document (smallest id) that holds a line keeps it.

The base rules look at one document: word characters, symbols, repeated lines, and words inside
three-word windows that occur again.

Defined results: a null text has no words and fails the base rules; a null host is a host of its
own; lines without a word are never removed; repeated rows are the same document; null ids sort last among
earliest documents; an empty table gives an empty result. Columns that are not named are ignored.

The counts go through partial aggregations, so neither a frequent line nor a large host is
collected anywhere, and rows that move hold hashes, never texts.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from kbspark.llm.marked import split_marked
from kbspark.session import stored

SHARE, LEAST_LIMIT, DEPLETED = 0.05, 4, 0.5
MIN_WORDS, MAX_REPEATED = 50, 0.5
SYMBOL = re.compile(r"[#*$%&|<>]")

MEASURES = [
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()), ("lines", pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int32())]))),
]
MEASURE_TYPE = (
    "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,"
    "lines:array<struct<h:bigint,w:int>>>"
)


def repeated_words(words: list[str], size: int = 3) -> int:
    """Words in windows of ``size`` words that occur twice or more, the first included."""
    if len(words) <= size:
        return 0
    numbers: dict[str, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    # Windows by number: each step pairs the number of a shorter window with the next word's.
    window = ids
    for k in range(1, size):
        pairs = window[:-1] * len(numbers) + ids[k:]
        _, window = np.unique(pairs, return_inverse=True)
    again = np.bincount(window)[window] > 1
    mark = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + size, -1)
    return int((np.cumsum(mark) > 0).sum())


def line_key(line: bytes) -> int:
    """Hash of a line's words, lowered and single-spaced; of a line without a word, zero."""
    words = line.lower().split()
    return xxh64_intdigest(b" ".join(words), 0) - (1 << 63) if words else 0


def measure(text: str | None) -> dict:
    """The base counts of a text, and hash and word count of its distinct lines with a word, each
    with the words of all its occurrences."""
    data = (text or "").encode()
    words = [w.decode() for w in data.split()]
    seen: set[bytes] = set()
    lines: dict[int, int] = {}
    repeated = 0
    for line in data.split(b"\n"):
        own = line.split()
        if not own:
            continue
        repeated += line in seen
        seen.add(line)
        key = line_key(line)
        lines[key] = lines.get(key, 0) + len(own)
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(SYMBOL.findall(text or "")),
        "n_dup_lines": repeated, "n_repeat_words": repeated_words(words),
        "lines": [{"h": h, "w": w} for h, w in lines.items()],
    }


def verdicts(df: DataFrame, doc: str, text: str, host: str, share: float, least: int, depleted: float) -> DataFrame:
    """The columns of ``judge``, ``host``, and ``removed``, the hashes of the lines that go, in
    order; null if none."""

    @F.arrow_udf(MEASURE_TYPE)
    def measures(texts: pa.Array) -> pa.Array:
        return pa.array([measure(t) for t in texts.to_pylist()], pa.struct(MEASURES))

    rows = df.select(F.col(doc).alias("doc_id"), F.col(host).alias("host"), F.xxhash64(text).alias("content"), measures(F.col(text)).alias("m"))
    rows = stored(rows.select("doc_id", "host", "content", "m.*"), "quality-measures")
    # A document of a host, once: its copies have the same content.
    held = rows.select("host", "content", "doc_id", F.explode("lines").alias("l")).select("host", "content", "doc_id", "l.h")
    once = held.groupBy("host", "h", "content").agg(F.min("doc_id").alias("first"))
    counts = once.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first"))
    size = rows.select("host", "content").distinct().groupBy(F.col("host").alias("of")).agg(F.count(F.lit(1)).alias("n_docs"))
    above = counts.filter(F.col("n") > least).join(size, F.col("host").eqNullSafe(F.col("of")))
    above = stored(above.filter(F.col("n") > share * F.col("n_docs")).select(F.col("host").alias("of"), F.col("h").alias("line"), "first"), "quality-above")
    uid = rows.withColumn("uid", F.monotonically_increasing_id())
    lines = uid.select("uid", "host", "doc_id", F.explode("lines").alias("l")).select("uid", "host", "doc_id", "l.*")
    hit = lines.join(above, F.col("host").eqNullSafe(F.col("of")) & (F.col("h") == F.col("line")))
    hit = hit.filter(~F.col("doc_id").eqNullSafe(F.col("first")))
    lost = hit.groupBy(F.col("uid").alias("row")).agg(F.sum("w").alias("n_removed_words"), F.sort_array(F.collect_set("h")).alias("removed"))
    out = uid.drop("lines").join(lost, F.col("uid") == F.col("row"), "left").na.fill(0, ["n_removed_words"])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 100 * MAX_REPEATED * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("n_removed_words") <= depleted * F.col("n_words")))
    return out.select(*JUDGED, "host", "removed")


JUDGED = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept", "content"]


def judge(df: DataFrame, doc: str = "doc_id", text: str = "text", host: str = "source", share: float = SHARE, least: int = LEAST_LIMIT, depleted: float = DEPLETED) -> DataFrame:
    """One row per row of ``df``: its id, the base counts, ``base_failed``, ``n_removed_words``
    (on lines above the limit), ``kept``, and ``content``, ``xxhash64`` of the text, by which rows
    of one id can be told apart."""
    return verdicts(df, doc, text, host, share, least, depleted).select(*JUDGED)


def remove_lines(df: DataFrame, doc: str = "doc_id", text: str = "text", host: str = "source", share: float = SHARE, least: int = LEAST_LIMIT, depleted: float = DEPLETED) -> DataFrame:
    """The rows of ``df`` that ``judge`` keeps, with ``text`` cut to the lines that are not above the
    limit, and ``n_lines_removed``."""
    found = verdicts(df, doc, text, host, share, least, depleted).filter(~F.col("kept") | F.col("removed").isNotNull())
    found = found.select(F.col("doc_id").alias("_of_doc"), F.col("content").alias("_of_text"), F.col("host").alias("_of_host"), F.col("kept").alias("_kept"), F.col("removed").alias("_removed"))
    found = stored(found.distinct(), "quality-found")  # repeated rows have one verdict
    # Columns are named by their table, whatever columns ``df`` has besides.
    same = df[doc].eqNullSafe(found["_of_doc"]) & (F.xxhash64(df[text]) == found["_of_text"]) & df[host].eqNullSafe(found["_of_host"])
    # Most documents lose nothing, and stay where they are.
    marked, others = split_marked(df, F.xxhash64(df[text]), found, "_of_text")
    rows = marked.join(found, same, "left").filter(F.coalesce(found["_kept"], F.lit(True)))

    @F.arrow_udf("struct<text:string,n:bigint>")
    def cut(texts: pa.Array, removed: pa.Array) -> pa.Array:
        out, counts = [], []
        for t, keys in zip(texts.to_pylist(), removed.to_pylist()):
            lines = (t or "").split("\n") if keys else []
            gone = set(keys or ())
            left = [x for x in lines if line_key(x.encode()) not in gone or not x.encode().split()]
            out.append("\n".join(left) if keys else t)
            counts.append(len(lines) - len(left))
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(counts, pa.int64())], ["text", "n"])

    done = cut(df[text], found["_removed"])
    names = [c for c in df.columns if c != "n_lines_removed"]
    kept = [done["text"].alias(c) if c == text else df[c] for c in names]
    whole = others.select(*[df[c] for c in names], F.lit(0).cast("long").alias("n_lines_removed"))
    return rows.select(*kept, done["n"].alias("n_lines_removed")).unionByName(whole)


OP8_SQL = rf"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), win AS (
  SELECT doc_id, i, words[i:i+2] AS g FROM w, LATERAL (SELECT unnest(generate_series(1, len(words) - 2)) AS i)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1
), repw AS (
  SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS j FROM rep) GROUP BY doc_id
), l AS (
  SELECT doc_id, host, text, x AS raw, regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS line
  FROM w, LATERAL (SELECT unnest(lines) AS x)
), f AS (
  SELECT host, line, count(DISTINCT text) AS n, min(doc_id) AS first FROM l GROUP BY host, line
), hs AS (SELECT host, count(DISTINCT text) AS n_docs FROM d GROUP BY host),
above AS (
  SELECT f.host, line, first FROM f JOIN hs ON f.host IS NOT DISTINCT FROM hs.host WHERE n > {LEAST_LIMIT} AND n > {SHARE} * n_docs
), lost AS (
  SELECT l.doc_id, CAST(sum(len(l.line)) AS BIGINT) AS n_removed_words FROM l JOIN above a
  ON l.host IS NOT DISTINCT FROM a.host AND l.line = a.line WHERE l.doc_id IS DISTINCT FROM a.first GROUP BY l.doc_id
)
SELECT w.doc_id, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  len(words) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(words) AS base_failed,
  coalesce(n_removed_words, 0) AS n_removed_words,
  NOT (len(words) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(words)) AND coalesce(n_removed_words, 0) <= {DEPLETED} * len(words) AS kept
FROM w LEFT JOIN repw USING (doc_id) LEFT JOIN lost USING (doc_id)
"""
