"""Captions, transcript chunks, speaker assignment, voiceprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark.functions import text as tx
from kbspark.operators.tables import first_per_key

# --- captions -------------------------------------------------------------------------------


def clock(ms: Column, mark: str = ",") -> Column:
    """Milliseconds as ``HH:MM:SS,mmm``."""
    ms = F.greatest(ms, F.lit(0).cast("long"))
    second = F.floor(ms / 1000)
    return F.format_string(
        f"%02d:%02d:%02d{mark}%03d",
        F.floor(second / 3600),
        F.floor(second / 60) % 60,
        second % 60,
        ms % 1000,
    )


def clock_ms(text: Column) -> Column:
    part = lambda i: F.regexp_extract(text, r"(\d{2}):(\d{2}):(\d{2})[,.](\d{3})", i).cast("long")
    return (part(1) * 3600 + part(2) * 60 + part(3)) * 1000 + part(4)


def render_captions(segments: DataFrame, fmt: str = "srt") -> DataFrame:
    """``segments(doc_id, seq, start_ms, end_ms, text)`` to one caption text per document.

    Empty texts are skipped and the counter stays dense. The caption text of a document is one
    value, so its segments meet in one row.
    """
    mark = "," if fmt == "srt" else "."
    block = F.concat(
        clock(F.col("start_ms"), mark), F.lit(" --> "), clock(F.col("end_ms"), mark), F.lit("\n"), tx.strip(F.col("text"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("seq", "block")))
    per_doc = (
        segments.where(tx.strip(F.col("text")) != "")
        .select("doc_id", "seq", block.alias("block"))
        .groupBy("doc_id")
        .agg(ordered.alias("blocks"))
    )
    if fmt == "srt":
        lines = F.transform("blocks", lambda s, i: F.concat((i + 1).cast("string"), F.lit("\n"), s["block"]))
        head = F.lit("")
    else:
        lines = F.transform("blocks", lambda s: s["block"])
        head = F.lit("WEBVTT\n\n")
    return per_doc.select("doc_id", F.concat(head, F.array_join(lines, "\n\n"), F.lit("\n")).alias("caption"))


def parse_captions(captions: DataFrame) -> DataFrame:
    """``captions(doc_id, caption)`` in SRT or VTT form to one row per spoken segment."""
    lines = lambda block: F.filter(
        F.transform(F.split(block, r"\r?\n"), tx.strip), lambda line: line != ""
    )
    blocks = F.transform(F.split(tx.strip(F.col("caption")), r"\n\s*\n"), lines)
    unnumbered = F.transform(
        blocks,
        lambda b: F.when(F.get(b, F.lit(0)).rlike(r"^\d+$"), F.slice(b, F.lit(2), F.greatest(F.size(b) - 1, F.lit(0)))).otherwise(b),
    )
    timing = r"^\d{2}:\d{2}:\d{2}[,.]\d{3}\s*-->\s*\d{2}:\d{2}:\d{2}[,.]\d{3}"
    spoken = F.filter(
        F.transform(
            unnumbered,
            lambda b: F.struct(
                F.get(b, F.lit(0)).alias("time"),
                F.array_join(F.slice(b, F.lit(2), F.greatest(F.size(b) - 1, F.lit(0))), " ").alias("text"),
            ),
        ),
        lambda s: s["time"].rlike(timing) & (s["text"] != ""),
    )
    return captions.select("doc_id", F.posexplode_outer(spoken).alias("_i", "_s")).where("_s IS NOT NULL").select(
        "doc_id",
        F.concat(F.lit("seg_"), F.col("_i") + 1).alias("segment_id"),
        (F.col("_i") + 1).cast("long").alias("seq"),
        clock_ms(F.substring_index("_s.time", "-->", 1)).alias("start_ms"),
        clock_ms(F.substring_index("_s.time", "-->", -1)).alias("end_ms"),
        F.lit("UNKNOWN").alias("speaker_local_id"),
        F.col("_s.text").alias("text"),
    )


def plain_transcripts(segments: DataFrame, limit: int = 24000, block: int = 1024) -> DataFrame:
    """Newline-joined segment texts per document, clipped to ``limit`` characters.

    A document is cut into blocks of sequence numbers. The lengths of the blocks before one say where it
    starts, and those before a segment in its block where the segment does; only segments that start before
    the clip are gathered. The full length comes from the sums of the blocks.
    """
    limit = max(4000, min(120000, limit))
    spoken = segments.withColumn("text", tx.strip(F.col("text"))).where("text <> ''").select("doc_id", "seq", "text")
    spoken = spoken.withColumn("_block", F.floor(F.col("seq") / block)).withColumn("_chars", F.length("text") + 1)
    whole = Window.partitionBy("doc_id")  # one row per block
    blocks = spoken.groupBy("doc_id", "_block").agg(F.sum("_chars").alias("_n")).select(
        "doc_id", "_block",
        F.coalesce(F.sum("_n").over(whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_from"),
        (F.sum("_n").over(whole) - 1).alias("total_chars"),
    )
    # The line end before a segment that starts at the clip is still inside of it.
    early = blocks.where(F.col("_from") <= limit)
    inside = Window.partitionBy("doc_id", "_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = spoken.join(early, ["doc_id", "_block"]).withColumn("_at", F.col("_from") + F.coalesce(F.sum("_chars").over(inside), F.lit(0)))
    texts = placed.where(F.col("_at") <= limit).groupBy("doc_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "_at", "text"))), lambda s: s["text"]).alias("_t"),
        F.first("total_chars").alias("total_chars"),
    )
    return texts.select(
        "doc_id",
        F.substring(F.array_join("_t", "\n"), 1, limit).alias("transcript"),
        "total_chars",
        (F.col("total_chars") > limit).alias("clipped"),
    )


# --- transcript chunks ----------------------------------------------------------------------

_MOVES = T.StructType(
    [T.StructField("carry", T.ArrayType(T.IntegerType())), T.StructField("opened", T.ArrayType(T.IntegerType()))]
)


def _block_moves(limit: int):
    """For each length an open chunk may have at the start of a block: its length at the end
    and the number of chunks opened in between."""

    @F.pandas_udf(_MOVES)
    def run(blocks: pd.Series) -> pd.DataFrame:
        rows = []
        for lengths in blocks:
            carry = np.arange(limit + 1)
            opened = np.zeros(limit + 1, dtype=np.int64)
            for n in lengths:
                opens = (carry == 0) | (carry + n > limit)
                carry = np.where(opens, min(n, limit), carry + n)
                opened += opens
            rows.append((carry.astype(np.int32), opened.astype(np.int32)))
        return pd.DataFrame(rows, columns=["carry", "opened"])

    return run


def _chained_moves():
    """The moves of consecutive blocks as one."""

    @F.pandas_udf(_MOVES)
    def run(carries: pd.Series, openings: pd.Series) -> pd.DataFrame:
        rows = []
        for carry_list, opened_list in zip(carries, openings):
            carry = np.arange(len(carry_list[0]))
            opened = np.zeros(len(carry), dtype=np.int64)
            for c, o in zip(carry_list, opened_list):
                opened += np.asarray(o)[carry]
                carry = np.asarray(c)[carry]
            rows.append((carry.astype(np.int32), opened.astype(np.int32)))
        return pd.DataFrame(rows, columns=["carry", "opened"])

    return run


def _entries(steps: Column, key: str, carry: Column, opened: Column) -> Column:
    """Walk ordered ``steps(key, carry, opened)`` from a start state; the state on entry to each."""
    start = F.struct(
        carry.cast("int").alias("carry"),
        opened.cast("long").alias("opened"),
        F.array().cast(f"array<struct<{key}:bigint,carry:int,opened:bigint>>").alias("out"),
    )

    def step(acc: Column, s: Column) -> Column:
        at = acc["carry"] + 1
        return F.struct(
            F.element_at(s["carry"], at).alias("carry"),
            (acc["opened"] + F.element_at(s["opened"], at)).alias("opened"),
            F.concat(
                acc["out"],
                F.array(F.struct(s[key].cast("long").alias(key), acc["carry"].alias("carry"), acc["opened"].alias("opened"))),
            ).alias("out"),
        )

    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def chunk_numbers(segments: DataFrame, limit: int = 800, block: int = 1024) -> DataFrame:
    """``segments(doc_id, seq, text)`` with ``chunk_no``, packing greedily up to ``limit``
    characters; a longer segment stands alone, empty ones are left out.

    ``seq`` numbers the segments of a document from zero. Packing depends on all that went
    before, so a long document is cut into blocks of ``block`` segments. Each block is first
    summed up as a table from the open chunk's length on entry to that on exit; the tables are
    chained per super-block, then per document, and every block is packed on its own from the
    entry state found. No task sees more than ``block`` segments or tables of a document.
    """
    spoken = segments.where(F.length("text") > 0).select(
        "doc_id", "seq", F.length("text").alias("_n"), F.floor(F.col("seq") / block).alias("_b")
    )
    blocks = spoken.groupBy("doc_id", "_b").agg(F.array_sort(F.collect_list(F.struct("seq", "_n"))).alias("_segs"))
    long_docs = spoken.groupBy("doc_id").agg(F.max("_b").alias("_last")).where("_last > 0").select("doc_id")
    moves = (
        blocks.join(long_docs, "doc_id", "left_semi")
        .withColumn("_m", _block_moves(limit)(F.transform("_segs", lambda s: s["_n"])))
        .select("doc_id", "_b", F.floor(F.col("_b") / block).alias("_sb"), "_m.carry", "_m.opened")
    )
    supers = moves.groupBy("doc_id", "_sb").agg(
        F.array_sort(F.collect_list(F.struct("_b", "carry", "opened"))).alias("_steps")
    )
    chained = supers.withColumn(
        "_m",
        _chained_moves()(
            F.transform("_steps", lambda s: s["carry"]), F.transform("_steps", lambda s: s["opened"])
        ),
    ).select("doc_id", "_sb", "_m.carry", "_m.opened")
    super_entry = (
        chained.groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("_sb", "carry", "opened"))).alias("_steps"))
        .select("doc_id", F.inline(_entries(F.col("_steps"), "_sb", F.lit(0), F.lit(0))))
    )
    block_entry = (
        supers.join(super_entry, ["doc_id", "_sb"])
        .select("doc_id", F.inline(_entries(F.col("_steps"), "_b", F.col("carry"), F.col("opened"))))
        .withColumnsRenamed({"carry": "_carry", "opened": "_opened"})
    )
    start = F.struct(
        F.coalesce("_carry", F.lit(0)).alias("carry"),
        F.coalesce("_opened", F.lit(0).cast("long")).alias("no"),
        F.array().cast("array<struct<seq:bigint,chunk_no:bigint>>").alias("out"),
    )

    def pack(acc: Column, s: Column) -> Column:
        opens = (acc["carry"] == 0) | (acc["carry"] + s["_n"] > limit)
        no = F.when(opens, acc["no"] + 1).otherwise(acc["no"])
        return F.struct(
            F.when(opens, F.least(s["_n"], F.lit(limit))).otherwise(acc["carry"] + s["_n"]).alias("carry"),
            no.alias("no"),
            F.concat(
                acc["out"], F.array(F.struct(s["seq"].cast("long").alias("seq"), no.alias("chunk_no")))
            ).alias("out"),
        )

    packed = blocks.join(block_entry, ["doc_id", "_b"], "left").select(
        "doc_id", F.inline_outer(F.aggregate("_segs", start, pack, lambda acc: acc["out"]))
    )
    return packed


def chunk_transcripts(segments: DataFrame, limit: int = 800, block: int = 1024) -> DataFrame:
    """Transcript chunks: joined text, time span, one speaker or ``MIXED``, segment ids.

    A chunk holds at most ``limit`` characters or one segment, so its group is small.
    """
    numbered = segments.join(chunk_numbers(segments, limit, block), ["doc_id", "seq"])
    members = F.array_sort(
        F.collect_list(F.struct("seq", "segment_id", "start_ms", "end_ms", "speaker_local_id", "text"))
    )
    grouped = numbered.groupBy("doc_id", "chunk_no").agg(members.alias("_m"))
    speakers = F.array_distinct(F.transform("_m", lambda m: F.coalesce(m["speaker_local_id"], F.lit("\0"))))
    return grouped.select(
        "doc_id",
        F.concat(F.lit("tchunk_"), "chunk_no").alias("segment_id"),
        F.col("_m")[0]["start_ms"].alias("start_ms"),
        F.element_at("_m", -1)["end_ms"].alias("end_ms"),
        F.when(F.size(speakers) == 1, F.col("_m")[0]["speaker_local_id"]).otherwise("MIXED").alias("speaker"),
        tx.strip(F.array_join(F.transform("_m", lambda m: m["text"]), " ")).alias("text"),
        F.transform("_m", lambda m: m["segment_id"]).alias("segment_ids"),
    )


# --- speakers -------------------------------------------------------------------------------


def assign_speakers(segments: DataFrame, turns: DataFrame, bin_ms: int = 30000) -> DataFrame:
    """Give each segment the speaker turn it overlaps longest; the earliest turn wins ties.

    ``turns(doc_id, turn_no, start_ms, end_ms, speaker)``. Both sides are cut into time bins,
    so an interval meets only those near it and a long document spreads over many tasks. A
    pair is counted in the first bin both touch. Without overlap the old speaker or
    ``UNKNOWN`` stays; in a document without turns the speaker is ``SPEAKER_1``.
    """

    def binned(df: DataFrame) -> DataFrame:
        first = F.floor(F.col("start_ms") / bin_ms)
        last = F.floor(F.greatest(F.col("end_ms") - 1, F.col("start_ms")) / bin_ms)
        return df.withColumn("_first", first).withColumn("_bin", F.explode(F.sequence(first, last)))

    s = binned(segments.select("doc_id", "segment_id", "start_ms", "end_ms")).alias("s")
    t = binned(turns).alias("t")
    shared = F.least(F.col("s.end_ms"), F.col("t.end_ms")) - F.greatest(F.col("s.start_ms"), F.col("t.start_ms"))
    pairs = s.join(
        t,
        (F.col("s.doc_id") == F.col("t.doc_id"))
        & (F.col("s._bin") == F.col("t._bin"))
        & (F.col("s._bin") == F.greatest(F.col("s._first"), F.col("t._first")))
        & (F.col("s.start_ms") < F.col("t.end_ms"))
        & (F.col("t.start_ms") < F.col("s.end_ms")),
    )
    best = pairs.groupBy(F.col("s.doc_id").alias("doc_id"), F.col("s.segment_id").alias("segment_id")).agg(
        F.max(F.struct(shared.alias("overlap"), (-F.col("t.turn_no")).alias("order"), F.col("t.speaker"))).alias("_best")
    )
    spoken = turns.select("doc_id").distinct().withColumn("_has_turns", F.lit(True))
    old = F.nullif(F.col("speaker_local_id"), F.lit(""))
    fallback = F.when(F.col("_has_turns"), F.coalesce(old, F.lit("UNKNOWN"))).otherwise(
        F.when(F.coalesce(old, F.lit("UNKNOWN")) == "UNKNOWN", "SPEAKER_1").otherwise(old)
    )
    return (
        segments.join(best, ["doc_id", "segment_id"], "left")
        .join(spoken, "doc_id", "left")
        .withColumn("speaker_local_id", F.coalesce(F.col("_best.speaker"), fallback))
        .drop("_best", "_has_turns")
    )


def enroll_speakers(segments: DataFrame) -> DataFrame:
    """One voiceprint per (source, speaker) with its number of segments."""
    speaker = F.coalesce(F.nullif(F.col("speaker_local_id"), F.lit("")), F.lit("UNKNOWN"))
    return (
        segments.groupBy(F.col("doc_id").alias("source_id"), speaker.alias("speaker_local_id"))
        .agg(F.count(F.lit(1)).alias("segment_count"))
        .withColumn("voiceprint_id", F.sha2(F.concat_ws(":", "source_id", "speaker_local_id"), 256))
    )


def match_voiceprints(segments: DataFrame, voiceprints: DataFrame) -> DataFrame:
    """Segments joined to the last voiceprint of their speaker within the source."""
    last = first_per_key(voiceprints, ["source_id", "speaker_local_id"], F.col("position").desc())
    return segments.join(
        last.select(F.col("source_id").alias("doc_id"), "speaker_local_id", "voiceprint_id"),
        ["doc_id", "speaker_local_id"],
    ).select("doc_id", "segment_id", "speaker_local_id", "voiceprint_id", F.lit(0.5).alias("confidence"))


def match_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy("doc_id").agg(F.count(F.lit(1)).alias("matches"))


# --- voice gallery --------------------------------------------------------------------------

# Gallery fields by the way they merge.
LIST_FIELDS = ("aliases", "tags", "roles", "organizations", "same_as", "identifiers", "contacts", "socials")
SCALAR_FIELDS = (
    "given_name", "family_name", "display_name", "full_name", "title", "role", "affiliation", "notes", "person_id",
    "birth_date", "death_date", "gender", "nationality", "language", "country", "city", "bio", "homepage", "image",
)
MAP_FIELDS = ("credits", "source_refs", "ebucore")


def merge_gallery(entries: DataFrame, incoming: DataFrame, overwrite: bool) -> DataFrame:
    """Fold incoming person fields into the gallery, one row per voiceprint on either side.

    Lists are united without nulls. Scalars and maps are replaced when ``overwrite``, else only
    filled in. The person id defaults to one made from the voiceprint.
    """
    joined = entries.alias("o").join(incoming.alias("n"), "voiceprint_id", "full")
    known, fresh = set(entries.columns), set(incoming.columns)

    def side(prefix: str, name: str, have: set, kind: str) -> Column:
        return F.col(f"{prefix}.{name}") if name in have else F.lit(None).cast(kind)

    out, maps = [F.col("voiceprint_id")], set()
    for name in LIST_FIELDS:
        if name in known | fresh:
            both = [
                F.filter(F.coalesce(side(p, name, h, "array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull())
                for p, h in (("o", known), ("n", fresh))
            ]
            out.append(F.array_union(*both).alias(name))
    for name in SCALAR_FIELDS:
        if name in known | fresh:
            old, new = side("o", name, known, "string"), side("n", name, fresh, "string")
            filled = F.coalesce(F.nullif(old, F.lit("")), new)
            value = F.coalesce(new, old) if overwrite else filled
            if name == "person_id":
                value = F.coalesce(F.nullif(value, F.lit("")), F.concat(F.lit("person_"), "voiceprint_id"))
            out.append(value.alias(name))
    for name in MAP_FIELDS:
        # Such a field may also be stored as JSON text, which is kept by the rule of scalars below.
        if name in known | fresh and all(t.startswith("map") for t in (dict(d.dtypes).get(name, "map") for d in (entries, incoming))):
            maps.add(name)
            kind = "map<string,string>"
            old = F.coalesce(side("o", name, known, kind), F.create_map().cast(kind))
            new = F.coalesce(side("n", name, fresh, kind), F.create_map().cast(kind))
            merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)
            out.append((merged if overwrite else F.when(F.size(old) > 0, old).otherwise(new)).alias(name))
    # Fields of other names and kinds, such as the confidence, are kept by the same rule as scalars.
    listed = {"voiceprint_id", *LIST_FIELDS, *SCALAR_FIELDS, *maps}
    for name in [*entries.columns, *(c for c in incoming.columns if c not in known)]:
        if name not in listed:
            both = [F.col(f"{p}.{name}") for p, have in (("n", fresh), ("o", known)) if name in have]
            out.append(F.coalesce(*(both if overwrite else reversed(both))).alias(name))
    return joined.select(*out)


def channel_suggestions(voiceprints: DataFrame, channels: DataFrame) -> DataFrame:
    """Person fields suggested for sources with exactly one speaker and a known channel."""
    single = voiceprints.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("voiceprint_id").alias("voiceprint_id")
    ).where("_n = 1")
    return single.join(channels.where(F.coalesce("channel", F.lit("")) != ""), "source_id").select(
        "voiceprint_id",
        F.col("channel").alias("title"),
        F.array(F.lit("auto-suggested"), F.lit("youtube-channel")).alias("tags"),
        F.lit("Auto-suggested from YouTube channel metadata.").alias("notes"),
    )


# The order of fields in the text of a gallery entry.
TEXT_SCALARS = (
    "display_name", "full_name", "given_name", "family_name", "title", "role", "affiliation", "bio", "notes",
)
TEXT_LISTS = ("roles", "organizations", "aliases", "tags", "same_as")
TEXT_JSON = ("identifiers", "contacts", "socials", "source_refs", "ebucore")


def gallery_text(entries: DataFrame) -> DataFrame:
    """The text of each gallery entry for embedding, with its hash."""
    have = set(entries.columns)
    parts = [
        F.when(F.coalesce(n, F.lit("")) != "", F.concat(F.lit(f"{n}: "), n)) for n in TEXT_SCALARS if n in have
    ]
    parts += [
        F.when(F.size(n) > 0, F.concat(F.lit(f"{n}: "), F.array_join(n, ", "))) for n in TEXT_LISTS if n in have
    ]
    kinds = dict(entries.dtypes)
    for n in (n for n in TEXT_JSON if n in have):
        filled, text = (F.coalesce(n, F.lit("")) != "", F.col(n)) if kinds[n] == "string" else (F.size(n) > 0, F.to_json(n))
        parts.append(F.when(filled, F.concat(F.lit(f"{n}: "), text)))
    return entries.select("voiceprint_id", F.concat_ws("\n", *parts).alias("text")).withColumn(
        "text_hash", F.sha2("text", 256)
    )
