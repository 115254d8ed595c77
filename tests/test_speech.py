import random

import pytest
from pyspark.sql import functions as F

from kbspark.operators import speech


def greedy(lengths, limit):
    out, current, number = [], 0, 0
    for n in lengths:
        if number == 0 or (current and current + n > limit):
            number, current = number + 1, 0
        current += n
        out.append(number)
    return out


@pytest.mark.parametrize("block", [2, 3, 1024])
def test_packing_over_blocks_equals_greedy(spark, block):
    rng = random.Random(block)
    docs = {d: [rng.choice([0, 1, 5, 9, 20, 30]) for _ in range(rng.choice([1, 3, 40]))] for d in range(12)}
    rows = [(d, i, "x" * n) for d, lengths in docs.items() for i, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "doc_id long, seq long, text string")
    got = {(r["doc_id"], r["seq"]): r["chunk_no"] for r in speech.chunk_numbers(df, limit=24, block=block).collect()}
    want = {}
    for d, lengths in docs.items():
        spoken = [(i, n) for i, n in enumerate(lengths) if n]
        for (i, _), number in zip(spoken, greedy([n for _, n in spoken], 24)):
            want[(d, i)] = number
    assert got == want


def test_transcript_chunk(spark):
    rows = [("v", 0, "seg_1", 0, 1000, "UNKNOWN", "Hello"), ("v", 1, "seg_2", 1000, 2000, "UNKNOWN", "world")]
    df = spark.createDataFrame(rows, "doc_id string, seq long, segment_id string, start_ms long, end_ms long, speaker_local_id string, text string")
    row = speech.chunk_transcripts(df).collect()
    assert len(row) == 1
    assert (row[0]["segment_id"], row[0]["text"], row[0]["start_ms"], row[0]["end_ms"], row[0]["speaker"]) == (
        "tchunk_1", "Hello world", 0, 2000, "UNKNOWN",
    )


def test_captions(spark):
    text = "1\n00:00:01,000 --> 00:00:03,000\nHello world\n\n2\n00:00:03,500 --> 00:00:05,000\nSecond\nline\n\n3\nbroken\n"
    rows = speech.parse_captions(spark.createDataFrame([("d", text)], "doc_id string, caption string")).collect()
    assert [(r["segment_id"], r["start_ms"], r["end_ms"], r["text"]) for r in rows] == [
        ("seg_1", 1000, 3000, "Hello world"), ("seg_2", 3500, 5000, "Second line"),
    ]


def test_speakers_against_nested_loop(spark):
    rng = random.Random(3)
    segs = [("d", f"s{i}", a, a + rng.randint(1, 90_000), "old" if i % 3 else None) for i, a in enumerate(rng.sample(range(300_000), 40))]
    turns = [("d", i, a, a + rng.randint(1, 70_000), f"spk{i % 4}") for i, a in enumerate(rng.sample(range(300_000), 25))]
    s = spark.createDataFrame(segs, "doc_id string, segment_id string, start_ms long, end_ms long, speaker_local_id string")
    t = spark.createDataFrame(turns, "doc_id string, turn_no long, start_ms long, end_ms long, speaker string")
    got = {r["segment_id"]: r["speaker_local_id"] for r in speech.assign_speakers(s, t, bin_ms=10_000).collect()}
    for _, sid, a, b, old in segs:
        overlaps = [(min(b, e) - max(a, st), -n, sp) for _, n, st, e, sp in turns if st < b and a < e]
        assert got[sid] == (max(overlaps)[2] if overlaps else (old or "UNKNOWN"))


def test_gallery_keeps_title_on_suggestion(spark):
    base = spark.createDataFrame([("vp", "CEO", ["a"])], "voiceprint_id string, title string, tags array<string>")
    base = base.withColumn("person_id", F.lit(None).cast("string"))
    new = spark.createDataFrame([("vp", "Channel", ["auto"])], "voiceprint_id string, title string, tags array<string>")
    row = speech.merge_gallery(base, new, overwrite=False).first()
    assert (row["title"], row["tags"], row["person_id"]) == ("CEO", ["a", "auto"], "person_vp")
    assert speech.merge_gallery(base, new, overwrite=True).first()["title"] == "Channel"


def test_channel_suggestion_needs_one_speaker(spark):
    prints = spark.createDataFrame([("a", "v1"), ("b", "v2"), ("b", "v3")], "source_id string, voiceprint_id string")
    channels = spark.createDataFrame([("a", "News"), ("b", "News")], "source_id string, channel string")
    assert [r["voiceprint_id"] for r in speech.channel_suggestions(prints, channels).collect()] == ["v1"]
