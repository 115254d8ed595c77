import random
import re
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbspark.operators import matching, retrieval, vectors

WORDS = ["alpha", "beta", "gam", "delta\\E", "a", "ε", "x%", "new york", "t_o"]


@pytest.mark.parametrize("patterns, bound", [(30_000, 0), (0, 200_000), (0, 0)])
def test_contained_pairs_against_brute_force(spark, monkeypatch, patterns, bound):
    monkeypatch.setattr(matching, "MAX_PATTERNS", patterns)
    monkeypatch.setattr(matching, "MAX_BROADCAST_ANCHORS", bound)
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 9)))) for i in range(60)]
    asked = ["", "a", "AL", "gam", "beta gam", "alpha beta gam", "ta ga", "delta\\E", "x%", "t_o", "%", "___", "new york a", "a%g", "ε"]
    queries = list(enumerate(asked))
    got = matching.contained_pairs(
        spark.createDataFrame(queries, "q long, query string"), spark.createDataFrame(texts, "t long, text string"), "q", ["t"]
    )
    want = set()
    for q, query in queries:
        if not query:
            continue
        regex = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in query.lower())
        want |= {(q, t) for t, text in texts if re.search(regex, text.lower(), re.DOTALL)}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


@pytest.mark.parametrize("bound", [4096, 0])
def test_top_vectors_against_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(vectors, "MAX_BROADCAST_QUERIES", bound)
    rng = np.random.default_rng(0)
    data = [(i, rng.integers(-2, 3, size=rng.choice([3, 4])).astype(float).tolist()) for i in range(80)] + [(99, [0.0, 0.0, 0.0, 0.0])]
    asked = [(i, rng.integers(-2, 3, size=4).astype(float).tolist()) for i in range(5)]
    found = vectors.top_vectors(
        spark.createDataFrame(asked, "q long, embedding array<double>"),
        spark.createDataFrame(data, "v long, embedding array<double>").repartition(5), 7, "q", "v",
    ).collect()

    def cosine(a, b):
        pairs = list(zip(a, b))
        na, nb = sum(x * x for x, _ in pairs) ** 0.5, sum(y * y for _, y in pairs) ** 0.5
        return 0.0 if na == 0 or nb == 0 else sum(x * y for x, y in pairs) / (na * nb)

    for q, vec in asked:
        scores = sorted((round(cosine(vec, v), 9) for _, v in data), reverse=True)[:7]
        mine = sorted((round(r["score"], 9) for r in found if r["q"] == q), reverse=True)
        assert mine == pytest.approx(scores)


def test_nearest_of_two(spark):
    store = spark.createDataFrame([("s1", [1.0, 0.0]), ("s2", [0.0, 1.0])], "v string, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "q long, embedding array<double>")
    assert [r["v"] for r in vectors.top_vectors(asked, store, 1, "q", "v").collect()] == ["s1"]


def test_pack_evidence_levels(spark):
    rows = [(q, r, f"d{r}", '"quoted" ' * 200) for q, n in ((1, 1), (2, 12), (3, 40)) for r in range(1, n + 1)]
    df = spark.createDataFrame(rows, "question_id long, rank int, doc_id string, text string")
    got = {r["question_id"]: r for r in retrieval.pack_evidence(df, ["doc_id", "text"], max_chars=6000).collect()}
    assert got[1]["payload"].count('"doc_id"') == 1 and got[1]["truncated"]
    assert got[2]["payload"].count('"doc_id"') == 12
    assert all(r["chars_final"] <= 6000 for r in got.values())
    clipped = retrieval.pack_evidence(df, ["doc_id", "text"], max_chars=1000).where("question_id = 3").first()
    assert '"truncated":true' in clipped["payload"] and clipped["chars_final"] <= 1000


def test_placeholder_when_nothing_is_found(spark):
    asked = spark.createDataFrame([("q1", "no such words"), ("q2", "harbor road")], "question_id string, query string")
    none = F.lit(None).cast("string")
    asked = asked.select("*", F.lit(None).cast("array<double>").alias("embedding"), none.alias("session_id"))
    segments = spark.createDataFrame([("d", "s", "the harbor road map")], "doc_id string, segment_id string, text string")
    got = {r["question_id"]: r for r in retrieval.retrieve(asked, F.lit("2024-01-31").cast("timestamp_ntz"), segments=segments).collect()}
    assert got["q1"]["doc_id"] == "N/A" and got["q1"]["text_snippet"] == "no such words"
    assert got["q2"]["doc_id"] == "d" and got["q2"]["score"] == pytest.approx(0.18 + 0.52 + 0.30)


def test_segment_filters_against_brute_force(spark):
    rng = random.Random(3)
    topics, entities, types = ["a", "b", "c", "all"], ["X", "Y"], ["file", "talk", None]
    day = lambda n: datetime(2024, 1, n)
    segments, asked = [], []
    for i in range(120):
        own = ["all", *rng.sample(topics[:3], rng.randint(0, 3))] if i % 9 else None
        segments.append((f"d{i % 40}", f"s{i}", " ".join(rng.choices(WORDS[:4], k=6)), own, rng.sample(entities, rng.randint(0, 2)), rng.choice(types), day(rng.randint(1, 20)) if i % 7 else None, i, f"sp{i}"))
    for i in range(60):
        want = rng.choice([None, [], ["all"], ["a"], ["a", "all", "b"], ["nobody"], ["all", "nobody"], [None, "c"]])
        asked.append((f"q{i}", rng.choice(["alpha", "beta gam", "%", "a_pha", "zzz", "A"]), want, rng.choice([None, ["X"], ["X", "Y"]]), rng.choice([None, None, "file"]), rng.choice([None, day(8)]), rng.choice([None, day(15)])))
    got = retrieval.filtered_pairs(
        spark.createDataFrame(asked, "question_id string, query string, want_topics array<string>, want_entities array<string>, want_source_type string, want_date_from timestamp_ntz, want_date_to timestamp_ntz"),
        spark.createDataFrame(segments, "doc_id string, segment_id string, text string, topics array<string>, entities array<string>, source_type string, created_at timestamp_ntz, start_ms long, speaker string"),
        ("start_ms", "speaker"),
    )
    want = set()
    for q, query, tops, ents, kind, since, until in asked:
        regex = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in query.lower())
        for doc, seg, text, own_t, own_e, own_kind, at, start, speaker in segments:
            members = {x for x in tops or [] if x is not None} <= set(own_t or []) and set(ents or []) <= set(own_e)
            dated = (since is None or (at is not None and at >= since)) and (until is None or (at is not None and at <= until))
            if members and dated and (kind is None or kind == own_kind) and re.search(regex, text.lower(), re.DOTALL):
                want.add((q, doc, seg, start, speaker))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 300


def test_common_members_are_looked_up_by_text(spark, monkeypatch):
    schema = "doc_id string, segment_id string, text string, topics array<string>, entities array<string>, source_type string, created_at timestamp_ntz"
    segments = [(f"d{i}", "s", f"Alpha {i} beta", ["en", *(["rare"] if i in (7, 70) else [])], [], None, None) for i in range(200)]
    asked = [("common", "alpha 7", ["en"]), ("rare", "alpha 7", ["en", "rare"]), ("none", "alpha 7", ["en", "nobody"]), ("all", "alpha 19", None)]
    nothing = {"want_entities": "array<string>", "want_source_type": "string", "want_date_from": "timestamp_ntz", "want_date_to": "timestamp_ntz"}
    questions = spark.createDataFrame(asked, "question_id string, query string, want_topics array<string>")
    questions = questions.withColumns({n: F.lit(None).cast(kind) for n, kind in nothing.items()})
    by_text, search = [], retrieval.contained_pairs
    monkeypatch.setattr(retrieval, "contained_pairs", lambda q, *rest, **named: by_text.extend(r[0] for r in q.select("question_id").collect()) or search(q, *rest, **named))
    got = retrieval.filtered_pairs(questions, spark.createDataFrame(segments, schema), ("text",), {"n": F.length("text")}).collect()
    assert sorted(by_text) == ["all", "common"]
    want = {("common", f"d{i}") for i in range(200) if str(i).startswith("7")} | {("rare", "d7"), ("rare", "d70")} | {("all", f"d{i}") for i in (19, *range(190, 200))}
    assert len(got) == len(want) and {(r["question_id"], r["doc_id"]) for r in got} == want and all(r["n"] == len(r["text"]) for r in got)


def test_evidence_carries_times_speakers_and_references(spark):
    asked = spark.createDataFrame([("q", "harbor road", None, ["talk"], "u")], "question_id string, query string, embedding array<double>, want_topics array<string>, session_id string")
    segments = spark.createDataFrame(
        [("d", "s1", "the harbor road map", ["talk"], 10, 20, "ann"), ("d", "s2", "the harbor road", ["other"], 30, 40, "bob")],
        "doc_id string, segment_id string, text string, topics array<string>, start_ms long, end_ms long, speaker string",
    )
    digests = spark.createDataFrame([("u", "harbor plans")], "session_id string, digest string")
    rows = retrieval.retrieve(asked, F.lit("2024-01-31").cast("timestamp_ntz"), segments=segments, digests=digests).orderBy("rank").collect()
    assert [(r["segment_id"], r["start_ms"], r["end_ms"], r["speaker"], r["source_refs"]) for r in rows] == [
        ("s1", 10, 20, "ann", None), ("state", None, None, "context", '{"kind":"auto_handoff"}'),
    ]


def test_hybrid_works_out_no_more_than_it_reads_per_event(spark):
    """Tokens of a question belong to the question, and recall reads neither slots nor reasons of a memory."""
    from kbspark.operators import memory
    from kbspark.plans import bindings as b

    sf_dir = "/root/testdata/sf0.001"
    history = b.feedback_history(spark, sf_dir)
    assert "regexp_extract_all" not in history._jdf.queryExecution().optimizedPlan().toString()
    assert all(r["query_tokens"] for r in history.collect()) and history.count() > 0
    slim, whole = b.recallable_memories(spark, sf_dir), b.stored_memories(spark, sf_dir)
    assert "memory_slot" not in slim.columns
    asked = b.recall_queries(spark, sf_dir)
    first, second = (memory.recall(asked, items, b.as_of(), 4, memory.long_term_table(items)) for items in (slim, whole))
    assert first.exceptAll(second).count() == 0 and second.exceptAll(first).count() == 0 and first.count() > 0
