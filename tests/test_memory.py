from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kbspark.functions import routing
from kbspark.operators import feedback, memory
from kbspark.operators.ordered import beyond_newest, number_rows, previous_time, running_sum

NOW = datetime(2024, 1, 31)
RAW = (
    "memory_id string, memory_type string, text string, topics array<string>, entities array<string>, kind string, "
    "memory_kind string, user_id string, project_id string, session_id string, importance double, confidence double, "
    "access_count long, created_at timestamp_ntz, expires_at timestamp_ntz, pinned_until timestamp_ntz"
)


def as_of():
    return F.lit("2024-01-31").cast("timestamp_ntz")


def raw(spark, *rows):
    base = dict(
        memory_type="working", topics=[], entities=[], kind=None, memory_kind=None, user_id=None, project_id=None,
        session_id=None, importance=0.5, confidence=0.7, access_count=0, created_at=NOW - timedelta(days=1),
        expires_at=None, pinned_until=None,
    )
    names = [f.split()[0] for f in RAW.split(", ")]
    return spark.createDataFrame([tuple({**base, **r}[n] for n in names) for r in rows], RAW)


def queries(spark, *rows):
    names = ["query_id", "query", "want_type", "want_kind", "user_id", "project_id", "session_id"]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"{n} string" for n in names))


def test_routing(spark):
    df = spark.createDataFrame(
        [("Step by step workflow: 1. run tests 2. deploy", None), ("we talked about this yesterday", "session"), ("my favorite editor is vim.", None)],
        "t string, hint string",
    )
    rows = df.select(
        routing.route(F.col("t"), F.col("hint"), F.lit(None).cast("string")).alias("r"), routing.slot_and_value(F.col("t")).alias("s")
    ).collect()
    assert [r["r"]["memory_kind"] for r in rows] == ["procedural", "episodic", "semantic"]
    assert tuple(rows[2]["s"]) == ("favorite_editor", "vim") and rows[0]["s"] is None


def test_remember(spark):
    df = spark.createDataFrame([("remember this: my favorite color is blue",), ("Remember as procedural: run it",), ("hi",)], "t string")
    rows = [r["r"] for r in df.select(routing.explicit_remember(F.col("t")).alias("r")).collect()]
    assert (rows[0]["text"], rows[0]["memory_kind"]) == ("my favorite color is blue", None)
    assert (rows[1]["text"], rows[1]["memory_kind"]) == ("run it", "procedural")
    assert not rows[2]["is_command"]


def test_recall_expiry_kind_and_scope(spark):
    items = memory.write_batch(
        raw(
            spark,
            dict(memory_id="live", text="Project Harbor launch checklist", user_id="a"),
            dict(memory_id="gone", text="Harbor temporary note", expires_at=NOW - timedelta(days=1)),
            dict(memory_id="other", text="Harbor for another", user_id="b", memory_kind="procedural"),
        )
    )
    asked = queries(
        spark, dict(query_id="1", query="harbor"), dict(query_id="2", query="harbor", user_id="a"),
        dict(query_id="3", query="HARBOR", want_kind="procedural"), dict(query_id="4", query="zzz"),
    )
    got = {}
    for r in memory.recall(asked, items, as_of()).collect():
        got.setdefault(r["query_id"], set()).add(r["memory_id"])
    assert got == {"1": {"live", "other"}, "2": {"live"}, "3": {"other"}}


def editors(spark, values):
    rows = [
        dict(memory_id=f"m{i}", text=f"My favorite editor is {v}", user_id="u", created_at=NOW - timedelta(hours=9000 - i))
        for i, v in enumerate(values)
    ]
    return memory.write_batch(raw(spark, *rows, dict(memory_id="other", text="My favorite editor is vim", user_id="w"), dict(memory_id="none", text="hello")))


@pytest.mark.parametrize("block", [3, 4096])
def test_supersede_equals_replay(spark, block):
    values = ["vim", "helix", "vim", "vim", "vim", "vim", "emacs", "nano", "helix", "helix", "vim", "ed", "ed", "ed", "ed"]
    got = {r["memory_id"]: r for r in memory.supersede(editors(spark, values), 2, block).collect()}
    for i, v in enumerate(values):
        r, old = got[f"m{i}"], [j for j in range(i) if values[j] != v]
        new = [j for j in range(i + 1, len(values)) if values[j] != v]
        name = lambda found, at: f"m{found[at]}" if found else None
        assert (r["n_supersedes"], r["n_superseded"]) == (len(old), len(new))
        assert (r["superseded_by"], r["replaced_id"], r["replaced_by"]) == (name(new, -1), name(old, -1), name(new, 0))
        assert r["supersedes"] == [f"m{j}" for j in reversed(old) if j >= i - 2]
        assert r["supersede_reason_code"] == ("slot_value_conflict" if new else None)
    assert got["other"]["superseded_by"] is None and got["none"]["replaced_id"] is None


def test_a_long_run_of_one_value_hides_nothing(spark):
    values = ["vim"] + ["helix"] * 70 + ["vim"] * 5000 + ["ed"]
    items = editors(spark, values)
    got = {r["memory_id"]: r for r in memory.supersede(items, block=64).collect()}
    assert {got[f"m{i}"]["superseded_by"] for i in range(5071)} == {"m5071"}
    assert got["m61"]["replaced_by"] == got["m1"]["replaced_by"] == "m71" and got["m5070"]["replaced_id"] == "m70"
    assert (got["m5070"]["n_supersedes"], got["m1"]["n_superseded"]) == (70, 5001)
    events = {(r["memory_id"], r["event"]): r for r in memory.revision_events(items, block=64).collect()}
    assert len(events) == 2 * 5072 - 1 - 1
    r = events["m5070", "supersedes"]
    assert (r["counterpart_memory_id"], r["previous_value"], r["new_value"], r["memory_slot"]) == ("m70", "helix", "vim", "favorite_editor")
    r = events["m0", "superseded"]
    assert (r["counterpart_memory_id"], r["previous_value"], r["new_value"], r["reason_code"]) == ("m1", "vim", "helix", "slot_value_conflict")
    assert r["at"] == NOW - timedelta(hours=9000 - 1)


def test_scope_is_read_from_variants(spark):
    """A filter on a promoted field, and all rows read whole; the items themselves come out of Python."""
    items = memory.write_batch(raw(spark, *[dict(memory_id=f"m{i}", text=f"note {i}", user_id=f"u{i % 2}", project_id=" ｐ1 " if i % 3 else None) for i in range(12)]))
    refs = F.to_json(F.struct("memory_kind", F.struct("project_id", "user_id").alias("scope")))
    found = memory.with_scope(items.withColumn("source_refs", refs).select("memory_id", "text", "source_refs"))
    assert dict(found.dtypes)["source_refs"] == "variant"
    kept = found.where((F.col("project_id") == "p1") & F.col("text").ilike("%note%")).collect()
    assert {r["memory_id"] for r in kept} == {f"m{i}" for i in range(12) if i % 3} and {r["user_id"] for r in kept} == {"u0", "u1"}
    odd = [(1, '{"user_id":"a","scope":{"user_id":"b"}}'), (2, '{"user_id":" ","scope":{"user_id":"b"}}'), (3, "no json"), (4, None), (5, '{"user_id":7}'), (6, "[]")]
    rows = memory.with_scope(spark.createDataFrame(odd, "id int, source_refs string")).orderBy("id").collect()
    assert [r["user_id"] for r in rows] == ["a", "b", None, None, "7", None]


def test_maintenance_and_stats(spark):
    rows = [
        dict(memory_id="keep", text="a"),
        dict(memory_id="expired", text="b", expires_at=NOW - timedelta(days=1)),
        dict(memory_id="pinned", text="b", expires_at=NOW - timedelta(days=1), pinned_until=NOW + timedelta(days=1)),
        dict(memory_id="oldfb", text="c", kind="retrieval_feedback", created_at=NOW - timedelta(days=5)),
        dict(memory_id="fb1", text="c", kind="retrieval_feedback", created_at=NOW - timedelta(hours=5)),
        dict(memory_id="fb2", text="c", kind="retrieval_feedback", created_at=NOW - timedelta(hours=4)),
    ]
    items = memory.write_batch(raw(spark, *rows))
    doomed = {r["memory_id"]: r["reason"] for r in memory.maintenance(items, as_of(), retention_days=1, keep=1).collect()}
    assert doomed == {"expired": "expired", "oldfb": "feedback_retention", "fb1": "feedback_overflow"}


def test_ordered_helpers_match_a_plain_order(spark):
    rows = [("k" if i % 3 else "hot", NOW + timedelta(seconds=(i * 37) % 400), i) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id long")
    placed = number_rows(df, ["k"], "ts", ["id"], seconds=30)
    timed = previous_time(placed, ["k"], "ts", ["id"], seconds=30)
    total = running_sum(timed, ["k"], "ts", ["id"], "id", "total", seconds=30)
    got = {(r["k"], r["id"]): r for r in total.collect()}
    for key in ("k", "hot"):
        ordered, last, running = sorted((ts, i) for k, ts, i in rows if k == key), None, 0
        for n, (ts, i) in enumerate(ordered, 1):
            running += i
            r = got[(key, i)]
            assert (r["position"], r["previous"], r["total"]) == (n, last, running)
            last = ts
    over = {r["id"] for r in beyond_newest(df, ["k"], 5, "ts", "id").collect()}
    assert over == {i for key in ("k", "hot") for _, i in sorted((ts, i) for k, ts, i in rows if k == key)[:-5]}


def feedback_case(spark, history, **settings):
    asked = spark.createDataFrame([(1, "harbor roadmap timeline", "u", None, None)], "question_id long, query string, user_id string, project_id string, session_id string")
    rows = spark.createDataFrame([(1, "good", "s", 0.5, 0.5), (1, "bad", "s", 0.5, 0.5)], "question_id long, doc_id string, segment_id string, score double, final_score double")
    store = spark.createDataFrame(
        history,
        "feedback_id long, created_at timestamp_ntz, user_id string, project_id string, session_id string, query_tokens array<string>, "
        "signals array<struct<doc_id:string,segment_id:string,outcome:string>>",
    )
    return {r["doc_id"]: r for r in feedback.rerank(rows, asked, store, as_of(), **settings).collect()}


TOKENS = ["harbor", "roadmap", "timeline"]
SIGNALS = [("good", "s", "cited"), ("bad", "s", "missed")]


def test_feedback_lifts_cited(spark):
    got = feedback_case(spark, [(1, NOW, "u", "p", None, TOKENS, SIGNALS)])
    assert got["good"]["feedback_boost"] == pytest.approx(0.12) and got["bad"]["final_score"] < 0.5
    assert got["good"]["final_score"] == pytest.approx(0.62)


def test_feedback_scope_decay_and_cluster_cap(spark):
    assert feedback_case(spark, [(1, NOW, "other", None, None, TOKENS, SIGNALS)])["good"]["feedback_boost"] is None
    fresh = feedback_case(spark, [(1, NOW, "u", None, None, TOKENS, SIGNALS)], half_life_hours=1.0)
    old = feedback_case(spark, [(1, NOW - timedelta(hours=3), "u", None, None, TOKENS, SIGNALS)], half_life_hours=1.0)
    assert fresh["good"]["feedback_boost"] > old["good"]["feedback_boost"] > 0
    twice = [(i, NOW, "u", None, None, TOKENS, SIGNALS) for i in (1, 2)]
    assert feedback_case(spark, twice, cluster_cap=1, cited_boost=0.1)["good"]["feedback_boost"] == pytest.approx(0.15)
