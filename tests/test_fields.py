"""Fields that callers give, and texts that only compatibility normalisation makes equal."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from kbspark.functions import privacy, routing
from kbspark.operators import chunking, memory, model, retrieval, speech

PLAN = (
    "plan_id int, intent string, topics array<string>, entities array<string>, source_type string, memory_type string, memory_kind string, "
    "user_id string, project_id string, session_id string, date_from string, date_to string, retrieve_top_k string, need_strong_model boolean, reason string"
)


def test_plans_are_normalised_and_keep_scope_and_reason(spark):
    row = (1, " ａsk　now ", ["ﬁle", "file", None, " x\ty "], ["Ⅳ", "IV"], "ｆile", None, "Ｓemantic", " u1 ", "ｐ2", "s 3", "２024-01-01", "soon", "99", None, "be cause " * 60)
    got = model.sanitize_plans(spark.createDataFrame([row], PLAN)).first()
    assert (got["intent"], got["topics"], got["entities"], got["source_type"], got["memory_kind"]) == ("ask now", ["file", "x y"], ["IV"], "file", "semantic")
    assert (got["user_id"], got["project_id"], got["session_id"], got["date_from"], got["date_to"]) == ("u1", "p2", "s 3", "2024-01-01", None)
    assert got["retrieve_top_k"] == 20 and got["reason"].startswith("be cause be") and len(got["reason"]) <= 320
    few = spark.createDataFrame([(2, None, None, None, None)], "plan_id int, topics array<string>, entities array<string>, retrieve_top_k string, need_strong_model boolean")
    got = model.sanitize_plans(few).first()
    assert got["intent"] == "ask" and got["topics"] == [] and got["session_id"] is None and got["reason"] is None


RAW = (
    "memory_id string, memory_type string, text string, topics array<string>, entities array<string>, kind string, memory_kind string, user_id string, "
    "project_id string, session_id string, importance double, confidence double, access_count long, created_at timestamp_ntz, expires_at timestamp_ntz, "
    "pinned_until timestamp_ntz, memory_slot string, memory_value string, source_refs string"
)


def test_callers_slot_value_and_references_go_before_those_found(spark):
    base = lambda i, text, **kw: tuple({**dict(zip([c.split()[0] for c in RAW.split(", ")], [None] * 19)), "memory_id": i, "text": text, **kw}.values())
    rows = [
        base("a", "My favorite editor is vim", memory_slot=" ｓlot ", memory_value="own value", source_refs='{"memory_kind":"procedural","doc":{"id":7},"scope":{"team":"x","user_id":"old"}}', user_id="u1"),
        base("b", "My favorite editor is vim", source_refs="no json"),
        base("c", "nothing to see", source_refs=None, project_id="p"),
    ]
    got = {r["memory_id"]: r for r in memory.write_batch(spark.createDataFrame(rows, RAW)).collect()}
    refs = {i: json.loads(r["source_refs"]) for i, r in got.items()}
    assert (got["a"]["memory_slot"], got["a"]["memory_value"]) == ("slot", "own value")
    assert refs["a"]["memory_kind"] == "procedural" and refs["a"]["doc"] == {"id": 7} and refs["a"]["memory_slot"] == "slot"
    assert refs["a"]["user_id"] == "u1" and refs["a"]["scope"] == {"team": "x", "user_id": "u1"}
    assert (got["b"]["memory_slot"], refs["b"]["memory_value"]) == ("favorite_editor", "vim") and "scope" not in refs["b"]
    assert refs["c"]["scope"] == {"project_id": "p"} and "memory_slot" not in refs["c"] and refs["c"]["memory_router_reason"] == "default_semantic"
    read = {r["memory_id"]: r["user_id"] for r in memory.with_scope(memory.write_batch(spark.createDataFrame(rows, RAW)).select("memory_id", "source_refs")).collect()}
    assert read == {"a": "u1", "b": None, "c": None}


def test_todo_and_remember_see_compatibility_characters(spark):
    df = spark.createDataFrame([("x", [None, "ＴODO"], None), ("x", ["other"], "my ｔodo list"), ("x", None, None)], "text string, topics array<string>, kind string")
    assert [bool(r["t"]) for r in df.select(memory.is_todo(F.col("text"), F.col("topics"), F.col("kind")).alias("t")).collect()] == [True, True, False]
    long = "remember this: " + "word " * 900
    df = spark.createDataFrame([(long,), ("Ｒemember this: ﬁle",)], "t string")
    cut = [r["r"]["text"] for r in df.select(routing.explicit_remember(F.col("t")).alias("r")).collect()]
    whole = [r["r"]["text"] for r in df.select(routing.explicit_remember(F.col("t"), (None, None, None)).alias("r")).collect()]
    assert len(cut[0]) <= 2000 and len(whole[0]) == len("word " * 900) - 1 and cut[1] == whole[1] == "file"


def test_packed_evidence_is_normalised(spark):
    df = spark.createDataFrame([(1, 1, "ﬁle　name", 10, "ann")], "question_id long, rank int, text string, start_ms long, speaker string")
    payload = retrieval.pack_evidence(df, ["text", "start_ms", "speaker"]).first()["payload"]
    assert json.loads(payload) == [{"speaker": "ann", "start_ms": 10, "text": "file name"}]


def test_transcript_context(spark):
    rows = [("ann", 61_000, 75_999, "Organization: o"), ("MIXED", 0, 1, "Organization: o"), (None, 0, 1, ""), ("bob", None, 5, ""), ("cy", 0, 999, "")]
    df = spark.createDataFrame(rows, "s string, a long, b long, c string")
    got = [r["x"] for r in df.select(chunking.transcript_context(F.col("s"), F.col("a"), F.col("b"), F.col("c")).alias("x")).collect()]
    assert got == ["Speaker: ann, Time: 61s-75s, Organization: o", "Organization: o", "", "Speaker: bob", "Speaker: cy, Time: 0s-0s"]


def test_long_transcripts_are_clipped_from_their_first_blocks(spark):
    rng = random.Random(5)
    rows = [(d, i, " " * (i % 2) + "t" * rng.randint(0, 40)) for d, n in ((1, 3000), (2, 3), (3, 90)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id int, seq int, text string").repartition(5)
    for block in (7, 1024):
        got = {r["doc_id"]: tuple(r)[1:] for r in speech.plain_transcripts(df, 4000, block).collect()}
        for d in (1, 2, 3):
            text = "\n".join(t.strip() for k, _, t in rows if k == d and t.strip())
            assert got.get(d, ("", 0, False)) == (text[:4000], len(text), len(text) > 4000)


def test_pseudonyms_keep_the_first_category_and_adjacent_matches(spark):
    token = lambda c, v: f"[PII_{c.upper()}_{hashlib.sha256(f'k|{c}|{v}'.encode()).hexdigest()[:10]}]"
    texts = {
        "a@b.co c@d.co": f"{token('email', 'a@b.co')} {token('email', 'c@d.co')}",
        "8001011234, call 8001011234": f"{token('se_personnummer', '8001011234')}, call {token('se_personnummer', '8001011234')}",
        "no data": "no data", "": "",
    }
    df = spark.createDataFrame([(t,) for t in [*texts, "ip 10.0.0.1 end", None]], "t string")
    got = {r["t"]: r["p"] for r in df.select("t", privacy.pseudonymize_column(F.col("t"), "k").alias("p")).collect()}
    assert got[None] is None
    assert all(got[t] == want for t, want in texts.items())
    assert got["ip 10.0.0.1 end"].startswith("ip [PII_") and got["ip 10.0.0.1 end"].endswith("] end")


def test_gallery_fields_merge_and_are_part_of_the_text(spark):
    schema = "voiceprint_id string, display_name string, city string, confidence double, contacts array<string>, credits map<string,string>, ebucore string"
    old = spark.createDataFrame([("v", "Ann", "", 0.4, ["mail:a", None], {"film": "x"}, None)], schema)
    new = spark.createDataFrame([("v", "Anna", "Lund", 0.9, ["mail:a", "tel:1"], {"film": "y", "tv": "z"}, '{"@id":1}'), ("w", "Bo", None, None, None, None, None)], schema)
    put = {r["voiceprint_id"]: r for r in speech.merge_gallery(old, new, True).collect()}
    kept = {r["voiceprint_id"]: r for r in speech.merge_gallery(old, new, False).collect()}
    assert (put["v"]["city"], put["v"]["confidence"], put["v"]["contacts"], put["v"]["credits"]) == ("Lund", 0.9, ["mail:a", "tel:1"], {"film": "y", "tv": "z"})
    assert (kept["v"]["display_name"], kept["v"]["city"], kept["v"]["confidence"], kept["v"]["credits"], kept["v"]["ebucore"]) == ("Ann", "Lund", 0.4, {"film": "x"}, '{"@id":1}')
    texts = {r["voiceprint_id"]: r["text"] for r in speech.gallery_text(speech.merge_gallery(old, new, True)).collect()}
    assert texts == {"v": 'display_name: Anna\ncontacts: ["mail:a","tel:1"]\nebucore: {"@id":1}', "w": "display_name: Bo"}
