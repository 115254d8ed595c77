import re
import random
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from kbspark.operators import graph, model, ops, sessions, tables
from kbspark.streaming import streams

REL = "source_id string, rel_id string, subj_entity_id string, predicate string, obj_entity_id string, doc_id string"


def check(spark, relations, entities):
    rel = spark.createDataFrame(relations, REL)
    ent = spark.createDataFrame(entities, "entity_id string, name string, type string")
    none = spark.createDataFrame([], "source_id string, predicate string, domain_type string, range_type string, description string, position int")
    rules = graph.rules_for(rel, none)
    return graph.validate(rel, graph.type_map(ent, rel), rules), rules


def test_ontology_cases(spark):
    entities = [("o1", "A", "Org"), ("o2", "B", "organization"), ("p", "P", "Person"), ("t", "T", "Topic"), ("s", "S", "Standard")]
    relations = [
        ("a", "1", "o1", "related to", "o2", "d1"), ("a", "2", "o1", "mentions", "s", "d1"), ("b", "3", "x", "unsupported_link", "y", "d1"),
        ("c", "4", "p", "has_topic", "t", "d1"), ("d", "5", "d1", "has_topic", "t", "d1"), ("e", "6", "p", " - ", "t", "d1"),
    ]
    checked, rules = check(spark, relations, entities)
    got = {r["rel_id"]: r["validation_error"] for r in checked.collect()}
    assert got == {
        "1": None, "2": None, "3": "predicate_not_in_ontology", "4": "domain_range_mismatch", "5": None, "6": "missing_predicate",
    }
    assert sorted(r["source_id"] for r in graph.publishable(checked).collect()) == ["a", "a", "d"]
    summary = {r["source_id"]: r for r in graph.validation_summary(checked, rules).collect()}
    assert summary["a"]["publish"] and not summary["c"]["publish"] and summary["a"]["rules"] == 6


def test_expand(spark):
    entities = spark.createDataFrame(
        [("e1", "Socialdemokraterna", "Org"), ("e2", "S", "Org"), ("e4", "Far", "Org")], "entity_id string, name string, type string"
    )
    relations = spark.createDataFrame([("r1", "e1", "e2"), ("r2", "e2", "e3"), ("r3", "e3", "e4"), ("r4", "e4", "e1")], "rel_id string, subj_entity_id string, obj_entity_id string")
    asked = spark.createDataFrame([("q", "socialdemokr")], "query_id string, query string")
    near, walked = graph.expand(asked, entities, relations, hops=1)
    assert {r["entity_id"] for r in near.collect()} == {"e1", "e2"} and {r["rel_id"] for r in walked.collect()} == {"r1"}
    far, walked = graph.expand(asked, entities, relations, hops=5)
    assert {(r["entity_id"], r["hop"]) for r in far.collect()} == {("e1", 0), ("e2", 1), ("e4", 3)}
    assert {r["rel_id"] for r in walked.collect()} == {"r1", "r2", "r3", "r4"}


def test_upsert_is_idempotent_and_takes_the_latest(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    source = spark.createDataFrame([(2, "old", 1), (2, "new", 2), (3, "c", 1)], "id long, v string, n int")
    once = tables.upsert(target, source, ["id"], F.col("n").desc()).select("id", "v")
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "new"), (3, "c")]
    twice = tables.upsert(once, source, ["id"], F.col("n").desc()).select("id", "v")
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))


def test_partitioned_write_replaces_only_its_partitions(spark):
    from kbspark.session import work_path

    path = work_path(spark, "parts")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "p string, v int")
    tables.write_partitioned(rows, path, "p")
    tables.write_partitioned(rows.where("p = 'a'").withColumn("v", F.lit(9)), path, "p")
    assert sorted((r["p"], r["v"]) for r in spark.read.json(path).collect()) == [("a", 9), ("b", 2)]


def test_step_status(spark):
    kind = "map<string,struct<status:string,chunk_count:int>>"
    rows = [("1", {"ingest_url": ("done", None)}), ("2", {"chunk_text": ("done", 3), "embed_chunks": ("failed", None)}), ("3", {"embed_chunks": ("done", None)}), ("4", {})]
    df = spark.createDataFrame(rows, f"id string, steps {kind}")
    got = {r["id"]: r["s"] for r in df.select("id", tables.step_status(F.col("steps")).alias("s")).collect()}
    assert got == {"1": "ingest done", "2": "chunks done", "3": "embeddings done", "4": "partial"}


def test_capped_payload(spark):
    df = spark.createDataFrame([("x" * 30,), ('"' * 900,), ("y" * 5000,)], "t string")
    got = [r[0] for r in df.select(model.capped_payload(F.to_json(F.struct("t")), 600, "input_json")).collect()]
    assert got[0] == '{"t":"' + "x" * 30 + '"}' and all('"truncated":true' in g for g in got[1:])
    assert all(len(g) <= 600 for g in got[::2])


def test_alerts_all_clear(spark):
    jobs = spark.createDataFrame([], "status string, attempts int, updated_at timestamp_ntz")
    log = spark.createDataFrame([], "created_at timestamp_ntz, error string")
    assert [r["code"] for r in ops.alerts(jobs, log, F.lit("2024-01-31").cast("timestamp_ntz")).collect()] == ["all_clear"]


def test_handoff_and_resume(spark):
    start = datetime(2024, 1, 1)
    rows = [("s", start + timedelta(minutes=m), n, f"Q: question {n}\nA: answer {n}. Next do it! Done") for n, m in enumerate((0, 1, 60))]
    turns = spark.createDataFrame(rows, "session_id string, ts timestamp_ntz, turn_no long, text string")
    cite = F.array(F.struct(F.lit("d1").alias("doc_id"), F.lit("s1").alias("segment_id")))
    digest = sessions.handoff(turns.withColumn("citations", cite), "now").first()["digest"]
    assert "- question 2" in digest and "- d1:s1" in digest and "- Next do it" in digest
    flags = {r["turn_no"]: (r["opens_session"], r["session_no"]) for r in sessions.resume_turns(turns).collect()}
    assert flags == {0: (True, 1), 1: (False, 1), 2: (True, 2)}
    shots = sessions.snapshots(turns.withColumn("question", F.lit("q")).withColumn("answer", F.lit("a")), every=2).collect()
    assert [r["turn_count"] for r in shots] == [2]


def as_files(spark, rows, schema, files=5, seed=1, last=()):
    """The rows shuffled and dealt to some files, read one file per micro-batch; ``last`` come in a file after all others."""
    from kbspark.session import work_path

    path, mixed = work_path(spark, "shuffled"), list(rows)
    random.Random(seed).shuffle(mixed)
    for part in range(files):
        spark.createDataFrame(mixed[part::files], schema).coalesce(1).write.mode("append").parquet(path)
    if last:
        time.sleep(0.05)  # files are taken by age
        spark.createDataFrame(last, schema).coalesce(1).write.mode("append").parquet(path)
    return streams.read_stream(spark, path, files_per_trigger=1)


EVENTS = "path long, event_id long, ts timestamp, ts_us long"


def events_of(n, key=lambda i: i % 3):
    start = datetime(2024, 1, 1)
    us = lambda i: i * 700_000 + (i % 5) * 90_000
    zero = int(start.replace(tzinfo=timezone.utc).timestamp() * 1_000_000)
    return [(key(i), i, start.replace(tzinfo=timezone.utc) + timedelta(microseconds=us(i)), zero + us(i)) for i in range(n)]


def debounced(rows, gap_us):
    last, out = {}, set()
    for path, event, _, ts in sorted(rows, key=lambda r: (r[3], r[1])):
        if path not in last or ts - last[path] >= gap_us:
            out.add(event)
            last[path] = ts
    return out


def test_debounce_in_the_order_of_time_whatever_the_order_of_files(spark):
    rows = events_of(60)
    # A row far past the end moves the watermark past all others.
    end = (99, 999, rows[-1][2] + timedelta(hours=2), rows[-1][3] + 7_200_000_000)
    want = debounced(rows, 2_500_000)
    stream = as_files(spark, rows, EVENTS, last=[end])
    got = [r["event_id"] for r in streams.to_table(streams.debounce(stream, "1 hour", 2.5), "debounce").collect()]
    assert sorted(got) == sorted(want)
    ntz = F.timestamp_add("MICROSECOND", F.col("ts_us") - rows[0][3], F.lit("2024-01-01").cast("timestamp_ntz"))
    df = spark.createDataFrame(rows, EVENTS).withColumn("ts", ntz)
    assert {r["event_id"] for r in streams.debounce_batch(df, 2.5).collect()} == want


def test_compaction_counts_in_order_and_forgets_the_silent(spark):
    rows = events_of(50, key=lambda i: i % 2)
    day = 86_400_000_000
    later = [(0, 100 + i, rows[-1][2] + timedelta(days=5, seconds=i), rows[-1][3] + 5 * day + i * 1_000_000) for i in range(4)]
    end = [(9, 999, rows[-1][2] + timedelta(days=9), rows[-1][3] + 9 * day)]
    from kbspark.session import work_path

    path = work_path(spark, "turns")
    for part in (rows[::2], rows[1::2], later, end):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(path)
    turns = lambda: streams.read_stream(spark, path, files_per_trigger=1).select(F.col("path").alias("session_id"), F.col("event_id").alias("turn_no"), "ts", "ts_us")
    kept = {(r["session_id"], r["turn_count"], r["turn_no"]) for r in streams.to_table(streams.compaction_stream(turns(), "1 hour", 4), "compact").collect()}
    first = {(k, n, 2 * (n - 1) + k) for k in (0, 1) for n in range(4, 26, 4)}
    assert kept == first | {(0, 28, 102)}
    fresh = {(r["session_id"], r["turn_count"], r["turn_no"]) for r in streams.to_table(streams.compaction_stream(turns(), "1 hour", 4, idle_days=2), "compact").collect()}
    assert fresh == first | {(0, 4, 103)}


def test_items_leave_by_their_newest_row(spark):
    rows = [(str(i), t, z, z // 1000 + 10_000) for _, i, t, z in events_of(60)]
    moved = [("3", rows[40][1], rows[40][2], None), ("4", rows[41][1], rows[41][2], rows[59][2] // 1000 + 90_000_000)]
    rows = [(m, t, z // 1000, leave) for m, t, z, leave in rows + moved]
    clock = rows[59][2] + 45_000
    end = ("end", rows[59][1] + timedelta(seconds=45), clock, None)  # moves the watermark past some of the times
    stream = as_files(spark, rows, "memory_id string, ts timestamp, ts_ms long, leave_ms long", last=[end])
    got = sorted((r["memory_id"], r["leave_ms"]) for r in streams.to_table(streams.expiry_stream(stream, "60 seconds"), "leave").collect())
    want = sorted((m, leave) for m, _, _, leave in rows if leave is not None and leave < clock - 60_000 and m not in ("3", "4"))
    assert got == want and 20 < len(want) < 58


class Held:
    """State of one key in memory, with the calls to it counted."""

    def __init__(self):
        self.rows, self.timers, self.calls = {}, set(), 0

    def of(self, name, _):
        held = self

        class Value:
            def exists(self):
                return bool(held.rows.get(name))

            def get(self):
                held.calls += 1
                return held.rows[name][0] if name == "timer" else iter(held.rows[name])

            def update(self, value):
                held.rows[name] = [value]
                held.calls += 1

            def appendValue(self, value):
                held.rows.setdefault(name, []).append(value)
                held.calls += 1

            def clear(self):
                held.rows.pop(name, None)

        return Value()

    getListState = getValueState = of

    def registerTimer(self, at):
        self.timers.add(at)
        self.calls += 1

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_items_of_a_group_share_state_and_timer():
    from pyspark.sql import Row

    from kbspark.streaming.state import Leaving

    class Clock:
        def getCurrentWatermarkInMs(self):
            return self.now

    dice, held, leaving, clock = random.Random(3), Held(), Leaving(), Clock()
    leaving.init(held)
    known, want, got = {}, [], []
    for now in range(0, 1000, 100):
        rows = []
        for _ in range(2000):
            ts = now + dice.randrange(100)
            rows.append((f"m{dice.randrange(3000)}", ts, ts + dice.randrange(300) if dice.random() < 0.8 else None))
        calls = held.calls
        assert list(leaving.handleInputRows((0,), iter([Row(group=0, memory_id=m, ts_ms=ts, leave_ms=leave) for m, ts, leave in rows]), clock)) == []
        clock.now = now + 50
        if (at := min(held.timers)) <= clock.now:
            got += [(now, *r) for r in leaving.handleExpiredTimer((0,), clock, None)]
            held.timers.remove(at)  # as Spark does
        assert len(held.timers) == 1 and held.calls - calls < 12
        # An item at a time, as it is stated.
        newest = {}
        for m, ts, leave in rows:
            newest[m] = max(newest.get(m, (-1, -1)), (ts, -1 if leave is None else leave))
        known.update({m: x for m, x in newest.items() if m not in known or x[0] >= known[m][0]})
        for m in [m for m, (ts, leave) in known.items() if (leave if leave >= 0 else ts) < clock.now]:
            if known.pop(m)[1] >= 0:
                want.append((now, m))
    assert sorted(r[:2] for r in got) == sorted(want) and len(want) > 3000


def test_digest_from_state_equals_the_batch_digest(spark):
    from kbspark.plans import bindings

    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    at = lambda minutes: (start + timedelta(minutes=minutes), int(start.timestamp() + 60 * minutes) * 1_000_000)
    said = lambda s, t: ("user", f"ask {t} of {s}") if t % 2 == 0 else ("assistant", f"answer {t} of {s}. next step {t}")
    rows = [(s, t, *said(s, t), *at(t)) for s in range(4) for t in range(2 + 18 * s)]
    rows += [(9, 0, "user", "never answered", *at(0)), (8, 3, "assistant", "never asked", *at(3)), (2, 100, "system", "note", *at(100)), (7, 0, *said(7, 0), *at(0)), (7, 1, *said(7, 1), *at(1))]
    schema = "session_id long, turn long, role string, text string, ts timestamp, ts_us long"
    # After 90 days session 3 goes on; it has been forgotten, so its turns from before are not in the digest.
    again = [(3, 200, "user", "back", *at(90 * 1440)), (3, 201, "assistant", "welcome", *at(90 * 1440 + 1))]
    df = spark.createDataFrame(rows, schema)
    asked = df.where("role = 'user'").select("session_id", "turn", F.col("text").alias("question"))
    answers = df.where("role = 'assistant'").select("session_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    digest = lambda pairs: {r["session_id"]: (r["turn_count"], r["digest"]) for r in sessions.handoff(bindings.as_turns(pairs), "now").collect()}
    want = digest(asked.join(answers, ["session_id", "turn"]))
    streamed = lambda **kw: {r["session_id"]: (r["turn_count"], r["digest"]) for r in streams.handoff_stream(as_files(spark, rows, schema, **kw), bindings.as_turns, "now", "1 day").collect()}
    assert streamed() == want and want[3][0] == 20 and set(want) == {0, 1, 2, 3, 7}
    other = [(5, 0, "user", "moves the clock", *at(80 * 1440))]
    from kbspark.session import work_path

    path = work_path(spark, "sessions")
    for part in (rows, other, again):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    stream = streams.read_stream(spark, path, files_per_trigger=1)
    got = {r["session_id"]: r["turn_count"] for r in streams.handoff_stream(stream, bindings.as_turns, "now", "1 day").collect()}
    assert got == {s: n for s, (n, _) in want.items()} | {3: 1}


def test_stream_upsert_keeps_the_latest_row_per_key(spark):
    rows = [(i % 7, i, f"v{i}") for i in range(90)]
    stream = as_files(spark, rows, "k long, n long, v string")
    newest = streams.upsert_stream(stream, ["k"], "n")
    assert sorted(tuple(r) for r in newest.select("k", "n", "v").collect()) == sorted({i % 7: (i % 7, i, f"v{i}") for i in range(90)}.values())


def test_a_merge_that_was_cut_off_is_finished_by_the_next_run(spark, monkeypatch):
    from kbspark.session import work_path

    base, order = work_path(spark, "merge"), [F.col("n").desc()]
    frame = lambda rows: spark.createDataFrame(rows, "k long, n long")
    tables.merge_buckets(frame([(i, 1) for i in range(20)]), f"{base}/t", f"{base}/s0", ["k"], order, buckets=4)
    update = frame([(i, 2) for i in range(0, 30, 3)])
    real = tables.write_partitioned
    monkeypatch.setattr(tables, "write_partitioned", lambda df, path, *by, **kw: real(df, path, *by, **kw) if "/s" in path[len(base):] else (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        tables.merge_buckets(update, f"{base}/t", f"{base}/s1", ["k"], order, buckets=4)
    monkeypatch.setattr(tables, "write_partitioned", real)
    tables.merge_buckets(update, f"{base}/t", f"{base}/s1", ["k"], order, buckets=4)
    got = sorted((r["k"], r["n"]) for r in spark.read.parquet(f"{base}/t").collect())
    assert got == sorted({**{i: 1 for i in range(20)}, **{i: 2 for i in range(0, 30, 3)}}.items())


def test_resume_evidence_moves_a_digest_once(spark, capsys):
    opened = spark.createDataFrame([(1, "a", True, 1), (2, "a", False, 1), (3, "a", True, 2), (4, "b", True, 1)], "turn_id int, session_id string, opens_session boolean, session_no int")
    evidence = spark.createDataFrame(
        [(1, "doc", "s", "x", 0.5, 1), (3, sessions.CONTEXT_DOC, "state", "own", 0.4, 0), (4, sessions.CONTEXT_DOC, "state", "own", 0.4, 0)],
        "turn_id int, doc_id string, segment_id string, text_snippet string, score double, rank int",
    )
    digests = spark.createDataFrame([("a", "d" * 2000)], "session_id string, digest string")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = sessions.resume_evidence(opened, evidence, digests, ["session_no"])
        out.explain("formatted")
        got = sorted((r["turn_id"], r["session_no"], r["doc_id"], r["score"], len(r["text_snippet"])) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert got == [(1, 1, sessions.CONTEXT_DOC, 1.05, 1800), (1, 1, "doc", 0.5, 1), (3, 2, sessions.CONTEXT_DOC, 1.05, 3), (4, 1, sessions.CONTEXT_DOC, 0.4, 3)]
    moved = re.findall(r"\) Exchange\s*\nInput \[\d+\]: \[([^\]]*)\]", capsys.readouterr().out)
    assert sum("digest#" in columns for columns in moved) == 1
