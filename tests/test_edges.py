"""Rows that the given tables do not hold: odd bytes, zones, tenants, nulls, long values."""

import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrameReader
from pyspark.sql import functions as F

from kbspark.functions import ids, routing
from kbspark.operators import matching, memory, speech, vectors
from kbspark.sources import files


def test_text_files_with_bad_bytes_and_other_suffixes(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.txt").write_bytes(b"ab\xffcd  \n x")
    (tmp_path / "deep" / "B.MD").write_text("ok \ufffd é")
    (tmp_path / "c.bin").write_bytes(b"no")
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in files.read_text_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "abcd x", "B.MD": "ok \ufffd é"}


@pytest.mark.parametrize("local", [True, False])
def test_documents_as_files_of_their_own(spark, tmp_path, monkeypatch, local):
    # Ids of any kind, repeated rows, texts of blanks; quick enough for large tables in a shared local folder.
    if not local:
        monkeypatch.setattr(files, "local_folder", lambda *_: None)
    rows = [("file:a b/1", " x\r\n y "), ("file:a b/1", " x\r\n y "), ("%", " \n"), ("é/" + "l" * 300, "\u0301 é"), (None, "no id"), ("r", "")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    files.write_text_documents(df.repartition(2), str(tmp_path / "docs"))
    got = files.split_heads(files.read_text_documents(spark, str(tmp_path / "docs"))).collect()
    want = [("file:a b/1", "x y"), ("file:a b/1", "x y"), ("%", ""), ("é/" + "l" * 300, "\u0301 é"), (None, "no id"), ("r", "")]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    files.write_text_documents(df.limit(0), str(tmp_path / "none"))
    assert files.read_text_documents(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("local", [True, False])
def test_the_driver_never_holds_a_list_of_all_documents(spark, tmp_path, monkeypatch, local):
    if not local:
        monkeypatch.setattr(files, "local_folder", lambda *_: None)
    df = spark.range(0, 40, 1, 4).selectExpr("cast(id as string) doc_id", "concat('text ', id) text")
    files.write_text_documents(df, str(tmp_path / "docs"))
    most, load = [], DataFrameReader.load

    def watched(self, *args, **kwargs):
        read = load(self, *args, **kwargs)
        most.append(len(read.inputFiles()))
        return read

    monkeypatch.setattr(DataFrameReader, "load", watched)
    monkeypatch.setattr(files, "LISTED", 15, raising=False)
    read = files.read_text_documents(spark, str(tmp_path / "docs"))
    got = files.split_heads(read).collect()
    assert sorted(map(tuple, got)) == sorted((str(i), f"text {i}") for i in range(40))
    assert max(most, default=0) <= 15 and len(read.inputFiles()) < 40


@pytest.mark.parametrize("listed", [None, 100, 2, 1])
def test_names_of_text_files(spark, tmp_path, monkeypatch, listed):
    # None: listed by tasks; else by the driver in parts of so many files. The same files as Spark's reader finds.
    names = ["a.txt", "B.MD", "sub/c.TxT", "sub/d.txt/e.md", "_a.txt", ".b.txt", "_k=v.txt", "_k=v/f.txt", "_tmp/g.txt", ".git/h.txt", "_metadata/i.md"]
    names += ["a b%41é.txt", "x[1]{y,z}?*.txt", "p[q]/r\\s.md", "n.txt.bak", "o.txt._COPYING_", "txt", "deep/1/2/3/empty.txt", "none.bin"]
    for name in names:
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text("" if "empty" in name else name)
    (tmp_path / "in" / "hollow").mkdir()
    (tmp_path / "in" / "link.txt").symlink_to(tmp_path / "in" / "a.txt")
    want = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path / "in"))
    want = {r["path"]: r["content"].decode() for r in want.collect() if r["path"].lower().endswith((".txt", ".md"))}
    assert len(want) == 11
    if listed is not None:
        monkeypatch.setattr(files, "local_folder", lambda *_: None)
        monkeypatch.setattr(files, "LISTED", listed)
    got = files.read_text_documents(spark, str(tmp_path / "in")).collect()
    assert len(got) == len(want) and dict(map(tuple, got)) == want
    for one, n in (("in/*.txt", 5), ("in/a.txt", 1), ("in/none.bin", 0), ("in/hollow", 0)):
        assert files.read_text_documents(spark, str(tmp_path / one)).count() == n, one
    with pytest.raises(AnalysisException):
        files.read_text_documents(spark, str(tmp_path / "missing"))


def test_every_file_of_a_folder_is_listed(spark, tmp_path):
    (tmp_path / "one").mkdir()
    for i in range(503):
        (tmp_path / "one" / f"{i:04d}.txt").write_text("x")
    assert files.scan_folder(spark, str(tmp_path)).count() == 503
    assert files.scan_folder(spark, str(tmp_path), 500).where("truncated").count() == 500


@pytest.mark.parametrize(
    "text, want",
    [
        ("2024-01-01T00:00:00+02:00", (2023, 12, 31, 22)), ("2024-01-01T00:00:00Z", (2024, 1, 1, 0)), ("2024-01-01T05:00:00", (2024, 1, 1, 5)),
        ("2024-01-01 03:00:00.5-0130", (2024, 1, 1, 4, 30, 0, 500000)), ("2024-01-01", (2024, 1, 1)), ("never", None), (None, None),
    ],
)
def test_times_with_zones(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(routing.parse_time(F.col("t"))).first()[0]
    assert got == (datetime.datetime(*want) if want else None)


def test_long_ids_stay_apart(spark):
    rows = spark.createDataFrame([("url:" + "a" * 300 + "1",), ("url:" + "a" * 300 + "2",)], "t string")
    got = [r[0] for r in rows.select(ids.safe_source_id(F.col("t"))).collect()]
    assert len(set(got)) == 2 and all(len(x) == 200 for x in got)


RAW = (
    "memory_id string, memory_type string, text string, topics array<string>, entities array<string>, kind string, memory_kind string,"
    " user_id string, project_id string, session_id string, importance double, confidence double, access_count long,"
    " created_at timestamp_ntz, expires_at timestamp_ntz, pinned_until timestamp_ntz"
)


def raw(key, text, user="u1", topics=(), project=None):
    at = datetime.datetime(2024, 1, 1)
    return (key, "working", text, list(topics), [], None, "semantic", user, project, None, 0.5, 0.5, 0, at, datetime.datetime(2030, 1, 1), None)


def test_stored_memories_are_whole_and_normalised(spark):
    rows = spark.createDataFrame([raw("a", "x" * 9000 + "end", "\uff21\uff22")], RAW)
    got = memory.write_batch(rows).first()
    assert got["text"].endswith("end") and got["user_id"] == "AB"


def test_recall_stays_in_its_scope(spark):
    as_of = F.lit(datetime.datetime(2024, 2, 1)).cast("timestamp_ntz")
    shared = [raw(f"{u}{i}", f"Our launch plan number {i}", u) for u in ("u1", "u2") for i in range(3)]
    items = memory.write_batch(spark.createDataFrame([*shared, raw("w", "editor notes", "u1", ["zebra"])], RAW))
    asked = [
        ("own", "launch plan", None, None, "u1"), ("all", "launch plan", None, None, None), ("kind", "launch plan", None, "procedural", "u1"),
        ("wild", "editor%zebra", None, None, None), ("one", "editor%notes", None, None, None), ("short", "n nu", None, None, "u1"), ("letter", "x", None, None, "u2"),
    ]
    queries = spark.createDataFrame([(*a, None, None) for a in asked], "query_id string, query string, want_type string, want_kind string, user_id string, project_id string, session_id string")
    found = {}
    for r in memory.recall(queries, items, as_of).collect():
        found.setdefault(r["query_id"], set()).add(r["memory_id"])
    assert found["own"] == {"u10", "u11", "u12"} and len(found["all"]) == 6
    assert "kind" not in found and "wild" not in found and "letter" not in found
    assert found["one"] == {"w"} and found["short"] >= {"u10", "u11", "u12"}
    # Pairs are made inside a scope only.
    scope = {"want_type": "memory_type", "want_kind": "memory_kind", **{n: n for n in memory.SCOPE}}
    pairs = matching.contained_pairs(queries.where("query_id = 'own'"), memory.searchable(items, "local"), "query_id", ["memory_id"], scope=scope)
    assert pairs.count() == 3


def test_gallery_keeps_other_fields(spark):
    old = spark.createDataFrame([("v1", "Ann", "SE", 1)], "voiceprint_id string, display_name string, nationality string, level int")
    new = spark.createDataFrame([("v1", "CEO", "NO"), ("v2", "CTO", None)], "voiceprint_id string, title string, nationality string")
    for overwrite, nation in ((True, "NO"), (False, "SE")):
        got = {r["voiceprint_id"]: r for r in speech.merge_gallery(old, new, overwrite).collect()}
        assert got["v1"]["nationality"] == nation and got["v1"]["level"] == 1 and got["v1"]["title"] == "CEO" and got["v2"]["nationality"] is None


@pytest.mark.parametrize("few", [True, False])
def test_vectors_without_an_embedding(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(vectors, "MAX_BROADCAST_QUERIES", 1)
    stored = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "vector_id long, embedding array<double>")
    asked = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [0.0, 2.0])], "question_id string, embedding array<double>")
    got = {(r["question_id"], r["rank"]): r["vector_id"] for r in vectors.top_vectors(asked, stored, 2, "question_id", "vector_id").collect()}
    assert got == {("a", 1): 1, ("a", 2): 3, ("c", 1): 3, ("c", 2): 1}
