import pytest
from pyspark.sql import functions as F

from kbspark.operators import deletion
from kbspark.session import drop_work, path_exists, stored, work_mark, work_path


def store(spark, base):
    rows = [(f"file:d{i % 40}", i) for i in range(400)] + [(None, 999)]
    for name, key in (("manifests", "source_id"), ("kb_segments", "doc_id")):
        deletion.write_table(spark.createDataFrame(rows, f"{key} string, n long"), f"{base}/{name}", key, buckets=8)
    return {n: f"{base}/{n}" for n in ("manifests", "kb_segments")}, rows


def left(spark, folder):
    return sorted(((r[0], r["n"]) for r in spark.read.parquet(folder).collect()), key=str)


def test_sources_go_from_every_table_and_nothing_else_does(spark):
    base = work_path(spark, "store")
    folders, rows = store(spark, base)
    gone = {f"file:d{i}" for i in (0, 3, 17)} | {"file:unknown"}
    counts = deletion.delete_sources(spark, folders, spark.createDataFrame([(g,) for g in gone], "source_id string"), f"{base}/run", buckets=8)
    assert {(r["table_name"], r["deleted"]) for r in counts.collect()} == {("manifests", 30), ("kb_segments", 30)}
    want = sorted((r for r in rows if r[0] not in gone), key=str)
    assert all(left(spark, f) == want for f in folders.values())
    late = spark.createDataFrame([("file:d3", 1), ("file:d4", 2)], "source_id string, n long")
    assert [r["n"] for r in deletion.without_deleted(late, spark.read.parquet(f"{base}/run/tombstones")).collect()] == [2]


def test_a_bucket_that_loses_all_rows_is_removed(spark):
    base = work_path(spark, "store")
    folders, rows = store(spark, base)
    everything = spark.createDataFrame([(r[0],) for r in rows if r[0]], "source_id string")
    deletion.delete_sources(spark, folders, everything, f"{base}/run", buckets=8)
    assert all(left(spark, f) == [(None, 999)] for f in folders.values())


def test_a_run_that_was_cut_off_is_finished_with_the_ids_it_began_with(spark, monkeypatch):
    base = work_path(spark, "store")
    folders, rows = store(spark, base)
    doomed = spark.createDataFrame([("file:d1",), ("file:d2",)], "source_id string")
    real = deletion.write_partitioned
    monkeypatch.setattr(deletion, "write_partitioned", lambda df, path, *by, **kw: (_ for _ in ()).throw(OSError("lost")) if path == folders["kb_segments"] else real(df, path, *by, **kw))
    with pytest.raises(OSError):
        deletion.delete_sources(spark, folders, doomed, f"{base}/run", buckets=8)
    monkeypatch.setattr(deletion, "write_partitioned", real)
    counts = deletion.delete_sources(spark, folders, doomed.limit(0), f"{base}/run", buckets=8)
    assert {r["deleted"] for r in counts.collect()} == {20}
    want = sorted((r for r in rows if r[0] not in ("file:d1", "file:d2")), key=str)
    assert all(left(spark, f) == want for f in folders.values())


def test_files_that_left_a_listing_name_their_sources(spark):
    listing = spark.createDataFrame([("a/1", "v"), ("a/2", "v"), ("a/3", "v")], "path string, source_version string")
    now = listing.where("path <> 'a/2'").withColumn("source_version", F.lit("w"))
    assert [r["source_id"] for r in deletion.deleted_sources(listing, now).collect()] == ["file:a/2"]


def test_work_folders_go_when_asked(spark):
    mark = work_mark()
    a, b = stored(spark.range(3), "a"), stored(spark.range(4), "b")
    paths = [r.inputFiles()[0].rsplit("/", 1)[0] for r in (a, b)]
    drop_work(spark, mark, work_mark() - 1)
    assert [path_exists(spark, p) for p in paths] == [False, True] and b.count() == 4
    drop_work(spark, mark)
    assert not path_exists(spark, paths[1]) and work_mark() == mark
