"""Structured Streaming jobs: intake, debounce, buckets, sessions, digests, snapshots, expiry, upsert."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.operators import intake, sessions
from kbspark.operators.tables import first_per_key, merge_buckets
from kbspark.session import path_exists, work_path
from kbspark.streaming.state import Debounce, EveryNth, Leaving, NewestTurns, with_state


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """A parquet folder or file as a stream; the files per trigger bound a micro-batch.

    The path is given as a pattern, since a stream source takes a plain path for a folder.
    """
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern)


def to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run over all available input in append mode and read the result back as a batch."""
    spark = stream.sparkSession
    path = work_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{path}/data")
        .option("checkpointLocation", f"{path}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def each_batch(stream: DataFrame, name: str, write: Callable[[DataFrame, str], None]) -> str:
    """Run ``write(batch, folder)`` per micro-batch. The folder is named by the batch id, so a
    batch that runs again after a failure replaces its own output."""
    path = work_path(stream.sparkSession, name)
    _run_batches(stream, f"{path}/checkpoint", lambda batch, i: write(batch, f"{path}/data/batch={i}"))
    return f"{path}/data"


def _run_batches(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> None:
    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def into_table(stream: DataFrame, name: str, keys: list[str], order: Callable[[int], list[Column]], shape: Callable[[DataFrame], DataFrame] | None = None, buckets: int = 64) -> DataFrame:
    """Merge every micro-batch of a stream into a keyed table, and read the table back.

    A batch first writes its rows to a folder of its own, so that they are computed once. The table is
    cut into buckets by key and a batch rewrites only those it touches (``merge_buckets``).
    """
    spark = stream.sparkSession
    base = work_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        incoming = f"{base}/incoming/batch={number}"
        (shape(batch) if shape else batch).write.mode("overwrite").parquet(incoming)
        merge_buckets(spark.read.parquet(incoming), f"{base}/table", f"{base}/staged/batch={number}", keys, order(number), buckets)

    _run_batches(stream, f"{base}/checkpoint", write)
    if not path_exists(spark, f"{base}/table"):  # no row came
        return spark.createDataFrame([], (shape(stream) if shape else stream).schema)
    return spark.read.parquet(f"{base}/table").drop("bucket")


def intake_stream(files: DataFrame, manifests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Settled file versions of a stream ``files(path, source_id, source_version)`` with the
    reason they are taken or skipped."""

    def write(batch: DataFrame, folder: str) -> None:
        settled = batch.where(intake.settled_path(F.col("path"))).dropDuplicates(["source_id", "source_version"])
        intake.new_file_versions(settled, manifests, jobs).write.mode("overwrite").parquet(folder)

    path = each_batch(files, "intake", write)
    # A version seen in several batches keeps its first outcome.
    rows = files.sparkSession.read.parquet(path)
    return first_per_key(rows, ["source_id", "source_version"], F.col("batch")).drop("batch")


def debounce(events: DataFrame, late: str, gap_seconds: float = 1.2) -> DataFrame:
    """Drop events of a path that follow its last accepted event within the gap.

    ``events(path, event_id, ts, ts_us)``. Events wait until the watermark, ``late`` behind the newest one,
    has passed them, and are then judged in the order of time, however they came; the rule compares with
    accepted events only, which no built-in deduplication does. A path is forgotten a gap after its last one.
    """
    timed = events.withColumn("ts", F.date_trunc("MILLISECOND", "ts")).withWatermark("ts", late)
    return with_state(timed, "path", Debounce(int(gap_seconds * 1_000_000)), "path long, event_id long, ts_us long")


def debounce_batch(events: DataFrame, gap_seconds: float = 1.2) -> DataFrame:
    """The same rule over a table: an event whose predecessor is a full gap away is always
    accepted, so only the runs of closer events are folded."""
    from kbspark.operators.ordered import previous_time, running_sum

    timed = previous_time(events, ["path"], "ts", ["event_id"])
    gap = int(gap_seconds * 1_000_000)
    away = F.timestamp_diff("MICROSECOND", F.col("previous"), F.col("ts")) >= gap
    opens = timed.withColumn("_open", F.when(F.col("previous").isNull() | away, 1).otherwise(0))
    runs = running_sum(opens, ["path"], "ts", ["event_id"], "_open", "_run")
    rows = F.array_sort(F.collect_list(F.struct("ts_us", "event_id")))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<struct<ts_us:bigint,event_id:bigint>>").alias("kept"))

    def fold(acc, row):
        ok = acc["last"].isNull() | (row["ts_us"] - acc["last"] >= gap)
        return F.struct(
            F.when(ok, row["ts_us"]).otherwise(acc["last"]).alias("last"),
            F.when(ok, F.concat(acc["kept"], F.array(row))).otherwise(acc["kept"]).alias("kept"),
        )

    kept = runs.groupBy("path", "_run").agg(rows.alias("_rows"))
    return kept.select("path", F.inline(F.aggregate("_rows", start, fold, lambda acc: acc["kept"])))


def bucket_counts(events: DataFrame, late: str, minutes: int = 60) -> DataFrame:
    """Events and errors per tumbling window; a window is final once the watermark, ``late``
    behind the newest event, passes it. Rows that come later still are left out."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", f"{minutes} minutes"))
        .agg(F.count(F.lit(1)).alias("events"), F.count(F.when(F.col("event_type") == "error", 1)).alias("errors"))
        .select(F.col("window.start").alias("start"), "events", "errors")
    )


def session_counts(events: DataFrame, late: str, gap_minutes: int = 45) -> DataFrame:
    """One row per finished session of a key; ``late`` as in ``bucket_counts``."""
    return (
        events.withWatermark("ts", late)
        .groupBy("session_id", F.session_window("ts", f"{gap_minutes} minutes"))
        .agg(F.count(F.lit(1)).alias("turns"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        .select("session_id", "turns", "first_ts", "last_ts")
    )


def handoff_stream(rows: DataFrame, shape: Callable[[DataFrame], DataFrame], as_of_text: str, late: str, limit: int = 20, idle_days: int | None = 30) -> DataFrame:
    """The digest of every session, refreshed for those a micro-batch touches.

    ``rows(session_id, turn, role, text, ts, ts_us)``. The state of a session is its newest ``limit`` turns, so no
    stored table is read again, and rows may come in any order; ``idle_days`` after its last row it is
    forgotten, while its digest stays in the table. ``shape`` gives turns ``(session_id, turn, question,
    answer)`` the form that digests are made of.
    """
    idle = None if idle_days is None else idle_days * 86_400_000_000
    recent = with_state(
        rows.withWatermark("ts", late), "session_id", NewestTurns(limit, idle), "session_id long, turn long, question string, answer string", "update"
    )
    digest = lambda batch: sessions.handoff(shape(batch), as_of_text, limit)
    # A later batch holds the newer digest.
    return into_table(recent, "handoff", ["session_id"], lambda number: [F.col("_fresh").desc()], digest)


def compaction_stream(turns: DataFrame, late: str, every: int = 12, idle_days: int | None = None) -> DataFrame:
    """A row for every ``every``-th turn of a session in the order of time; ``turns(session_id, turn_no, ts, ts_us)``.

    Turns wait until the watermark has passed them; what stays of a session is their number, until it was
    silent for ``idle_days``.
    """
    idle = None if idle_days is None else idle_days * 86_400_000_000
    timed = turns.withColumn("ts", F.date_trunc("MILLISECOND", "ts")).withWatermark("ts", late)
    return with_state(timed, "session_id", EveryNth(every, idle), "session_id long, turn_count long, turn_no long")


def expiry_stream(items: DataFrame, late: str, groups: int = 4096) -> DataFrame:
    """Items that leave, with the time they leave, once the watermark has passed it.

    ``items(memory_id, ts, ts_ms, leave_ms)``: ``leave_ms`` is the later of expiry and pin, null for items that
    stay; the newest row of an item counts. Items are dealt to ``groups`` keys by the hash of their id; each
    has one event-time timer, and its waiting items are read and written together.
    """
    timed = items.withWatermark("ts", late)
    dealt = timed.select(F.pmod(F.xxhash64("memory_id"), F.lit(groups)).alias("group"), "memory_id", "ts_ms", "leave_ms", "ts")
    return with_state(dealt, "group", Leaving(), "memory_id string, leave_ms long")


def upsert_stream(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Latest row per key of a stream, kept in one table by the keyed upsert of each micro-batch."""
    return into_table(rows, "upsert", keys, lambda number: [F.col(order).desc(), F.col("_fresh").desc()])
