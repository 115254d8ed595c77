"""File scans: text documents, JSON lines, folders, front-matter notes, voice galleries."""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark import schemas
from kbspark.functions import text as tx
from kbspark.operators import intake
from kbspark.operators.tables import first_per_key
from kbspark.session import local_folder, make_folder, work_path

TEXT_SUFFIXES = (".txt", ".md")  # fixed values
LISTED = 50_000  # files that the driver lists at once, a fixed value


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole ``.txt`` and ``.md`` files below ``path``, white space normalised.

    Bytes that are no UTF-8 are left out. Other files are passed over by name, not read, and so are empty ones. The driver
    never holds the list of all files: in a shared local folder tasks list them; of other stores, and of paths with
    wildcards, Spark's reader takes parts of ``LISTED`` files at most, one after the other, into a table in the work folder.
    """
    folder = local_folder(spark, path)
    if folder is not None and os.path.exists(folder):
        return _normalized(_read_in_tasks(spark, folder))
    parts = _parts(spark, path)
    first = list(itertools.islice(parts, 2))
    if len(first) < 2:
        return _normalized(_read_listed(spark, first[0] if first else [path]))
    out, tasks = work_path(spark, "texts"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    for part in itertools.chain(first, parts):
        _normalized(_read_listed(spark, part).coalesce(tasks)).write.mode("append").parquet(out)
    return spark.read.schema("path string, text string").parquet(out)


def _normalized(read: DataFrame) -> DataFrame:
    """``path, text`` of ``read(path, content)``."""
    raw = read.select("path", F.col("content").cast("string").alias("value"))
    mended = F.replace(F.make_valid_utf8("value"), F.lit("\ufffd"), F.lit(""))
    text = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(mended)
    return raw.select("path", tx.normalize_space(text).alias("text"))


def _hidden(name: str) -> bool:
    """Names of folders that Spark's readers pass over."""
    marked = name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")
    return marked and not name.startswith(("_metadata", "_common_metadata"))


def _is_text(name: str) -> bool:
    """Names of files that Spark's readers take, with a suffix of text."""
    return name.lower().endswith(TEXT_SUFFIXES) and name[:1] != "." and (name[:1] != "_" or "=" in name)


def _read_in_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """``path, content`` of the text files below a shared local folder, without empty ones, as Spark's readers.

    One task lists the folder itself, several what lies below its entries, and the files found are dealt out by name.
    """

    def found(path: str, deep: bool) -> Iterator[str]:
        if not os.path.isdir(path):
            yield from [path] if _is_text(os.path.basename(path)) else []
            return
        with os.scandir(path) as entries:
            for e in entries:
                if e.is_dir():
                    if not _hidden(e.name):
                        yield from found(e.path, deep) if deep else [e.path]
                elif _is_text(e.name) and e.is_file():
                    yield e.path

    def listing(deep: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            paths = itertools.chain.from_iterable(found(os.fsdecode(x.as_py()), deep) for b in batches for x in b.column(0))
            while some := [os.fsencode(x) for x in itertools.islice(paths, 4096)]:
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary())], ["path"])

        return run

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.binary()), pa.array(contents, pa.binary())], ["path", "content"])

        paths, contents, size = [], [], 0
        for b in batches:
            for path in b.column(0).to_pylist():
                with open(path, "rb") as file:
                    content = file.read()
                if not content:
                    continue
                paths.append(path)
                contents.append(content)
                size += len(content)
                if size > 1 << 22 or len(paths) == 1024:
                    yield batch()
                    paths, contents, size = [], [], 0
        yield batch()

    dealt = int(spark.conf.get("spark.sql.shuffle.partitions")), "path"
    root = spark.range(0, 1, 1, 1).select(F.lit(folder).cast("binary").alias("path"))
    entries = root.mapInArrow(listing(False), "path binary").repartition(*dealt)
    files = entries.mapInArrow(listing(True), "path binary").repartition(*dealt)
    read_files = files.mapInArrow(read, "path binary, content binary")
    return read_files.select(F.concat(F.lit("file:"), F.col("path").cast("string")).alias("path"), "content")


def _read_listed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, content`` of the text files below ``paths``, which the driver lists."""
    either = lambda s: "".join(f"[{c}{c.upper()}]" for c in s[1:])
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{" + ",".join(either(s) for s in TEXT_SUFFIXES) + "}")
        .load(paths)
        .select("path", "content")
    )


def _parts(spark: SparkSession, path: str) -> Iterator[list[str]]:
    """Lists of paths, in whatever store, that hold all text files below ``path``, each ``LISTED`` files at most."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())

    def pieces(status) -> Iterator[tuple[str, int]]:
        at = status.getPath()
        n = store.getContentSummary(at).getFileCount() if status.isDirectory() else int(_is_text(at.getName()))
        if n <= LISTED:
            yield re.sub(r"([\[\]{}*?\\])", r"\\\1", at.toString()), n
            return
        entries = store.listStatusIterator(at)
        while entries.hasNext():
            entry = entries.next()
            if not _hidden(entry.getPath().getName()):
                yield from pieces(entry)

    part, held = [], 0
    for piece, n in itertools.chain.from_iterable(pieces(s) for s in store.globStatus(place) or ()):
        if part and held + n > LISTED:
            yield part
            part, held = [], 0
        if n:
            part.append(piece)
            held += n
    if part:
        yield part


def write_text_documents(docs: DataFrame, path: str) -> None:
    """Each row of ``docs(doc_id, text)`` as a ``.txt`` file of its own below ``path``, headed by a line with its
    encoded id, ``%`` for none.

    In a shared local folder the tasks write the files themselves: Hadoop's local store starts several processes
    for each new file. A task that runs again writes the same names again.
    """
    head = F.coalesce(F.url_encode("doc_id"), F.lit("%"))
    rows = docs.select(F.concat_ws("\n", head, "text").alias("value"))
    folder = local_folder(docs.sparkSession, path)
    if folder is None:
        # A folder of its own for every 8192 rows of a task, so that readers can list the files in parts.
        rows = rows.withColumn("part", F.shiftright(F.monotonically_increasing_id(), 13))
        rows.write.partitionBy("part").option("maxRecordsPerFile", 1).text(path)
        return

    def put(batches):
        from pyspark import TaskContext

        below, n = f"{folder}/{TaskContext.get().partitionId():05d}", 0
        os.makedirs(below, exist_ok=True)
        for batch in batches:
            for value in batch.column(0):
                with open(f"{below}/{n:08d}.txt", "wb") as out:
                    out.write(value.as_buffer())
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    make_folder(docs.sparkSession, path)
    rows.mapInArrow(put, "n long").agg(F.sum("n")).collect()


def split_heads(read: DataFrame) -> DataFrame:
    """``doc_id, text`` of files that ``write_text_documents`` wrote, read by ``read_text_documents``."""
    head = F.substring_index("text", " ", 1)
    return read.select(
        F.when(head != "%", F.url_decode(head)).alias("doc_id"),
        F.expr("substring(text, length(substring_index(text, ' ', 1)) + 2)").alias("text"),
    )


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped by the reader."""
    return spark.read.schema(schema).json(path)


def scan_folder(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """Settled files below ``root`` with their content hash; ``limit`` bounds them per
    first-level folder."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(root)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("length").alias("bytes"),
            F.sha2("content", 256).alias("source_version"),
        )
    )
    inside = F.element_at(F.split("path", root.rstrip("/") + "/", 2), 2)
    files = files.withColumn("relative", inside).withColumn("root", F.substring_index("relative", "/", 1))
    return intake.bounded_listing(files.where(intake.settled_path(F.col("relative"))), limit)


def parse_notes(notes: DataFrame, command_key: str = "command", auto_key: str = "auto", inbox: str = "inbox") -> DataFrame:
    """``notes(path, text)`` with flat ``key: value`` front matter to command, parameters and body."""
    parts = F.split("text", "---", 3)
    framed = F.col("text").startswith("---") & (F.size(parts) == 3)
    header = F.when(framed, parts[1]).otherwise(F.lit(""))
    lines = F.filter(F.split(header, "\n"), lambda x: x.rlike(r"^\s*[^:\s][^:]*:"))
    pairs = F.map_from_entries(
        tx.first_by(
            F.transform(
                lines,
                lambda x: F.struct(
                    tx.strip(F.substring_index(x, ":", 1)).alias("key"),
                    tx.strip(F.regexp_extract(x, r"(?s)^[^:]*:(.*)$", 1)).alias("value"),
                ),
            ),
            lambda e: e["key"],
        )
    )
    parsed = notes.select(
        "path",
        pairs.alias("header"),
        F.when(framed, F.regexp_replace(parts[2], r"^\n+", "")).otherwise(F.col("text")).alias("body"),
    )
    folders = F.split(F.lower("path"), "/")
    in_inbox = F.array_contains(F.slice(folders, F.lit(1), F.greatest(F.size(folders) - 1, F.lit(0))), inbox)
    header_col = F.col("header")
    return parsed.select(
        "path",
        F.nullif(header_col[command_key], F.lit("")).alias("command"),
        F.map_filter(header_col, lambda k, _: k != command_key).alias("params"),
        (F.coalesce(F.lower(header_col[auto_key]) == "true", F.lit(False)) | in_inbox).alias("auto"),
        "body",
    )


def read_voice_gallery(spark: SparkSession, root: str, pattern: str = "voiceprints.jsonl") -> DataFrame:
    """Union of the voiceprint files below ``root`` named by ``pattern``; the first row per
    voiceprint stays."""
    found = spark.read.schema(schemas.VOICEPRINTS).option("recursiveFileLookup", True)
    rows = found.option("pathGlobFilter", pattern).json(root)
    named = rows.where(F.coalesce("voiceprint_id", F.lit("")) != "")
    return first_per_key(named, ["voiceprint_id"], F.col("source_id"), F.col("speaker_local_id"))


def render_note(header: dict[str, Column], body: Column) -> Column:
    """A note with flat front matter."""
    lines = [F.concat(F.lit(f"{k}: "), v.cast("string"), F.lit("\n")) for k, v in header.items()]
    return F.concat(F.lit("---\n"), *lines, F.lit("---\n\n"), body)
