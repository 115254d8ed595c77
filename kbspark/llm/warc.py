r"""Legacy archive conversion: ARC files of either version to equivalent WARC records.

Archives are written and read by Spark's own text source, so they may lie in any store it
reaches: an ARC record is a row ended by ``\n``, a WARC record a row ended by ``\r\n\r\n``,
and each partition becomes one gzip-compressed archive. Such a file is read in order by one
task, which takes a record's content by its declared length, whatever line ends it holds, and
keeps no more than one record.

The converter synthesises what ARC lacks: record ids (name-based UUIDs over the archived URL,
date, page and payload), W3C timestamps, record types by scheme, and SHA-256 digests. Records
with equal payloads of at least ``MIN_SHARED`` bytes refer to the one with the smallest page id.

Defined results: a null html is an empty payload; a null or empty URL is written as ``-`` and
read back as null; blanks and line ends in a URL are percent-encoded; a null page id is kept as null
and never the target of a reference unless all equal payloads have none; repeated rows of a page
id are records of their own and all of them are what the smallest id is; an empty table gives
archives without records; blocks and payloads in any encoding are carried as bytes, and header lines
that are no UTF-8 are taken as Latin-1. Only ``page_id, url, html`` are read, further columns are ignored.

A file is one gzip member, so its records are read in order and not by offset.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.session import stored, work_path

MIN_SHARED = 100
ARC_DATE = "20240101000000"
# The header fields that each version of the format declares.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122
ARC_END, WARC_END = "\n", "\r\n\r\n"
# The fastest compression: archives of a conversion are read once or few times.
GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


# --- ARC -------------------------------------------------------------------------------


def text_of(raw: bytes) -> str:
    """Header bytes as text: UTF-8, or Latin-1 as older crawlers wrote it."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def version_block(version: int, name: str, date: str = ARC_DATE) -> str:
    body = f"{version} 0 kbspark\n{ARC_FIELDS[version]}\n"
    extra = "" if version == 1 else f" 200 - - 0 {name}"
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{extra} {len(body)}\n{body}"


def arc_url(url: str | None) -> str:
    quoted = "".join(f"%{ord(c):02X}" if c <= " " else c for c in url or "")
    return quoted or "-"


def arc_record(version: int, name: str, page_id: int | None, url: str | None, html: str, date: str = ARC_DATE) -> str:
    size = len(html.encode())
    content = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n"
        f"X-Page-Id: {'' if page_id is None else page_id}\r\n\r\n"
    )
    extra = "" if version == 1 else f" 200 - - 0 {name}"
    return f"{arc_url(url)} 0.0.0.0 {date} text/html{extra} {len(content) + size}\n{content}{html}"


def write_arc(pages: DataFrame, path: str) -> str:
    """Legacy archives of ``pages``, one per partition, of both versions in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, name = 1 + part % 2, f"pages-{part:05d}.arc"
        yield pa.RecordBatch.from_pydict({"value": [version_block(version, name)]})
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(3)]
            yield pa.RecordBatch.from_pydict(
                {"value": pa.array([arc_record(version, name, p, u, h or "") for p, u, h in zip(*cols)], pa.string())}
            )

    rows = pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "value string")
    rows.write.options(**GZIP, lineSep=ARC_END).text(path)
    return path


def contents(pieces: Iterator[tuple[str, bytes]], end: bytes, size_of) -> Iterator[tuple[str, bytes, bytes]]:
    """File, header and content of each record, from the pieces between two ends.

    ``size_of(header)`` is the declared length; the content is put together from as many pieces
    as have that many bytes, ends between them included. A content that ends like half an end is parted too
    early; what is left over is the start of the next record. Blank pieces between records are skipped.
    """
    left: list[tuple[str, bytes]] = []
    for file, header in iter(lambda: left.pop() if left else next(pieces, None), None):
        if not header.strip():
            continue
        size = size_of(file, header)
        parts, have = [], -len(end)
        while have < size:
            where, piece = left.pop() if left else next(pieces, (None, b""))
            if where != file:
                raise ValueError(f"a record of {file} ends before its declared length {size}")
            parts.append(piece)
            have += len(end) + len(piece)
        content = end.join(parts)
        if have != size:
            if content[size : size + len(end)] != end:
                raise ValueError(f"a record of {file} has {have} bytes and declares {size}")
            left.append((file, content[size + len(end) :]))
        yield file, header, content[:size]


def parse_arc(pieces: Iterator[tuple[str, bytes]], blocks: bool = False) -> Iterator[dict]:
    """Records of ARC files given line by line; a file's version block names its header fields, and is a row of its own
    with ``info`` if ``blocks`` is set."""
    fields: dict[str, list[str]] = {}

    def size_of(file: str, header: bytes) -> int:
        return int(header.rsplit(b" ", 1)[1])

    for file, header, content in contents(pieces, b"\n", size_of):
        if header.startswith(b"filedesc://"):
            lines = text_of(content).split("\n")
            fields[file] = lines[1].split(" ")
            name, date = text_of(header).split(" ")[0].removeprefix("filedesc://"), text_of(header).split(" ")[2]
            if blocks:
                yield {"info": f"{lines[0].split(' ')[0]} {name}", "Archive-date": date, "content": content}
            continue
        values = text_of(header).split(" ")
        if file not in fields or len(values) != len(fields[file]):
            raise ValueError(f"the header of a record of {file} does not have the declared fields")
        yield dict(zip(fields[file], values)) | {"content": content}


def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for b in batches:
        yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist())


def read_text(spark: SparkSession, path: str, end: str) -> DataFrame:
    rows = spark.read.option("lineSep", end).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))


def http_parts(content: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, header block and payload of an archived HTTP response."""
    block, _, payload = content.partition(b"\r\n\r\n")
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, block, payload


def page_of(http: dict[str, str]) -> int | None:
    return int(http["x-page-id"]) if http.get("x-page-id") else None


ARC_INDEX = "page_id bigint, payload_bytes bigint, payload_digest string, url string, date string"
ARC_RECORDS = ARC_INDEX + ", http binary, payload binary, info string"
ARROW = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def columns_of(schema: str) -> tuple[list[str], list[pa.DataType]]:
    names, kinds = zip(*(x.split(" ") for x in schema.split(", ")))
    return list(names), [ARROW[k] for k in kinds]


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of ARC archives, blocks and payloads as they are, whatever bytes they hold; ``info`` tells the version
    and name of a file on the row of its version block. Without ``payloads`` only what references need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for r in parse_arc(pieces_of(batches), payloads):
            if "info" in r:
                rows.append([None, None, None, None, r["Archive-date"], None, None, r["info"]])
                continue
            http, block, payload = http_parts(r["content"])
            row = [page_of(http), len(payload), hashlib.sha256(payload).hexdigest(), None if r["URL"] == "-" else r["URL"], r["Archive-date"]]
            if payloads:
                row += [block, payload, None]
                held += len(payload)
            rows.append(row)
            if len(rows) == 4096 or held > 8_000_000:
                yield as_batch(rows, names, types)
                rows, held = [], 0
        if rows:
            yield as_batch(rows, names, types)

    schema = ARC_RECORDS if payloads else ARC_INDEX
    names, types = columns_of(schema)
    return read_text(spark, path, ARC_END).mapInArrow(run, schema)


def as_batch(rows: list, names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


# --- WARC ------------------------------------------------------------------------------


def record_id(url: str | None, date: str, page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{url} {date} {page_id} {digest}')}>"


def warc_date(date: str) -> str:
    """The 14 digits of an ARC date as a W3C timestamp; shorter dates are filled up."""
    d = date + "00000101000000"[len(date) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def info_record(info: str, date: str) -> bytes:
    """The ``warcinfo`` record that stands for the version block of an ARC file."""
    version, name = info.split(" ", 1)
    block = f"software: kbspark\r\nformat: WARC File Format 1.0\r\ndescription: converted from {name}, ARC version {version}\r\n".encode()
    head = [
        "WARC/1.0", "WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(info, date, None, '')}", f"WARC-Date: {warc_date(date)}",
        "Content-Type: application/warc-fields", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block


def warc_record(page_id, size, digest, url, date, http, payload, first, first_url, first_date) -> bytes:
    """The WARC record of one ARC record; ``first`` is the page id it repeats, with its URL and date, or none."""
    head = ["WARC/1.0"]
    web = url is None or url.startswith(("http:", "https:"))
    kind = "revisit" if first is not None else "response" if web else "resource"
    head += [f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(url, date, page_id, digest)}", f"WARC-Date: {warc_date(date)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {url}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    block, mime = http + b"\r\n\r\n", "application/http; msgtype=response"
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {record_id(first_url, first_date, first, digest)}")
        if first_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {first_url}")
        head += [f"WARC-Refers-To-Date: {warc_date(first_date)}", f"X-Refers-To-Page: {first}", f"X-Payload-Length: {size}"]
    elif kind == "resource":
        # No exchange was recorded, only what was found; its own headers stay as fields of the record.
        fields = http_parts(block)[0]
        block, mime = payload, fields.get("content-type", "application/octet-stream")
        head.append(f"X-Page-Id: {'' if page_id is None else page_id}")
    else:
        block += payload
    head += [f"Content-Type: {mime}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block


def convert(spark: SparkSession, arc: str, warc: str) -> str:
    """WARC archives of ARC archives, equal payloads written once.

    The archives are read twice: once for an index of digests, from which only those that occur
    again are kept, and once to write. Payloads move only if these digests are too many for
    Spark to send to all tasks.
    """
    index = read_arc(spark, arc, payloads=False).filter(F.col("payload_bytes") >= MIN_SHARED)
    origin = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url", "date"))).alias("o")
    again = index.groupBy(F.col("payload_digest").alias("shared")).agg(origin, F.count(F.lit(1)).alias("n"))
    again = again.filter((F.col("n") > 1) & F.col("o").isNotNull())
    again = stored(again.select("shared", F.col("o.page_id").alias("first"), F.col("o.url").alias("first_url"), F.col("o.date").alias("first_date")), "warc-again")
    records = read_arc(spark, arc).join(again, F.col("payload_digest") == F.col("shared"), "left")
    repeats = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))

    @F.arrow_udf("binary")
    def render(p: pa.Array, n: pa.Array, d: pa.Array, u: pa.Array, t: pa.Array, h: pa.Array, x: pa.Array, f: pa.Array, fu: pa.Array, ft: pa.Array, i: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in (p, n, d, u, t, h, x, f, fu, ft, i)))
        return pa.array([warc_record(*row[:-1]) if row[-1] is None else info_record(row[-1], row[4]) for row in rows], pa.binary())

    whole = records.withColumn("repeats", repeats).withColumn("payload", F.when(F.col("repeats").isNull(), F.col("payload")))
    made = render("page_id", "payload_bytes", "payload_digest", "url", "date", "http", "payload", "repeats", "first_url", "first_date", "info")
    # The text source writes the bytes of a string as they are.
    whole.select(made.cast("string").alias("value")).write.options(**GZIP, lineSep=WARC_END).text(warc)
    return warc


WARC_ROWS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, record_id string, url string, warc_date string"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives; the payload of a response is hashed anew.

    A resource, which a record of another scheme becomes, is told apart from a response by its
    type alone and reads as ``response``.
    """

    def size_of(file: str, header: bytes) -> int:
        return int(header[header.rindex(b"Content-Length:") + 15 :].split(b"\r\n", 1)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for file, header, content in contents(pieces_of(batches), b"\r\n\r\n", size_of):
            lines = header.decode().split("\r\n")
            if lines[0] != "WARC/1.0":
                raise ValueError(f"no WARC record starts where {file} should have one")
            head = dict(x.split(": ", 1) for x in lines[1:])
            if head["WARC-Type"] == "warcinfo":
                continue
            if head["WARC-Type"] == "resource":
                http, payload = {"x-page-id": head["X-Page-Id"].strip()}, content
            else:
                http, _, payload = http_parts(content)
            again = head["WARC-Type"] == "revisit"
            size = int(head["X-Payload-Length"]) if again else len(payload)
            digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
            if not again and hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"a payload of {file} does not have its digest")
            to = int(head["X-Refers-To-Page"]) if again else None
            kind = "revisit" if again else "response"
            rows.append([page_of(http), size, digest, kind, to, head["WARC-Record-ID"], head.get("WARC-Target-URI"), head["WARC-Date"]])
            if len(rows) == 4096:
                yield as_batch(rows, names, types)
                rows = []
        if rows:
            yield as_batch(rows, names, types)

    names, types = columns_of(WARC_ROWS)
    return read_text(spark, path, WARC_END).mapInArrow(run, WARC_ROWS)


def archive_pages(pages: DataFrame) -> DataFrame:
    """``pages`` written as ARC archives, converted to WARC archives, and read back."""
    spark = pages.sparkSession
    arc = write_arc(pages, work_path(spark, "arc"))
    return read_warc(spark, convert(spark, arc, work_path(spark, "warc")))


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, d.payload_digest,
  CASE WHEN first IS NOT NULL AND d.page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN d.page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
