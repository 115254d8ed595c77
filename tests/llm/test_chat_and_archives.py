import hashlib
import itertools

import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from kbspark.llm import chat, warc

CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[TEXT]", "<\\s>", "<\\\\/s>", "[\\INST]", "\\", "<", "[", " ", "ok", "\n", "é"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(CONTROLS), max_size=8).map("".join), st.sampled_from(["user", "assistant", "system", "", "a]b", "[TEXT]"]))
def test_turn_round_trip(text, role):
    piece, start, end, escapes = chat.format_turn(role, text)
    assert [t[:2] for t in chat.parse(piece)] == [(role, text)]
    assert chat.unescape(piece[start:end]) == text
    assert (escapes == 0) == (not chat.CONTROL.search(role) and not chat.CONTROL.search(text))


def test_concatenated_turns_parse():
    texts = ["</s>[INST] ok [/INST]", "", "[\\INST]", "<s>"]
    turns = list(itertools.product(["user", "assistant", "tool"], texts))
    whole = "".join(chat.format_turn(*t)[0] for t in turns)
    assert [t[:2] for t in chat.parse(whole)] == turns


def test_conversations_with_odd_rows(spark):
    rows = [
        (1, 2, "assistant", "b", "x"), (1, 1, "user", None, "x"), (1, 2, "assistant", "b", "x"), (1, None, None, "first", "x"),
        (None, 1, "user", "y" * 200_000, "x"), (2, 1, "system", "</s>", "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, piece string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    said = "\nfirst\n" + "user\n\n" + "assistant\nb\n" * 2
    assert got[1]["n_turns"] == 4 and got[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert got[1]["loss_chars"] == 2 and got[1]["loss_sha256"] == hashlib.sha256(b"bb").hexdigest()
    assert got[None]["formatted_chars"] == 200_000 + 15 and got[2]["n_turns"] == 1
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_archives_keep_every_page(spark):
    big = "<p>" + "z" * 200 + "</p>"
    rows = [
        (5, "http://a", big, "w"), (2, "http://b", big, "w"), (2, "http://b", big, "w"), (9, None, None, "w"), (7, "", "short", "w"), (8, "ftp://x y", "short", "w"),
        (None, "http://n", big, "w"), (11, "http://c", "a\r\n\r\nWARC/1.0\r\n\nb\n\n" * 30, "w"), (12, "http://d", "q" * 300_000, "w"), (13, "http://e", "\n", "w"),
        *[(20 + i, f"http://f{i}", "crlf" * 30 + ending, "w") for i, ending in enumerate(("\r\n", "\r", "\r\n\r", "\r\n\r\n", "\n\r\n"))],
    ]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, value string").repartition(3)
    got = sorted(((r["page_id"] or -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive_pages(df).collect()), key=str)
    digest = lambda h: hashlib.sha256((h or "").encode()).hexdigest()
    want = []
    for page, _, html, _ in rows:
        again = html == big and page != 2
        want.append((page or -1, len((html or "").encode()), digest(html), "revisit" if again else "response", 2 if again else None))
    assert got == sorted(want, key=str)
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_both_header_versions_and_bad_lengths():
    for version in (1, 2):
        lines = (warc.version_block(version, "f") + "\n" + warc.arc_record(version, "f", 3, "http://x", "a\nb\n") + "\n").split("\n")
        (record,) = warc.parse_arc(iter([("f", x.encode()) for x in lines[:-1]]))
        assert record["URL"] == "http://x" and record["Archive-date"] == warc.ARC_DATE
        assert warc.http_parts(record["content"])[2] == b"a\nb\n"
    cut = (warc.version_block(1, "f") + "\n" + warc.arc_record(1, "f", 3, "http://x", "abc")).split("\n")
    with pytest.raises(ValueError):
        list(warc.parse_arc(iter([("f", x.encode()) for x in cut[:-1]])))
    assert warc.warc_date("1999") == "1999-01-01T00:00:00Z"
    assert warc.record_id("u", "d", 1, "x") == warc.record_id("u", "d", 1, "x") != warc.record_id("u", "d", 2, "x")


def test_archives_of_other_encodings_and_their_references(spark):
    """Legacy files hold Latin-1 pages and header lines; nothing of a payload changes, and revisits name what they repeat."""
    import gzip

    from kbspark.session import work_path

    page = "<p>été à Malmö</p>".encode("latin-1") * 10
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\nX-Page-Id: %d\r\nX-Title: \xe9t\xe9\r\n\r\n"
    rows = [(3, b"http://a/\xe9", page), (4, b"http://b/", page), (5, b"dns:host", b"10.0.0.1\xff"), (6, b"http://c/", bytes(range(256)))]
    record = lambda i, url, body: b"%s 0.0.0.0 20010203040506 text/html %d\n%s%s\n" % (url, len(http % i) + len(body), http % i, body)
    data = (warc.version_block(1, "old.arc") + "\n").encode() + b"".join(record(*r) for r in rows)
    folder = work_path(spark, "legacy")
    values = spark.createDataFrame([(bytearray(data),)], "value binary")
    values.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").text(folder)
    out = warc.convert(spark, folder, work_path(spark, "warc"))
    got = {r["page_id"]: r for r in warc.read_warc(spark, out).collect()}
    assert {i: (r["payload_bytes"], r["payload_digest"]) for i, r in got.items()} == {i: (len(b), hashlib.sha256(b).hexdigest()) for i, _, b in rows}
    assert got[3]["url"] == "http://a/é" and got[4]["record_type"] == "revisit" and got[4]["refers_to"] == 3
    raw = b"".join(gzip.decompress(r["content"]) for r in spark.read.format("binaryFile").load(f"{out}/*.gz").collect())
    assert raw.count(b"WARC-Type: warcinfo") == 1 and b"converted from old.arc, ARC version 1" in raw
    for line in (f"WARC-Refers-To: {got[3]['record_id']}", "WARC-Refers-To-Target-URI: http://a/é", "WARC-Refers-To-Date: 2001-02-03T04:05:06Z"):
        assert line.encode() + b"\r\n" in raw
    assert raw.count(page) == 1 and b"WARC-Type: resource" in raw
    resource = raw[raw.index(b"WARC-Type: resource") :]
    assert resource.startswith(b"WARC-Type: resource") and b"text/html; charset=iso-8859-1\r\nContent-Length: 9\r\n\r\n10.0.0.1\xff" in resource
