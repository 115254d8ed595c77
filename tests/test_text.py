import unicodedata

from pyspark.sql import functions as F

from kbspark.functions import ids, privacy
from kbspark.functions import text as tx
from kbspark.operators import chunking, intake
from kbspark.sources import files


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("r")).first()["r"]


def test_normalize_space(spark):
    assert one(spark, "ＡＢＣ　１２３\n\n\tｘ  ", tx.normalize_space) == "ABC 123 x"
    assert one(spark, "a" * 200, lambda c: tx.user_text(c, 50)) == "a" * 50
    samples = ["é", "é", "ﬁ", "½", "ª", " x", "한글", "plain", "·©®", "ſ"]
    rows = spark.createDataFrame([(s,) for s in samples], "v string").select("v", tx.nfkc(F.col("v")).alias("r")).collect()
    assert all(r["r"] == unicodedata.normalize("NFKC", r["v"]) for r in rows)


def test_readable_text(spark):
    page = (
        "<html><head><title>T</title><script>var a='</p>';</script></head><body><h1>Hello</h1><p>World</p>"
        "<!-- gone --><svg><p>no</p></svg>a&amp;lt;b &hearts;</body></html>"
    )
    assert one(spark, page, tx.readable_text) == "Hello World a&lt;b ♥"


def test_entities_end_with_a_semicolon(spark):
    # A title cut in the middle of an entity, and names that only start like one.
    assert one(spark, "<p>in &amp ver &am &quo tail &hearts;</p>", tx.readable_text) == "in &amp ver &am &quo tail ♥"
    assert one(spark, "a &amp;lt; &notit; &copy &#x41; &#66 &lt;", tx.readable_text) == "a &lt; &notit; &copy A &#66 <"


def test_links_tags_ids(spark):
    assert one(spark, "see https://example.com/story).\nand https://example.com/story", tx.links) == ["https://example.com/story"]
    tags = spark.createDataFrame([(["Python,Graph", "graph\nops", " "],)], "t array<string>")
    assert tags.select(tx.normalize_tags(F.col("t")).alias("r")).first()["r"] == ["Python", "Graph", "ops"]
    assert one(spark, "url:https://a:1/b", ids.source_value) == "https://a:1/b"
    assert one(spark, "url:https://a/b c", ids.safe_source_id) == "url_https___a_b_c"


def test_chunk_edges(spark):
    sizes = [0, 1, 200, 201, 380, 381]
    docs = spark.createDataFrame([(n, " ".join(f"w{i}" for i in range(n))) for n in sizes], "doc_id int, text string")
    rows = chunking.chunk_documents(docs).collect()
    count = {n: sum(r["doc_id"] == n for r in rows) for n in sizes}
    assert count == {0: 0, 1: 1, 200: 1, 201: 2, 380: 2, 381: 3}
    last = max((r for r in rows if r["doc_id"] == 381), key=lambda r: r["chunk_index"])
    assert last["text"] == " ".join(f"w{i}" for i in range(360, 381))


def test_redaction(spark):
    cases = {
        "IP 127.0.0.1 and id 19800101-1234": "IP [REDACTED_IP_ADDRESS] and id [REDACTED_SE_PERSONNUMMER]",
        "192.168.100.200": "[REDACTED_PHONE]",
        "a1.22.33.444 and 1.22.33.444": "a[REDACTED_PHONE] and [REDACTED_PHONE]",
        "mail jane@example.com": "mail [REDACTED_EMAIL]",
    }
    df = spark.createDataFrame([(k,) for k in cases], "text string")
    got = {r["text"]: r["redacted"] for r in privacy.redact_stages(df).collect()}
    assert got == cases


def test_matches_that_share_a_neighbour_follow_the_sql(spark):
    cases = {
        "a 4387393285946913 +1 (438) 555-5817 b": "a [REDACTED_PHONE] +[REDACTED_PHONE] b",
        "a@b.co c@d.co e@f.co": "[REDACTED_EMAIL] [REDACTED_EMAIL] [REDACTED_EMAIL]",
        "\ufdd0 070 123 45 67 \ufdd1": "\ufdd0 [REDACTED_PHONE] \ufdd1",
    }
    df = spark.createDataFrame([(k,) for k in cases], "text string")
    got = {r["text"]: r for r in privacy.redact_stages(df).collect()}
    assert {k: r["redacted"] for k, r in got.items()} == cases
    assert [r["n_phone"] for r in got.values()] == [2, 0, 1] and got["a@b.co c@d.co e@f.co"]["n_email"] == 3
    out = one(spark, next(iter(cases)), lambda c: privacy.pseudonymize_column(c, "salt"))
    assert out.count("[PII_PHONE_") == 2 and "] +[" in out


def test_pseudonyms_are_stable(spark):
    text = "Email jane@example.com and jane@example.com, phone +46 70 123 45 67"
    out = one(spark, text, lambda c: privacy.pseudonymize_column(c, "salt"))
    tokens = [w.strip(",") for w in out.split() if w.startswith("[PII_EMAIL_")]
    assert len(tokens) == 2 and tokens[0] == tokens[1]
    assert "[PII_PHONE_" in out


def test_policy_modes(spark):
    rows = [
        (1, "mail me at reporter@example.com", "off", "ollama", True, True),
        (2, "mail me at reporter@example.com", "bogus", "ollama", True, True),
        (3, "nothing here", "redact", "chatgpt", True, False),
    ]
    df = spark.createDataFrame(rows, "id int, text string, mode string, provider string, fail_closed boolean, provider_enabled boolean")
    got = {r["id"]: r for r in privacy.apply_policy(df, "s").collect()}
    assert got[1]["reason_codes"] == "allow.egress_policy_off" and not got[1]["transformed"]
    assert got[2]["reason_codes"] == "enforce.invalid_mode_fallback.redact,transform.redact.email"
    assert got[3]["effective_mode"] == "off" and "provider_filter_disabled.chatgpt" in got[3]["reason_codes"]


def test_allowlist(spark):
    paths = spark.createDataFrame([("/a/b/c.txt",), ("/a/bc",), ("/a/b",), ("/x/y",)], "path string")
    roots = spark.createDataFrame([("/a/b/",), ("/a/b/c.txt",)], "root string")
    assert sorted(r[0] for r in intake.allowed_paths(paths, roots).collect()) == ["/a/b", "/a/b/c.txt"]
    assert intake.allowed_paths(paths, roots.limit(0)).count() == 0


def test_notes_and_paths(spark):
    notes = spark.createDataFrame(
        [("/n/a.md", "---\ncommand: ask\nquestion: who: me\n---\n\nBody --- more"), ("/n/Inbox/b.md", "plain")],
        "path string, text string",
    )
    got = {r["path"]: r for r in files.parse_notes(notes).collect()}
    assert got["/n/a.md"]["command"] == "ask" and got["/n/a.md"]["params"] == {"question": "who: me"}
    assert got["/n/a.md"]["body"] == "Body --- more" and not got["/n/a.md"]["auto"]
    assert got["/n/Inbox/b.md"]["auto"] and got["/n/Inbox/b.md"]["body"] == "plain"
    df = spark.createDataFrame([("/d/x.txt",), ("/d/.h/x",), ("/d/x.PART",), ("/d/.x",)], "p string")
    assert [r[0] for r in df.where(intake.settled_path(F.col("p"))).collect()] == ["/d/x.txt"]
