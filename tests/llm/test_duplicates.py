import random
import re

import numpy as np
import pytest
import xxhash

from kbspark.llm import components, decontaminate, line_dedup, line_quality, simhash
from kbspark.session import stored

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def groups_of(edges, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


# --- components ------------------------------------------------------------------------


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1064)] + [(7, i) for i in range(2000, 2100)]
    edges += [(3, 3), (None, 4), (1001, 1000)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == groups_of(real, {x for e in real for x in e})
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


# --- SimHash ---------------------------------------------------------------------------


def brute_print(text, size=3):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lower(text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_forest_equals_all_pairs():
    rng = np.random.default_rng(1)
    for _ in range(8):
        words = set()
        for center in rng.integers(0, 2**63, 6):
            for _ in range(int(rng.integers(1, 90))):
                w = int(center)
                for b in rng.integers(0, 64, int(rng.integers(0, 5))):
                    w ^= 1 << int(b)
                words.add(w)
        words = np.array(sorted(words), np.uint64)
        words = words[np.argsort(simhash.gray_rank(words))]
        near = np.argwhere(np.bitwise_count(words[:, None] ^ words[None, :]) <= simhash.BITS)
        want = groups_of([tuple(map(int, p)) for p in near], range(len(words)))
        assert simhash.link_groups(words, np.array([0])).tolist() == [want[i] for i in range(len(words))]
        half = len(words) // 3
        a, b = words[:half], words[half:]
        of_a, of_b = (simhash.link_groups(x, np.array([0])) for x in (a, b))
        assert simhash.link_runs(a, b, of_a, of_b).tolist() == [want[i] for i in range(len(words))]


def test_gray_order():
    codes = np.arange(4096, dtype=np.uint64)
    assert (simhash.gray_rank(codes ^ (codes >> np.uint64(1))) == codes).all()


@pytest.mark.parametrize("chunk", [4, 4096])
def test_links_across_runs(spark, monkeypatch, chunk):
    """One ball of near fingerprints, cut into many runs, and far ones."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = np.random.default_rng(2)
    center = int(rng.integers(0, 2**62))
    ball = {center ^ (1 << int(i)) ^ (1 << int(j)) for i, j in rng.integers(0, 64, (150, 2))}
    words = sorted(ball | {int(x) for x in rng.integers(0, 2**62, 60)})
    df = spark.createDataFrame([(w - (1 << 64) if w >= 1 << 63 else w,) for w in words], "fp bigint")
    got = groups_of([(r["u"], r["v"]) for r in simhash.links(df).collect()], [r["fp"] for r in df.collect()])
    signed = np.array([r["fp"] for r in df.collect()], np.int64)
    near = np.argwhere(np.bitwise_count(signed.view(np.uint64)[:, None] ^ signed.view(np.uint64)[None, :]) <= 3)
    want = groups_of([(int(signed[a]), int(signed[b])) for a, b in near], signed.tolist())
    same = lambda g: {frozenset(k for k in g if g[k] == r) for r in g.values()}
    assert same(got) == same(want)


def test_near_duplicates_of_odd_rows(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(900, None), (901, ""), (902, " \n\t"), (903, "One"), (904, "one"), (905, docs[0][1]), (905, docs[0][1]), (None, docs[0][1]), (906, "w " * 60_000)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, node string")
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)
    prints = [brute_print(t) for _, t in docs]
    words = np.array(prints, np.uint64)
    near = np.argwhere(np.bitwise_count(words[:, None] ^ words[None, :]) <= 3)
    of = groups_of([tuple(map(int, p)) for p in near], range(len(docs)))
    name = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            name[of[i]] = min(name.get(of[i], doc), doc)
    assert got == sorted(((d, f"{p:016x}", name[of[i]]) for i, ((d, _), p) in enumerate(zip(docs, prints))), key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


# --- decontamination ---------------------------------------------------------------------


def brute_hits(text, items):
    words, hit, found = WORD.findall(lower(text)), set(), set()
    for item, own in items:
        own = WORD.findall(lower(own))
        size = min(10, len(own))
        wins = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in wins:
                hit.update(range(i, i + size))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_decontamination_of_odd_rows(spark):
    import hashlib

    long = " ".join(f"w{i % 37}" for i in range(40))
    items = [(1, long), (2, long), (3, "alpha beta"), (4, "Gamma"), (5, None), (6, "... !"), (None, "alpha beta"), (12, "x " * 14), (1, long), (7, "a b c d e f g")]
    docs = [
        (1, "pre " + long.upper() + " post"), (2, None), (3, ""), (4, "alpha,beta gamma-alpha BETA"), (5, "x x x x x x x x x x x"), (6, "a b c d e f a b c d e f g h"),
        (1, "pre " + long.upper() + " post"), (8, ("filler text here " * 20_000) + "alpha beta"), (None, "gamma"), (9, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"), (10, "w1 w2 w3 w4 w5 w6 w7 w8 w9"),
        (11, long + " " + long), (12, "é日 gamma"),
    ]
    df = spark.createDataFrame([(*d, 1, "s") for d in docs], "doc_id bigint, text string, key int, sig string")
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id bigint, text string, win int")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.contamination(df, bench).collect()), key=str)
    want = []
    for doc, text in docs:
        n, hit, found = brute_hits(text, [i for i in items if i[0] is not None])
        want.append((doc, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0))
    assert got == sorted(want, key=str)
    none = decontaminate.contamination(df, bench.limit(0)).collect()
    assert len(none) == len(docs) and not any(r["contaminated"] for r in none)
    assert decontaminate.contamination(df.limit(0), bench).count() == 0


# --- lines -----------------------------------------------------------------------------


def brute_lines(rows):
    """Kept text of each row; rows are in the order of id."""
    place = {}
    for doc, text in rows:
        for i, line in enumerate((text or "").split("\n")):
            words = tuple(lower(line).split())
            if words and ((doc if doc is not None else 1 << 62), i) < place.get(words, (1 << 63, 0)):
                place[words] = ((doc if doc is not None else 1 << 62), i)
    long = [w for w in place if len(w) >= line_dedup.MIN_WORDS]
    near = {w for w in long for v in long if place[v] < place[w] and line_dedup.within_one(list(w), list(v))}
    out = []
    for doc, text in rows:
        kept = []
        for i, line in enumerate((text or "").split("\n")):
            words = tuple(lower(line).split())
            if not words or (words not in near and place[words] == ((doc if doc is not None else 1 << 62), i)):
                kept.append(line)
        out.append((doc, None if text is None else "\n".join(kept)))
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [[f"v{x}" for x in rng.integers(0, 30, int(rng.integers(8, 14)))] for _ in range(25)]
    lines = []
    for b in base:
        for _ in range(8):
            w = list(b)
            for _ in range(int(rng.integers(0, 3))):
                k, at = int(rng.integers(0, 3)), int(rng.integers(0, len(w)))
                w[at : at + (k != 0)] = [] if k == 2 else [f"n{rng.integers(0, 4)}"]
            lines.append("  ".join(w).title() if rng.integers(0, 2) else " ".join(w))
    rng.shuffle(lines)
    rows = [(i, "\n".join(lines[8 * i : 8 * i + 8])) for i in range(25)]
    rows += [(50, None), (51, ""), (52, "\n \n\t"), (53, "one"), (54, "two\none"), (55, "x y " * 20_000), (56, rows[0][1]), (56, rows[0][1]), (None, rows[1][1] + "\nfresh line")]
    df = spark.createDataFrame([(*r, 1, "d") for r in rows], "doc_id bigint, text string, line int, _drop string")
    got = line_dedup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "line", "_drop", "n_lines_dropped", "n_lines_near"]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(brute_lines(rows), key=str)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_line_edits():
    a = "a b c d".split()
    for other, near in (("a b c d", True), ("a x c d", True), ("a b d", True), ("a b c c d", True), ("b c d x", False), ("a b", False), ("", False)):
        assert line_dedup.within_one(a, other.split()) is near and line_dedup.within_one(other.split(), a) is near


# --- quality rules -----------------------------------------------------------------------


def test_repeated_words():
    brute = lambda w: len({j for i in range(len(w) - 2) if [w[k : k + 3] for k in range(len(w) - 2)].count(w[i : i + 3]) > 1 for j in (i, i + 1, i + 2)})
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 4, 30, 200):
        words = [str(x) for x in rng.integers(0, 4, n)]
        assert line_quality.repeated_words(words) == brute(words)


def test_quality_of_odd_rows(spark):
    own = lambda i, n: " ".join(f"u{i}x{k}" for k in range(n))
    shared = "Common footer of this host " + own("f", 60)
    rows = [(i, own(i, 40) + "\n" + shared, "h") for i in range(6)]  # over half is the footer
    rows += [(20, own(20, 100) + "\n" + shared.upper(), "h"), (21, None, "h"), (22, "", None), (23, own(23, 60), None), (24, "a b c " * 40_000, "h"), (25, own(25, 60), "h"), (25, own(25, 60), "h")]
    rows += [(30 + i, rows[0][1], "g") for i in range(9)]  # copies count as one document
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, source string, lines int")
    got = [(r["doc_id"], r["base_failed"], r["n_removed_words"], r["kept"]) for r in line_quality.judge(df, share=0.1, least=3).collect()]
    want = {i: (False, 65 if i else 0, i == 0) for i in range(6)} | {20: (False, 65, True), 21: (True, 0, False), 22: (True, 0, False), 23: (False, 0, True), 24: (True, 0, False), 25: (False, 0, True)}
    want |= {30 + i: (False, 0, True) for i in range(9)}
    assert len(got) == len(rows) and all((f, n, k) == want[i] for i, f, n, k in got)
    assert line_quality.judge(df.limit(0)).count() == 0


def test_lines_above_the_limit_are_cut(spark):
    own = lambda i: " ".join(f"u{i}x{k}" for k in range(100))
    rows = [(i, f"Shared  HEAD of site\n\n{own(i)}\nshared head of site", "h") for i in range(8)] + [(20, own(20), None), (20, own(20), None), (21, None, "h"), (22, "short", "h")]
    df = spark.createDataFrame([(*r, 1, "r") for r in rows], "doc_id bigint, text string, source string, host int, _removed string")
    got = line_quality.remove_lines(df, share=0.1, least=3)
    assert got.columns == [*df.columns, "n_lines_removed"]
    want = [(i, rows[i][1] if i == 0 else "\n" + own(i), 2 if i else 0) for i in range(8)] + [(20, own(20), 0)] * 2
    assert sorted((r["doc_id"], r["text"], r["n_lines_removed"]) for r in got.collect()) == want
    assert line_quality.remove_lines(df.limit(0)).count() == 0


def test_a_small_host_loses_its_footer(spark):
    """By the limits that the pipeline uses, on a host of some dozens of documents."""
    own = lambda i: " ".join(f"u{i}x{k}" for k in range(100))
    rows = [(i, own(i) + ("\nFooter of this host" if i < 30 else "\nseen four times" if i < 34 else ""), "h") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = sorted((r["doc_id"], r["text"]) for r in line_quality.remove_lines(df).collect())
    assert got == [(i, own(i) if 0 < i < 30 else t) for i, t, _ in rows]


def test_the_registered_query_removes_lines(spark):
    """With its own limits, on hosts of some dozens of documents."""
    from kbspark.llm import queries

    footer = "read more about us on the pages of this site"
    rows = [(i, f"host{i % 2}", " ".join(f"w{i}x{k}" for k in range(70)) + (f"\n{footer}" if i % 4 < 3 else "")) for i in range(60)]
    got = line_quality.judge(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    # Host 0 holds documents 0 and 2, host 1 documents 1 and 3 of every four; the earliest keeps its line.
    assert {r["doc_id"] for r in got if r["n_removed_words"] == 10} == {i for i in range(60) if i % 4 < 3} - {0, 1}
    found = queries.op8_line_quality(spark, "/root/testdata/sf0.01").agg({"n_removed_words": "sum"}).first()[0]
    assert found > 0


def test_line_dedup_leaves_only_the_tables_its_result_reads(spark):
    from kbspark.session import path_exists, work_mark
    from kbspark.session import _made as made

    words = [f"w{i}" for i in range(14)]
    rows = [(1, " ".join(words)), (2, " ".join(["x", *words[1:]])), (3, " ".join(words))]
    before = work_mark()
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in made[before:]] == ["lines-first", "lines", "lines-near"]
    assert all(path_exists(spark, p) for p in made[before:])
    assert sorted((r["doc_id"], r["n_lines_dropped"], r["n_lines_near"]) for r in out.collect()) == [(1, 0, 0), (2, 1, 1), (3, 1, 0)]


def test_documents_that_lose_no_line_do_not_move(spark):
    """The few documents that lose a line meet the findings by a shuffle, the others stay."""
    draw = random.Random(7)
    own = lambda: " ".join("%032x" % draw.getrandbits(128) for _ in range(6000))
    rows = [(i, own() + ("\n" + " ".join(f"shared{k}" for k in range(12)) if i < 8 else ""), "h") for i in range(40)]
    df = stored(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), "test-unmoved")
    moved = lambda: spark._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = line_quality.remove_lines(df)
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        before = moved()
        got = sorted((r["doc_id"], r["text"]) for r in out.collect())
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        # Random hexadecimal digits are stored in half their size at the least.
        assert moved() - before < sum(len(t) for _, t, _ in rows) // 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [(i, t.split("\n")[0] if 0 < i < 8 else t) for i, t, _ in rows]
