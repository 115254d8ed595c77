import pytest

import corpus_pipeline
from kbspark.llm import decontaminate, line_dedup, line_quality, simhash
from kbspark.session import stored

SF_DIR = "/root/testdata/sf0.001"


def test_stages_on_the_smallest_tables(spark):
    """Every stage against its operator's own result, which other tests compare with brute force."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    bench = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    columns = docs.columns
    rows = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "encoding"]
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SF_DIR), f"test-{name}")
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "quality_rules":
            want = {r["doc_id"] for r in line_quality.judge(docs).collect() if r["kept"]}
            assert rows(out) == sorted((i, before[i]) for i in want)
        if name == "line_dedup":
            kept = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
            assert rows(out) == sorted((i, t) for i, t in kept.items() if t.strip())
            assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
        if name == "near_duplicates":
            want = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
            assert rows(out) == sorted((i, before[i]) for i in want)
        if name == "decontamination":
            bad = {r["doc_id"] for r in decontaminate.contamination(docs, bench).collect() if r["contaminated"]}
            assert bad and rows(out) == sorted((i, t) for i, t in before.items() if i not in bad)
        if name == "encoding":
            assert rows(out) == sorted(before.items()) and out.filter("not round_trip").count() == 0
            assert out.columns == [*columns, "ids", "round_trip"]
        else:
            assert out.columns == columns
        docs = out


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:4])
def test_stages_with_odd_rows(spark, name, stage):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, None, "a", None, None, 1), (2, "", "a", "s", 0, 1), (3, text, "a", "s", 5, 1), (3, text, "a", "s", 5, 1), (4, text, "a", None, 5, 1), (None, text + " z", None, "s", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, gone int")
    out = stage(spark, docs, SF_DIR)
    assert out.columns == docs.columns
    kept = [r["doc_id"] for r in out.collect()]
    assert 3 in kept
    if name == "near_duplicates":
        assert kept.count(3) == 1 and 4 not in kept
    assert stage(spark, docs.limit(0), SF_DIR).count() == 0


def test_rows_of_one_id_are_judged_by_their_own_text(spark):
    """Null and repeated ids; one of each id is a near copy of document 0, or holds a window of the benchmark."""
    own = lambda i: " ".join(f"u{i}x{k}" for k in range(80))
    leak = next(r["text"] for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").orderBy("item_id").collect() if len(r["text"].split()) > 12)
    clean = [(0, own(0)), (5, own(1)), (5, own(2)), (None, own(3)), (None, own(4))]
    for stage, bad in ((corpus_pipeline.near_duplicates, own(0)), (corpus_pipeline.decontamination, own(9) + " " + leak)):
        rows = [(*r, "a", "s", 1) for r in [*clean, (5, bad), (None, bad)]]
        out = stage(spark, spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), SF_DIR)
        assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(clean, key=str)


def test_the_whole_run_leaves_one_table_and_equals_its_stages(spark):
    from kbspark.session import drop_work, work_mark

    mark = work_mark()
    out = corpus_pipeline.run(spark, SF_DIR)
    assert work_mark() == mark + 1
    got = sorted((r["doc_id"], r["text"], tuple(r["ids"]), r["round_trip"]) for r in out.collect())
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF_DIR), f"test-{name}")
    assert got == sorted((r["doc_id"], r["text"], tuple(r["ids"]), r["round_trip"]) for r in docs.collect()) and got
    drop_work(spark, mark)


def test_line_functions_run_once(spark):
    """A function of the lines that Spark evaluates twice also takes twice the Python workers."""
    docs = spark.createDataFrame([(1, "a b\n\na b"), (2, None), (3, "")], "doc_id bigint, text string")
    hashed = line_dedup.hash_lines(docs)
    assert hashed._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted((r["doc_id"], r["line"]) for r in hashed.collect()) == [(1, 0), (1, 2)]
    kept = line_dedup.dedup_lines(docs).filter("text like 'a%'")
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython [cut(") == 1
    assert [r["text"] for r in kept.collect()] == ["a b\n"]
