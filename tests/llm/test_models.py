import math
import zlib
from collections import Counter

import numpy as np
import pytest

from kbspark.llm import context_tree, toxicity


def held_out(doc, by=7, left=2):
    return doc is not None and zlib.crc32(str(doc).encode()) % by == left


# --- context trees -----------------------------------------------------------------------


def brute_model(texts, depth):
    """Counts per decision and context, and the weighted probability of every node."""
    counts = {}
    for text in texts:
        data = bytes(depth) + text.encode().lower() + b"\xff"
        for i in range(depth, len(data)):
            for k in range(8):
                prefix, bit = (1 << k) | (data[i] >> (8 - k)), data[i] >> (7 - k) & 1
                for d in range(depth + 1):
                    counts.setdefault((d, data[i - d : i], prefix), [0, 0])[bit] += 1

    def log_e(n):
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(sum(n) + 1) - math.log(math.pi)

    log_w, stop = {}, {}
    for d in range(depth, -1, -1):
        below = {}
        for (e, context, prefix), w in log_w.items():
            if e == d + 1:
                below[context[1:], prefix] = below.get((context[1:], prefix), 0.0) + w
        for (e, context, prefix), n in counts.items():
            if e == d:
                own = log_e(n)
                log_w[e, context, prefix] = own if d == depth else float(np.logaddexp(own, below[context, prefix]) - math.log(2))
                stop[e, context, prefix] = 1.0 if d == depth else math.exp(own - math.log(2) - log_w[e, context, prefix])
    return counts, stop


def brute_score(text, counts, stop, depth):
    data, total = bytes(depth) + text.encode().lower() + b"\xff", 0.0
    for i in range(depth, len(data)):
        for k in range(8):
            prefix, bit = (1 << k) | (data[i] >> (8 - k)), data[i] >> (7 - k) & 1
            p = None
            for d in range(depth, -1, -1):
                node = (d, data[i - d : i], prefix)
                if node in counts:
                    one = (counts[node][1] + 0.5) / (sum(counts[node]) + 1)
                    p = one if p is None else stop[node] * one + (1 - stop[node]) * p
            p = 0.5 if p is None else p
            total += math.log10(p if bit else 1 - p)
    return total


def test_scores_equal_brute_force(spark, monkeypatch):
    rows = [(i, f"The cat {i % 3} sat on the mat.\nAnd {'so ' * (i % 4)}on é") for i in range(30)]
    rows += [(40, None), (41, ""), (42, "zebra QUIZ"), (43, "ab " * 20_000), (44, "The cat"), (44, "The cat"), (None, "no id")]
    train = [t or "" for i, t in rows if not held_out(i)]
    counts, stop = brute_model(train, context_tree.DEPTH)
    words = Counter(w for t in train for w in [*t.lower().split(), None])
    total, kinds = sum(words.values()), len(words)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, n int").repartition(4)
    for frequent in (20, 3):  # the second leaves most words to the join
        monkeypatch.setattr(context_tree, "FREQUENT", frequent)
        got = context_tree.score(df).collect()
        assert len(got) == len(rows)
        for r in got:
            text = next(t for i, t in rows if i == r["doc_id"]) or ""
            tokens = [*text.lower().split(), None]
            assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held_out(r["doc_id"]), len(tokens), total)
            assert r["n_known"] == sum(w in words for w in tokens)
            assert r["base_score"] == pytest.approx(sum(math.log10((words[w] + 1) / (total + kinds + 1)) for w in tokens))
            # Half precision of the table.
            assert r["score"] == pytest.approx(brute_score(text, counts, stop, context_tree.DEPTH), rel=2e-3, abs=0.02)
    assert context_tree.score(df.limit(0)).count() == 0


@pytest.mark.parametrize("frequent", [20, 6])
def test_no_node_is_lost(spark, monkeypatch, frequent):
    """Varied text of more nodes than a table of 2**16 places holds, however few sequences all tasks get."""
    monkeypatch.setattr(context_tree, "SLOTS", 16)
    monkeypatch.setattr(context_tree, "FREQUENT", frequent)
    rng = np.random.default_rng(6)
    parts = ["".join(map(chr, rng.integers(97, 123, 9))) for _ in range(400)]
    rows = [(i, " ".join(parts[int(x)] for x in rng.integers(0, 400, 90))) for i in range(40)]
    counts, stop = brute_model([t for i, t in rows if not held_out(i)], context_tree.DEPTH)
    assert len(counts) > 1 << 16 and any(held_out(i) for i, _ in rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    for r in context_tree.score(df).collect():
        assert r["score"] == pytest.approx(brute_score(rows[r["doc_id"]][1], counts, stop, context_tree.DEPTH), rel=1e-6)


def test_predictions_of_a_context_add_up_to_one():
    rng = np.random.default_rng(0)
    one = np.where(rng.random(1 << context_tree.SLOTS) < 0.5, rng.normal(0, 2, 1 << context_tree.SLOTS), np.nan).astype(np.float16)
    scorer = context_tree.Scorer(one, rng.random(1 << context_tree.SLOTS).astype(np.float16), rng.integers(0, 2, 1 << context_tree.SLOTS).astype(np.uint8))
    for context in (0, 12345, (1 << 39) + 77):
        p = 10 ** scorer.predict(np.uint64(context << 8) | np.arange(256, dtype=np.uint64))
        assert p.sum() == pytest.approx(1)
        assert np.log10(p) == pytest.approx(scorer(np.uint64(context << 8) | np.arange(256, dtype=np.uint64)))


# --- toxicity ----------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    labelled = docs.join(labels.select("doc_id"), "doc_id", "left_semi").repartition(4)
    model = toxicity.fit(labelled, labels)
    rows = toxicity.score(labelled, model).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    y, s = np.array([r["toxic"] for r in rows]), np.array([r["score"] for r in rows])
    rank = s.argsort().argsort() + 1
    auc = (rank[y == 1].mean() - (y.sum() + 1) / 2) / (len(y) - y.sum())
    assert auc > 0.9 and ((s >= 0.5) == y).mean() > max(0.92, 1 - y.mean())


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "x" * 150_000, 1), (4, "b b", 1), (4, "b b", 1), (None, "c", 1)], "doc_id bigint, text string, score int")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, none)).collect()
    assert len(got) == 6 and {r["score"] for r in got} == {0.0} and {r["predicted"] for r in got} == {0}
    for r in got:
        assert r["held_out"] == held_out(r["doc_id"], 5, 0)
    words = ["calm", "river", "stone", "light", "garden", "window"]
    rows = [(i, " ".join(words[(i * 7 + k * k) % 6] for k in range(30)) + (" vilest word" if i % 2 else "")) for i in range(80)]
    some = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows] + [(3, None), (None, 1)], "doc_id bigint, toxic int")
    got = toxicity.score(docs, toxicity.fit(some, labels)).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert toxicity.score(docs.limit(0), toxicity.fit(some, labels)).count() == 0
