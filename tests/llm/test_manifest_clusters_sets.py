import hashlib
import re
import zlib
from itertools import combinations

import numpy as np
import pytest

from kbspark.llm import centroids, jaccard, merkle

# --- Merkle manifest ---------------------------------------------------------------------


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"])))


def brute_manifest(rows):
    """doc_id, leaf, subroot, root, proof hash, folded root and verdict of every row, node by node."""
    first = lambda v: (v is not None, v if v is not None else 0)
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))

    def climb(level, at):
        steps = []
        while len(level) > 1:
            run = at // 16 * 16
            steps.append(("".join(level[run:at]), "".join(level[at + 1 : run + 16])))
            level = [h("".join(level[k : k + 16])) for k in range(0, len(level), 16)]
            at //= 16
        return level[0], steps

    trees = [sorted((r for r in rows if r["source"] == s), key=lambda r: (first(r["doc_id"]), brute_leaf(r))) for s in sources]
    subroots = [climb([brute_leaf(r) for r in tree], 0)[0] for tree in trees]
    out = []
    for number, tree in enumerate(trees):
        leaves = [brute_leaf(r) for r in tree]
        for at, r in enumerate(tree):
            _, low = climb(leaves, at)
            root, high = climb(subroots, number)
            now = leaves[at]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] is not None:
                now = brute_leaf(r | {"text": re.sub("[A-Z]", lambda m: m[0].lower(), r["text"])})
            for left, right in low + high:
                now = h(left + now + right)
            proof = h("".join(a + b for a, b in low + high))
            out.append((r["doc_id"], leaves[at], subroots[number], root, proof, now, now == root))
    return out


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 300, 4095, 4096])
@pytest.mark.parametrize("total", [0, 100_000])
def test_every_node_of_a_block_has_a_place_of_its_own(n, total):
    levels = merkle.levels_of(n, total or n)
    places = np.concatenate([merkle.place(np.arange(merkle.ceil_div(n, 16**k)), k, n, levels) for k in range(levels)])
    assert sorted(places) == list(range(merkle.nodes_in(n, levels)))
    # The root comes first, and every run of leaves lies together, behind its parent.
    assert merkle.place(np.zeros(1, int), levels - 1, n, levels)[0] == 0
    if levels > 1:
        leaves, above = merkle.place(np.arange(n), 0, n, levels), merkle.place(np.arange(merkle.ceil_div(n, 16)), 1, n, levels)
        if levels % 2 == 0:
            assert (leaves == above[np.arange(n) // 16] + 1 + np.arange(n) % 16).all()


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, tree string, rank string, root string, at string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", None) for r in rows], SCHEMA)


def checked(spark, rows):
    df = documents(spark, rows)
    made = merkle.manifest(df, altered={"text": merkle.altered_text(df["text"], df["doc_id"])})
    got = [tuple(r) for r in merkle.verify(made).collect()]
    want = brute_manifest([dict(zip(("doc_id", "source", "lang", "n_chars", "text"), r)) for r in rows])
    assert sorted(got, key=str) == sorted(want, key=str)
    return got, made


def test_manifest_with_odd_rows(spark):
    rows = [(i, f"s{i % 3}", "en", i, f"Text {i}") for i in range(70)]
    rows += [(None, "s1", None, None, None), (None, "s1", None, None, ""), (None, None, "x", 1, "Null Source"), (7, "", "x", 0, "Empty"), (5, "ü", "x", 0, "É A")]
    rows += [(3, "s0", "en", 3, "Again")] * 3 + [(200, "single", "a", 5, "A" * 300_000), (201, "z", "a", None, None)]
    got, _ = checked(spark, rows)
    assert len({r[3] for r in got}) == 1 and 0 < sum(not r[6] for r in got) < len(got)


def test_sources_larger_than_a_block_and_many_sources(spark):
    rows = [(i, "hot", "en", 1, f"T{i}") for i in range(4096 + 300)] + [(i, f"s{i:03d}", "en", 1, "x") for i in range(280)]
    _, made = checked(spark, rows)
    assert len(made["documents"]) == 2 and len(made["sources"]) == 1
    assert made["documents"][0].agg({"n": "max"}).first()[0] == merkle.LEAVES


def test_manifest_of_nothing_and_of_one(spark):
    got, _ = checked(spark, [])
    assert got == []
    ((_, leaf, subroot, root, proof, folded, verified),), _ = checked(spark, [(1, "a", "b", 2, "low")])
    assert leaf == subroot == root == folded and proof == h("") and verified


# --- centroids -----------------------------------------------------------------------------


def brute_clusters(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else h(f"1:{r[0]}"), r[1]))
    cen = [list(v) for _, v in order[:k]]
    best = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cen))
    for _ in range(rounds):
        of = [best(v)[1] for _, v in kept]
        for n in range(len(cen)):
            own = [v for (_, v), o in zip(kept, of) if o == n]
            if own:
                cen[n] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *best(v)) for i, v in kept]
    return [(i, n, d, sum(e for _, e, m in found if m == n), sum(e for _, e, _ in found), h(",".join(map(str, cen[n])))) for i, d, n in found]


VECTORS = "vec_id bigint, embedding array<float>, label int, v string, rank int, cluster int"


def clustered(spark, rows):
    df = spark.createDataFrame([(i, v, 1, "a", 2, 3) for i, v in rows], VECTORS)
    return [tuple(r) for r in centroids.summed(*centroids.cluster(df)).collect()]


def test_hilbert_curve_visits_neighbours():
    for axes, bits in ((2, 4), (3, 3), (5, 2)):
        cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * axes)).reshape(axes, -1)
        rank = centroids.hilbert_rank(cells, bits)
        assert sorted(rank) == list(range(len(rank)))
        path = cells[:, np.argsort(rank)]
        assert (np.abs(np.diff(path, axis=1)).sum(axis=0) == 1).all()


def test_candidates_hold_the_nearest_centroid():
    rng = np.random.default_rng(4)
    fewer = 0
    for spread in (1, 5, 40, 1 << 25):
        for _ in range(40):
            cen = rng.integers(-spread, spread + 1, (12, 6))
            cen[3] = cen[9]  # a tie
            box = rng.integers(-spread, spread + 1, 6) + rng.integers(0, max(2, spread // 3), (30, 6))
            own, far = centroids.nearest(box, box.min(axis=0), box.max(axis=0), cen)
            exact = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c)) for c in cen] for v in box], object)
            assert [int(x) for x in far] == [min(r) for r in exact] and own.tolist() == [min(range(12), key=lambda n: (r[n], n)) for r in exact]
            fewer += len(centroids.candidates(box.min(axis=0), box.max(axis=0), cen)) < 11
    assert fewer > 100


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    middles = rng.normal(0, 1, (5, 64))
    rows = [(i, [float(np.float32(x)) for x in middles[i % 5] + rng.normal(0, 0.1, 64)]) for i in range(900)]
    rows += [(2000 + i, rows[0][1]) for i in range(300)] + [(2000, rows[0][1])] * 2 + [(None, rows[3][1]), (None, None), (3000, rows[1][1][:63]), (3001, rows[1][1] + [0.0])]
    for odd in (float("nan"), float("inf"), -float("inf"), None):
        rows.append((3010, rows[2][1][:40] + [odd] + rows[2][1][41:]))
    assert sorted(clustered(spark, rows), key=str) == sorted(brute_clusters(rows), key=str)
    beyond = (4000, [1e30] + rows[0][1][1:])
    assert sorted(clustered(spark, [*rows, beyond]), key=str) == sorted(brute_clusters(rows), key=str)
    few = rows[:4]
    assert sorted(clustered(spark, few), key=str) == sorted(brute_clusters(few), key=str)
    assert clustered(spark, []) == [] and clustered(spark, [(1, None)]) == []


def test_blocks_of_clustered_vectors_have_few_candidates(spark):
    rng = np.random.default_rng(7)
    middles = rng.normal(0, 1, (16, 64))
    rows = [(i, (middles[i % 16] + rng.normal(0, 0.05, 64)).tolist()) for i in range(16 * 1024)]
    vectors = centroids.whole_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    blocks = centroids.blocks_of(vectors, centroids.Grid(centroids.first_vectors(vectors, centroids.SAMPLE).astype(float)), 64).collect()
    cen = np.floor(64 * middles).astype(np.int64)
    wide = lambda b: np.frombuffer(b, np.int32).astype(np.int64)
    sizes = [len(centroids.candidates(wide(r["low"]), wide(r["high"]), cen)) for r in blocks]
    assert sum(r["n"] for r in blocks) == len(rows) and np.mean(sizes) < 5


# --- n-gram Jaccard join ---------------------------------------------------------------------


def brute_sets(rows, percent=85):
    shingles = []
    for _, text in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        shingles.append({tuple(words[k : k + 4]) for k in range(max(1, len(words) - 3))} if words else set())
    group = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        a, b = shingles[i], shingles[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b) and group[i] != group[j]:
            group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    names = {g: min([rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None], default=None) for g in set(group)}
    return sorted(((rows[k][0], len(shingles[k]), names[group[k]]) for k in range(len(rows))), key=str)


def joined(spark, rows, percent=85):
    df = spark.createDataFrame([(i, t, "a", 1, 2) for i, t in rows], "doc_id bigint, text string, id string, n int, key int")
    return sorted((tuple(r) for r in jaccard.near_sets(df, percent=percent).collect()), key=str)


def made_texts(rng, n):
    """Texts of many sizes, copies with changed words at the limit, and shared passages."""
    word = lambda: f"w{rng.integers(0, 4000)}"
    passage = [word() for _ in range(40)]
    texts = []
    for i in range(n):
        if i % 3 == 0 or not texts:
            words = [word() for _ in range(int(rng.integers(1, 30) if i % 2 else rng.integers(30, 200)))]
            if i % 5 == 0:
                words = words[:20] + passage + words[20:]
        else:
            words = texts[int(rng.integers(0, len(texts)))].split()
            for _ in range(int(rng.integers(0, max(2, len(words) // 30)))):
                words[int(rng.integers(0, len(words)))] = word()
            words = words[: len(words) - int(rng.integers(0, 3))] or ["x"]
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("seed, percent", [(1, 85), (2, 85), (3, 70)])
def test_join_equals_all_pairs(spark, seed, percent):
    rng = np.random.default_rng(seed)
    rows = [(int(i), t) for i, t in enumerate(made_texts(rng, 180))]
    got = joined(spark, rows, percent)
    assert got == brute_sets(rows, percent)
    assert sum(r[0] != r[2] for r in got) > 12


def test_both_sides_of_the_bound_find_every_link(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(int(i), t) for i, t in enumerate(made_texts(rng, 100))]
    for bound in (0, 40, 100_000):
        monkeypatch.setattr(jaccard, "cheapest_bound", lambda rated, percent, bound=bound: bound)
        assert joined(spark, rows) == brute_sets(rows)


def test_rows_filed_grow_with_the_sets_alone(spark):
    """A set files as many keys in a large group of near copies as in a small one."""
    for copies in (20, 2000):
        rows = [(i, 146, 22, [(copies, k) for k in range(23)], 22.0) for i in range(20)] + [(100 + i, 20, 3, [(copies, k) for k in range(4)], 3.0) for i in range(20)]
        rated = spark.createDataFrame(rows, "id long, n long, q int, first array<struct<held_by:long,shingle:long>>, fame double")
        made = {r["heavy"]: r["count"] for r in jaccard.members(rated, jaccard.cheapest_bound(rated, 85), 85).groupBy("heavy").count().collect()}
        assert made == {True: 20 * 22, False: 20 * 6}


def test_parts_of_linked_sets_share_enough():
    rng = np.random.default_rng(3)
    for _ in range(3000):
        a = int(rng.integers(1, 400))
        b = int(rng.integers(a, a * 100 // 85 + 1))
        shared = -(-85 * (a + b) // 185)
        if shared > a:
            continue
        both = rng.permutation(10_000)[: a + b - shared]
        x, y = np.sort(both[:a]), np.sort(np.concatenate([both[:shared], both[a:]]))
        meet = len(np.intersect1d(x[: int(jaccard.part_size(a, 85))], y[: int(jaccard.part_size(b, 85))]))
        assert meet >= min(jaccard.needed(a, 85), shared) and (b == a or meet >= min(jaccard.needed(b, 85), shared))


def test_sketches_never_differ_more_than_their_sets(spark):
    rng = np.random.default_rng(6)
    sets = []
    for _ in range(100):
        a = rng.integers(0, 1 << 62, int(rng.integers(1, 700)))
        b = np.concatenate([a[: int(rng.integers(0, len(a) + 1))], rng.integers(0, 1 << 62, int(rng.integers(1, 300)))])
        sets += [np.unique(a).tolist(), np.unique(b).tolist()]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, shingles array<long>")
    made = {r["of"]: [r[f"s{i}"] & (1 << 64) - 1 for i in range(jaccard.SKETCH)] for r in jaccard.sketches(df).collect()}
    for i in range(0, 200, 2):
        bits = sum((x ^ y).bit_count() for x, y in zip(made[i], made[i + 1]))
        apart = len(set(sets[i]) ^ set(sets[i + 1]))
        assert bits <= apart and (apart < 60 or bits > 40)


def test_join_with_odd_rows(spark):
    base = [f"b{i}" for i in range(120)]
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two three"), (7, "one two three"), (8, "one two"), (None, "one two"), (None, "null only"), (None, None)]
    rows += [(9, " ".join(base)), (9, " ".join(base)), (10, " ".join(base).upper()), (11, " ".join(base[:-1])), (None, " ".join(base[1:]))]
    rows += [(12, "x " * 100_000), (13, "y" * 500_000), (14, " ".join(f"q{i}" for i in range(40_000))), (15, " ".join(f"q{i}" for i in range(39_000)))]
    assert joined(spark, rows) == brute_sets(rows)
    assert joined(spark, []) == []


def test_a_large_group_of_near_copies(spark):
    """Each differs from the next in one word; chains and stars of links make one component, and a passage in all others makes none."""
    rng = np.random.default_rng(8)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(600):
        words = list(base)
        words[int(rng.integers(0, 150))] = f"own{i}"
        rows.append((1000 + i, " ".join(words)))
    rows += [(5000 + i, " ".join(base[:60] + [f"o{i}x{k}" for k in range(90)])) for i in range(300)]
    got = joined(spark, rows)
    assert [r[2] for r in got if r[0] < 5000] == [1000] * 600 and all(r[0] == r[2] for r in got if r[0] >= 5000)
