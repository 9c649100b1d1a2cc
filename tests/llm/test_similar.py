"""The near-dedup stage of the pipeline against all pairs."""

import random

import numpy as np

from sparkvet.llm import similar, stages

SCHEMA = "doc_id long, text string, lang string"


def groups(texts):
    """Number of the group of each text, by 5-word Jaccard similarity of 0.8 or more over all pairs."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(sets)))
    for _ in sets:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets[:i]):
                if x == y or 5 * len(x & y) >= 4 * len(x | y):
                    root[i] = root[j] = min(root[i], root[j])
    return root


def test_sketches_bound_the_difference():
    g = np.random.default_rng(1)
    for n in (0, 3, 100, 5000):
        a = np.unique(g.integers(0, 1 << 64, n, np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], g.integers(0, 1 << 64, n // 3, np.uint64)]))
        bits = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(similar.parity_sketch(a), similar.parity_sketch(b), strict=True))
        assert bits <= len(np.setxor1d(a, b)) and (n != 100 or bits > 0.8 * len(np.setxor1d(a, b)))


def test_near_copies(spark):
    r = random.Random(4)
    texts = [None, "", " ", "one", "ONE", "one two", "a b c d e"]
    for _ in range(8):
        base = [f"w{r.randrange(3000)}" for _ in range(r.randint(40, 120))]
        texts.append(" ".join(base))
        for changes in (1, 1, 2, 5, 20):
            copy = list(base)
            for _ in range(changes):
                copy[r.randrange(len(copy))] = f"w{r.randrange(3000)}"
            texts.append(" ".join(copy))
    order = r.sample(range(len(texts)), len(texts))
    rows = [(i, texts[k], "en") for i, k in enumerate(order)]
    docs = spark.createDataFrame([*rows, rows[9]], SCHEMA).repartition(3)
    want = groups([t for _, t, _ in rows])
    first = sorted({want.index(g) for g in want})
    assert len(first) < len(rows) - 10
    kept = stages.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns and sorted(x["doc_id"] for x in kept.collect()) == first
    assert sorted(x["doc_id"] for x in similar.first_of_similar(docs, 5, 0.8, cell_rows=2).collect()) == first
    assert stages.drop_near_copies(spark, docs.limit(0), "").collect() == []


def variants(n, cut=0.0, seed=6):
    """Texts that each differ from one base in 2 to 8 words; a share of them lacks 25 words besides, or differs from another variant."""
    r = random.Random(seed)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(base)]
    while len(texts) < n:
        copy = r.choice(texts).split() if r.random() < cut else list(base)
        for _ in range(r.randint(2, 8)):
            copy[r.randrange(len(copy))] = f"x{r.randrange(10**6)}"
        at = r.randrange(len(copy)) if r.random() < cut else len(copy)
        texts.append(" ".join(copy[:at] + copy[at + 25 :]))
    return texts


def test_rows_follow_the_size_of_a_group(spark, monkeypatch):
    made, apart = [], similar._apart

    def counted(members, *more):
        made[-1] += members.count()
        return apart(members, *more)

    monkeypatch.setattr(similar, "_apart", counted)
    for n in (150, 600):
        made.append(0)
        docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(variants(n))], SCHEMA)
        assert n // 2 < similar.first_of_similar(docs, 5, 0.8, cell_rows=32).count() < n
    assert 0 < made[1] < 5 * made[0]


def test_rare_shingles_lose_no_pair(spark):
    texts = [*dict.fromkeys([*variants(50, 0.3), *variants(30, 0.3, 7)]), "a", "a b c d e f", "a b c d e f g", "b c d e f g"]
    sets = [similar.shingle_set(similar.digests(t.encode(), 5)) for t in texts]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "xxhash64(text) AS __th")
    found = similar._classes(rows, 5).cache()
    number = {x["__set"]: x["doc_id"] for x in found.collect()}
    classes = found.selectExpr("__set", "__n", "__set AS root")
    for similarity in (0.8, 0.55):
        want = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if (both := len(np.intersect1d(x, y))) >= similarity * (len(x) + len(y) - both) - 1e-9}
        for cell_rows in (1, 256):
            pairs = similar._rare_pairs(rows, found, classes, found.select("__set", "__sketch"), 5, similarity, cell_rows).collect()
            got = {tuple(sorted((number[a], number[b]), reverse=True)) for a, b in pairs}
            assert len(want) > 20 and want <= got and 2 * len(got) < len(sets) * (len(sets) - 1)
    found.unpersist()


def test_blocks_are_bounded_and_hold_each_pair_once(spark):
    n = 300
    members = spark.range(n).selectExpr("id AS __set", "1 AS __n", "id AS root", "7L AS token", "0 AS at", f"{n}L AS rows")
    rows = similar._blocks(members, "token", 1)
    assert rows.count() == n * similar.MOST_BLOCKS
    sketches = spark.range(n).selectExpr("id AS __set", f"array_repeat(0L, {similar.WORDS}) AS __sketch")
    pairs = similar._apart(rows, ["token", "x", "y"], sketches, 0.8).collect()
    assert len(pairs) == len(set(pairs)) == n * (n - 1) // 2
