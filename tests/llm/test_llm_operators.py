"""Every operator against a brute-force version on small tables with nulls, empty and long texts, repeats and extra columns."""

import base64
import hashlib
import math
import os
import random
import re
import struct
import tracemalloc
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkvet.llm import bpe, common, embed_graph, merkle, mixing, ngram_lm, packing, queries, simhash, subword, token_counts, token_files, toxicity, warc
from sparkvet.llm.components import components

BYTE, WORD = queries.tokenizer_path(queries.BYTE_BPE), queries.tokenizer_path(queries.WORD_BPE)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length int, score double, __text string"
rng = random.Random(5)
WORDS = ["the", "of", "und", "île", "Étude", "ner", "ation", "42", "x!", "|", "...", "tion", "<|endoftext|>", "ΟΔΟΣ"]


def words(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


BASE = words(60)
TEXTS = [None, "", " ", "one", "one two", "a\n\nb", "  two  spaces \n x", BASE, BASE, BASE + " more", BASE.upper(), "\U0001f600 中文   end ", words(4000), words(300), "no newline " * 40, *(words(rng.randint(1, 80)) for _ in range(12))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 + 1, t, "en", f"s{i % 2}", len(t or ""), 7, 0.5, "clash") for i, t in enumerate(TEXTS)]
    rows += [rows[7], (None, "no id at all", "en", "s", 1, 7, 0.5, "clash")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def key(x):
    return (x[0] is not None, *x) if not isinstance(x, dict) else x


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_bpe_is_the_library(path):
    library, own = Tokenizer.from_file(path), bpe.PieceEncoder(path)
    alphabet = [*"ab'sdtZ1² \n\t.,!é́Σßİ<|>中​\x1c\x85　", "<|endoftext|>", "<|startoftext|>", "  ", " \n", "'ll"]
    for _ in range(3000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
        want = library.encode(t, add_special_tokens=False).ids
        assert own.ids(t.encode()) == struct.pack(f"<{len(want)}I", *want) and own.count(t.encode()) == len(want)


def test_packing(docs, none, rows):
    library = Tokenizer.from_file(BYTE)
    out = packing.pack(docs, BYTE, capacity=256, buckets=4).collect()
    want = []
    for d, t in rows:
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        for p, (s, n) in enumerate(packing.cut(len(ids), 256)):
            want.append((d, p, s, n, zlib.crc32(struct.pack(f"<{n}I", *ids[s : s + n]))))
    same([tuple(r)[:5] for r in out], want)
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in bins.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= 256
    assert packing.pack(none, BYTE).collect() == []


@pytest.mark.parametrize("seed", range(40))
def test_reduction_keeps_the_optimum(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 12, 20])
    items = [r.randint(1, capacity) for _ in range(r.randint(1, 9))]

    def optimum(left, bins=()):
        if not left:
            return len(bins)
        best = 99
        for i in range(len(bins)):
            if bins[i] >= left[0] and bins[i] not in bins[:i]:
                best = min(best, optimum(left[1:], (*bins[:i], bins[i] - left[0], *bins[i + 1 :])))
        return min(best, optimum(left[1:], (*bins, capacity - left[0])))

    fixed, rest = packing.reduce_dominated(Counter(items), capacity)
    left = sorted((s for s, n in rest.items() for _ in range(n)), reverse=True)
    assert all(sum(p) <= capacity for p, _ in fixed)
    assert Counter(s for p, m in fixed for s in p * m) + Counter(left) == Counter(items)
    assert sum(m for _, m in fixed) + optimum(left) == optimum(sorted(items, reverse=True))


def test_packing_needs_few_sequences():
    r = random.Random(1)
    histogram = Counter(r.randint(1, 1024) for _ in range(20000))
    patterns = [*packing.reduce_dominated(histogram, 1024)[0], *packing.best_fit(packing.reduce_dominated(histogram, 1024)[1], 1024)]
    assert Counter({s: n for s, n in Counter(s for p, m in patterns for s in p * m).items()}) == histogram
    assert sum(m for _, m in patterns) <= 1.01 * -(-sum(s * n for s, n in histogram.items()) // 1024)


def fingerprint(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if len(w) >= 3 else [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def by_links(n, linked, names):
    """Least name of each row's component."""
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                if i != j and linked(i, j) and root[j] < root[i]:
                    root[i], changed = root[j], True
    groups = defaultdict(list)
    for i in range(n):
        groups[root[i]].append(names[i])
    return [min((x for x in groups[root[i]] if x is not None), default=None) for i in range(n)]


def test_simhash(docs, none, rows):
    fps = [fingerprint(t) for _, t in rows]
    component = by_links(len(rows), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 2, [d for d, _ in rows])
    same([tuple(r) for r in simhash.near_duplicates(docs).collect()], [(d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, component, strict=True)])
    assert simhash.near_duplicates(none).collect() == []


@pytest.mark.parametrize("cell_rows", [1, 256])
def test_simhash_links_are_whole(spark, cell_rows):
    r = random.Random(3)
    fps = {0}
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            x ^= 1 << r.randrange(64)
            x ^= (1 << r.randrange(64)) * r.randint(0, 1)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "__fp long"), cell_rows=cell_rows)
    roots = dict(tuple(x) for x in components(edges).collect())
    want = by_links(len(fps), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 2, signed)
    assert [roots.get(x, x) for x in signed] == want


def test_checksum_does_not_overflow(spark):
    from sparkvet.llm.components import checksum

    rows = spark.range(30_000_000).selectExpr("id a", "-id b")
    assert tuple(rows.agg(*checksum("a", "b")).first())[0] == 30_000_000


def test_components_of_a_hub(spark):
    edges = [(0, i) for i in range(1, 3000)] + [(5000, i) for i in range(2999, 4000)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert set(got.values()) == {0} and len(got) == 4001


def test_components(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (-5, 200)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, -5: -5, 200: -5}


def trigram_model(training):
    """p(w | u, v) by the formulas of interpolated modified Kneser-Ney smoothing, from plain counters."""
    grams = Counter(g for t in training for x in [["<s>", "<s>", *t]] for g in zip(x, x[1:], x[2:], strict=False))
    known = {w for t in training for w in t}
    pairs = Counter()
    for (_, v, w), n in grams.items():
        pairs[v, w] += n if v == "<s>" else 1
    before = Counter(w for _, w in pairs)
    ds = [ngram_lm.discounts([sum(n == k for n in level.values()) for k in (1, 2, 3, 4)]) for level in (before, pairs, grams)]
    sums = [defaultdict(list), defaultdict(list), defaultdict(list)]
    for level, table in enumerate((before, pairs, grams)):
        for g, n in table.items():
            sums[level][g[:-1] if level else ()].append(n)

    def p(level, context, w):
        below = p(level - 1, context[1:], w) if level else 1 / (len(known) + 1)
        seen = sums[level].get(context)
        if not seen:
            return below
        n, d = (before[w], pairs[(*context, w)], grams[(*context, w)])[level] if level else before[w], ds[level]
        return (max(n - d[min(n, 3) - 1], 0) if n else 0) / sum(seen) + sum(d[min(f, 3) - 1] for f in seen) / sum(seen) * below

    return lambda u, v, w: p(2, (u, v), w), known


def test_ngram_model(docs, none, rows):
    token = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) + [""]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    training = [token(t) for d, t in rows if not held(d)]
    c = Counter(w for t in training for w in t)
    n = sum(c.values())
    p, known = trigram_model(training)
    assert abs(sum(p("the", "of", w) for w in [*known, "never seen"]) - 1) < 1e-9
    want = {}
    for doc, t in rows:
        x = token(t)
        y = ["<s>", "<s>", *x]
        want[doc] = (held(doc), len(x), sum(w in c for w in x), n, sum(math.log10((c[w] + 1) / (n + len(c) + 1)) for w in x), sum(math.log10(p(*g)) for g in zip(y, y[1:], x, strict=False)))
    got = ngram_lm.score(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:5] == want[r["doc_id"]][:4] and np.allclose(tuple(r)[5:], want[r["doc_id"]][4:], rtol=1e-9)
    assert ngram_lm.score(none).collect() == []


def test_ngram_ids_and_counts():
    g = np.random.default_rng(1)
    block = [g.integers(0, 9, 500, np.uint64) << np.uint64(50), g.integers(0, 9, 500).astype("<u4"), g.integers(1, 1 << 40, 500)]
    want = Counter()
    for a, b, n in zip(*(c.tolist() for c in block), strict=True):
        want[a, b] += n
    assert [((a, b), n) for a, b, n in zip(*(c.tolist() for c in ngram_lm.merged(*block)), strict=True)] == sorted(want.items())
    counts = np.array([1, 254, 255, 3, 1 << 32, (1 << 40) + 7])
    assert (ngram_lm.expanded(*ngram_lm.compact(counts), np.arange(6)) == counts).all()
    keys, second, n = np.array([3, 3, 9, 1 << 63], np.uint64), np.array([1, 2, 0, 5], "<u4"), np.array([1, 1 << 40, 2, 3])
    assert all((x == y).all() for x, y in zip(ngram_lm.unpack(ngram_lm.pack(keys, second, n), 2), (keys, second, n), strict=True))


def test_ngram_index():
    g = np.random.default_rng(3)
    for keys in (g.integers(0, 1 << 44, 5000), np.concatenate((g.integers(0, 9, 3000) << 40, np.arange(1 << 20, (1 << 20) + 4000))), np.array([7]), np.array([0, (1 << 64) - 1], np.uint64)):
        keys = np.unique(keys.astype(np.uint64))
        counts = np.minimum(g.zipf(1.4, len(keys)), 1 << 40)
        counts[-1] = (1 << 40) + 7
        index = ngram_lm.indexed(keys, counts)
        asked = np.concatenate((keys, keys + np.uint64(1), g.integers(0, 1 << 63, 50, np.uint64)))
        at, hit = ngram_lm.look_up(index, asked)
        assert (hit == np.isin(asked, keys)).all() and (keys[at[hit]] == asked[hit]).all()
        assert (ngram_lm.index_counts(index, at[hit]) == counts[at[hit]]).all()
    for bits in (1, 7, 16, 22, 24, 32, 62):
        values, n = g.integers(0, 1 << bits, 400, np.uint64), np.append(g.integers(1, 1 << 11, 399), 1 << 40)
        raw, places, large = ngram_lm.fold(values, n, bits)
        assert (ngram_lm.counts_at(raw, places, large, bits, np.arange(400)) == n).all()


def test_ngram_model_takes_little_disk(spark):
    """The files of orders 2 and 3 against 8 bytes a key, 4 a begin, 4 a follower and one a count; of the tables between orders only the last stays."""
    g = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in np.minimum(g.zipf(1.3, 300), 30000)) for _ in range(200)]
    shared = Path(common.filesystem(common.shared_dir(spark))[1])
    tables = lambda: {*shared.glob("llm-trigrams-*"), *shared.glob("llm-pairs-*")}
    already = tables()
    model = ngram_lm.fit(spark.createDataFrame([(t.encode(),) for t in texts], "text binary"), "lmsize")
    tokens = [["<s>", "<s>", *t.split(), ""] for t in texts]
    grams = {x for t in tokens for x in zip(t, t[1:], t[2:], strict=False)}
    plain = 12 * len({x[:2] for x in grams}) + 5 * len(grams) + 9 * len({x[1:] for x in grams})
    files = [common.filesystem(f)[1] for f in (*model.contexts, *model.pairs) if f]
    assert sum(os.path.getsize(f) for f in files) < 0.7 * plain
    assert tables() == already


def vectors(spark, n=400):
    g = np.random.default_rng(2)
    base = g.normal(size=(n // 8, 24))
    x = [base[i % len(base)] + g.normal(size=24) * 0.09 * (i >= len(base)) for i in range(n)]
    rows = [(i, [float(v) for v in x[i]], i % 3) for i in range(n)]
    rows += [(n, rows[5][1], 0), (n + 1, [2 * v for v in rows[5][1]], 0), (n + 2, None, 0), (n + 3, [0.0] * 24, 0), (n + 4, [float("nan")] * 24, 0), (n + 5, [None] * 24, 0), (n + 6, [1.0, 2.0], 0), (n + 7, [2.0, 4.0], 0), (n + 8, [float("inf")] + [1.0] * 23, 0), (n + 9, [], 0), rows[5]]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def test_embeddings(spark):
    df = vectors(spark)
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    ok = [e is not None and len(e) > 0 and all(v is not None and math.isfinite(v) for v in e) and any(e) for _, e in rows]
    unit = [np.array(e) / np.linalg.norm(e) if k else None for (_, e), k in zip(rows, ok, strict=True)]
    linked = lambda i, j: ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= 0.95
    component = by_links(len(rows), linked, [v for v, _ in rows])
    want = [(v, sum(i != j and linked(i, j) for j in range(len(rows))), component[i], v == component[i]) for i, (v, _) in enumerate(rows)]
    got = [tuple(r) for r in embed_graph.near_duplicates(df, embed_graph.Settings(shard_rows=64, most_rows=150)).collect()]
    true, found = dict((w[0], w[1]) for w in want), dict((g[0], g[1]) for g in got)
    assert all(found[v] <= true[v] for v in true) and sum(found.values()) >= 0.95 * sum(true.values())
    same(got, want)
    assert embed_graph.near_duplicates(df.limit(0)).collect() == []


def slices_of(text):
    """The slices of each paragraph, by the rule: cuts behind eight bytes whose hash is 0 modulo 64."""
    data, out, at = text.encode(), [], 0
    cut = {i + 8 for i in range(len(data) - 7) if (int.from_bytes(data[i : i + 8], "little") * 0x9E3779B97F4A7C15 % (1 << 64)) >> 58 == 0}
    for line in data.split(b"\n"):
        ends = [c - at for c in sorted(cut) if at < c < at + len(line)]
        out.append([line[i:j] for i, j in zip([0, *ends], [*ends, len(line)], strict=True) if j > i])
        at += len(line) + 1
    return out


def test_merkle_trees_by_hand():
    digest = lambda x: hashlib.blake2b(x, digest_size=16).digest()
    for t in ["", "one", "a\n\nb", BASE, "\n".join([BASE, words(40), "", words(200)])]:
        sections, held, shown = [], [], []
        paragraphs = slices_of(t)
        for i, leaves in enumerate(paragraphs):
            leaves = [digest(b"l" + x) for x in leaves]
            held.append(digest(b"p" + b"".join(leaves)))
            shown.append(held[-1].hex()[:6] * bool(leaves) + "".join(x.hex()[:4] for x in leaves) * (len(leaves) > 1))
            if not leaves or held[-1][-1] % 8 == 0 or i + 1 == len(paragraphs):
                sections.append((digest(b"s" + b"".join(held)), ",".join(shown)))
                held, shown = [], []
        want = digest(b"r" + b"".join(s for s, _ in sections)).hex() + ":" + ";".join(f"{s.hex()[:8]}={x}" for s, x in sections)
        assert merkle.fingerprint(t) == want and merkle.shown(merkle.parsed(want)) == want


def test_merkle_likeness_and_edits():
    def by_hand(a, b):
        x, y = ([s for p in slices_of(t) for s in p] for t in (a, b))
        rows = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, v in enumerate(x):
            for j, w in enumerate(y):
                rows[i + 1][j + 1] = rows[i][j] + 1 if v == w else max(rows[i][j + 1], rows[i + 1][j])
        return 2 * rows[-1][-1] / (len(x) + len(y))

    a = "\n".join(" ".join(f"word{(i * 37 + j * 11) % 997}" for j in range(60)) for i in range(30))
    lines = a.split("\n")
    shuffled = random.Random(2).sample(lines, len(lines))
    inserted = a.replace("word55 ", "word55 an insertion of five words ", 1)
    for b in (inserted, a[100:], a + " end", lines[3] + "\n" + a, "\n".join(shuffled), merkle.edited(a, "\n".join(lines[::-1]))):
        got = merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(b))
        assert 0 < got < 1 and by_hand(a, b) - 0.05 <= got <= by_hand(a, b) + 0.01
    assert merkle.likeness(merkle.fingerprint(a), merkle.fingerprint("\n".join(shuffled))) < 0.6  # order counts
    assert merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(a)) == 1 and merkle.likeness(merkle.fingerprint("x"), merkle.fingerprint("y")) == 0
    edits = merkle.differing(merkle.fingerprint(a), merkle.fingerprint(inserted))
    line = next(i for i, x in enumerate(inserted.split("\n")) if "an insertion" in x)
    ends = [len(ps) for _, ps in merkle.parsed(merkle.fingerprint(inserted))[1]]
    assert 1 <= len(edits) <= 3 and {sum(ends[:s]) + p for s, p, _ in edits} == {line}


def test_merkle(spark, docs, none, rows):
    hash_of = {(r["doc_id"], r["t"]): r["h"] for r in docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit("")).cast("binary")).alias("h")).collect()}
    order = sorted(rows, key=lambda r: (common.LONG_MIN if r[0] is None else r[0], hash_of[r]))
    want = []
    for i, (d, t) in enumerate(order):
        changed = merkle.edited(t, order[(i + 1) % len(order)][1])
        want.append((d, len(t), hashlib.sha256(changed.encode()).hexdigest(), merkle.fingerprint(t), merkle.fingerprint(changed)))
    got = merkle.fingerprints_with_edits(docs).collect()
    same([tuple(r)[:5] for r in got], want)
    for r in got:
        assert r["near_edited"] == merkle.likeness(r["fingerprint"], r["edited_fingerprint"]) and (r["edited_slices"] == 0) == (r["first_edit"] is None)
    assert merkle.fingerprints_with_edits(none).collect() == []
    assert len({merkle.fingerprint(t) for t in {x for _, x in rows}}) == len({x for _, x in rows})
    many = spark.range(400).select(F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id")).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    texts = {r["text"] for r in many.collect()}
    got = merkle.fingerprints_with_edits(many).collect()
    assert len(got) == 400 and {r["fingerprint"] for r in got} == {merkle.fingerprint(t) for t in texts}


def labelled(spark):
    r = random.Random(9)
    plain, bad = ["the", "of", "on", "ation", "re", "inter", "ed", "th"], ["zorgling", "vexatious", "grumbold"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        text = [r.choice(plain) + r.choice(plain) for _ in range(r.randint(20, 60))]
        if toxic:
            for _ in range(4):
                text.insert(r.randrange(len(text)), r.choice(bad))
        rows.append((i, " ".join(text)))
        labels.append((i, i % 3 == 0, int(toxic), int(i % 5 != 0)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, x boolean, toxic int, quality int")


def test_toxicity(spark, docs, none):
    d, labels = labelled(spark)
    out = toxicity.score(d, labels).join(labels, "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out) and len(held) > 80
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.95
    assert toxicity.clean(d, labels).columns == d.columns and abs(toxicity.clean(d, labels).count() - 450) < 20
    edge = toxicity.score(docs, labels).collect()
    assert len(edge) == docs.count() and all(0 <= r["score"] <= 1 for r in edge)
    assert toxicity.score(none, labels).collect() == [] and toxicity.clean(docs, labels).columns == docs.columns
    assert {r["score"] for r in toxicity.score(docs, labels.limit(0)).collect()} != {None}


def test_mixing(spark, docs, none):
    d, labels = labelled(spark)
    domains = labels.select("doc_id", F.col("toxic").alias("label"))
    out = mixing.rates(d, domains, [0.6, 0.4], BYTE).collect()
    p, n, r = np.array([x["posterior"] for x in out]), np.array([x["tokens"] for x in out]), np.array([x["rate"] for x in out])
    assert np.allclose((r * n) @ p / n.sum(), [0.6, 0.4], atol=1e-4) and (r >= 0).all()
    assert all(np.allclose(x["reached"], (r * n) @ p) and np.allclose(x["wanted"], n.sum() * np.array([0.6, 0.4])) and x["settled"] for x in out)
    assert all(x["copies"] in (math.floor(x["rate"]), math.floor(x["rate"]) + 1) for x in out)
    library = Tokenizer.from_file(BYTE)
    true = {x["doc_id"]: len(library.encode(x["text"], add_special_tokens=False).ids) + 1 for x in d.collect()}
    assert abs(sum(n) / sum(true.values()) - 1) < 0.02
    kept = mixing.mixed(d, domains, [0.6, 0.4], BYTE)
    assert kept.columns == d.columns and Counter(x["doc_id"] for x in kept.collect()) == {x["doc_id"]: x["copies"] for x in out if x["copies"]}
    assert mixing.rates(none, domains, [0.5, 0.5], BYTE).collect() == [] and mixing.mixed(none, domains, [0.5, 0.5], BYTE).collect() == []
    edge = mixing.rates(docs, domains, [0.5, 0.5], BYTE).collect()
    assert len(edge) == docs.count() and all(x["rate"] >= 0 and x["tokens"] >= 1 for x in edge)
    odd = spark.createDataFrame([(None, 1), (0, None), (4, 0), (4, 1), (999999, 1), (8, 7)], "doc_id long, label int")
    assert len(mixing.rates(d, odd, [0.5, 0.5], BYTE).collect()) == d.count()


def test_mixing_learns_and_counts_whole_texts(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("aeioubcdfghklmnprst") for _ in range(r.randint(3, 9)))
    long = {i: " ".join(word() + r.choice([" zorgling", " vexatious"]) for _ in range(1300)) for i in range(12)}  # all of domain 1, and all over 16 KB
    rows = list(long.items()) + [(i, " ".join(word() for _ in range(40))) for i in range(12, 300)]
    rows += [(300 + i, f"{t} {word()}") for i, t in enumerate(long.values())]  # without a label
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 12)) for i in range(300)], "doc_id long, label int")
    assert min(len(t) for _, t in rows[:12]) > 16384
    library = Tokenizer.from_file(BYTE)
    out = {x["doc_id"]: x for x in mixing.rates(d, labels, [0.5, 0.5], BYTE).collect()}
    assert all(out[i]["tokens"] == len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows)
    assert all(out[i]["posterior"][1] > 0.9 for i in [*range(12), *range(300, 312)]) and max(out[i]["posterior"][1] for i in range(12, 300)) < 0.1


def test_classifier_learns_from_every_row(spark):
    d, labels = labelled(spark)
    texts = dict(d.collect())
    label = {x["doc_id"]: x["toxic"] for x in labels.collect()}
    few = labels.select("doc_id", F.col("toxic").alias("label"))
    one = subword.one_label(few, 2)
    want, number = np.zeros((2, 1 << subword.BITS), np.int64), np.zeros(2, np.int64)
    for i, t in texts.items():
        number[label[i]] += 1
        found = [b[v] for b, v in subword.grams(subword._buffer([t.encode()])[0], (4, 5), subword.BITS)]
        want[label[i], np.unique(np.concatenate(found))] += 1
    for rows in (d, d.repartition(7)):
        held, n = subword.occurrences(rows.select("doc_id", F.col("text").cast("binary").alias("text")).join(one, "doc_id"), 2, (4, 5))
        assert (held == want).all() and n.tolist() == number.tolist() == [450, 150]
    groups = subword.grouped(d, one, 2, (4, 5))
    x, y = groups.shares([t.encode() for t in texts.values()]), np.array([label[i] for i in texts])
    table = spark.createDataFrame([(int(a), b) for a, b in zip(y, x.tolist(), strict=True)], "label int, shares array<double>").repartition(3)
    weights = subword.fit_weights(table, groups)
    gap = (subword.probabilities(x, weights) - np.eye(2)[y])[:, 1:].T @ x / len(x) + 1e-4 * x.var(0) * weights
    assert np.abs(gap).max() < 1e-4  # the optimum over all rows
    model = subword.linear(groups, weights)
    assert np.allclose(model.probabilities([t.encode() for t in texts.values()]), subword.probabilities(x, weights), atol=1e-4)
    long = ["ab " * 3000, "", "x", "größer " * 20]
    assert all(np.array_equal(a, np.unique(np.concatenate([b[v] for b, v in subword.grams(subword._buffer([t.encode()])[0], (4, 5), subword.BITS)] or [np.zeros(0)]))) for t, a in zip(long, subword.distinct([t.encode() for t in long], (4, 5)), strict=True))


def test_mixing_is_the_constrained_optimum(spark):
    g = np.random.default_rng(3)
    cases = [(np.array([[1.0, 0.0], [0.0, 1.0], [0.5, 0.5], [0.9, 0.1]]), [0.02, 0.98]), (np.array([[1.0, 0.0], [0.5, 0.5]]), [0.0, 1.0]), (g.dirichlet([0.5] * 3, 40), [0.5, 0.3, 0.2])]
    for p, targets in cases:
        n = g.integers(1, 30, len(p)).astype(float)
        table = spark.createDataFrame([(float(a), b) for a, b in zip(n, p.tolist(), strict=True)], "tokens double, posterior array<double>")
        fit = mixing.fit_rates(table, targets, most_steps=400, tolerance=1e-8)
        r = mixing.rate(p, fit.steps)
        gap = (r * n) @ p - np.array(targets) * n.sum()
        gradient = p @ np.linalg.pinv((p * n[:, None]).T @ p, rcond=1e-9) @ gap
        assert fit.settled and (r >= 0).all() and np.allclose(fit.reached, (r * n) @ p)
        assert (np.abs(gradient[r > 1e-9]) < 1e-3).all() and (gradient[r <= 1e-9] > -1e-3).all()  # no rate could move and bring the targets nearer


def test_large_rates_are_dealt_into_batches(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, label int")
    out = mixing.rates(rows, labels, [0.5, 0.5], BYTE).collect()
    assert mixing.mixed(rows, labels, [0.5, 0.5], BYTE).count() == sum(x["copies"] for x in out)
    ends = np.cumsum(mixing._copies(np.array([1000.0, 0.0, 2.5]), np.array([0.9, 0.9, 0.1])))
    assert ends.tolist() == [1000, 1000, 1003]


def test_token_counts(docs, none, rows):
    library = Tokenizer.from_file(BYTE)
    want = [(d, len(t.encode()), n, n > 512) for d, t in rows for n in [len(library.encode(t, add_special_tokens=False).ids)]]
    same([tuple(r) for r in token_counts.count_tokens(docs, BYTE, entries=50, per_task=20).collect()], want)
    assert token_counts.count_tokens(none, BYTE).collect() == []


def test_token_files(spark, docs, none, rows):
    library = Tokenizer.from_file(WORD)
    manifest = token_files.write(docs, common.scratch(spark, "t"), WORD, frame_ids=100)
    got = [tuple(r) for r in token_files.read(spark, manifest).collect()]
    lengths = {d: [*library.encode(t, add_special_tokens=False).ids, 2] for d, t in rows}
    assert len(got) == len(rows)
    start = 0
    for d, s, n, crc in sorted(got, key=lambda x: x[1]):
        ids = lengths[d]
        assert (s, n, crc) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += n
    assert [x[0] for x in sorted(got, key=lambda x: x[1])] == sorted((d for d, _ in rows), key=lambda d: common.LONG_MIN if d is None else d)
    reader = token_files.Reader(manifest.orderBy(F.desc("documents")).first()["file"])
    some = reader.frames[-1][5]
    assert len(reader.frames) > 1 and reader.find(some) and reader.find(-77) == []
    assert token_files.read(spark, token_files.write(none, common.scratch(spark, "t"), WORD)).collect() == []


def test_damaged_frame_is_noticed(spark, docs, tmp_path):
    file = token_files.write(docs, common.scratch(spark, "t"), WORD).first()["file"]
    _, path = common.filesystem(file)
    data = bytearray(open(path, "rb").read())
    data[30] ^= 255
    copy = tmp_path / "x"
    copy.write_bytes(data)
    with pytest.raises(Exception):  # noqa: B017
        list(token_files.Reader(str(copy)).documents())


def test_warc(spark):
    big = "".join(rng.choice("abcdefé\n") for _ in range(30000))
    rows = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, None), (4, "u v", ""), (5, "http://b", big), (6, "http://c", big), (None, "http://d", "<p>x</p>"), (7, "http://e", "only"), (None, "f", "nobody else")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    files = warc.write(pages, common.scratch(spark, "w"), segment=1000)
    got = [tuple(r) for r in warc.page_records(warc.read(spark, files)).collect()]
    best = {}
    for p, _, h in rows:
        best[h or ""] = max((x for x in (best.get(h or ""), p) if x is not None), default=None)
    want = []
    for p, _, h in rows:
        h = h or ""
        revisit = best[h] != p
        want.append((p, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "revisit" if revisit else "response", best[h] if revisit else None, None))
    same(got, want)
    small = [r for r in warc.page_records(warc.read(spark, warc.write(pages, common.scratch(spark, "w"), smallest=100))).collect()]
    assert {r["page_id"] for r in small if r["record_type"] == "revisit"} == {5}
    assert warc.read(spark, warc.write(pages.limit(0), common.scratch(spark, "w"))).collect() == []


def test_warc_problems():
    assert warc.unchunked(warc.chunked(b"abc" * 9999, 7)) == b"abc" * 9999 and warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nab")


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"] for r in docs.collect()}
        docs = common.materialize(stage(spark, docs, sf), "test")
        assert {r["doc_id"] for r in docs.select("doc_id").collect()} <= before
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    library = Tokenizer.from_file(BYTE)
    sums = defaultdict(int)
    for r in docs.collect():
        sums[r["doc_id"]] += r["length"]
    texts = {r["doc_id"]: r["text"] for r in common.table(spark, sf, "documents").collect()}
    assert all(s % (len(library.encode(texts[d], add_special_tokens=False).ids) + 1) == 0 for d, s in sums.items())
    assert len(corpus_pipeline.STAGES) == 4 and corpus_pipeline.run(spark, sf).count() == docs.count()


def test_scoring_takes_little_memory(monkeypatch):
    """Blocks bound what scoring holds, and give the same numbers."""
    g = np.random.default_rng(3)
    texts = [b"", *(bytes(g.integers(97, 123, 4000, np.uint8)).replace(b"e", b" ") for _ in range(1000))]
    model = subword.Model(g.normal(size=(1, 1 << 18)).astype(np.float32), np.zeros(1), (4, 5, 6), 18, 256.0)
    tracemalloc.start()
    found = model.probabilities(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20
    monkeypatch.setattr(subword, "BLOCK", 1 << 30)
    assert np.array_equal(found, model.probabilities(texts)) and model.probabilities([]).shape == (0, 2)


def test_lean_tasks_start_without_encoders():
    """Reused workers don't carry a tokenizer's caches into stages without one; no row is lost or moved."""
    bpe.encoder(BYTE)
    batches = [pa.record_batch([pa.array(range(n))], ["x"]) for n in (0, 3, 2500)]
    rows = common.lean(batches)
    first = next(rows)
    assert bpe.encoder.cache_info().currsize == 0
    assert [x for b in (first, *rows) for x in b.column(0).to_pylist()] == [*range(3), *range(2500)]
