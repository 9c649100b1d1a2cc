"""Each stage of the pipeline against a brute-force version, on whole tables, and on an empty one."""

import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from sparkvet.llm import common, mixing, queries, stages, toxicity

from test_similar import groups

SF = "/root/testdata/sf0.001"


def n_grams(text):
    """Buckets of the byte 4-, 5- and 6-grams of a text that hold no white space but at their ends, and whether they are counted."""
    data = bytes(32 if chr(b).isspace() and b < 128 else (b + 32 if 65 <= b <= 90 else b) for b in text)
    data = b" " + data + b" "
    for n in (4, 5, 6):
        for i in range(len(data) - n + 1):
            g = data[i : i + n]
            if 32 not in g[1:-1]:
                h = g[0]
                for b in g[1:]:
                    h = (h * 0x01000193 & 0xFFFFFFFF) ^ b
                yield ((h + n) * 0x9E3779B1 & 0xFFFFFFFF) >> 14


def toxic_score(model, text):
    found = list(n_grams(text))
    z = model.scale * sum(float(model.margins[0][b]) for b in found) / max(1, len(found)) + float(model.bias[0])
    return 1 / (1 + np.exp(-z))


def test_stages_against_brute_force(spark):
    docs = common.table(spark, SF, "documents")
    rows = [r.asDict() for r in docs.collect()]
    key = lambda r: (r["doc_id"] is not None, r["doc_id"], r["text"] or "")

    model = toxicity.fit(docs, common.table(spark, SF, "labels"))
    want = [r for r in rows if toxic_score(model, (r["text"] or "").encode()) < 0.5]
    kept = common.materialize(stages.drop_toxic(spark, docs, SF), "t")
    assert sorted((r.asDict() for r in kept.collect()), key=key) == sorted(want, key=key) and 0 < len(want) < len(rows)

    rows = sorted(want, key=key)
    group = groups([r["text"] for r in rows])
    want = [r for i, r in enumerate(rows) if group.index(group[i]) == i]
    kept = common.materialize(stages.drop_near_copies(spark, kept, SF), "t")
    assert sorted((r.asDict() for r in kept.collect()), key=key) == want and len(want) < len(rows)

    rated = mixing.rates(kept, queries.quality_domains(spark, SF), queries.QUALITY_TARGETS, queries.tokenizer_path(queries.BYTE_BPE)).collect()
    p, n, r = np.array([x["posterior"] for x in rated]), np.array([x["tokens"] for x in rated]), np.array([x["rate"] for x in rated])
    gap = (r * n) @ p - np.array(queries.QUALITY_TARGETS) * n.sum()
    gradient = p @ np.linalg.pinv((p * n[:, None]).T @ p) @ gap
    assert rated[0]["settled"] and (np.abs(gradient[r > 1e-9]) < 1e-3).all() and (gradient[r <= 1e-9] > -1e-3).all()  # the constrained optimum
    copies = {x["doc_id"]: x["copies"] for x in rated}
    mixed = common.materialize(stages.mix_to_targets(spark, kept, SF), "t")
    rows = [r.asDict() for r in mixed.collect()]
    assert Counter(r["doc_id"] for r in rows) == {d: c for d, c in copies.items() if c}
    assert all(abs(c - x["rate"]) < 1 for x in rated for c in [copies[x["doc_id"]]]) and all(r in want for r in rows)

    library = Tokenizer.from_file(queries.tokenizer_path(queries.BYTE_BPE))
    pieces = Counter()
    for x in rows:
        ids = [*library.encode(x["text"] or "", add_special_tokens=False).ids, 2]
        head = len(ids) % 1024 or min(1024, len(ids))
        cuts = [0, *range(head, len(ids) + 1, 1024)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            pieces[x["doc_id"], i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    packed = stages.pack_sequences(spark, mixed, SF).collect()
    assert Counter(tuple(x)[:5] for x in packed) == pieces
    places = defaultdict(list)
    for x in packed:
        places[x["sequence_id"]].append((x["offset"], x["length"]))
    for items in places.values():
        items.sort()
        assert items[0][0] == 0 and all(a + m == b for (a, m), (b, _) in zip(items, items[1:], strict=False)) and sum(m for _, m in items) <= 1024


def test_empty_table_and_clashing_columns(spark):
    docs = common.table(spark, SF, "documents").withColumnsRenamed({"lang": "__set", "source": "tokens"})
    for frame in (docs.limit(0), docs.limit(7)):
        for name, stage in corpus_pipeline.STAGES:
            out = common.materialize(stage(spark, frame, SF), "t")
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == frame.columns and out.count() <= 4 * frame.count()
