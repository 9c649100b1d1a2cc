"""Token counts by a map-side lookup in two tiers.

Tier one is a table of frequent pre-token lengths, broadcast in compact form (one block of bytes and one of small
numbers); tier two is the bounded cache of each worker, which encodes what the table lacks. No pre-token is shuffled:
the table is found from at most `per_task` candidates a task. The table saves time only; counts never depend on it.

Defined cases: null text counts as empty (0 tokens); null doc_id stays null; repeated rows are counted once each; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, common


def frequent_pieces(docs: DataFrame, entries: int, per_task: int, longest: int = 24) -> list[bytes]:
    """The most frequent pieces of all texts, as far as bounded counters of the tasks know them."""

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(text.split(b" "))
                if len(seen) > 32 * per_task:
                    seen = Counter(dict(seen.most_common(4 * per_task)))
        top = [(p, n) for p, n in seen.most_common(per_task) if 0 < len(p) <= longest]
        yield pa.record_batch([pa.array([p for p, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])

    found = docs.select(common.text_bytes(docs).alias("text")).mapInArrow(run, "piece binary, n long")
    return [bytes(r[0]) for r in found.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(entries).collect()]


def length_table(pieces: list[bytes], vocabulary: str) -> tuple[bytes, bytes]:
    """The pieces, joined, and their token counts as uint16; pieces hold no spaces."""
    known = bpe.PieceEncoder(vocabulary)
    kept, counts = [], []
    for piece in pieces:
        try:
            n = len(known._spaced(piece)) // 4
        except bpe.Irregular:
            continue
        kept.append(piece)
        counts.append(n)
    return b" ".join(kept), np.array(counts, np.uint16).tobytes()


_counters: dict[tuple, bpe.PieceEncoder] = {}


def counter(vocabulary: str, table: tuple[bytes, bytes]) -> bpe.PieceEncoder:
    key = (vocabulary, hash(table))
    if key not in _counters:
        _counters.clear()  # a worker counts for one query at a time
        start = dict(zip(table[0].split(b" "), np.frombuffer(table[1], np.uint16).tolist(), strict=True)) if table[0] else {}
        _counters[key] = bpe.PieceEncoder(vocabulary, start)
    return _counters[key]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, entries: int = 16384, per_task: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row."""
    table = docs.sparkSession.sparkContext.broadcast(length_table(frequent_pieces(docs, entries, per_task), vocabulary))

    def run(batches):
        count = counter(vocabulary, table.value).count
        for batch in batches:
            texts = batch.column(1).to_pylist()
            tokens = [count(t) for t in texts]
            yield pa.record_batch([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.text_bytes(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
