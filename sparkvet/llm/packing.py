"""Best-fit packing of tokenized documents into sequences, after a Martello-Toth dominance reduction.

Lengths are whole numbers up to the capacity, so the instance is a histogram of at most `capacity` classes however many
documents there are. The reduction fixes sets {j}, {j, a} and {j, a, b} that dominate every other way to place length j;
best fit by decreasing length packs what is left. Both yield patterns with multiplicities, and the k-th piece of a
class finds its place from its rank alone.

Defined cases: null text counts as empty; every document ends with `end_id`, so an empty one is a piece of length 1; repeated
rows are packed once each; an empty table gives no rows; other input columns are ignored; a null doc_id stays null.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe, common

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens; only the first may be shorter than the capacity."""
    head = n % capacity or min(n, capacity)
    return [(0, head), *((at, capacity) for at in range(head, n, capacity))] if n else []


def tokenized_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    end = end_id.to_bytes(4, "little")

    def run(batches):
        encode = bpe.encoder(vocabulary)
        for batch in batches:
            rows = ([], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode.ids(text) + end
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    for column, value in zip(rows, (doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])), strict=True):
                        column.append(value)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.text_bytes(docs).alias("text")).mapInArrow(run, PIECES)


class _Classes:
    """Counts of the lengths that are left, with the ascending list of those lengths."""

    def __init__(self, histogram: dict[int, int]):
        self.n = {s: c for s, c in histogram.items() if c > 0}
        self.sizes = sorted(self.n)

    def take(self, size: int, m: int) -> None:
        self.n[size] -= m
        if not self.n[size]:
            del self.n[size]
            self.sizes.pop(bisect_left(self.sizes, size))

    def give(self, size: int, m: int) -> None:
        if size not in self.n:
            insort(self.sizes, size)
        self.n[size] = self.n.get(size, 0) + m

    def largest(self, limit: int) -> int:
        """The largest length left that is <= limit, or 0."""
        at = bisect_right(self.sizes, limit)
        return self.sizes[at - 1] if at else 0

    def two_above(self, size: int) -> int:
        """Sum of the two smallest single pieces longer than size; a very large number if there are not two."""
        got = []
        for s in self.sizes[bisect_right(self.sizes, size) :]:
            got += [s] * min(2 - len(got), self.n[s])
            if len(got) == 2:
                return sum(got)
        return 1 << 60

    def most_with(self, room: int) -> int:
        """How many of the shortest pieces fit into room together, 3 standing for 3 or more."""
        got = 0
        for s in self.sizes:
            while got < 3 and room >= s and got < 3:
                fits = min(self.n[s], room // s, 3 - got)
                if not fits:
                    return got
                got += fits
                room -= fits * s
                break
            if got >= 3 or room < s:
                break
        return min(got, 3)

    def best_pair(self, room: int) -> int:
        """The largest sum of two pieces that fits into room, or 0."""
        best = 0
        for a in self.sizes:
            if a > room:
                break
            self.take(a, 1)
            b = self.largest(room - a)
            self.give(a, 1)
            if b:
                best = max(best, a + b)
        return best


def reduce_dominated(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Fixed patterns with multiplicities, and the histogram that is left.

    For the longest open length j, let a be the longest other piece that fits beside it.
    - Nothing fits: {j} is all that can be done.
    - a fills the sequence, or at most one piece fits beside j, or a is at least as long as any two that fit together:
      whatever stands beside j in some packing can trade places with a, so {j, a} dominates.
    - At most two fit, b is the longest that fits beside j and a, and no two pieces both longer than b fit beside j:
      {j, a, b} dominates.
    Fixing a set only removes pieces, which keeps the conditions true for its other copies while j, a and b last.
    """
    left, fixed = _Classes(histogram), []
    changed = True
    while changed:
        changed = False
        for j in reversed(list(left.sizes)):
            while j in left.n:
                left.take(j, 1)
                room = capacity - j
                a = left.largest(room)
                chosen: tuple[int, ...] | None = None
                if not a:
                    chosen = (j,)
                else:
                    k = left.most_with(room)
                    if a == room or k == 1 or (k == 2 and a >= left.best_pair(room)):
                        chosen = (j, a)
                    elif k == 2:
                        left.take(a, 1)
                        b = left.largest(room - a)
                        left.give(a, 1)
                        if b and left.two_above(b) > room:
                            chosen = (j, a, b)
                left.give(j, 1)
                if chosen is None:
                    break
                m = min(left.n[s] // chosen.count(s) for s in set(chosen))
                if not m:
                    break
                for s in chosen:
                    left.take(s, m)
                fixed.append((chosen, m))
                changed = True
    return fixed, left.n


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit by decreasing length; sequences with the same content so far are handled as one pattern with a multiplicity."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(room: int, items: tuple[int, ...], m: int) -> None:
        if m:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((items, m))

    for size in sorted(histogram, reverse=True):
        count = histogram[size]
        while count:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                items, m = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            else:
                room, items, m = capacity, (), count
            each = room // size
            full = min(m, count // each)
            put(room - each * size, items + (size,) * each, full)
            count -= full * each
            m -= full
            if m and count:  # fewer than `each` are left: they go into one more sequence
                put(room - count * size, items + (size,) * count, 1)
                count, m = 0, m - 1
            if items:
                put(room, items, m)
    return [x for groups in open_.values() for x in groups]


def plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the ranks of each length go: sorted keys length << 44 | first rank, first sequence, offset, number of ranks."""
    fixed, rest = reduce_dominated(histogram, capacity)
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for items, m in [*fixed, *best_fit(rest, capacity)]:
        offset = 0
        for size in items:
            rank = used.get(size, 0)
            rows.append(((size << 44) | rank, sequence, offset, m))
            used[size] = rank + m
            offset += size
        sequence += m
    rows.sort()
    return tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 4


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, buckets: int = 256) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. docs: doc_id, text.

    buckets: the least number of parts in which pieces of one length are numbered, whose counts make the numbers global; a part more for each 2^18 pieces.
    """
    pieces = common.materialize(tokenized_pieces(docs, vocabulary, capacity, end_id), "pieces")
    buckets = max(buckets, pieces.count() >> 18)
    pieces = pieces.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = pieces.groupBy("length", "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("__n")).collect()}  # a row per length: at most `capacity`
    keys, sequences, places, _ = plan(histogram, capacity)
    within = Window.partitionBy("length", "__bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("__rank", F.row_number().over(within) - 1).join(offsets, ["length", "__bucket"])

    def place(batches):
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            key = (batch.column("length").to_numpy() << 44) | rank
            at = np.searchsorted(keys, key, side="right") - 1
            first = keys[at] & ((1 << 44) - 1)
            out = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch([*out, pa.array(sequences[at] + rank - first), pa.array(places[at])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("__rank") + F.col("__before")).cast("long").alias("rank"))
    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")
