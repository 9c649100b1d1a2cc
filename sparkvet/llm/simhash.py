"""SimHash near-duplicates by segment popcounts.

A fingerprint is seen as 32 segments of two bits, each standing for its number of set bits. In unary (01, 11 for 1 and 2) the
Manhattan distance of two such vectors is the popcount of their XOR, and it never exceeds the Hamming distance of the
fingerprints. Vectors within distance 2 differ in at most 2 of 6 groups of segments, so they share at least one of the
15 grid cells made of 4 groups. Candidates of a cell are filtered by the Manhattan bound and verified exactly.

A cell of over `cell_rows` different fingerprints is cut further by a second grid of the same kind, whose segments have one bit and
whose groups lie across those of the first: members within distance 2 agree in 4 of its 6 groups too. A cell of both grids
leaves about ten bits open, so the number of different fingerprints in it is bounded whatever the input. Nothing is left out.

Defined cases: null text counts as empty; a text without words has fingerprint 0 and links like any other; fewer than three
words are one shingle; repeated rows give repeated rows; a null doc_id never names a component unless nothing else can.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

SEED = 42
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def digests(text: bytes, width: int = 3) -> np.ndarray:
    """Eight hash bytes a row for each shingle of `width` words, repeats included; A-Z lower-cased, words cut at ASCII white space. Fewer words are one shingle."""
    words = text.lower().split()
    if not words:
        return np.empty((0, 8), np.uint8)
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-width] + 1)).tolist()
        shingles = [joined[a:b] for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED))), np.uint8).reshape(-1, 8)


def simhash(found: np.ndarray) -> int:
    """64-bit SimHash of the digests of a text, signed; 0 without any."""
    if not len(found):
        return 0
    set_bits = np.concatenate([np.bincount(found[:, i], minlength=256) @ BITS for i in range(8)])
    return int.from_bytes(np.packbits(2 * set_bits > len(found)).tobytes(), "big", signed=True)


def fingerprint(text: bytes) -> int:
    """SimHash of 3-word shingles."""
    return simhash(digests(text))


def fingerprints(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (doc_id unless given) with the fingerprint of text as a signed long, __fp."""
    kept = docs.select(*[docs[c] for c in keep or ["doc_id"]], common.text_bytes(docs).alias("__text"))
    schema = kept.drop("__text").schema.add("__fp", "long")

    def run(batches):
        for batch in batches:
            found = pa.array([fingerprint(t) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=[*batch.schema.names[:-1], "__fp"])

    return kept.mapInArrow(run, schema)


def _masks(groups: list[int]) -> list[int]:
    """Masks of the 15 choices of 4 out of 6 groups of bits, as signed longs."""
    masks = [sum(c) for c in combinations(groups, 4)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _runs() -> list[int]:
    """Six groups of segments that follow each other: 5, 5, 5, 5, 6, 6 segments of two bits."""
    groups, at = [], 0
    for width in (10, 10, 10, 10, 12, 12):
        groups.append(((1 << width) - 1) << at)
        at += width
    return groups


def _stripes() -> list[int]:
    """Six groups of single bits, each spread evenly over the fingerprint."""
    return [sum(1 << i for i in range(64) if i % 6 == k) for k in range(6)]


def unary_popcounts(fp: Column) -> Column:
    """Each two bits of fp replaced by their popcount in unary."""
    odd = F.lit(0x5555555555555555)
    shifted = F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(shifted).bitwiseAND(odd)
    both = fp.bitwiseAND(shifted).bitwiseAND(odd)
    return some.bitwiseOR(F.shiftleft(both, 1))


def _cells(rows: DataFrame, by: str, groups: list[int], *more: str) -> DataFrame:
    """rows with a row for each of the 15 cells of column `by`: g, cell, and the columns `more`."""
    places = F.array(*[F.struct(F.lit(i).alias("g"), F.col(by).bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(_masks(groups))])
    return rows.select("__fp", "__t", *more, F.explode(places).alias("x")).select("__fp", "__t", *more, "x.g", "x.cell")


def _close_pairs(members: DataFrame, keys: list[str], distance: int) -> DataFrame:
    """Pairs within a cell that the Manhattan bound lets pass and the exact distance confirms."""
    a, b = members.alias("a"), members.alias("b")
    close = (F.col("a.__fp") > F.col("b.__fp")) & (F.bit_count(F.col("a.__t").bitwiseXOR(F.col("b.__t"))) <= distance) & (F.bit_count(F.col("a.__fp").bitwiseXOR(F.col("b.__fp"))) <= distance)
    for k in keys:
        close = close & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return a.join(b, close).select(F.col("a.__fp").alias("a"), F.col("b.__fp").alias("b"))


def links(fps: DataFrame, distance: int = 2, cell_rows: int = 256) -> DataFrame:
    """Edges (a, b): all pairs of different fingerprints within `distance` (at most 2) bits, some of them repeated. fps: __fp, distinct."""
    if not 0 <= distance <= 2:
        raise ValueError("4 of 6 groups agree within 2 bits at most")
    embedded = fps.select("__fp", unary_popcounts(F.col("__fp")).alias("__t"))
    cells = _cells(embedded, "__t", _runs())
    sizes = common.materialize(cells.groupBy("g", "cell").agg(F.count("*").alias("n")).where("n > 1"), "cells")
    members = common.materialize(cells.join(sizes, ["g", "cell"]), "members")
    plain = members.where(F.col("n") <= cell_rows).select("__fp", "__t", "g", "cell")
    crowded = members.where(F.col("n") > cell_rows).select("__fp", "__t", F.col("g").alias("g1"), F.col("cell").alias("cell1"))
    finer = _cells(crowded, "__fp", _stripes(), "g1", "cell1")
    return _close_pairs(plain, ["g", "cell"], distance).union(_close_pairs(finer, ["g1", "cell1", "g", "cell"], distance))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable by links of at most 2 bits) of every row."""
    rows = common.materialize(fingerprints(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])), "fingerprints")
    named = component_of_fingerprints(rows)
    hot = common.hot_keys(named, "__fp", "__n")
    joined = common.salted_join(rows, named.select("__fp", "component_id"), "__fp", F.col("doc_id"), hot)
    return joined.select("doc_id", F.lpad(F.lower(F.hex("__fp")), 16, "0").alias("fingerprint"), "component_id")


def component_of_fingerprints(rows: DataFrame) -> DataFrame:
    """__fp, __n (rows that have it), component_root (least fingerprint), component_id. rows: doc_id, __fp."""
    fps = common.materialize(rows.groupBy("__fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("__n")), "distinct")
    roots = components(links(fps.select("__fp")))
    rooted = fps.join(roots, fps["__fp"] == roots["node"], "left").select("__fp", "__n", "least", F.coalesce("root", "__fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return common.materialize(rooted.join(first, "root").select("__fp", "__n", F.col("root").alias("component_root"), "component_id"), "components")


def first_rows(docs: DataFrame, found: DataFrame, key: str, named: DataFrame) -> DataFrame:
    """The first row of docs by (doc_id, hash of the text) of each component_root. found: doc_id, __th, key; named: key, component_root."""
    least = found.groupBy(key).agg(F.min(F.struct(common.id_order(F.col("doc_id")).alias("id"), "__th")).alias("least"))
    kept = named.join(least, key).groupBy("component_root").agg(F.min("least").alias("least")).select("least.*").withColumnRenamed("id", "__id")
    keyed = docs.select(F.struct("*").alias("__row"), common.id_order(docs["doc_id"]).alias("__id"), F.xxhash64(docs["text"]).alias("__th"))
    return keyed.join(kept.distinct(), ["__id", "__th"], "left_semi").dropDuplicates(["__id", "__th"]).select("__row.*")
