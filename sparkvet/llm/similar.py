"""Groups of documents by exact Jaccard similarity of their shingle sets.

Candidates come from SimHash links of at most 2 bits and from bands of min-hashes: 64 bits of SimHash lie up to 14 bits apart at a
similarity of 0.8, where cells of segments select too little. With 20 bands of 5 a pair at 0.8 shares a band with a chance of 0.9996,
more similar ones with a higher one. Every candidate is verified on the whole sets, so no pair below the similarity links.

Texts with the same set are one class. A first round holds each class against the one of its band that has most company in its own bands: the
text that the others were copied from, if there is one, so large groups are linked with few pairs. A second one holds all pairs of a band that are still apart, so a band whose classes are one group by then needs
nothing. Of these pairs only such are handed on whose sizes and parity sketches allow the similarity: a sketch has a bit for each of `WORDS` * 64 buckets of
shingle hashes, set if an odd number of shingles falls into it, so two sketches never differ in more bits than the sets differ in shingles, and the filter loses
nothing.

The classes of bands of over `cell_rows` classes, the variants of one text say, are joined by what is rare in them instead, over all such bands at once. Each
set is put in one order for all, shingles of frequent buckets last, and lists its class under the first of them, one more than it can do without at the
similarity: two similar sets share a list, and what they share first lies far enough in front in both for the rest to suffice. This is exact, needs no second band, and
a list holds the classes that share a rare shingle, however many share the frequent ones. Lists of one group, and classes that no other of their list
can be similar to by place and size, drop out. A list that is crowded even so is dealt to at most `MOST_BLOCKS` blocks, so the rows that are
made grow as the input; only the comparisons within such a list grow with its square. No class is left out.

Defined cases: null text counts as empty, and empty texts are one group; fewer words than a shingle are one shingle; repeated rows leave one row; a
null doc_id comes first; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components
from .simhash import digests, first_rows, links, simhash

BANDS, ROWS = 20, 5
FACTORS = np.random.default_rng(42).integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
BLOCK = 1024
WORDS = 16  # 64-bit words of a parity sketch
BUCKETS = 1 << 18  # in which shingles are counted; their order alone depends on the counts
MOST_BLOCKS = 32


def shingle_set(found: np.ndarray) -> np.ndarray:
    """The different digests, ascending."""
    return np.unique(found.reshape(-1).view(np.uint64))


def bands(shingles: np.ndarray) -> list[int]:
    """A signed long for each band of min-hashes; none without shingles."""
    if not len(shingles):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(shingles), BLOCK):
        least = np.minimum(least, (FACTORS[:, None] * shingles[None, i : i + BLOCK]).min(axis=1))
    joined, width = least.tobytes(), 8 * ROWS
    return [int.from_bytes(xxhash.xxh64_digest(joined[i * width : (i + 1) * width], i), "big", signed=True) for i in range(BANDS)]


def parity_sketch(shingles: np.ndarray) -> list[int]:
    """WORDS signed longs: a bit is set where an odd number of shingles falls into its bucket."""
    odd = np.bincount((shingles % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(">i8").tolist()


def _classes(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, __th of docs with __set (hash of the shingle set), __n (its size), __fp (SimHash), __bands, __sketch."""
    kept = docs.select("doc_id", "__th", common.text_bytes(docs).alias("__text"))
    schema = kept.drop("__text").schema.add("__set", "long").add("__n", "integer").add("__fp", "long").add("__bands", T.ArrayType(T.LongType())).add("__sketch", T.ArrayType(T.LongType()))

    def run(batches):
        for batch in common.lean(batches):
            sets, sizes, fps, cells, sketches = [], [], [], [], []
            for text in batch.column(2):
                found = digests(text.as_py(), words)
                shingles = shingle_set(found)
                sets.append(int.from_bytes(xxhash.xxh64_digest(shingles.tobytes()), "big", signed=True))
                sizes.append(len(shingles))
                fps.append(simhash(found))
                cells.append(bands(shingles))
                sketches.append(parity_sketch(shingles))
            made = [pa.array(sets, pa.int64()), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64()), pa.array(cells, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], names=["doc_id", "__th", "__set", "__n", "__fp", "__bands", "__sketch"])

    return kept.mapInArrow(run, schema)


def _sets(docs: DataFrame, found: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """__set and its shingles as bytes, of the classes in wanted (__set, distinct)."""
    one = found.groupBy("__set").agg(F.min(F.struct(common.id_order(F.col("doc_id")).alias("__id"), "__th")).alias("x"))
    chosen = one.join(wanted, "__set").select("__set", "x.__id", "x.__th")
    keyed = docs.select(common.id_order(docs["doc_id"]).alias("__id"), "__th", common.text_bytes(docs).alias("__text"))
    texts = keyed.join(chosen, ["__id", "__th"]).dropDuplicates(["__id", "__th"]).select("__set", "__text")

    def run(batches):
        for batch in common.lean(batches):
            made = pa.array([shingle_set(digests(t.as_py(), words)).tobytes() for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["__set", "shingles"])

    return common.materialize(texts.mapInArrow(run, "__set long, shingles binary"), "sets")


def _verified(docs: DataFrame, found: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of classes whose sets have the similarity."""
    pairs = common.materialize(pairs, "pairs")
    sets = _sets(docs, found, pairs.select(F.col("a").alias("__set")).union(pairs.select("b")).distinct(), words)
    hot = common.hot_keys(pairs.groupBy("b").agg(F.count("*").alias("n")), "b", "n")
    x = common.salted_join(pairs, sets.select(F.col("__set").alias("b"), F.col("shingles").alias("y")), "b", F.col("a"), hot, how="inner")
    x = x.join(sets.select(F.col("__set").alias("a"), F.col("shingles").alias("x")), "a").select("a", "b", "x", "y")

    def run(batches):
        for batch in common.lean(batches):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common_ = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common_ >= similarity * (len(x) + len(y) - common_) - 1e-9)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return common.materialize(x.mapInArrow(run, "a long, b long"), "verified")


def _near(classes: DataFrame) -> DataFrame:
    """Pairs of structs (__set, __n) that link the classes whose fingerprints are equal or within 2 bits."""
    least = common.materialize(classes.groupBy("__fp").agg(F.min(F.struct("__set", "__n")).alias("x")), "least")
    equal = classes.join(least, "__fp").where(F.col("__set") != F.col("x.__set")).select(F.struct("__set", "__n").alias("a"), F.col("x").alias("b"))
    edges = links(least.select("__fp"))
    edges = edges.join(least.select(F.col("__fp").alias("a"), F.col("x").alias("xa")), "a").join(least.select(F.col("__fp").alias("b"), F.col("x").alias("xb")), "b")
    return equal.union(edges.select("xa", "xb"))


def _apart(members: DataFrame, keys: list[str], sketches: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of a cell whose classes are in different groups so far and whose sizes, places and sketches allow the similarity. sketches: __set, __sketch.

    members: __set, __n, root, keys, at: how many shingles of the set are known to be of no use for the pair. With x, y and own, a pair meets once.
    """
    words = [F.col("__sketch")[i].alias(f"w{i}") for i in range(WORDS)]
    members = members.join(sketches.select("__set", *words), "__set")
    a, b = members.alias("a"), members.alias("b")
    differing = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a.w{i}").bitwiseXOR(F.col(f"b.w{i}"))) for i in range(WORDS)])
    both = F.col("a.__n") + F.col("b.__n")
    met = (F.col("a.__set") > F.col("b.__set")) & (F.col("a.root") != F.col("b.root")) & _fits(F.col("a.__n"), F.col("b.__n"), similarity)
    met = met & (F.least(F.col("a.__n") - F.col("a.at"), F.col("b.__n") - F.col("b.at")) >= both * (similarity / (1 + similarity)) - 1e-6)
    met = met & (differing <= both * ((1 - similarity) / (1 + similarity)) + 1e-6)
    if "own" in members.columns:
        met = met & ((F.col("a.x") == F.col("a.y")) | (F.col("a.own") != F.col("b.own")))
    for k in keys:
        met = met & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return a.join(b, met).select(F.col("a.__set").alias("a"), F.col("b.__set").alias("b"))


def _fits(m: Column, n: Column, similarity: float) -> Column:
    """Sets of m and n shingles can have the similarity."""
    return F.least(m, n) >= similarity * F.greatest(m, n) - 1e-9


def _open_cells(members: DataFrame, keys: list[str], cell_rows: int) -> tuple[DataFrame, DataFrame]:
    """members (__set, __n, root, keys, more) of cells that hold several groups: those of at most cell_rows classes, and the others with the cell's size, rows."""
    sizes = members.groupBy(*keys).agg(F.count("*").alias("rows"), F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select(*keys, "rows")
    open_ = common.materialize(members.join(sizes, keys), "open")
    return open_.where(F.col("rows") <= cell_rows), open_.where(F.col("rows") > cell_rows)


def _blocks(members: DataFrame, key: str, cell_rows: int) -> DataFrame:
    """A row for each pair of blocks that a member takes part in: x <= y number the blocks of its cell, own is the member's. MOST_BLOCKS rows a member at most."""
    blocks = F.least(F.ceil(F.col("rows") / cell_rows), F.lit(MOST_BLOCKS)).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("__set"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("__set", "__n", "root", key, "at", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own")


def _frequent(sets: DataFrame, least: int) -> np.ndarray:
    """For each of BUCKETS buckets how many shingles of sets fall into it; 0 where not over `least`."""

    def run(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for batch in common.lean(batches):
            for x in batch.column(0):
                np.add.at(counts, _buckets(np.frombuffer(x.as_buffer(), np.uint64)), 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at])], names=["bucket", "n"])

    made = sets.select("shingles").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > least).toArrow()
    found = np.zeros(BUCKETS, np.int64)
    found[made["bucket"].to_numpy()] = made["n"].to_numpy()
    return found


def _buckets(shingles: np.ndarray) -> np.ndarray:
    return (shingles % np.uint64(BUCKETS)).astype(np.int64)


def _prefix(shingles: np.ndarray, frequent: np.ndarray, similarity: float) -> np.ndarray:
    """The shingles of a set that come first, rare ones before frequent ones: one more than the set can lack in another of the similarity."""
    n = len(shingles)
    return shingles[np.argsort(frequent[_buckets(shingles)], kind="stable")[: n - int(np.ceil(similarity * n - 1e-9)) + 1]]


def _lists(sets: DataFrame, similarity: float, cell_rows: int) -> DataFrame:
    """token, __set, __n, root, at: a row for each of the first shingles of a set, and its place. sets: __set, __n, root, shingles."""
    frequent = _frequent(sets, cell_rows)

    def run(batches):
        for batch in common.lean(batches):
            first = [_prefix(np.frombuffer(x.as_buffer(), np.uint64), frequent, similarity) for x in batch.column(3)]
            lengths = [len(x) for x in first]
            rows = pa.array(np.repeat(np.arange(len(first)), lengths))
            tokens = np.concatenate([np.zeros(0, np.uint64), *first]).view(np.int64)
            places = np.concatenate([np.zeros(0, np.int32), *[np.arange(n, dtype=np.int32) for n in lengths]])
            yield pa.RecordBatch.from_arrays([pa.array(tokens), *[c.take(rows) for c in batch.columns[:3]], pa.array(places)], names=["token", "__set", "__n", "root", "at"])

    made = sets.select("__set", "__n", "root", "shingles").mapInArrow(run, "token long, __set long, __n integer, root long, at integer")
    return common.materialize(made, "lists")


def _of_use(lists: DataFrame, similarity: float) -> DataFrame:
    """The rows of lists that can be one of a pair: near enough to the front for a set of the same size, or for the least such set of the list."""
    share = similarity / (1 + similarity)
    n, rest = F.col("__n"), F.col("__n") - F.col("at")
    short = rest >= 2 * share * n - 1e-6
    least = lists.groupBy("token").agg(F.min(F.when(short, n)).alias("least"), F.min("root").alias("low"), F.max("root").alias("high")).where("low != high and least is not null").select("token", "least")
    return common.materialize(lists.join(least, "token").where(short | (rest >= share * (F.col("least") + n) - 1e-6)).drop("least"), "useful")


def _rare_pairs(docs: DataFrame, found: DataFrame, classes: DataFrame, sketches: DataFrame, words: int, similarity: float, cell_rows: int) -> DataFrame:
    """Pairs (a, b), some of them repeated: all of different groups that have the similarity, and few others. classes: __set, __n, root, distinct."""
    sets = _sets(docs, found, classes.select("__set"), words).join(classes, "__set")
    few, many = _open_cells(_of_use(_lists(sets, similarity, cell_rows), similarity), ["token"], cell_rows)
    return _apart(few, ["token"], sketches, similarity).union(_apart(_blocks(many, "token", cell_rows), ["token", "x", "y"], sketches, similarity))


def similar_classes(docs: DataFrame, found: DataFrame, words: int, similarity: float, cell_rows: int = 256) -> DataFrame:
    """__set, component_root (least __set that verified pairs reach) of each class of found."""
    classes = common.materialize(found.groupBy("__set").agg(F.first("__n").alias("__n"), F.first("__fp").alias("__fp"), F.first("__bands").alias("__bands"), F.first("__sketch").alias("__sketch")), "classes")
    sketches = classes.select("__set", "__sketch")
    cells = classes.select("__set", "__n", F.explode("__bands").alias("cell"))
    sizes = cells.groupBy("cell").agg(F.count("*").alias("rows")).where("rows > 1")
    met = cells.join(sizes, "cell").groupBy("__set").agg(F.first("__n").alias("__n"), F.sum("rows").alias("company"), F.collect_list("cell").alias("cells"))  # a row a band of a class
    members = common.materialize(met.select("__set", "__n", "company", F.explode("cells").alias("cell")), "members")
    leads = members.groupBy("cell").agg(F.max(F.struct("company", F.struct("__set", "__n").alias("x"))).alias("lead")).select("cell", F.col("lead.x").alias("lead"))
    stars = members.join(leads, "cell").where(F.col("__set") != F.col("lead.__set")).select(F.struct("__set", "__n").alias("a"), F.col("lead").alias("b")).union(_near(classes.select("__set", "__n", "__fp")))
    stars = stars.where(_fits(F.col("a.__n"), F.col("b.__n"), similarity)).select(F.col("a.__set").alias("a"), F.col("b.__set").alias("b")).distinct()
    first = _verified(docs, found, stars, words, similarity)
    roots = components(first).select(F.col("node").alias("__set"), "root")
    placed = members.join(roots, "__set", "left").select("__set", "__n", "cell", F.coalesce("root", "__set").alias("root"), F.lit(0).alias("at"))
    few, many = _open_cells(placed, ["cell"], cell_rows)
    crowded = common.materialize(many.select("__set", "__n", "root").distinct(), "crowded")
    pairs = _apart(few, ["cell"], sketches, similarity).union(_rare_pairs(docs, found, crowded, sketches, words, similarity, cell_rows))
    both = first.union(_verified(docs, found, pairs.distinct(), words, similarity))
    roots = components(both).select(F.col("node").alias("__set"), "root")
    return classes.select("__set").join(roots, "__set", "left").select("__set", F.coalesce("root", "__set").alias("component_root"))


def first_of_similar(docs: DataFrame, words: int, similarity: float, cell_rows: int = 256) -> DataFrame:
    """The rows of docs, all columns, that come first by (doc_id, hash of the text) in their group; of repeated rows one."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], F.xxhash64(docs["text"]).alias("__th"))
    found = common.materialize(_classes(rows, words), "classes")
    return first_rows(docs, found, "__set", similar_classes(rows, found, words, similarity, cell_rows))
