"""Embedding near-duplicates over a robust-pruned flat graph.

Equal vectors are one class. Classes go to the shards of their `overlap` nearest centroids. In each shard candidates for the neighbours
of a class come from small overlapping groups around sub-centroids and from all over the shard; they are pruned so that no kept
neighbour is shadowed by a closer one, and the adjacency lists of a class are united over its shards. Then every class is searched for in each
of its shards: greedily with a beam, from the medoids of the shard's groups that are nearest to it, and from each hit on as long as
hits turn up. What the search meets is verified in double precision. A pair of classes counts in the first shard that holds both, so links are
added up without listing pairs; a shard passes on one edge a class for the components.

An audit compares one class in `audit` (by hash, so more of them in larger tables) with all classes by brute force, in blocks, and counts which
of their links the search has found, each pair of classes once whatever its copies. The overlap grows until the recall is reached; if
it isn't when each class is in every shard, that is an error.

Defined cases: vectors that are null, zero, or hold null or non-finite components link with nothing; vectors of different lengths don't
link; repeated rows are vectors of their own; a null vec_id never names a component unless nothing else can;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.95
    overlap: int = 4  # shards of a class
    shard_rows: int = 1024  # classes a centroid, before overlapping
    most_rows: int = 8192  # larger shards are cut by centroids of their own, again and again
    sample: int = 16384  # classes that centroids are fitted on, for the first level and for all cuts of one round
    group_rows: int = 48  # rows a sub-centroid, before overlapping
    groups: int = 3  # groups of a row
    degree: int = 16  # kept neighbours a shard
    near: int = 32  # nearest candidates a group
    spread: int = 16  # candidates from all over the shard
    alpha: float = 1.2
    beam: int = 24
    slack: float = 0.03  # hits within this of the threshold are expanded too
    audit: int = 50  # one class in so many is a query of the audit
    audit_block: int = 4096  # queries that are held at once
    recall: float = 0.97


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spaced rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(x, c, 1)[:, 0]
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        full = np.linalg.norm(sums, axis=1) > 0
        c[full] = unit(sums[full])
    return c


def nearest(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """Indices of the n nearest centroids of each row, nearest first."""
    n = min(n, len(c))
    out = np.empty((len(x), n), np.int64)
    for a in range(0, len(x), 2048):
        s = x[a : a + 2048] @ c.T
        if n < s.shape[1]:
            top = np.argpartition(-s, n - 1, axis=1)[:, :n]
        else:
            top = np.broadcast_to(np.arange(n), s.shape).copy()
        order = np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable")
        out[a : a + 2048] = np.take_along_axis(top, order, 1)
    return out


class Shards:
    """Centroids of the first level and of cut shards, which may be cut again."""

    def __init__(self, first: np.ndarray):
        self.first, self.cut = first, {}
        self.numbers = len(first)

    def split(self, shard: int, centroids_: np.ndarray) -> None:
        self.cut[shard] = (self.numbers, centroids_)
        self.numbers += len(centroids_)

    def of(self, x: np.ndarray, overlap: int) -> list[list[int]]:
        """Ascending shard numbers of each row."""
        out = [set(row) for row in nearest(x, self.first, overlap).tolist()]
        inside: dict[int, list[int]] = {}
        for i, shards in enumerate(out):
            for t in shards & self.cut.keys():
                inside.setdefault(t, []).append(i)
        while inside:
            shard, rows = inside.popitem()
            base, c = self.cut[shard]
            for i, subs in zip(rows, nearest(x[rows], c, overlap).tolist(), strict=True):
                out[i].discard(shard)
                for t in {base + k for k in subs}:
                    out[i].add(t)
                    if t in self.cut:
                        inside.setdefault(t, []).append(i)
        return [sorted(s) for s in out]


def robust_prune(x: np.ndarray, candidates: np.ndarray, s: Settings) -> np.ndarray:
    """At most `degree` neighbours of each row out of its candidates (local indices, -1 for none), padded with -1."""
    m = len(x)
    kept = np.full((m, s.degree), -1, np.int64)
    for a in range(0, m, 512):
        cand = candidates[a : a + 512]
        own = x[a : a + 512]
        v = x[np.maximum(cand, 0)]
        d = 1 - np.einsum("qcd,qd->qc", v, own)
        d[(cand < 0) | (cand == np.arange(a, a + len(cand))[:, None])] = np.inf
        rows = np.arange(len(cand))
        for r in range(s.degree):
            pick = np.argmin(d, axis=1)
            alive = np.isfinite(d[rows, pick])
            if not alive.any():
                break
            kept[a : a + 512][alive, r] = cand[rows, pick][alive]
            between = 1 - np.einsum("qcd,qd->qc", v, v[rows, pick])
            d[s.alpha * between <= d] = np.inf
            d[rows, pick] = np.inf
    return kept


def groups(x: np.ndarray, s: Settings) -> list[np.ndarray]:
    """Overlapping groups of about group_rows * groups rows; those of crowded sub-centroids are cut in order of a projection, so none holds more than twice that."""
    m = len(x)
    k = max(1, m // s.group_rows)
    c = centroids(x[np.linspace(0, m - 1, min(m, 8 * k)).astype(int)], k, 4)
    own = nearest(x, c, s.groups)
    row, group = np.repeat(np.arange(m), own.shape[1]), own.ravel()
    order = np.argsort(group, kind="stable")
    row, group = row[order], group[order]
    most, out = 2 * s.group_rows * s.groups, []
    for members in np.split(row, np.flatnonzero(np.diff(group)) + 1):
        if len(members) > most:
            members = members[np.argsort(x[members] @ x[members[len(out) % len(members)]], kind="stable")]
        out += [members[a : a + most] for a in range(0, len(members), most // 2) if a == 0 or a + most // 2 < len(members)]
    return out


def build(x: np.ndarray, s: Settings) -> np.ndarray:
    """Pruned neighbours of each row of one shard."""
    m = len(x)
    if m < 2:
        return np.full((m, s.degree), -1, np.int64)
    found: list[list[np.ndarray]] = [[] for _ in range(m)]
    for members in groups(x, s):
        if len(members) < 2:
            continue
        sims = x[members] @ x[members].T
        near = min(s.near, len(members) - 1)
        top = np.argpartition(-sims, near, axis=1)[:, : near + 1]
        for i, picks in zip(members.tolist(), members[top], strict=True):
            found[i].append(picks)
    far = (np.arange(m)[:, None] + (np.arange(1, s.spread + 1) * max(1, m // (s.spread + 1)))[None, :]) % m
    width = max(sum(map(len, f)) for f in found)
    candidates = np.full((m, width), -1, np.int64)
    for i, f in enumerate(found):
        if f:
            picks = np.unique(np.concatenate(f))
            candidates[i, : len(picks)] = picks
    return robust_prune(x, np.concatenate([candidates, far], 1), s)


def undirected(neighbours: list[np.ndarray], m: int, most: int) -> np.ndarray:
    """Padded adjacency with the reverse edges, at most `most` a row, own edges first."""
    degree = np.fromiter(map(len, neighbours), np.int64, m)
    a = np.repeat(np.arange(m), degree)
    b = np.concatenate(neighbours) if m else np.zeros(0, np.int64)
    source, target = np.concatenate([a, b]), np.concatenate([b, a])
    reverse = np.concatenate([np.zeros(len(a), np.int8), np.ones(len(b), np.int8)])
    _, first = np.unique(source * m + target, return_index=True)
    source, target, reverse = source[first], target[first], reverse[first]
    order = np.lexsort((target, reverse, source))
    source, target = source[order], target[order]
    starts = np.searchsorted(source, np.arange(m))
    slot = np.arange(len(source)) - starts[source]
    keep = slot < most
    out = np.full((m, min(most, int(slot.max()) + 1 if len(slot) else 1)), -1, np.int64)
    out[source[keep], slot[keep]] = target[keep]
    return out


def medoid(x: np.ndarray, members: np.ndarray) -> int:
    """The member nearest to the mean of a group."""
    return int(members[np.argmax(x[members] @ x[members].mean(0))])


def range_search(x: np.ndarray, adjacency: np.ndarray, s: Settings, block: int = 512):
    """For each block of rows as queries: (first row, hits as a boolean matrix of similarities of at least threshold - slack).

    A query enters at the medoids of the groups that it falls into; a medoid has its whole group as neighbours. From there the search is greedy
    along the pruned lists with a beam, and then goes on from every hit.
    """
    m, floor = len(x), np.float32(s.threshold - s.slack)
    found = groups(x, s)
    entry = np.array([medoid(x, g) for g in found])
    row, group = np.concatenate(found), np.repeat(np.arange(len(found)), list(map(len, found)))
    order = np.argsort(row, kind="stable")
    row, group = row[order], group[order]
    for a in range(0, m, block):
        q = x[a : a + block]
        n = len(q)
        seen, expanded, hits = (np.zeros((n, m), bool) for _ in range(3))
        beam_ids = np.full((n, s.beam), -1, np.int64)
        beam_sims = np.full((n, s.beam), -2.0, x.dtype)

        def meet(who: np.ndarray, what: np.ndarray, beam: bool) -> None:
            """Query who[i] looks at row what[i]."""
            pairs = np.unique(who * m + what)
            who, what = pairs // m, pairs % m
            fresh = ~seen[who, what]
            who, what = who[fresh], what[fresh]
            seen[who, what] = True
            sims = np.einsum("qd,qd->q", x[what], q[who])
            hit = sims >= floor
            hits[who[hit], what[hit]] = True
            if beam and len(who):
                active, row_ = np.unique(who, return_inverse=True)
                slot = np.arange(len(who)) - np.searchsorted(who, who)
                ids, near = np.full((len(active), slot.max() + 1), -1, np.int64), np.full((len(active), slot.max() + 1), -2.0, x.dtype)
                ids[row_, slot], near[row_, slot] = what, sims
                all_ids, all_sims = np.concatenate([beam_ids[active], ids], 1), np.concatenate([beam_sims[active], near], 1)
                top = np.argpartition(-all_sims, s.beam - 1, axis=1)[:, : s.beam]
                beam_ids[active], beam_sims[active] = np.take_along_axis(all_ids, top, 1), np.take_along_axis(all_sims, top, 1)

        def step(who: np.ndarray, nodes: np.ndarray, beam: bool) -> None:
            """Query who[i] goes on from the node nodes[i]."""
            expanded[who, nodes] = True
            where, slot = np.nonzero(adjacency[nodes] >= 0)
            meet(who[where], adjacency[nodes[where], slot], beam)

        lo, hi = np.searchsorted(row, [a, a + n])
        who, into = row[lo:hi] - a, group[lo:hi]
        meet(who, entry[into], True)
        size = np.array([len(found[g]) for g in into])
        meet(np.repeat(who, size), np.concatenate([found[g] for g in into]), True)
        active = np.arange(n)
        while len(active):  # the best of the beam that has not been expanded, until there is none
            ids = beam_ids[active]
            open_ = np.where((ids >= 0) & ~expanded[active[:, None], np.maximum(ids, 0)], beam_sims[active], -3)
            pick = np.argmax(open_, axis=1)
            go = open_[np.arange(len(active)), pick] > -3
            active = active[go]
            step(active, ids[go][np.arange(len(active)), pick[go]], True)
        while True:  # every hit is expanded, up to eight of a query at a time
            who, what = np.nonzero(hits & ~expanded)
            if not len(who):
                break
            some = np.arange(len(who)) - np.searchsorted(who, who) < 8
            step(who[some], what[some], False)
        yield a, hits


def shard_links(x: np.ndarray, adjacency: np.ndarray, copies: np.ndarray, members: list[list[int]], shard: int, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links in copies, linked rows, least row linked to it by any path) of each row; the first two count pairs whose first common shard this is."""
    m = len(x)
    earlier: dict[int, list[int]] = {}
    for i, shards in enumerate(members):
        for t in shards:
            if t < shard:
                earlier.setdefault(t, []).append(i)
    masks = np.zeros((len(earlier), m), bool)
    for k, rows in enumerate(earlier.values()):
        masks[k, rows] = True
    masks = masks[masks.sum(1) > 1]
    true = np.zeros((m, m), bool)
    for at, hits in range_search(x.astype(np.float32), adjacency, s):
        a, b = np.nonzero(hits)
        for c in range(0, len(a), 1 << 16):  # verified in double precision
            p, q = a[c : c + (1 << 16)] + at, b[c : c + (1 << 16)]
            kept = np.einsum("pd,pd->p", x[p], x[q]) >= s.threshold
            true[p[kept], q[kept]] = True
    np.fill_diagonal(true, False)
    total, linked, root = np.zeros(m), np.zeros(m, np.int64), np.arange(m)
    for at in range(0, m, 512):
        a, b = np.nonzero(true[at : at + 512] | true[:, at : at + 512].T)  # either of two found the other
        a += at
        root = _join(root, a, b)
        for c in range(0, len(a), 1 << 16):
            p, q = a[c : c + (1 << 16)], b[c : c + (1 << 16)]
            own = ~(masks[:, p] & masks[:, q]).any(0)
            total += np.bincount(p[own], copies[q[own]], m)
            linked += np.bincount(p[own], minlength=m)
    return total, linked, root


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least rows after joining the pairs; root names the least row of each row's group so far."""
    label = _least_label(root[a], root[b], len(root))
    return label[root]


def _least_label(a: np.ndarray, b: np.ndarray, m: int) -> np.ndarray:
    """The least row that each row reaches over the pairs."""
    root = np.arange(m)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def _blocks(batches, key: str):
    """Columns of each run of rows with the same key, as lists."""
    now, held = None, None
    for batch in batches:
        names = batch.schema.names
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            row = dict(zip(names, row, strict=True))
            if row[key] != now:
                if now is not None:
                    yield now, held
                now, held = row[key], []
            held.append(row)
    if now is not None:
        yield now, held


def _vectors(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def _fan_out(classes: DataFrame, shards: Shards, overlap: int, kept: list[str], narrow: bool = False) -> DataFrame:
    """shard, shards, x and the columns `kept`: a row for each class and shard. narrow: x as float32."""
    schema = classes.select(kept).schema.add("shard", "integer").add("shards", T.ArrayType(T.IntegerType())).add("x", "binary")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch.column("x").to_pylist())
            of = shards.of(x, overlap)
            rows = np.repeat(np.arange(len(of)), [len(o) for o in of])
            data = pa.array([v.tobytes() for v in x.astype(np.float32)], pa.binary()) if narrow else batch.column("x")
            numbers, lists = np.array([t for o in of for t in o], np.int32), pa.array(of, pa.list_(pa.int32()))
            for a in range(0, len(rows), 4096):
                some = pa.array(rows[a : a + 4096])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(some) for c in kept), pa.array(numbers[a : a + 4096]), lists.take(some), data.take(some)], names=schema.names)

    return classes.select(*kept, "x").mapInArrow(run, schema)


def _fit_shards(classes: DataFrame, total: int, s: Settings, most_rounds: int = 8) -> Shards:
    """Centroids fitted on a bounded sample; shards of over most_rows classes are cut, all of a round on one sample, until none is left."""
    sample = lambda df, n: [(r[0], bytes(r[1])) for r in df.orderBy("cid").limit(n).select("shard", "x").collect()]  # noqa: E731  cid is a hash
    x = _vectors([v for _, v in sample(classes.withColumn("shard", F.lit(0)), s.sample)])
    shards = Shards(centroids(x, max(1, min(-(-total // s.shard_rows), len(x) // 8))))
    for _ in range(most_rounds):
        sizes = _fan_out(classes, shards, s.overlap, ["cid"]).groupBy("shard").agg(F.count("*").alias("n"))
        large = {r["shard"]: r["n"] for r in sizes.where(F.col("n") > s.most_rows).collect()}  # fewer than shards
        if not large:
            return shards
        each = max(64, s.sample // len(large))
        members = _fan_out(classes, shards, s.overlap, ["cid"]).where(F.col("shard").isin(list(large)))
        first = Window.partitionBy("shard", "part").orderBy("cid")
        parts = members.withColumn("part", F.pmod("cid", F.lit(16))).withColumn("i", F.row_number().over(first)).where(F.col("i") <= -(-each // 16))
        by_shard: dict[int, list[bytes]] = {}
        for r in parts.select("shard", "x").collect():  # about `sample` rows
            by_shard.setdefault(r["shard"], []).append(bytes(r["x"]))
        for shard, n in sorted(large.items()):
            own = _vectors(by_shard[shard])
            shards.split(shard, centroids(own, max(2, min(-(-n * s.overlap // s.most_rows), len(own) // 4))))
    return shards


def _search(classes: DataFrame, shards: Shards, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(cid, links in copies, linked classes) and edges (a, b), by way of the graph."""
    spark = classes.sparkSession
    n = 4 * common.partitions(spark)
    narrow = _fan_out(classes, shards, s.overlap, ["cid"], narrow=True).select("shard", "cid", "x").repartition(n, "shard").sortWithinPartitions("shard", "cid")

    def lists(batches):
        for _, rows in _blocks(batches, "shard"):
            x = np.frombuffer(b"".join([r["x"] for r in rows]), np.float32).reshape(len(rows), -1)
            cid = np.array([r["cid"] for r in rows])
            yield pa.record_batch([pa.array(cid), pa.array([cid[k[k >= 0]] for k in build(x, s)], pa.list_(pa.int64()))], ["cid", "neighbours"])

    united = narrow.mapInArrow(lists, "cid long, neighbours array<long>").groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours"))  # a list a shard of the class
    listed = classes.join(united, "cid", "left").select("cid", "n", "x", "neighbours")
    graph = _fan_out(listed, shards, s.overlap, ["cid", "n", "neighbours"]).repartition(n, "shard").sortWithinPartitions("shard", "cid")

    def search(batches):
        for shard, rows in _blocks(batches, "shard"):
            x = _vectors([r["x"] for r in rows])
            cid = np.array([r["cid"] for r in rows])
            copies = np.array([r["n"] for r in rows], float)
            own = []
            for r in rows:
                want = np.array(r["neighbours"] or [], np.int64)
                at = np.minimum(np.searchsorted(cid, want), len(cid) - 1)
                own.append(at[cid[at] == want])
            links, linked, root = shard_links(x, undirected(own, len(x), 3 * s.degree), copies, [r["shards"] for r in rows], shard, s)
            yield pa.record_batch([pa.array(cid), pa.array(links.astype(np.int64)), pa.array(linked), pa.array(cid[root])], ["cid", "links", "linked", "root"])

    found = common.materialize(graph.mapInArrow(search, "cid long, links long, linked long, root long"), "found")
    return found.groupBy("cid").agg(F.sum("links").alias("links"), F.sum("linked").alias("linked")), found.where("cid != root").select(F.col("cid").alias("a"), F.col("root").alias("b"))


def true_links(classes: DataFrame, queries: list[tuple[int, bytes]], threshold: float) -> DataFrame:
    """cid, true: how many other classes each query (cid, unit vector) links with, by brute force."""
    q, cids = _vectors([x for _, x in queries]), np.array([c for c, _ in queries])

    def run(batches):
        total = np.zeros(len(cids), np.int64)
        for batch in batches:
            if batch.num_rows:
                hit = q @ _vectors(batch.column("x").to_pylist()).T >= threshold
                total += (hit & (cids[:, None] != batch.column("cid").to_numpy()[None, :])).sum(1)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(cids[some]), pa.array(total[some])], ["cid", "true"])

    return classes.select("cid", "x").mapInArrow(run, "cid long, true long").groupBy("cid").agg(F.sum("true").alias("true"))


def _audit(classes: DataFrame, s: Settings) -> DataFrame:
    """cid, true of every query of the audit that links with anything; a pass over the classes for each block of queries."""
    asked = common.materialize(classes.where(F.pmod(F.xxhash64("cid"), F.lit(s.audit)) == 0).select("cid", "x"), "queries")
    blocks = max(1, -(-asked.count() // s.audit_block))
    parts = []
    for k in range(blocks):
        queries = [(r[0], bytes(r[1])) for r in asked.where(F.pmod("cid", F.lit(blocks)) == k).collect()]  # about audit_block rows
        if queries:
            parts.append(common.materialize(true_links(classes, queries, s.threshold), "true"))
    return reduce(DataFrame.union, parts) if parts else common.empty(classes.sparkSession, "cid long, true long")


def _one_length(classes: DataFrame, total: int, s: Settings) -> tuple[DataFrame, DataFrame, float]:
    """Searches with growing overlap until the audit's recall is reached."""
    true = common.materialize(_audit(classes, s), "audit")
    while True:
        shards = _fit_shards(classes, total, s)
        links, edges = _search(classes, shards, s)
        links = common.materialize(links, "links")
        wanted, got = true.join(links, "cid", "left").agg(F.sum("true"), F.sum(F.least("true", F.coalesce("linked", F.lit(0))))).first()
        reached = got / wanted if wanted else 1.0
        if reached >= s.recall:
            return links, edges, reached
        if s.overlap >= len(shards.first):
            raise RuntimeError(f"the audit found {reached:.3f} of the links with each class in every shard, less than {s.recall}")
        s = replace(s, overlap=2 * s.overlap)


def near_duplicates(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding)."""
    e = vectors["embedding"].cast("array<double>")
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), e.alias("e"))
    fine = F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("e", lambda v: v != 0)
    rows = rows.withColumn("cid", F.when(F.coalesce(fine, F.lit(False)), F.xxhash64("e")))
    grouped = rows.where(F.col("cid").isNotNull()).groupBy("cid", "e").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))

    def scaled(batches):
        for batch in batches:
            v = [np.asarray(r, np.float64) for r in batch.column("e").to_pylist()]
            v = [r / np.abs(r).max() for r in v]  # no overflow in the norm
            yield pa.record_batch([batch.column("cid"), batch.column("n"), batch.column("least"), pa.array([len(r) for r in v], pa.int32()), pa.array([(r / np.sqrt(r @ r)).tobytes() for r in v], pa.binary())], ["cid", "n", "least", "length", "x"])

    classes = common.materialize(grouped.select("cid", "n", "least", "e").mapInArrow(scaled, "cid long, n long, least long, length int, x binary"), "classes")
    links = edges = None
    for length, total in sorted(tuple(r) for r in classes.groupBy("length").agg(F.count("*")).collect()):  # a row a vector length
        a, b, _ = _one_length(classes.where(F.col("length") == length), total, settings)
        links, edges = (a, b) if links is None else (links.union(a), edges.union(b))
    if links is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    roots = components(edges)
    named = classes.join(links, "cid", "left").join(roots, classes["cid"] == roots["node"], "left")
    named = named.select("cid", "n", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "cid").alias("root"))
    first = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = common.materialize(named.join(first, "root").select("cid", "n", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id"), "named")
    joined = common.salted_join(rows.drop("e"), named.select("cid", "n_links", "component_id"), "cid", F.col("vec_id"), common.hot_keys(named, "cid", "n"))
    out = joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
