"""Document fingerprints: a Merkle tree over paragraphs and sections.

Leaves are slices of a paragraph (a line), cut where a hash of the eight bytes before is 0 modulo `SLICE`, so that behind an
insertion the cuts stand where they stood. A paragraph's digest covers its slices, a section's its paragraphs, the root's
its sections. A section ends at an empty line or behind a paragraph whose digest is 0 modulo `SECTION`, so that an edit leaves the
bounds of other sections where they are.

A fingerprint is text: the root in 32 hex digits, a colon, then sections joined by ";": 8 digits of the section's digest, "=", its paragraphs joined by
",". A paragraph is 6 digits of its digest, then, if it has several slices, 4 digits of each; an empty line is nothing. Equal roots mean equal
texts. Otherwise two trees are compared from the top: branches with equal digests that stand in the same order are passed over, and only what lies
between them is looked into, down to the slices that differ. Prefixes may agree by chance (one slice in 65,536): that can raise a
likeness by a hair, never make two texts equal.

Defined cases: null text counts as empty, whose tree has one empty paragraph without leaves; rows of one doc_id follow each other by hash of
the text; null doc_ids come first; the document after the last is the first, so a single row is next to itself; an
empty table gives no rows; other columns are ignored. Rows of a doc_id that very many share are dealt to ranges by the hash.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SLICE, SECTION = 64, 8
MULTIPLIER, SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - SLICE.bit_length() + 1)

Paragraph = tuple[str, list[str]]  # prefix of the digest, prefixes of its slices
Section = tuple[str, list[Paragraph]]
Path = tuple[int, int, int]  # section, paragraph in it, slice in that


def _digest(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


def cuts(data: bytes) -> list[int]:
    """Places behind eight bytes whose hash is 0 modulo SLICE."""
    n = len(data)
    if n < 8:
        return []
    windows = np.empty(n - 7, np.uint64)
    for i in range(min(8, n - 7)):
        windows[i::8] = np.frombuffer(data, "<u8", (n - i) // 8, i)
    return (np.flatnonzero(windows * MULTIPLIER >> SHIFT == 0) + 8).tolist()


def tree(text: str) -> tuple[str, list[Section]]:
    """Root (32 hex digits) and sections of a text."""
    data = text.encode()
    places, next_ = cuts(data), 0
    sections: list[Section] = []
    whole: list[bytes] = []
    paragraphs: list[Paragraph] = []
    held: list[bytes] = []
    lines, at = data.split(b"\n"), 0
    for i, line in enumerate(lines):
        end, begin, leaves = at + len(line), at, []
        while next_ < len(places) and places[next_] < end:
            if places[next_] > begin:
                leaves.append(_digest(b"l" + data[begin : places[next_]]))
                begin = places[next_]
            next_ += 1
        if end > begin:
            leaves.append(_digest(b"l" + data[begin:end]))
        paragraph = _digest(b"p" + b"".join(leaves))
        held.append(paragraph)
        paragraphs.append((paragraph[:3].hex(), [x[:2].hex() for x in leaves]) if leaves else ("", []))
        if not line or paragraph[-1] % SECTION == 0 or i + 1 == len(lines):
            whole.append(_digest(b"s" + b"".join(held)))
            sections.append((whole[-1][:4].hex(), paragraphs))
            paragraphs, held = [], []
        at = end + 1
    return _digest(b"r" + b"".join(whole)).hex(), sections


def shown(tree_: tuple[str, list[Section]]) -> str:
    """The fingerprint of a tree."""
    root, sections = tree_
    return f"{root}:{';'.join([s + '=' + ','.join([p + ''.join(x) if len(x) > 1 else p for p, x in ps]) for s, ps in sections])}"


def parsed(print_: str) -> tuple[str, list[Section]]:
    """The tree of a fingerprint."""
    sections = []
    for section in print_[33:].split(";"):
        paragraphs = [(p[:6], [p[i : i + 4] for i in range(6, len(p), 4)] or ([""] if p else [])) for p in section[9:].split(",")]
        sections.append((section[:8], paragraphs))
    return print_[:32], sections


def fingerprint(text: str) -> str:
    return shown(tree(text))


def in_order(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Ascending pairs of places with equal values: equal ends first, then the longest ascending run among like occurrences."""
    low = 0
    while low < min(len(x), len(y)) and x[low] == y[low]:
        low += 1
    high = 0
    while high < min(len(x), len(y)) - low and x[-1 - high] == y[-1 - high]:
        high += 1
    places: dict[str, list[int]] = defaultdict(list)
    for j in range(len(y) - high - 1, low - 1, -1):
        places[y[j]].append(j)
    ends: list[int] = []  # least last place of a run of each length
    last: list[tuple[int, int]] = []
    before: dict[tuple[int, int], tuple[int, int] | None] = {}
    for i in range(low, len(x) - high):
        if places.get(x[i]):
            j = places[x[i]].pop()
            k = bisect_left(ends, j)
            before[i, j] = last[k - 1] if k else None
            if k == len(ends):
                ends.append(j)
                last.append((i, j))
            else:
                ends[k], last[k] = j, (i, j)
    middle, at = [], last[-1] if last else None
    while at:
        middle.append(at)
        at = before[at]
    return [*((i, i) for i in range(low)), *reversed(middle), *((len(x) - h, len(y) - h) for h in range(high, 0, -1))]


def compared(a: list[Section], b: list[Section]) -> tuple[int, list[Path]]:
    """How many slices stand in both in the same order, and the paths of b's that do not."""
    upper = [(s, [(i, j, p) for j, p in enumerate(ps)]) for i, (s, ps) in enumerate(b)]
    same, edits = 0, []
    for old, new in _gaps(in_order([s for s, _ in a], [s for s, _ in b]), len(a), len(b)):
        if old is None:
            same += sum(len(x) for _, x in b[new][1])
            continue
        mine, theirs = [p for s in old for p in a[s][1]], [p for s in new for p in upper[s][1]]
        for left, right in _gaps(in_order([p for p, _ in mine], [p[0] for _, _, p in theirs]), len(mine), len(theirs)):
            if left is None:
                same += len(theirs[right][2][1])
                continue
            x = [leaf for p in left for leaf in (mine[p][1] if len(mine[p][1]) > 1 else [mine[p][0]] * len(mine[p][1]))]
            paths = [(theirs[p][0], theirs[p][1], k) for p in right for k in range(len(theirs[p][2][1]))]
            y = [leaf for p in right for leaf in (theirs[p][2][1] if len(theirs[p][2][1]) > 1 else [theirs[p][2][0]] * len(theirs[p][2][1]))]
            kept = {j for _, j in in_order(x, y)}
            same += len(kept)
            edits += [path for j, path in enumerate(paths) if j not in kept]
    return same, edits


def _gaps(pairs: list[tuple[int, int]], m: int, n: int):
    """(None, j) for each pair, and (range, range) of what lies between pairs, in order."""
    i = j = 0
    for p, q in [*pairs, (m, n)]:
        if i < p or j < q:
            yield range(i, p), range(j, q)
        if p < m or q < n:
            yield None, q
        i, j = p + 1, q + 1


def _slices(sections: list[Section]) -> int:
    return sum(len(x) for _, ps in sections for _, x in ps)


def likeness_and_edits(a: tuple[str, list[Section]], b: tuple[str, list[Section]]) -> tuple[float, list[Path]]:
    """1 for equal roots, else twice the slices in common over all slices, below 1; and the paths of b's slices that a has not."""
    if a[0] == b[0]:
        return 1.0, []
    same, edits = compared(a[1], b[1])
    total = _slices(a[1]) + _slices(b[1])
    return (min(2 * same / total, 1 - 1e-9) if total else 0.0), edits


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints."""
    return likeness_and_edits(parsed(a), parsed(b))[0]


def differing(a: str, b: str) -> list[Path]:
    """Paths of the branches of b that locate its edits against a."""
    return likeness_and_edits(parsed(a), parsed(b))[1]


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_slices long, first_edit string, last_edit string"


def fingerprints_with_edits(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text), see OUT. first_edit, last_edit: section.paragraph.slice of the edited text's tree.

    Rows are dealt to ranges of (doc_id, hash of the text); the first row of each range also goes to the end of the range before,
    so every task meets each of its documents together with the next one.
    """
    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.id_order(docs["doc_id"]).alias("at"), common.text_bytes(docs).alias("text")).withColumn("hash", F.xxhash64("text"))
    bounds = common.range_bounds(rows, "at", common.text_ranges(docs))
    rows = rows.withColumn("bucket", common.range_bucket(F.col("at"), F.col("hash"), bounds))
    firsts = sorted((r[0], *r[1]) for r in rows.groupBy("bucket").agg(F.min(F.struct("at", "hash"))).collect())  # a row a range
    if not firsts:
        return common.empty(spark, OUT)
    tails = spark.createDataFrame([(at, hash_, firsts[i - 1][0]) for i, (_, at, hash_) in enumerate(firsts)], "at long, hash long, before int")
    marked = rows.join(F.broadcast(tails), ["at", "hash"], "left")  # a row a range
    places = F.filter(F.array(F.struct(F.col("bucket"), F.lit(0).alias("tail")), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("tail"))), lambda x: x["bucket"].isNotNull())
    dealt = marked.select("doc_id", "at", "hash", "text", F.explode(places).alias("x")).select("doc_id", "at", "hash", "text", "x.*")
    dealt = dealt.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("tail", "at", "hash")
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.string(), pa.string())

    def run(batches):
        held, out, size = None, [], 0

        def flush():
            return pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], [x.split()[0] for x in OUT.split(", ")])

        for batch in batches:
            for doc_id, data, tail in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "tail")), strict=True):
                if tail and held is None:
                    continue  # repeated first rows of the next range
                text = data.decode()
                own = tree(text)
                if held is not None:
                    before, old, old_tree = held
                    changed = edited(old, text)
                    changed_tree = tree(changed)
                    near, edits = likeness_and_edits(old_tree, changed_tree)
                    first, last = (".".join(map(str, edits[i])) if edits else None for i in (0, -1))
                    out.append((before, len(old), sha256(changed.encode()).hexdigest(), shown(old_tree), shown(changed_tree), near, likeness_and_edits(old_tree, own)[0], len(edits), first, last))
                    size += len(old)
                    if len(out) >= 2000 or size > 8 << 20:
                        yield flush()
                        out, size = [], 0
                held = None if tail else (doc_id, text, own)
        yield flush()

    return dealt.select("doc_id", "text", "tail").mapInArrow(run, OUT)
