"""Linear softmax over a text's character n-grams, learned from every labelled text there is.

A text's subwords are its byte n-grams inside words, the white space before and after a word included, hashed into `2 ** bits`
buckets. One pass over the labelled texts counts, exactly, how many texts of each class hold a bucket. For each class but the first a bucket
falls into one of a few groups by how much likelier it is in texts of that class than of the others, less what chance explains. A text is
then known by the shares of its subwords in these groups, and a softmax over the shares, with a small ridge, is brought to its optimum by Newton steps
over all labelled rows. The steps see a few numbers a row, so they pass over a small table and not over the texts; the driver holds the counts
(`classes * 2 ** bits`) and the weights. Since a bucket's weight follows from its groups, the result is one linear model of the buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_TABLE = bytes(32 if chr(b).isspace() and b < 128 else (b + 32 if 65 <= b <= 90 else b) for b in range(256))
BITS = 18
BLOCK = 1 << 18  # bytes of text that are handled together; n-grams take some 40 times as much
FEW = 1024  # subwords up to which sorting them is faster than marking their buckets
FEW_TEXTS = 64  # texts of a class below which chance gets 1.5 deviations and not 2, which hardly any bucket would pass
PART = 1 << 14  # buckets whose counts travel together
BOUNDS = np.array([-3, -1.5, -0.7, -0.25, -0.05, 1e-9, 0.05, 0.25, 0.7, 1.5, 3])  # of the groups, as logarithms of ratios
GROUPS = len(BOUNDS) + 1
SCALE = 256.0
NEUTRAL = int(np.searchsorted(BOUNDS, 0.0, "right"))  # group of the buckets that tell nothing
MULTIPLIER, MIXER = np.uint32(0x01000193), np.uint32(0x9E3779B1)


def _buffer(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each between two spaces, and where each starts (with the end)."""
    data = np.frombuffer(b"".join(b" %b " % t.translate(_TABLE) for t in texts), np.uint8)
    ends = np.cumsum(np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts)))
    return data, np.concatenate(([0], ends))


def grams(data: np.ndarray, sizes: tuple[int, ...], bits: int):
    """For each n: (bucket, is an n-gram) of every position of data that can start one."""
    h = data.astype(np.uint32)
    space = data == 32
    inner = np.zeros(len(data), bool)  # white space strictly inside the n-gram
    shift = np.uint32(32 - bits)
    for n in range(2, max(sizes) + 1):
        m = len(data) - n + 1
        if m <= 0:
            return
        h = h[:m] * MULTIPLIER ^ data[n - 1 :]
        if n > 2:
            inner = inner[:m] | space[n - 2 : n - 2 + m]
        if n in sizes:
            yield ((h + np.uint32(n)) * MIXER) >> shift, ~inner[:m] & (~(space[:m] & space[n - 1 :]) | (n > 2))


@dataclass(frozen=True)
class Model:
    """margins: for each class but the first, its weight less that of the first, a float32 for each bucket."""

    margins: np.ndarray
    bias: np.ndarray
    sizes: tuple[int, ...]
    bits: int
    scale: float

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """(texts, classes); long lists are scored in blocks."""
        margins = [np.append(margin, np.float32(0)) for margin in self.margins]  # the row after the last weighs nothing
        return np.concatenate([self._block(block, margins) for _, block in _blocks(texts)] or [self._block([], margins)])

    def _block(self, texts: list[bytes], margins: list[np.ndarray]) -> np.ndarray:
        classes = len(self.margins) + 1
        logits = np.zeros((len(texts), classes))
        if texts:
            data, edges = _buffer(texts)
            starts = edges[:-1]
            number, total = np.zeros(len(texts)), np.zeros((len(texts), classes - 1))
            for bucket, valid in grams(data, self.sizes, self.bits):
                at = np.minimum(starts, len(valid) - 1)
                kept = np.where(valid, bucket, np.uint32(1 << self.bits))
                held = starts < len(valid)
                number += np.add.reduceat(valid, at, dtype=np.int64) * held
                for k, margin in enumerate(margins):
                    total[:, k] += np.add.reduceat(margin[kept], at, dtype=np.float64) * held
            logits[:, 1:] = self.scale * total / np.maximum(number, 1)[:, None] + self.bias
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(1, keepdims=True)


def one_label(labels: DataFrame, classes: int) -> DataFrame:
    """doc_id, label: the greatest of a document's labels; null labels and those beyond the classes are passed over."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("label").between(0, classes - 1))
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("label").cast("int").alias("label"))


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about BLOCK bytes, and the number of the first."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > BLOCK or i + 1 == len(texts):
            yield first, texts[first : i + 1]
            first, size = i + 1, 0


def distinct(texts: list[bytes], sizes: tuple[int, ...], bits: int = BITS) -> Iterator[np.ndarray]:
    """The different buckets of each text."""
    mark = np.zeros(1 << bits, bool)
    for _, block in _blocks(texts):
        data, edges = _buffer(block)
        found = []
        for bucket, valid in grams(data, sizes, bits):
            found.append((bucket[valid], np.concatenate(([0], np.cumsum(valid)))[np.minimum(edges, len(valid))]))
        for i in range(len(block)):
            parts = [b[at[i] : at[i + 1]] for b, at in found]
            if sum(map(len, parts)) < FEW:
                yield np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint32)
                continue
            for b in parts:
                mark[b] = True
            held = np.flatnonzero(mark)
            mark[held] = False
            yield held


def occurrences(rows: DataFrame, classes: int, sizes: tuple[int, ...], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(texts of each class that hold a bucket, texts of each class), over all rows (label int, text binary)."""
    parts = -(-(1 << bits) // PART)

    def count(batches):
        held, number = np.zeros((classes, 1 << bits), np.int64), np.zeros(classes, np.int64)
        for batch in common.lean(batches):
            labels = batch.column(0).to_pylist()
            for k, buckets in zip(labels, distinct(batch.column(1).to_pylist(), sizes, bits), strict=True):
                held[k, buckets] += 1
                number[k] += 1
        pack = zstandard.ZstdCompressor(level=1).compress
        sent = {k * (parts + 1) + i: held[k, i * PART : (i + 1) * PART] for k in range(classes) for i in range(parts)}
        sent |= {k * (parts + 1) + parts: number[k : k + 1] for k in range(classes)}
        sent = {i: pack(x.tobytes()) for i, x in sent.items() if x.any()}
        yield pa.record_batch([pa.array(sent, pa.int32()), pa.array(sent.values(), pa.binary())], ["part", "counts"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[i] = total.get(i, 0) + np.frombuffer(unpack(x), np.int64)
        yield pa.record_batch([pa.array(total, pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["part", "counts"])

    schema = "part int, counts binary"
    held, number = np.zeros((classes, 1 << bits), np.int64), np.zeros(classes, np.int64)
    sums = rows.select("label", "text").mapInArrow(count, schema).repartition(min(parts, common.partitions(rows.sparkSession)), "part").mapInArrow(add, schema)
    for part, counts in sums.collect():  # classes * 2 ** bits numbers, whatever the input
        k, i = divmod(part, parts + 1)
        if i == parts:
            number[k] = np.frombuffer(counts, np.int64)[0]
        else:
            held[k, i * PART : (i + 1) * PART] = np.frombuffer(counts, np.int64)
    return held, number


@dataclass(frozen=True)
class Groups:
    """of: for each class but the first, the group of each bucket. number: how many texts of each class were learned from."""

    of: np.ndarray
    number: np.ndarray
    sizes: tuple[int, ...]

    @property
    def width(self) -> int:
        return 1 + len(self.of) * (GROUPS - 1)

    def shares(self, texts: list[bytes]) -> np.ndarray:
        """(texts, width): one, then for each class but the first the shares of a text's subwords in the groups but the neutral one, times SCALE."""
        out = np.zeros((len(texts), self.width))
        out[:, 0] = 1
        for first, block in _blocks(texts):
            data, edges = _buffer(block)
            owner = np.repeat(np.arange(0, len(block) * GROUPS, GROUPS, dtype=np.int32), np.diff(edges))
            counts, number = np.zeros((len(self.of), len(block) * GROUPS), np.int64), 0
            for bucket, valid in grams(data, self.sizes, BITS):
                at, held = owner[: len(valid)][valid], bucket[valid]
                for k, of in enumerate(self.of):
                    counts[k] += np.bincount(at + of[held], minlength=counts.shape[1])
            counts = counts.reshape(len(self.of), len(block), GROUPS)
            if len(counts):
                number = np.maximum(counts[0].sum(1), 1)[:, None]
                out[first : first + len(block), 1:] = SCALE * np.delete(counts, NEUTRAL, 2).transpose(1, 0, 2).reshape(len(block), -1) / number
        return out


def grouped(docs: DataFrame, labels: DataFrame, classes: int, sizes: tuple[int, ...] = (4, 5, 6)) -> Groups:
    """Groups by the texts of all rows of docs that have a label. labels: as one_label gives them."""
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.text_bytes(docs).alias("text"))
    held, number = occurrences(texts.join(labels.hint("merge"), "doc_id"), classes, sizes)  # the same plan at every size
    of = np.zeros((classes - 1, held.shape[1]), np.uint8)
    for k in range(1, classes):
        here, rest = number[k], number.sum() - number[k]
        least = min(here, rest)  # as if both sides had as many texts
        a = held[k] * (least / max(1, here)) + 1
        b = (held.sum(0) - held[k]) * (least / max(1, rest)) + 1
        ratio, chance = np.log(a / b), (1.5 if least < FEW_TEXTS else 2) * np.sqrt(1 / a + 1 / b)
        of[k - 1] = np.searchsorted(BOUNDS, np.sign(ratio) * np.maximum(np.abs(ratio) - chance, 0), "right")
    return Groups(of, number, sizes)


def vectors(column: pa.Array, rows: int) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def probabilities(shares: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(rows, classes). A row's numbers don't depend on the rows beside it."""
    z = np.concatenate([np.zeros((len(shares), 1)), (shares[:, None, :] * weights).sum(2)], 1)
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _sums(table: DataFrame, weights: np.ndarray) -> np.ndarray:
    """Over all rows: sums of the shares and their squares, the loss, its gradient and second derivatives; each task sends one row a number."""
    others, width = weights.shape
    size = others * width

    def run(batches):
        total = np.zeros(2 * width + 1 + size + size * size)
        for batch in batches:
            if batch.num_rows:
                x, y = vectors(batch.column("shares"), batch.num_rows), batch.column("label").to_numpy()
                p = probabilities(x, weights)
                loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum()
                p = p[:, 1:]
                second = np.zeros((others, width, others, width))
                for a in range(others):
                    for b in range(others):
                        second[a, :, b] = (x * (p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ x
                total += np.concatenate([x.sum(0), (x * x).sum(0), [loss], ((p - np.eye(others + 1)[y][:, 1:]).T @ x).ravel(), second.ravel()])
        yield pa.record_batch([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "x"])

    out = np.zeros(2 * width + 1 + size + size * size)
    for i, x in table.select("label", "shares").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x")).collect():
        out[i] = x
    return out


def fit_weights(table: DataFrame, groups: Groups, ridge: float = 1e-4, most: int = 60, tolerance: float = 1e-10) -> np.ndarray:
    """Weights (classes - 1, width) of least mean loss over all rows of table (label int, shares), with a ridge in units of each share's deviation.

    Without texts of two classes every row gets the classes' shares of the labels, none of them below a millionth.
    """
    classes, width = len(groups.number), groups.width
    base = np.log(np.maximum(groups.number / max(1, groups.number.sum()), 1e-6))
    weights = np.zeros((classes - 1, width))
    weights[:, 0] = (base - base[0])[1:]
    if np.count_nonzero(groups.number) < 2:
        return weights
    best, step, ridges = None, np.zeros_like(weights), np.zeros(width)
    for _ in range(most):
        sums = _sums(table, weights + step)
        n, size = sums[0], weights.size
        if best is None:
            ridges = ridge * np.maximum(0, sums[width : 2 * width] / n - (sums[:width] / n) ** 2)  # the first, of the ones, is 0
        at = weights + step
        loss = sums[2 * width] / n + (ridges * at * at).sum() / 2
        if best is not None and loss > best + 1e-12:
            step = step / 2
            continue
        best, weights = loss, at
        gradient = sums[2 * width + 1 :][:size] / n + (ridges * at).ravel()
        second = sums[-size * size :].reshape(size, size) / n + np.diag(np.tile(ridges, classes - 1) + 1e-9)
        step = -np.linalg.solve(second, gradient).reshape(weights.shape)
        if -(gradient * step.ravel()).sum() < tolerance:
            break
    return weights


def linear(groups: Groups, weights: np.ndarray) -> Model:
    """The same classifier as a weight for each bucket."""
    each = np.insert(weights[:, 1:].reshape(len(weights), len(groups.of), GROUPS - 1), NEUTRAL, 0, axis=2)
    margins = np.stack([sum(each[k, j][of] for j, of in enumerate(groups.of)) for k in range(len(weights))])
    return Model(np.ascontiguousarray(margins, np.float32), weights[:, 0], groups.sizes, BITS, SCALE)
