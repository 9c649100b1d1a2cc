"""An interpolated modified Kneser-Ney trigram model, counted in Spark, stored as sorted hash arrays, memory-mapped by workers.

Words are known by their 64-bit hash. The vocabulary is the sorted array of the hashes of all training tokens, cut into ranges by
the leading bits; a word's id is its place in it, so ids keep the order of the hashes. Trigrams are dealt to ranges by a hash of their
context (u, v): a range file holds the sorted contexts with their numbers of followers, where the followers of every GROUP-th begin, the
followers' ids in order and their counts. A second shuffle of the different (v, w) with the number of different u before them gives the
middle order, a third one the numbers of v and w.

Sorted pairs of ids are cut into runs of equal leading bits, and only the other bits of each are stored (`indexed`); a count stands in the bits
that are left of its key's last byte (`fold`). Counts that don't fit stand in a table of their own with up to 64 bits, so none wraps.

Tasks sort and sum what they have before it is shuffled. Ranges are as many as the tokens ask for (`RANGE` each), whatever the
shuffle partitions; contexts are spread by a hash, and pairs of a word that holds over 1/256 of all tokens by a hash of both words, so a range holds
more only where one context has more different followers than that. Nothing is pruned.

Tokens: words between ASCII white space, A-Z lower-cased, and one end for each document; the first words follow start marks.
p(w|uv) = max(c(uvw) - D3, 0) / c(uv) + g(uv) p(w|v); p(w|v) the same with the number of different u before (v, w) (counts, where v is the start
mark); p(w) with the number of different v before w; below it 1 / (V + 1) for each token and for unknown ones. A context
without followers leaves the order below.

Defined cases: null text counts as empty (the end alone); a null doc_id trains and is not held out; repeated rows count once each; an
empty table, or one without training rows, gives scores from 1 / (V + 1); other columns are ignored. More than 2^32 - 2 different words raise.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .toxicity import remainder

END = xxhash.xxh64_intdigest(b"")
CHUNK = 1 << 18  # tokens that are handled together
HELD = 1 << 21  # different keys that a task holds before it passes them on
RANGE = 1 << 22  # training tokens a range of contexts
HOT_SHARE = 256
PACK, UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
U32, LOW = np.uint64(32), np.uint64(0xFFFFFFFF)
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)
LONG_SLICE = 32  # followers from which a context's sums are stored
RUN = 16  # keys a run of equal leading bits, on average at least
GROUP = 8  # contexts for which the place of the first follower is stored once


def hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, and where each text starts."""
    words = [t.lower().split() for t in texts]
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.cumsum(lengths) - lengths
    out = np.full(lengths.sum(), END, np.uint64)
    inside = np.ones(len(out), bool)
    inside[starts + lengths - 1] = False
    digest = xxhash.xxh64_intdigest
    out[inside] = np.fromiter((digest(w) for ws in words for w in ws), np.uint64, int(inside.sum()))
    return out, starts


def chunks(batches, columns: int) -> Iterator[tuple[list[list], np.ndarray, np.ndarray]]:
    """The first `columns` columns and the token hashes of blocks of documents; the text is the last column."""
    rows: list[list] = [[] for _ in range(columns)]
    texts, size = [], 0
    for batch in batches:
        for *values, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for r, v in zip(rows, values, strict=True):
                r.append(v)
            texts.append(text)
            size += len(text)
            if size > 5 * CHUNK:
                yield rows, *hashes(texts)
                rows, texts, size = [[] for _ in range(columns)], [], 0
    if texts:
        yield rows, *hashes(texts)


def spread(pairs: np.ndarray, bits: int) -> np.ndarray:
    """A range of each pair of ids (first << 32 | second), by the leading bits of a hash."""
    if not bits:
        return np.zeros(len(pairs), np.int64)
    x = (pairs ^ pairs >> U32) * np.uint64(MIX[0])
    x = (x ^ x >> np.uint64(29)) * np.uint64(MIX[1])
    return ((x ^ x >> U32) >> np.uint64(64 - bits)).astype(np.int64)


Block = tuple[np.ndarray, ...]  # keys, perhaps a second key, counts


def merged(*block: np.ndarray) -> Block:
    """The block in order of its keys, counts of equal keys added up."""
    *keys, counts = block
    if not len(counts):
        return block
    order = np.argsort(keys[0])
    sort_by = keys[0][order]
    if len(keys) > 1:  # the second key, below the rank of the first
        rank = np.zeros(len(order), np.uint64)
        np.cumsum(sort_by[1:] != sort_by[:-1], out=rank[1:])
        sort_by = rank << U32 | keys[1][order]
        second = np.argsort(sort_by)
        order, sort_by = order[second], sort_by[second]
    first = _begins(sort_by)
    return (*(k[order[first]] for k in keys), np.add.reduceat(counts[order], first))


def _begins(ascending: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(ascending)), bool), ascending[1:] != ascending[:-1])))


def _stable(place: np.ndarray) -> np.ndarray:
    """The order of range numbers, equal ones as they come; numbers of 16 bits are sorted by counting."""
    return np.argsort(place.astype(np.uint16) if len(place) and place.max() < 1 << 16 else place, kind="stable")


def counted_trigrams(h: np.ndarray, starts: np.ndarray, v: Vocabulary) -> Block:
    """Contexts (u << 32 | v), words and counts of the different trigrams of a chunk, in order."""
    words, own = np.unique(h, return_inverse=True)
    ids = np.append(v.find(words), len(v)).astype(np.uint64)  # ascending: all words are known
    own, mark = own.astype(np.uint64), np.uint64(len(words))
    before = _previous(own, starts, mark)
    bits = np.uint64(21)
    if len(words) >> 21:
        raise ValueError("a chunk has more different words than its keys hold")
    keys = np.sort(_previous(before, starts, mark) << bits + bits | before << bits | own)
    first = _begins(keys)
    keys, low = keys[first], np.uint64((1 << 21) - 1)
    return ids[keys >> bits + bits] << U32 | ids[keys >> bits & low], ids[keys & low].astype("<u4"), np.diff(np.append(first, len(h)))


class Sums:
    """Sums of counts by key; blocks are merged when they outgrow HELD, or twice what the last merge left."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.size, self.limit = 0, HELD

    def add(self, *block: np.ndarray) -> bool:
        """True if merging doesn't make it small any more, and it is time to pass on."""
        self.blocks.append(merged(*block))
        self.size += len(self.blocks[-1][-1])
        if self.size <= self.limit:
            return False
        self._merge()
        return self.size > HELD // 2

    def _merge(self) -> None:
        if len(self.blocks) > 1:
            self.blocks = [merged(*map(np.concatenate, zip(*self.blocks, strict=True)))]
        self.size = len(self.blocks[0][-1])
        self.limit = max(HELD, 2 * self.size)

    def take(self) -> Block | None:
        if not self.blocks:
            return None
        self._merge()
        out = self.blocks[0]
        self.__init__()
        return out


def pack(*block: np.ndarray) -> bytes:
    """Ascending keys as differences, second keys and counts, byte plane by byte plane, compressed."""
    columns = [np.diff(block[0], prepend=np.uint64(0)), *(b.astype("<u4") for b in block[1:-1]), block[-1].astype("<u8")]
    planes = [c.view(np.uint8).reshape(len(c), -1).T for c in columns]
    return PACK.compress(b"".join(np.ascontiguousarray(p).tobytes() for p in planes))


def unpack(data: bytes, keys: int = 1) -> Block:
    raw = np.frombuffer(UNPACK.decompress(data), np.uint8)
    n, at, out = len(raw) // (12 + 4 * keys), 0, []
    for width in (8, *(4,) * (keys - 1), 8):
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).reshape(-1).view(f"<u{width}"))
        at += n * width
    return (np.cumsum(out[0], dtype=np.uint64), *out[1:-1], out[-1].astype(np.int64))


def dealt(block: Block | None, bounds: np.ndarray, by: np.ndarray | None = None, base: int = 0) -> pa.RecordBatch:
    """A row for each range: its number and its packed part. bounds: the least value of `by` (the first key) of each range but the first."""
    rows = []
    if block is not None:
        cuts = [0, *np.searchsorted(block[0] if by is None else by, bounds).tolist(), len(block[0])]
        rows = [(base + i, pack(*(c[a:b] for c in block))) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "part"])


def ranges(batches, keys: int = 1) -> Iterator[tuple[int, Block]]:
    """(range, block) of each range whose parts stand together."""
    now, sums = None, Sums()
    for batch in batches:
        for b, data in zip(batch.column("bucket").to_pylist(), batch.column("part").to_pylist(), strict=True):
            if b != now:
                if now is not None:
                    yield now, sums.take()
                now = b
            sums.add(*unpack(data, keys))
    if now is not None:
        yield now, sums.take()


def save(folder: str, name: str, *arrays: np.ndarray) -> str:
    """Writes arrays to a file of a name of its own, since a task may run twice: for each its width, type and length, then the data at multiples of 8 bytes."""
    uri = f"{folder}/{name}-{uuid.uuid4().hex}.bin"
    system, path = common.filesystem(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path, compression=None) as out:
        out.write(np.array([len(arrays), *(x for a in arrays for x in (a.dtype.itemsize, len(a)))], "<u8").tobytes())
        for a in arrays:
            data = np.ascontiguousarray(a).tobytes()
            out.write(data + bytes(-len(data) % 8))
    return uri


@lru_cache(maxsize=4096)
def mapped(uri: str) -> tuple[np.ndarray, ...]:
    """The unsigned arrays in a file: memory-mapped where the shared folder is mounted, else read."""
    from pyarrow import fs

    system, path = common.filesystem(uri)
    if isinstance(system, fs.LocalFileSystem):
        data = np.asarray(np.memmap(path, np.uint8, "r"))
    else:
        with system.open_input_file(path) as file:
            data = np.frombuffer(file.read(), np.uint8)
    n = int(data[:8].view("<u8")[0])
    head = data[8 : 8 + 16 * n].view("<u8").reshape(n, 2).tolist()
    at, out = 8 + 16 * n, []
    for width, length in head:
        out.append(data[at : at + width * length].view(f"<u{width}"))
        at += -(-width * length // 8) * 8
    return tuple(out)


def compact(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One byte a count, and the places and values of those that don't fit."""
    over = np.flatnonzero(counts >= 255)
    return np.minimum(counts, 255).astype(np.uint8), over.astype("<u8"), counts[over].astype("<u8")


def expanded(small: np.ndarray, places: np.ndarray, values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The counts at some places."""
    out = small[at].astype(np.int64)
    large = np.flatnonzero(out == 255)
    if len(large):
        out[large] = values[np.searchsorted(places, at[large].astype(np.uint64))]
    return out


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype("<u4" if not len(x) or int(x.max()) < 1 << 32 else "<u8")


def _layout(bits: int) -> tuple[int, int]:
    """Bytes that a value of so many bits (62 at most) and its count take together, and the bits of them that the count has."""
    width = (bits + 9) >> 3
    return width, 8 * width - bits


def fold(values: np.ndarray, counts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values and counts (1 at least) together in few bytes, and the places and values of the counts that don't fit."""
    width, spare = _layout(bits)
    most = (1 << spare) - 1
    over = np.flatnonzero(counts > most)
    both = values.astype("<u8") << np.uint64(spare) | np.minimum(counts - 1, most).astype("<u8")
    raw = np.append(both.view(np.uint8).reshape(-1, 8)[:, :width], np.zeros(8, np.uint8))  # as `_fetch` reads 8 bytes
    return raw, _small(over), _small(counts[over])


def _view(raw: np.ndarray, width: int) -> np.ndarray:
    """Folded values, each in the low bytes of a number whose others are of the next; one more stands at the end."""
    kind = np.dtype("<u4" if width <= 4 else "<u8")
    return np.ndarray(((len(raw) - 8) // width + 1,), kind, raw, strides=(width,))


def _fetch(raw: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    return _view(raw, width)[at].astype("<u8") & np.uint64((1 << 8 * width) - 1)


def counts_at(raw: np.ndarray, places: np.ndarray, values: np.ndarray, bits: int, at: np.ndarray) -> np.ndarray:
    """The counts of folded values at some places."""
    width, spare = _layout(bits)
    most = (1 << spare) - 1
    out = (_fetch(raw, width, at) & np.uint64(most)).astype(np.int64) + 1
    large = np.flatnonzero(out > most)
    if len(large):
        out[large] = values[np.searchsorted(places, at[large].astype(places.dtype))]
    return out


def search(raw: np.ndarray, bits: int, lo: np.ndarray, hi: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted values in ascending slices [lo, hi) of folded values, and which were found."""
    width, spare = _layout(bits)
    view, at = _view(raw, width), lo.copy()
    aside = view.itemsize * 8 - 8 * width  # shifts the bytes of the next value out
    open_ = np.flatnonzero((lo < hi) & (want >> np.uint64(bits) == 0))
    want = want << np.uint64(spare)
    lo_, hi_, want_ = lo[open_], hi[open_], (want[open_] << np.uint64(aside)).astype(view.dtype)
    aside, left = view.dtype.type(aside), np.ones(len(open_), bool)
    while len(open_):
        mid = (lo_ + hi_) >> 1
        less = (view[mid] << aside < want_) & left
        lo_, hi_ = np.where(less, mid + 1, lo_), np.where(less, hi_, mid)
        left = lo_ < hi_
        if 2 * np.count_nonzero(left) <= len(left):
            at[open_] = lo_
            open_, lo_, hi_, want_ = open_[left], lo_[left], hi_[left], want_[left]
            left = left[left]
    found = np.flatnonzero(at < hi)
    hit = np.zeros(len(at), bool)
    hit[found] = (_fetch(raw, width, at[found]) ^ want[found]) >> np.uint64(spare) == 0
    return at, hit


def indexed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ascending different keys and their counts: the bits that are stored of each key, the leading bits of the runs, where these begin, folded rest and counts."""
    change = keys[1:] ^ keys[:-1]
    bits = bisect_left(range(62), True, key=lambda b: bool(np.count_nonzero(change >> np.uint64(b)) < len(keys) // RUN))
    leading = keys >> np.uint64(bits)
    begin = _begins(leading)
    rest = keys & np.uint64((1 << bits) - 1)
    return np.array([bits], "<u8"), _small(leading[begin]), _small(np.append(begin, len(keys))), *fold(rest, counts, bits)


def look_up(index: tuple[np.ndarray, ...], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in an index, and which were found."""
    bits, leading, begin, raw = int(index[0][0]), *index[1:4]
    high = keys >> np.uint64(bits)
    run = np.minimum(np.searchsorted(leading, high), len(leading) - 1)
    lo = begin[run].astype(np.int64)
    hi = np.where(leading[run] == high, begin[run + 1].astype(np.int64), lo)
    return search(raw, bits, lo, hi, keys & np.uint64((1 << bits) - 1))


def index_counts(index: tuple[np.ndarray, ...], at: np.ndarray) -> np.ndarray:
    return counts_at(*index[3:6], int(index[0][0]), at)


def _grouped(parts: DataFrame, buckets: int) -> DataFrame:
    n = min(buckets, 4 * common.partitions(parts.sparkSession))
    return parts.repartitionById(n, F.pmod("bucket", F.lit(n))).sortWithinPartitions("bucket")


def _bounds(bits: int) -> np.ndarray:
    return np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)


def _runs(place: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, begin, end) of the runs of an ascending array."""
    begins = np.flatnonzero(np.diff(place, prepend=-1)).tolist() if len(place) else []
    return [(int(place[a]), a, b) for a, b in zip(begins, [*begins[1:], len(place)], strict=True)]


@dataclass(frozen=True)
class Vocabulary:
    bits: int
    offsets: np.ndarray  # id of the first word of each range, and V
    files: tuple[str | None, ...]  # hashes, counts
    total: int  # N
    hot: np.ndarray  # ascending ids of words that hold over 1 / HOT_SHARE of all tokens

    def __len__(self) -> int:
        return int(self.offsets[-1])

    @property
    def id_bits(self) -> int:
        return len(self).bit_length()  # the start mark is V

    def narrow(self, pairs: np.ndarray) -> np.ndarray:
        """Pairs of known ids (first << 32 | second) without the bits that no id has; they keep their order."""
        return pairs >> U32 << np.uint64(self.id_bits) | pairs & LOW

    def find(self, hashes_: np.ndarray) -> np.ndarray:
        """Ids of ascending hashes; V + 1 for unknown ones."""
        out = np.full(len(hashes_), len(self) + 1, np.int64)
        cuts = np.searchsorted(hashes_, _bounds(self.bits))
        for i, (a, b) in enumerate(zip([0, *cuts.tolist()], [*cuts.tolist(), len(hashes_)], strict=True)):
            if b > a and self.files[i]:
                known = mapped(self.files[i])[0]
                at = np.minimum(np.searchsorted(known, hashes_[a:b]), len(known) - 1)
                hit = known[at] == hashes_[a:b]
                out[a:b][hit] = (at + self.offsets[i])[hit]
        return out

    def range_of(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets[1:-1], ids, side="right")


def count_words(training: DataFrame, folder: str, bits: int) -> Vocabulary:
    """training: text binary."""

    def scan(batches):
        sums = Sums()
        for _, h, _ in chunks(batches, 0):
            if sums.add(h, np.ones(len(h), np.int64)):
                yield dealt(sums.take(), _bounds(bits))
        yield dealt(sums.take(), _bounds(bits))

    def merge(batches):
        names = ["bucket", "n", "total", "file", "often"]
        rows = []
        for b, (keys, counts) in ranges(batches):
            often = np.flatnonzero(counts * HOT_SHARE > counts.sum())  # under HOT_SHARE of them
            rows.append((b, len(keys), int(counts.sum()), save(folder, "words", keys, *compact(counts)), [x for i in often.tolist() for x in (i, int(counts[i]))]))
        yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())))], names)

    parts = training.mapInArrow(scan, "bucket int, part binary")
    made = common.materialize(_grouped(parts, 1 << bits).mapInArrow(merge, "bucket int, n long, total long, file string, often array<long>"), "vocabulary").collect()  # a row a range
    common.drop_shuffles(training.sparkSession)
    sizes, files = np.zeros(1 << bits, np.int64), [None] * (1 << bits)
    for r in made:
        sizes[r["bucket"]], files[r["bucket"]] = r["n"], r["file"]
    offsets, total = np.concatenate(([0], np.cumsum(sizes))), sum(r["total"] for r in made)
    if offsets[-1] + 2 > 1 << 32:
        raise ValueError(f"{offsets[-1]} different words don't fit into 32-bit ids")
    hot = sorted(int(offsets[r["bucket"]]) + i for r in made for i, n in zip(r["often"][::2], r["often"][1::2], strict=True) if n * HOT_SHARE > total)
    return Vocabulary(bits, offsets, tuple(files), total, np.array([*hot, offsets[-1]], np.int64))  # the start mark, V, stands before many words too


def discounts(of_counts: np.ndarray) -> np.ndarray:
    """D for counts 1, 2 and 3 or more from the numbers of n-grams seen 1, 2, 3 and 4 times; plain values where these don't serve."""
    n1, n2, n3, n4 = (float(x) for x in of_counts)
    plain = np.array([0.5, 1.0, 1.5])
    if not n1 or not n2 or not n3:
        return plain
    y = n1 / (n1 + 2 * n2)
    found = np.array([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.where((found > 0) & (found < [1, 2, 3]), found, plain)


def _discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.maximum(counts - np.concatenate(([0.0], d))[np.minimum(counts, 3).astype(np.int64)], 0)


def _shares(counts: np.ndarray, totals: np.ndarray, seen: np.ndarray, d: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Interpolated probabilities; `below` where a context has no followers. seen: (n, 3) followers seen once, twice, more often."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(totals > 0, (_discounted(counts, d) + seen @ d * below) / totals, below)


def pair_range(v: np.ndarray, w: np.ndarray, vocabulary: Vocabulary, bits: int) -> np.ndarray:
    """The range of the pairs (v, w): by v, or by a hash of both where v is hot."""
    by_word = (v.astype(np.int64) << bits) // (len(vocabulary) + 1)
    by_hash = spread(v.astype(np.uint64) << U32 | w.astype(np.uint64), bits)
    at = np.minimum(np.searchsorted(vocabulary.hot, v), len(vocabulary.hot) - 1)
    return np.where(vocabulary.hot[at] == v, by_hash, by_word)


@dataclass(frozen=True)
class Model:
    vocabulary: Vocabulary
    bits: int
    contexts: tuple[str | None, ...]  # by range: index of contexts and numbers of followers, first of each group, folded words and counts, sums of long slices
    pairs: tuple[str | None, ...]  # by pair range: index of (v, w) and counts
    words: tuple[tuple[str | None, ...], ...]  # by range of the word: total, once, twice, more (as a context), before
    different: int  # number of different pairs
    d: tuple[np.ndarray, np.ndarray, np.ndarray]  # of words, pairs, trigrams
    gamma1: float

    def _dense(self, ids: np.ndarray, columns: list[int]) -> np.ndarray:
        """(n, columns) of the word arrays of ascending ids; 0 for unknown words."""
        out = np.zeros((len(ids), len(columns)))
        known = np.searchsorted(ids, len(self.vocabulary) + 1)
        for place, a, b in _runs(self.vocabulary.range_of(ids[:known])):
            for i, c in enumerate(columns):
                if self.words[place][c]:
                    out[a:b, i] = expanded(*mapped(self.words[place][c]), ids[a:b] - self.vocabulary.offsets[place])
        return out

    def unigram(self, ids: np.ndarray) -> np.ndarray:
        """p(w)."""
        words, back = np.unique(ids, return_inverse=True)
        size = len(self.vocabulary)
        if not self.different:
            return np.full(len(ids), 1 / (size + 1))
        n = np.zeros(len(words))
        inside = np.searchsorted(words, size)
        n[:inside] = self._dense(words[:inside], [4])[:, 0]
        return (_discounted(n, self.d[0]) / self.different + self.gamma1 / (size + 1))[back]

    def bigram(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """p(w | v) of each pair."""
        size = len(self.vocabulary)
        keys, back = np.unique(v.astype(np.uint64) << U32 | w.astype(np.uint64), return_inverse=True)
        v, w = (keys >> U32).astype(np.int64), (keys & LOW).astype(np.int64)
        counts = np.zeros(len(keys), np.int64)
        known = np.flatnonzero((v <= size) & (w < size))
        place = pair_range(v[known], w[known], self.vocabulary, self.bits)
        order = _stable(place)
        known, place = known[order], place[order]
        for p, a, b in _runs(place):
            if self.pairs[p]:
                index = mapped(self.pairs[p])
                at, hit = look_up(index, self.vocabulary.narrow(keys[known[a:b]]))
                counts[known[a:b][hit]] = index_counts(index, at[hit])
        different, own = np.unique(v, return_inverse=True)
        sums = self._dense(different, [0, 1, 2, 3])[own]
        return _shares(counts, sums[:, 0], sums[:, 1:], self.d[1], self.unigram(w))[back]

    def _range(self, p: int, ctx: np.ndarray, w: np.ndarray, out: np.ndarray) -> None:
        """Fills out (count, total, once, twice, more) of the trigrams of one range; ctx ascending."""
        stored = mapped(self.contexts[p])
        index, (first, followers, places, values, long_at), long_sums = stored[:6], stored[6:11], stored[11:]
        id_bits = self.vocabulary.id_bits
        different, own = np.unique(ctx, return_inverse=True)
        at, known = look_up(index, self.vocabulary.narrow(different))
        lo, hi = np.zeros((2, len(different)), np.int64)
        lo[known], hi[known] = _slices(index, first, at[known])
        sums = np.zeros((len(different), 4))
        short = np.flatnonzero(known & (hi - lo < LONG_SLICE))
        if len(short):
            length = hi[short] - lo[short]
            ends = np.cumsum(length)
            counts = counts_at(followers, places, values, id_bits, np.arange(ends[-1]) + np.repeat(lo[short] - ends + length, length))
            begin = ends - length
            sums[short] = np.stack([np.add.reduceat(x, begin) for x in (counts, counts == 1, counts == 2, counts > 2)], 1)
        long = np.flatnonzero(known & (hi - lo >= LONG_SLICE))
        if len(long):
            where = np.searchsorted(long_at, at[long].astype(np.uint64))
            sums[long] = np.stack([x[where] for x in long_sums], 1)
        out[:, 1:] = sums[own]
        place, found = search(followers, id_bits, lo[own], hi[own], w.astype(np.uint64))
        hit = np.flatnonzero(found)
        out[hit, 0] = counts_at(followers, places, values, id_bits, place[hit])

    def log10(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 p of each token of texts after the two before it."""
        size = len(self.vocabulary)
        v = _previous(ids, starts, size)
        u = _previous(v, starts, size)
        below = self.bigram(v, ids)
        found = np.zeros((len(ids), 5))
        known = np.flatnonzero((u <= size) & (v <= size))
        ctx = u[known].astype(np.uint64) << U32 | v[known].astype(np.uint64)
        order = np.argsort(ctx)
        order = order[_stable(spread(ctx[order], self.bits))]
        known, ctx = known[order], ctx[order]
        for p, a, b in _runs(spread(ctx, self.bits)):
            if self.contexts[p]:
                part = np.zeros((b - a, 5))
                self._range(p, ctx[a:b], ids[known[a:b]], part)
                found[known[a:b]] = part
        return np.log10(_shares(found[:, 0], found[:, 1], found[:, 2:], self.d[2], below))


def _slices(index: tuple[np.ndarray, ...], first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the followers of contexts begin and end: the first of the group, and the numbers of those between."""
    near = (at // GROUP * GROUP)[:, None] + np.arange(GROUP)
    last = int(index[2][-1]) - 1
    n = index_counts(index, np.minimum(near, last).reshape(-1)).reshape(near.shape)
    begin = first[at // GROUP].astype(np.int64) + (n * (near < at[:, None])).sum(1)
    return begin, begin + n[np.arange(len(at)), at % GROUP]


def _previous(ids: np.ndarray, starts: np.ndarray, mark: int) -> np.ndarray:
    out = np.concatenate(([mark], ids[:-1]))
    out[starts] = mark
    return out


def _of_counts(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3, 4."""
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist()


MERGED = "kind string, bucket int, part binary, n long, of_counts array<long>, file string"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.string())
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [x.split()[0] for x in MERGED.split(", ")])


def _parts(batch: pa.RecordBatch) -> list[tuple]:
    return [("part", b, p, None, None, None) for b, p in zip(*(c.to_pylist() for c in batch.columns), strict=True)]


def count_ngrams(training: DataFrame, v: Vocabulary, folder: str, bits: int) -> Model:
    """training: text binary. The start mark has the id V."""
    size, buckets, word_ranges = len(v), 1 << bits, len(v.offsets) - 1
    numbers = np.arange(1, buckets)

    def by_range(block: Block | None) -> pa.RecordBatch:
        if block is None:
            return dealt(None, numbers)
        place = spread(block[0], bits)
        order = _stable(place)
        return dealt(tuple(c[order] for c in block), numbers, place[order])

    def scan(batches):
        sums = Sums()
        for _, h, starts in chunks(batches, 0):
            if sums.add(*counted_trigrams(h, starts, v)):
                yield by_range(sums.take())
        yield by_range(sums.take())

    def merge_trigrams(batches):
        for b, (ctx, words, counts) in ranges(batches, 2):
            begin = _begins(ctx)
            followers = np.diff(np.append(begin, len(ctx)))
            long = np.flatnonzero(followers >= LONG_SLICE)
            sums = [np.add.reduceat(x.astype(np.int64), begin)[long].astype("<u8") for x in (counts, counts == 1, counts == 2, counts > 2)]
            file = save(folder, "trigrams", *indexed(v.narrow(ctx[begin]), followers), _small(begin[::GROUP]), *fold(words, counts, v.id_bits), long.astype("<u8"), *sums)
            middle = (ctx & LOW).astype(np.int64)
            keys, n = merged(middle.astype(np.uint64) << U32 | words.astype(np.uint64), np.where(middle == size, counts, 1))
            place = pair_range((keys >> U32).astype(np.int64), (keys & LOW).astype(np.int64), v, bits)
            order = _stable(place)
            yield _batch([("range", b, None, len(ctx), _of_counts(counts), file), *_parts(dealt((keys[order], n[order]), numbers, place[order]))])

    def merge_pairs(batches):
        by_word = v.offsets[1:-1].astype(np.uint64)
        for b, (keys, n) in ranges(batches):
            file = save(folder, "pairs", *indexed(v.narrow(keys), n))
            rows = [("range", b, None, len(keys), _of_counts(n), file)]
            first = keys >> U32
            for kind, (key, number) in enumerate(((first, n), (first, n == 1), (first, n == 2), (first, n > 2), (keys & LOW, np.ones(len(n))))):
                kept = number > 0
                rows += _parts(dealt(merged(key[kept], number[kept].astype(np.int64)), by_word, base=kind * word_ranges))
            yield _batch(rows)

    def merge_words(batches):
        for b, (words, n) in ranges(batches):
            kind, place = divmod(b, word_ranges)
            dense = np.zeros(int(v.offsets[place + 1] - v.offsets[place]) + (place == word_ranges - 1), np.int64)  # the start mark follows the last word
            dense[words.astype(np.int64) - int(v.offsets[place])] = n
            yield _batch([("range", b, None, int((n > 2).sum()), _of_counts(n), save(folder, "dense", *compact(dense)))])

    def merge(parts: DataFrame, run, n: int, tag: str, read: str | None = None) -> tuple[DataFrame, list, str]:
        """The parts for the next order, what was saved, and the folder of both; read: the folder that `parts` come from, which goes when they are merged."""
        path = common.scratch(training.sparkSession, tag)
        found = common.materialize(_grouped(parts, n).mapInArrow(run, MERGED), tag, path)
        saved = found.where("kind = 'range'").select("bucket", "n", "of_counts", "file").collect()  # a row a range
        if read:
            common.remove(read)
        common.drop_shuffles(training.sparkSession)
        return found.where("kind = 'part'").select("bucket", "part"), saved, path

    def by_bucket(rows: list, n: int) -> list:
        out = [None] * n
        for r in rows:
            out[r["bucket"]] = r["file"]
        return out

    add = lambda rows: np.sum([r["of_counts"] for r in rows], axis=0) if rows else np.zeros(4)
    parts, trigrams, read = merge(training.mapInArrow(scan, "bucket int, part binary"), merge_trigrams, buckets, "trigrams")
    parts, pairs, read = merge(parts, merge_pairs, buckets, "pairs", read)
    _, dense, _ = merge(parts, merge_words, 5 * word_ranges, "words", read)
    before = [r for r in dense if r["bucket"] >= 4 * word_ranges]
    different = sum(r["n"] for r in pairs)
    d1 = discounts(add(before))
    gamma1 = float(d1 @ [add(before)[0], add(before)[1], sum(r["n"] for r in before)]) / max(1, different)
    files = by_bucket(dense, 5 * word_ranges)
    return Model(v, bits, tuple(by_bucket(trigrams, buckets)), tuple(by_bucket(pairs, buckets)), tuple(zip(*(files[k * word_ranges : (k + 1) * word_ranges] for k in range(5)), strict=True)), different, (d1, discounts(add(pairs)), discounts(add(trigrams))), gamma1)


def fit(training: DataFrame, tag: str = "lm") -> Model:
    """training: one column, text binary."""
    spark = training.sparkSession
    folder = common.scratch(spark, tag)
    bits = lambda n: max(0, (n - 1).bit_length())
    words = count_words(training, folder, bits(common.text_ranges(training, each=256 << 20)))
    return count_ngrams(training, words, folder, bits(max(common.partitions(spark), -(-words.total // RANGE))))


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """Scores every row of docs (doc_id, text) with the model of the rows whose crc32(doc_id as text) mod folds is not held; see OUT."""
    held_out = F.coalesce(remainder(docs["doc_id"], folds) == held, F.lit(False))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out.alias("held_out"), common.text_bytes(docs).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(fit(rows.where(~F.col("held_out")).select("text")))  # names of files and a few numbers

    def run(batches):
        m = model.value
        v = m.vocabulary
        size = len(v)
        for (doc_ids, held_), h, starts in chunks(batches, 2):
            words, back = np.unique(h, return_inverse=True)
            ids = v.find(words)
            counts = np.zeros(len(ids))
            inside = np.flatnonzero(ids < size)
            own = ids[inside]  # ascending, as ids keep the order of the hashes
            for place, a, b in _runs(v.range_of(own)):
                counts[inside[a:b]] = expanded(*mapped(v.files[place])[1:], own[a:b] - v.offsets[place])
            base = np.log10((counts + 1) / (v.total + size + 1))[back]
            ids = ids[back]
            sums = lambda x, kind=np.float64: np.add.reduceat(x, starts, dtype=kind)  # noqa: E731, B023
            columns = (doc_ids, held_, np.diff(np.append(starts, len(h))), sums(ids < size, np.int64), np.full(len(starts), v.total), sums(base), sums(m.log10(ids, starts)))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], [x.split()[0] for x in OUT.split(", ")])

    return rows.mapInArrow(run, OUT)
