"""Token ids in binary files: independent zstandard frames, then a document index and a seek table.

File: frames, a skippable frame (magic 184D2A50) with the first and last document of each frame, and a skippable frame in
the public seekable format (184D2A5E ... 8F92EAB1) with the compressed size, raw size and checksum (low half of XXH64) of
each frame. A frame holds, little-endian: uint32 documents, uint8 bytes an id, int64 doc ids, uint32 lengths, ids. A reader seeks
to the end, reads the two tables and decompresses the frames it needs alone.

Defined cases: null text counts as empty (the end id alone); rows of one doc_id stand together, by hash of the text, in several files if
there are very many; null doc_ids come first and read back as null; an empty table gives no file and no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common

INDEX_MAGIC, SEEK_MAGIC, SEEK_END = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
MANIFEST = "bucket int, file string, documents long, ids long, bytes long"


class Writer:
    """Appends documents to an open stream and closes it with the tables."""

    def __init__(self, out, wide: bool, frame_ids: int, level: int):
        self.out, self.wide, self.frame_ids, self.zstd = out, wide, frame_ids, zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int, int, int, int]] = []
        self.documents = self.ids = self.bytes = 0
        self._reset()

    def _reset(self) -> None:
        self.doc_ids, self.lengths, self.parts, self.pending = [], [], [], 0

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.parts.append(ids)
        self.pending += len(ids)
        if self.pending >= self.frame_ids:
            self._frame()

    def _frame(self) -> None:
        ids = np.concatenate(self.parts).astype("<u4" if self.wide else "<u2").tobytes()
        raw = struct.pack("<IB", len(self.doc_ids), 4 if self.wide else 2) + np.array(self.doc_ids, "<i8").tobytes() + np.array(self.lengths, "<u4").tobytes() + ids
        packed = self.zstd.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF, self.doc_ids[0], self.doc_ids[-1]))
        self.documents, self.ids, self.bytes = self.documents + len(self.doc_ids), self.ids + self.pending, self.bytes + len(packed)
        self._reset()

    def close(self) -> None:
        if self.doc_ids:
            self._frame()
        index = b"".join(struct.pack("<qq", *f[3:]) for f in self.frames)
        seek = b"".join(struct.pack("<III", *f[:3]) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEK_END)
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index + struct.pack("<II", SEEK_MAGIC, len(seek)) + seek)


class Reader:
    """Random access to one file."""

    def __init__(self, uri: str):
        system, path = common.filesystem(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_END or not flags & 0x80:
            raise ValueError(f"no seek table at the end of {uri}")
        seek = size - 9 - 12 * n
        rows = [struct.unpack("<III", x) for x in _cut(self._at(seek, 12 * n), 12)]
        index = [struct.unpack("<qq", x) for x in _cut(self._at(seek - 8 - 16 * n, 16 * n), 16)]
        self.frames, at = [], 0
        for (packed, raw, check), (first, last) in zip(rows, index, strict=True):
            self.frames.append((at, packed, raw, check, first, last))
            at += packed

    def __enter__(self) -> Reader:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def _at(self, offset: int, n: int) -> bytes:
        return self.file.read_at(n, offset)

    def frame(self, i: int) -> Iterator[tuple[int, np.ndarray]]:
        """(doc_id, ids) of a frame, after its checksum holds."""
        at, packed, size, check, _, _ = self.frames[i]
        raw = zstandard.ZstdDecompressor().decompress(self._at(at, packed), max_output_size=size)
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"checksum of frame {i} does not hold")
        n, width = struct.unpack_from("<IB", raw)
        doc_ids = np.frombuffer(raw, "<i8", n, 5)
        lengths = np.frombuffer(raw, "<u4", n, 5 + 8 * n)
        ids = np.frombuffer(raw, f"<u{width}", -1, 5 + 12 * n)
        ends = np.cumsum(lengths, dtype=np.int64)
        for doc_id, end, length in zip(doc_ids.tolist(), ends.tolist(), lengths.tolist(), strict=True):
            yield doc_id, ids[end - length : end]

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        for i in range(len(self.frames)):
            yield from self.frame(i)

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The ids of the rows of one document; only the frames that may hold it are read."""
        return [ids for i, f in enumerate(self.frames) if f[4] <= doc_id <= f[5] for d, ids in self.frame(i) if d == doc_id]


def _cut(data: bytes, n: int) -> list[bytes]:
    return [data[i : i + n] for i in range(0, len(data), n)]


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2, frame_ids: int = 1 << 16, level: int = 3) -> DataFrame:
    """Writes the token ids of docs (doc_id, text) in ascending doc_id order and returns the manifest, a row a file.

    A task writes under a name of its own, and only the manifest says which files count: files of lost attempts are never read.
    """
    spark = docs.sparkSession
    rows = docs.select(common.id_order(docs["doc_id"]).alias("doc_id"), common.text_bytes(docs).alias("text")).withColumn("hash", F.xxhash64("text"))
    bounds = common.range_bounds(rows, "doc_id", common.text_ranges(docs, each=32 << 20))
    rows = rows.withColumn("bucket", common.range_bucket(F.col("doc_id"), F.col("hash"), bounds))
    rows = rows.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("doc_id", "hash").select("doc_id", "text", "bucket")
    end = np.array([end_id], "<u4")

    def run(batches):
        import uuid

        encode = bpe.encoder(vocabulary)
        wide = encode.library.get_vocab_size() > 1 << 16 or end_id >= 1 << 16
        made, now, writer, out = [], None, None, None

        def close():
            writer.close()
            out.close()
            made.append((now, name, writer.documents, writer.ids, writer.bytes))

        for batch in batches:
            for doc_id, text, bucket in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "bucket")), strict=True):
                if bucket != now:
                    if writer:
                        close()
                    now, name = bucket, f"{folder}/tokens-{bucket:06d}-{uuid.uuid4().hex}.tok.zst"
                    system, path = common.filesystem(name)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(path, compression=None)
                    writer = Writer(out, wide, frame_ids, level)
                writer.add(doc_id, np.concatenate([np.frombuffer(encode.ids(text), "<u4"), end]))
        if writer:
            close()
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*made, strict=True) if made else ((),) * 5, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["bucket", "file", "documents", "ids", "bytes"])

    manifest = f"{folder}/manifest"
    rows.mapInArrow(run, MANIFEST).write.parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids before it in all files), n_tokens, ids_crc32 (of uint32 ids) of each document, from the files alone."""
    files = manifest.orderBy("bucket").collect()  # a row a file
    base, rows = 0, []
    for f in files:
        rows.append((f["file"], base))
        base += f["ids"]
    if not rows:
        return common.empty(spark, "doc_id long, start long, n_tokens long, ids_crc32 long")

    def run(batches):
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out = ([], [], [], [])
                with Reader(name) as file:
                    for doc_id, ids in file.documents():
                        for column, value in zip(out, (None if doc_id == common.LONG_MIN else doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                            column.append(value)
                        start += len(ids)
                        if len(out[0]) >= 10_000:
                            yield pa.record_batch([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "n_tokens", "ids_crc32"])
                            out = ([], [], [], [])
                yield pa.record_batch([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(rows, "file string, start long").repartition(len(rows))
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
