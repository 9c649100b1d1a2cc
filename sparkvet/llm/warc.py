"""WARC archives with segmented records: writing, deduplicating by payload, reading and reassembling.

Writing: one gzip member a record; a response is an HTTP message in chunked framing. A record longer than `segment` bytes is cut: the
first part carries WARC-Segment-Number 1, continuation records follow with the first one's identifier
(WARC-Segment-Origin-ID), and the last names the total length. Of equal payloads of at least `smallest` bytes the one
with the largest page_id is a response, and the others are revisit records that refer to it.

Reading: records are streamed from each file; parts are grouped by origin and put in order of their number, wherever they stand; the total
length is verified, the chunked framing is decoded, and the payload is held against its digest.

Defined cases: null html counts as empty; a null page_id is written as "null" and read back as null, and never is the one referred to
while another page has the payload; rows that repeat the chosen page_id are all responses; an empty table gives no
file and no rows; other columns are ignored. A record that can't be put together has its `problem` set.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MANIFEST = "file string, records long, bytes long"
PART = "record_id string, type string, refers_to string, digest string, length long, origin string, number int, total long, block binary"
RECORD = "record_id string, type string, refers_to string, digest string, payload_bytes long, problem string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(data: bytes, size: int = 1 << 14) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (data[i : i + size] for i in range(0, len(data), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes:
    """The body of a message in chunked framing; extensions and trailers are passed over. ValueError if it's cut short."""
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        size = int(data[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if len(data) < at + size + 2:
            raise ValueError("chunk cut short")
        out.append(data[at : at + size])
        at += size + 2


def _record(kind: str, record_id: str, block: bytes, **fields: str | int | None) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": "2000-01-01T00:00:00Z"} | {k.replace("_", "-"): v for k, v in fields.items() if v is not None} | {"Content-Length": len(block)}
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def records(name: str, url: str, payload: bytes, refers_to: str | None, segment: int) -> Iterator[bytes]:
    """The gzip members of one page."""
    digest = "sha1:" + base32_sha1(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    fields = {"WARC_Target_URI": url, "WARC_Payload_Digest": digest, "Content_Type": "application/http;msgtype=response"}
    if refers_to is not None:
        block = http + b"Content-Length: %d\r\n\r\n" % len(payload)
        yield _record("revisit", name, block, **fields, WARC_Refers_To=f"<{refers_to}>", WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        return
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    if len(parts) == 1:
        yield _record("response", name, block, **fields)
        return
    yield _record("response", name, parts[0], **fields, WARC_Segment_Number=1)
    for i, part in enumerate(parts[1:], 2):
        yield _record("continuation", f"{name}:{i}", part, WARC_Segment_Origin_ID=f"<{name}>", WARC_Segment_Number=i, WARC_Segment_Total_Length=len(block) if i == len(parts) else None)


def write(pages: DataFrame, folder: str, smallest: int = 0, segment: int = 1 << 12, roll: int = 64 << 20) -> DataFrame:
    """Writes pages (page_id, url, html) into archives of about `roll` bytes and returns the manifest, a row a file.

    Only files in the manifest count, so those of lost attempts are never read. A payload that very many pages share is joined in salted parts.
    """
    spark = pages.sparkSession
    url = pages["url"].cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), url.alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("payload")))
    large = F.octet_length("payload") >= smallest
    winners = common.materialize(rows.where(large).groupBy("sha1").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")), "winners")
    hot = [bytes(x) for x in common.hot_keys(winners, "sha1", "n")]
    joined = common.salted_join(rows, winners.select("sha1", "winner"), "sha1", F.col("page_id"), hot)
    revisits = large & ~F.col("winner").eqNullSafe(F.col("page_id"))
    joined = joined.select("page_id", "url", "payload", F.when(revisits, F.col("winner")).alias("refers_to"))

    def run(batches):
        made, out, n, size = [], None, 0, 0
        for batch in batches:
            for page_id, link, payload, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"{folder}/pages-{uuid.uuid4().hex}.warc.gz"
                    system, path = common.filesystem(name)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    out, n, size = system.open_output_stream(path, compression=None), 0, 0
                key = f"urn:page:{'null' if page_id is None else page_id}:{uuid.uuid4().hex}"
                for member in records(key, "" if link is None else " ".join(link.split()), payload, None if target is None else f"urn:page:{target}", segment):
                    out.write(member)
                    n, size = n + 1, size + len(member)
                if size >= roll:
                    out.close()
                    made.append((name, n, size))
                    out = None
        if out is not None:
            out.close()
            made.append((name, n, size))
        yield pa.record_batch([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "records", "bytes"])

    manifest = f"{folder}/manifest"
    joined.mapInArrow(run, MANIFEST).write.parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


def stream(file, block: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of an open file, gzip members or plain; one record is held at a time."""
    pending = file.read(block)
    zipped = pending[:2] == b"\x1f\x8b"
    unzip, buffer = zlib.decompressobj(31), bytearray()

    def more() -> bool:
        nonlocal pending, unzip
        while True:
            if not pending:
                pending = file.read(block)
                if not pending:
                    return False
            if not zipped:
                buffer.extend(pending)
                pending = b""
                return True
            got = unzip.decompress(pending)
            pending = b""
            if unzip.eof:
                pending, unzip = unzip.unused_data, zlib.decompressobj(31)
            if got:
                buffer.extend(got)
                return True

    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                if buffer.strip():
                    raise ValueError("record head cut short")
                return
        lines = bytes(buffer[:end]).decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record starts with {lines[0][:20]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(headers["content-length"])
        while len(buffer) < end + 4 + length:
            if not more():
                raise ValueError("record cut short")
        body = bytes(buffer[end + 4 : end + 4 + length])
        del buffer[: end + 4 + length]
        while len(buffer) < 4 and more():
            pass
        if buffer[:4] == b"\r\n\r\n":
            del buffer[:4]
        yield headers, body


def payload_of(block: bytes) -> tuple[bytes, dict[str, str]]:
    """Body and headers of an HTTP message, chunked framing decoded."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("no HTTP head")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
    if headers.get("transfer-encoding", "").lower() == "chunked":
        body = unchunked(body)
    return body, headers


def _finished(kind: str, digest: str | None, block: bytes) -> tuple[int | None, str | None]:
    """(payload length, problem) of a whole record's block."""
    try:
        body, headers = payload_of(block)
    except ValueError as e:
        return None, str(e)
    if kind == "revisit":
        return int(headers["content-length"]) if "content-length" in headers else None, None
    if digest and base32_sha1(body) != digest:
        return len(body), "payload digest does not hold"
    return len(body), None


def read(spark: SparkSession, files: DataFrame) -> DataFrame:
    """RECORD rows of all response and revisit records in the files (column file); parts may stand in different files."""
    trim = lambda x: x and x.strip("<>")
    names = [x.split()[0] for x in PART.split(", ")]
    types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary())

    def scan(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, path = common.filesystem(uri)
                rows, size = [], 0
                with system.open_input_stream(path, compression=None) as file:
                    for headers, block in stream(file):
                        kind = headers.get("warc-type", "")
                        if kind not in ("response", "revisit", "continuation"):
                            continue
                        name, digest = trim(headers.get("warc-record-id")), (headers.get("warc-payload-digest") or "").removeprefix("sha1:") or None
                        if "warc-segment-number" in headers:
                            origin = trim(headers.get("warc-segment-origin-id")) or name
                            total = headers.get("warc-segment-total-length")
                            rows.append((name, kind, trim(headers.get("warc-refers-to")), digest, None, origin, int(headers["warc-segment-number"]), total and int(total), block))
                            size += len(block)
                        else:
                            length, problem = _finished(kind, digest, block)
                            rows.append((name, kind, trim(headers.get("warc-refers-to")), digest, length, name, 0, None, problem and problem.encode()))
                        if size > 8 << 20 or len(rows) >= 5000:
                            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)
                            rows, size = [], 0
                yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    def join(batches):
        """Parts of one origin stand together in order; only one record is put together at a time."""
        parts, out = [], []

        def assembled():
            first, last = parts[0], parts[-1]
            block = b"".join(p[8] for p in parts)
            if [p[6] for p in parts] != list(range(1, len(parts) + 1)):
                length, problem = None, "segments missing or repeated"
            elif last[7] is None or last[7] != len(block):
                length, problem = None, "total length does not hold"
            else:
                length, problem = _finished(first[1], first[3], block)
            return (first[5], first[1] if first[6] == 1 else "response", first[2], first[3], length, problem)

        def flush():
            return pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()))], [x.split()[0] for x in RECORD.split(", ")])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if parts and row[5] != parts[0][5]:
                    out.append(assembled())
                    parts = []
                if row[6] == 0:
                    out.append((row[0], row[1], row[2], row[3], row[4], row[8] and row[8].decode()))
                else:
                    parts.append(row)
            if len(out) >= 5000:
                yield flush()
                out = []
        if parts:
            out.append(assembled())
        yield flush()

    listed = files.select("file").repartition(max(1, min(files.count(), 4 * common.partitions(spark))))
    found = listed.mapInArrow(scan, PART)
    return found.repartition(common.partitions(spark), "origin").sortWithinPartitions("origin", "number").mapInArrow(join, RECORD)


def page_records(records_: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, problem of the records that `write` made."""
    number = lambda c: F.expr(f"try_cast(split_part({c}, ':', 3) as long)")
    return records_.select(number("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), number("refers_to").alias("refers_to"), "problem")
