"""Archives as tables: tar, tar.gz and zip contents become (path, bytes) rows under budgets; what is refused is a row with an error."""

from __future__ import annotations

import io
import lzma
import struct
import stat
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTRY = "pkg string, path string, content binary, size long, error string"
DATA_ENDINGS = (".json", ".csv", ".txt", ".md", ".parquet", ".png", ".jpg", ".gif", ".svg", ".ipynb", ".sqlite", ".db")


@dataclass(frozen=True)
class Budget:
    entries: int = 10_000
    total: int = 200_000_000
    file: int = 5_000_000
    ratio: int = 100


def name_error(name: str) -> str | None:
    """Why an entry's name is refused."""
    if not name or "\0" in name or "\\" in name or name.startswith("/") or name[1:2] == ":" or ".." in name.split("/"):
        return "bad_path"
    return None


def _tar(data: bytes) -> Iterator[tuple[str, int, str | None, object]]:
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as tar:
        for m in tar:
            if m.isdir():
                continue
            error = "link" if m.issym() or m.islnk() else "special" if not m.isreg() or m.issparse() else None
            yield m.name, m.size, error, (lambda m=m: tar.extractfile(m))


def _zip(data: bytes) -> Iterator[tuple[str, int, str | None, object]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for m in z.infolist():
            if m.is_dir():
                continue
            error = "encrypted" if m.flag_bits & 1 else "link" if stat.S_ISLNK(m.external_attr >> 16) else None
            yield m.filename, m.file_size, error, (lambda m=m: z.open(m))


def entries(data: bytes, budget: Budget = Budget()) -> list[tuple[str, bytes | None, int, str | None]]:
    """(path, content, size, error) of each entry; a broken budget or archive ends with one row whose path is null."""
    out, total, seen = [], 0, set()
    try:
        for name, size, error, opened in _zip(data) if data[:2] == b"PK" else _tar(data):
            if len(out) >= budget.entries:
                return [*out, (None, None, 0, "too_many_entries")]
            error = name_error(name) or ("duplicate" if name in seen else None) or error
            seen.add(name)
            if error:
                out.append((name, None, size, error))
                continue
            with opened() as stream:
                head = stream.read(budget.file + 1)
            if len(head) > budget.file:
                skipped = name.lower().endswith(DATA_ENDINGS) and head[:4] not in (b"\x7fELF", b"\0asm")
                out.append((name, None, size, "skipped_large_data" if skipped else "too_large"))
                continue
            total += len(head)
            if total > budget.total:
                return [*out, (None, None, total, "total_too_large")]
            if total > budget.ratio * len(data):
                return [*out, (None, None, total, "ratio_too_high")]
            out.append((name, head, len(head), None))
    except (tarfile.TarError, zipfile.BadZipFile, zlib.error, lzma.LZMAError, struct.error, EOFError, OSError, ValueError, RuntimeError, NotImplementedError, MemoryError, IndexError) as e:
        out.append((None, None, 0, f"unreadable:{type(e).__name__}"))
    return out


def read(archives: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """ENTRY rows of archives (pkg, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for pkg, content in zip(pdf["pkg"], pdf["content"], strict=True):
                yield pd.DataFrame([(pkg, *e) for e in entries(bytes(content), budget)], columns=["pkg", "path", "content", "size", "error"])

    return archives.select("pkg", "content").mapInPandas(run, ENTRY)


def without_top_folder(files: DataFrame) -> DataFrame:
    """files (pkg, path, ...) less the top folder of packages that have just one."""
    top = F.split_part("path", F.lit("/"), F.lit(1))
    flat = F.bool_or(~F.contains("path", F.lit("/")))
    one = files.groupBy("pkg").agg((F.countDistinct(top).alias("n")), flat.alias("flat")).where("n = 1 AND NOT flat").select("pkg", F.lit(True).alias("__one"))
    return files.join(one, "pkg", "left").withColumn("path", F.when(F.col("__one"), F.substr("path", F.instr("path", "/") + 1)).otherwise(F.col("path"))).drop("__one")


def verified(jobs: DataFrame) -> DataFrame:
    """jobs (version, sha256, content, ...) with `error`: a version that isn't known, or a digest that doesn't hold."""
    return jobs.withColumn("error", F.when(F.col("version") != 1, "version").when(F.sha2("content", 256) != F.lower("sha256"), "digest"))
