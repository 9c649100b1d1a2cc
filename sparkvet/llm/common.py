"""Helpers shared by the operators of this folder: shared storage, ranges of a key, hot keys."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkvet.session import ensure_importable

LONG_MIN = -(1 << 63)
SLICE_ROWS = 1024  # rows of a batch that are handled together


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or one in the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
        if not spark.sparkContext.master.startswith("local") and (base.startswith("file:") or "://" not in base):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/llm-{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage and survives lost executors. path: a folder by `scratch`, for `remove`."""
    path = path or scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """The pyarrow file system of a URI (or plain path) and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def remove(path: str) -> None:
    """Removes a materialized table that nothing reads any more."""
    system, inside = filesystem(path)
    system.delete_dir(inside)


def drop_shuffles(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished queries, which it does when the driver collects its garbage; else they stay until it happens to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_bytes(df: DataFrame, column: str = "text") -> Column:
    """The column as UTF-8 bytes; null counts as empty."""
    return F.coalesce(df[column].cast("string"), F.lit("")).cast("binary")


def release() -> None:
    """Gives back what earlier tasks left in this worker, which Spark uses again for other stages: encoders with their caches, and freed memory."""
    from . import bpe

    bpe.forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def lean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices, for tasks without a tokenizer; the worker gives back memory before and after them."""
    release()
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)
        del batch
    release()


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def id_order(column: Column) -> Column:
    """Ids in ascending order, nulls first."""
    return F.coalesce(column.cast("long"), F.lit(LONG_MIN))


def text_ranges(docs: DataFrame, column: str = "text", each: int = 48 << 20) -> int:
    """Into how many ranges to deal texts: as many as shuffle partitions, and one more for each `each` bytes of text beyond them."""
    total = docs.agg(F.sum(F.octet_length(docs[column].cast("string")).cast("long"))).first()[0] or 0
    return max(partitions(docs.sparkSession), -(-total // each))


def range_bounds(df: DataFrame, column: str, n: int) -> list[tuple[int, int]]:
    """At most n - 1 ascending cut points (value, hash) that deal rows into ranges of about equal number. column: long, without nulls.

    A value that spans several cuts holds more rows than a range should; cuts at equal steps of the second number, a
    hash, spread its rows. One value a range reaches the driver. Any cut points are right: they are never assumed to be even.
    """
    if n < 2:
        return []
    found = df.approxQuantile(column, [i / n for i in range(1, n)], 1 / (8 * n))
    cuts: dict[int, int] = {}
    for x in found:
        x = max(LONG_MIN, min(int(x), -LONG_MIN - 1))
        cuts[x] = cuts.get(x, 0) + 1
    return [(x, LONG_MIN + (j << 64) // k) for x, k in sorted(cuts.items()) for j in range(k)]


def range_bucket(value: Column, hash_: Column, bounds: list[tuple[int, int]]) -> Column:
    """Number of bounds that are <= (value, hash), by binary search over an array of constants."""
    if not bounds:
        return F.lit(0)
    values, hashes = (F.split(F.lit(",".join(str(b[i]) for b in bounds)), ",").cast("array<long>") for i in (0, 1))
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]

    def search(at: Column, step: Column) -> Column:
        x, h = F.get(values, at + step - 1), F.get(hashes, at + step - 1)
        return F.when((x < value) | ((x == value) & (h <= hash_)), at + step).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), search)


def hot_keys(counts: DataFrame, key: str, n: str, share: int = 256) -> list:
    """Keys that hold over 1/share of all rows, so fewer than `share` of them, whatever the size of the table."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return [r[0] for r in counts.where((F.col(n) * share > total) & F.col(key).isNotNull()).select(key).collect()]


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: Column, hot: list, salts: int = 32, how: str = "left") -> DataFrame:
    """Equi-join in which the rows of hot keys are dealt over `salts` tasks: right rows of those keys are repeated, left rows take a salt from `spread`."""
    if not hot:
        return left.join(right, key, how)
    is_hot = lambda df: df[key].isin(hot)
    a = left.withColumn("__salt", F.when(is_hot(left), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
    b = right.withColumn("__salt", F.explode(F.when(is_hot(right), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return a.join(b, [key, "__salt"], how).drop("__salt")


def empty(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)
