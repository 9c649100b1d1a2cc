"""Facts of source files as a table: one row a fact (pkg, path, fact, name, detail, start, end, line, extra).

Files are independent, so this is a map over rows; what relates files is left to joins. The language follows from a file's name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkvet.functions import paths
from sparkvet.session import ensure_importable
from sparkvet.sources import javascript_facts, python_facts

FACT = "pkg string, path string, fact string, name string, detail string, start long, end long, line int, extra map<string,string>"
SOURCES = r"\.(?:py|[cm]?[jt]sx?)\z"


def reader_of(path: str) -> Callable[[str, str, bytes], list[tuple]]:
    return (python_facts if path.endswith(".py") else javascript_facts).facts_of


def extract(files: DataFrame, largest: int = 5_000_000) -> DataFrame:
    """Fact rows of the source files among files (pkg, path, content); a file over `largest` bytes is recorded, not read."""
    kept = files.where(F.col("path").rlike(SOURCES) & ~F.col("path").rlike(r"\.d\.[cm]?ts\z") & ~paths.is_ignored(F.col("path")))
    big = kept.where(F.octet_length("content") > largest).select("pkg", "path", F.lit("skipped").alias("fact"), F.lit("size").alias("name"), F.lit(None).cast("string").alias("detail"), F.lit(0).cast("long").alias("start"), F.octet_length("content").cast("long").alias("end"), F.lit(0).alias("line"), F.create_map().cast("map<string,string>").alias("extra"))

    ensure_importable(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in FACT.split(", ")]
        for pdf in batches:
            rows = [r for p, f, c in zip(pdf["pkg"], pdf["path"], pdf["content"], strict=True) for r in reader_of(f)(p, f, bytes(c))]
            yield pd.DataFrame(rows, columns=names)

    return kept.where(F.octet_length("content") <= largest).select("pkg", "path", "content").mapInPandas(run, FACT).unionByName(big)
