"""A corpus pipeline of four stages; each reads what its predecessor wrote as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkvet.llm import common
from sparkvet.llm import stages

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("simhash near-dedup", stages.drop_near_copies),
    ("mixing to target weights", stages.mix_to_targets),
    ("best-fit packing", stages.pack_sequences),
]

#: Two stages apply fitted models and one a tokenizer, which SQL cannot express; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), "stage")
    return docs
