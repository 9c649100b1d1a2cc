"""The stages of corpus_pipeline: (spark, docs, sf_dir) -> DataFrame. All but the last keep the columns of docs, whatever their names.

Defined cases, for every stage: null text counts as empty; a null doc_id is a document like any other; of rows with the same doc_id and text the
dedup stage keeps one, and the others treat each alike; an empty table gives an empty table; empty labels leave the
first stage nothing to reject by and the third all rates of one domain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common, queries


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go."""
    from .toxicity import clean

    return clean(docs, common.table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each group stays; a group is linked by pairs whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more."""
    from .similar import first_of_similar

    return first_of_similar(docs, words=5, similarity=0.8)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or dropped at the rates that bring the quality domains to their target shares of tokens."""
    from .mixing import mixed

    return mixed(docs, queries.quality_domains(spark, sf_dir), queries.QUALITY_TARGETS, queries.tokenizer_path(queries.BYTE_BPE))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 1024 tokens."""
    from .packing import pack

    return pack(docs, queries.tokenizer_path(queries.BYTE_BPE), capacity=1024, end_id=2)
