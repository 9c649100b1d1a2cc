"""Toxicity scores of whole texts by the subword model of this folder.

The model is fitted on all rows that have a label and are not held out, whole texts. Scores depend on the text alone.

Defined cases: null text counts as empty and gets the score of the bias; a null doc_id is not held out; a null label is no label; a
document labelled twice counts as toxic if any label says so, and all its rows are learned from; without texts of both classes every score is
the share of toxic ones (within a millionth of 0 or 1; a half without any); repeated rows are scored once each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, subword


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id as text, modulo folds; null stays null."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5) -> subword.Model:
    """Learns `toxic` of labels (doc_id, toxic) from the rows whose remainder is not 0."""
    learned = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("label")).where(remainder(F.col("doc_id"), folds) != 0)
    learned = subword.one_label(learned, 2)
    groups = subword.grouped(docs, learned, 2)
    shared = docs.sparkSession.sparkContext.broadcast(groups)

    def run(batches):
        for batch in common.lean(batches):
            yield pa.record_batch([batch.column(0), pa.array(list(shared.value.shares(batch.column(1).to_pylist())), pa.list_(pa.float64()))], ["doc_id", "shares"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.text_bytes(docs).alias("text")).where("doc_id IS NOT NULL")
    shares = rows.mapInArrow(run, "doc_id long, shares array<double>")
    return subword.linear(groups, subword.fit_weights(common.materialize(shares.join(learned, "doc_id").select("label", "shares"), "labelled"), groups))


def score(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5) of every row of docs (doc_id, text)."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, folds))  # 2 ** 18 float32 whatever the input

    def run(batches):
        for batch in common.lean(batches):
            p = model.value.probabilities(batch.column(2).to_pylist())[:, 1]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(remainder(docs["doc_id"], folds) == 0, F.lit(False)).alias("held_out"), common.text_bytes(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def clean(docs: DataFrame, labels: DataFrame, folds: int = 5, limit: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score is below the limit."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, folds))
    rows = docs.select(F.struct("*").alias("row"), common.text_bytes(docs).alias("text"))

    def run(batches):
        for batch in common.lean(batches):
            kept = model.value.probabilities(batch.column(1).to_pylist())[:, 1] < limit
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(kept))], names=["row"])

    return rows.mapInArrow(run, rows.select("row").schema).select("row.*")
