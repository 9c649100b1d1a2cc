"""Mixing to target weights with soft domain memberships.

A classifier learned from every labelled text gives each document a posterior over domains. Rates r >= 0 are fitted so that the
expected tokens of each domain, sum of r * tokens * posterior, match the targets: projected gradient on the least squares
of the gaps, whitened by H = sum of tokens * posterior * posterior', from r = 1. Scaled by a document's tokens the step is one over the
largest curvature, so the gaps never grow. A document's rate follows from its posterior and the few gradients so far, so a step is one pass
that sums one number a domain; no rate is gathered. Passes end when the targets are met, or when a step moves nothing
any more (targets that no rates can meet); what was reached is part of the result.

A document's tokens are those that the tokenizer gives for its whole text, and one end. Texts are read twice: once those with a label, for
the classifier's counts, and once all of them, for tokens and the shares that posteriors follow from (see subword).

Defined cases: null text counts as empty (the end alone, rate of its posterior); a null doc_id takes part and stays null; repeated rows
take part once each, and rows with one doc_id but different texts are drawn apart; a document labelled twice has the greater label, and all its rows are learned from; null labels and labels of no document are passed over; domains that
no document can supply keep their gap; an empty table gives no rows; other columns are ignored by `rates` and kept by `mixed`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe, common, subword

COPY_ROWS = 256  # rows of a batch of copies


@dataclass(frozen=True)
class Domains:
    groups: subword.Groups
    weights: np.ndarray

    def posteriors(self, texts: list[bytes]) -> np.ndarray:
        return subword.probabilities(self.groups.shares(texts), self.weights)


def _draw(doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) for each document, by a hash."""
    return F.pmod(F.xxhash64(doc_id.cast("long"), text), F.lit(1 << 40)) / F.lit(float(1 << 40))


def features(docs: DataFrame, groups, vocabulary: str) -> DataFrame:
    """doc_id, tokens, shares array<double>, draw of every row. groups: a broadcast subword.Groups."""

    def run(batches):
        count = bpe.encoder(vocabulary).count
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = pa.array([count(t) + 1.0 for t in texts], pa.float64())
            yield pa.record_batch([batch.column(0), n, pa.array(list(groups.value.shares(texts)), pa.list_(pa.float64())), batch.column(2)], ["doc_id", "tokens", "shares", "draw"])

    text = common.text_bytes(docs)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), _draw(docs["doc_id"], text).alias("draw"))
    return rows.mapInArrow(run, "doc_id long, tokens double, shares array<double>, draw double")


def fit_domains(docs: DataFrame, labels: DataFrame, domains: int, vocabulary: str) -> tuple[DataFrame, Domains]:
    """(doc_id, tokens, posterior, draw of every row, the classifier). labels: doc_id, label (domain number). vocabulary: file of the tokenizer whose tokens are mixed."""
    labels = subword.one_label(labels, domains)
    groups = subword.grouped(docs, labels, domains, sizes=(4, 5))
    table = common.materialize(features(docs, docs.sparkSession.sparkContext.broadcast(groups), vocabulary), "features")
    weights = subword.fit_weights(common.materialize(table.join(labels, "doc_id").select("label", "shares"), "labelled"), groups)

    def run(batches):
        for batch in batches:
            p = subword.probabilities(subword.vectors(batch.column(2), batch.num_rows), weights) if batch.num_rows else []
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(list(p), pa.list_(pa.float64())), batch.column(3)], ["doc_id", "tokens", "posterior", "draw"])

    rated = table.mapInArrow(run, "doc_id long, tokens double, posterior array<double>, draw double")
    return common.materialize(rated, "posteriors"), Domains(groups, weights)


def rate(posterior: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates after the given gradient steps, each projected onto r >= 0."""
    r = np.ones(len(posterior))
    for g in steps:
        r = np.maximum(0.0, r - posterior @ g)
    return r


def _posteriors(batch) -> np.ndarray:
    return subword.vectors(batch.column("posterior"), batch.num_rows)


def _sums(table: DataFrame, domains: int, steps: list[np.ndarray]) -> np.ndarray:
    """[expected tokens of each domain at the rates of steps, then H row by row]; each task sends one row."""

    def run(batches):
        total = np.zeros(domains * (domains + 1))
        for batch in batches:
            if batch.num_rows:
                p, n = _posteriors(batch), batch.column("tokens").to_numpy().astype(float)
                total += np.concatenate([(rate(p, steps) * n) @ p, ((p * n[:, None]).T @ p).ravel()])
        yield pa.record_batch([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "x"])

    rows = table.select("tokens", "posterior").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x")).collect()
    out = np.zeros(domains * (domains + 1))
    for i, x in rows:
        out[i] = x
    return out


@dataclass(frozen=True)
class Fit:
    steps: list[np.ndarray]
    wanted: np.ndarray  # tokens of each domain
    reached: np.ndarray  # expected tokens of each domain at the rates
    settled: bool  # the targets are met, or no step brings them nearer


def fit_rates(table: DataFrame, targets: list[float], most_steps: int = 100, tolerance: float = 1e-6) -> Fit:
    """The gradient steps that bring the expected tokens to targets (shares of the tokens there are). table: tokens, posterior."""
    k = len(targets)
    share = np.maximum(np.asarray(targets, float), 0)
    share = share / share.sum()
    steps: list[np.ndarray] = []
    inverse = before = None
    settled = False
    for left in range(most_steps, -1, -1):
        sums = _sums(table, k, steps)
        if inverse is None:
            start = sums[:k].sum()
            inverse = np.linalg.pinv(sums[k:].reshape(k, k), rcond=1e-9)
        gap = sums[:k] - share * start
        allowed = tolerance * max(1.0, start)
        settled = np.abs(gap).max() <= allowed or (before is not None and np.abs(sums[:k] - before).max() <= allowed / 10)
        if settled or not left:
            break
        before = sums[:k]
        steps.append(inverse @ gap)
    return Fit(steps, share * start, sums[:k], bool(settled))


def _copies(rates_: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """The whole part of each rate, and one more with the probability of the rest."""
    whole = np.floor(rates_)
    return (whole + (draws < rates_ - whole)).astype(np.int64)


def rates(docs: DataFrame, labels: DataFrame, targets: list[float], vocabulary: str) -> DataFrame:
    """doc_id, tokens, posterior, rate, copies of every row, and for all rows alike: wanted and reached (tokens of each domain) and settled.

    labels: doc_id, label; targets: a share for each label.
    """
    table, _ = fit_domains(docs, labels, len(targets), vocabulary)
    fit = fit_rates(table, targets)

    def run(batches):
        for batch in batches:
            r = rate(_posteriors(batch), fit.steps) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(r), pa.array(_copies(r, batch.column(3).to_numpy()))], names=["doc_id", "tokens", "posterior", "rate", "copies"])

    rated = table.mapInArrow(run, "doc_id long, tokens double, posterior array<double>, rate double, copies long")
    totals = lambda x: F.array(*[F.lit(float(v)) for v in x])
    return rated.withColumns({"wanted": totals(fit.wanted), "reached": totals(fit.reached), "settled": F.lit(fit.settled)})


def mixed(docs: DataFrame, labels: DataFrame, targets: list[float], vocabulary: str) -> DataFrame:
    """The rows of docs, all columns, each as often as its copies say."""
    table, domains = fit_domains(docs, labels, len(targets), vocabulary)
    fit, domains = fit_rates(table, targets), docs.sparkSession.sparkContext.broadcast(domains)
    text = common.text_bytes(docs)
    rows = docs.select(F.struct("*").alias("row"), text.alias("text"), _draw(docs["doc_id"], text).alias("draw"))

    def run(batches):
        for batch in batches:
            copies = _copies(rate(domains.value.posteriors(batch.column(1).to_pylist()), fit.steps), batch.column(2).to_numpy())
            ends = np.cumsum(copies)
            for a in range(0, int(ends[-1]) if len(ends) else 0, COPY_ROWS):  # a large rate makes many batches, not a large one
                places = np.searchsorted(ends, np.arange(a, min(a + COPY_ROWS, ends[-1])), side="right")
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places))], names=["row"])

    return rows.mapInArrow(run, rows.select("row").schema).select("row.*")
