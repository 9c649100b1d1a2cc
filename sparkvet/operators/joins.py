"""Joins without a built-in counterpart, as DataFrame compositions: containment, glob tables, prefixes, as-of."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def innermost(points: DataFrame, spans: DataFrame, keys: list[str], point: str, start: str, end: str, order: str, width: int = 4096) -> DataFrame:
    """points with the smallest span of the same keys with start <= point < end (ties: least `order`); points in no span are left out.

    Spans are spread over buckets of `width` positions, so the join is an equi-join on keys and bucket.
    """
    a = points.select(*keys, point).distinct().withColumn("__bin", F.floor(F.col(point) / width))  # equal places share their span
    b = spans.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)))).where(F.col(end) > F.col(start))
    hit = a.join(b, [*keys, "__bin"]).where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end)))
    chosen = [c for c in spans.columns if c not in keys]
    best = hit.groupBy(*keys, point).agg(F.min_by(F.struct(*chosen), F.struct(F.col(end) - F.col(start), F.col(order))).alias("__span"))
    return points.join(best, [*keys, point]).select("*", "__span.*").drop("__span")


def glob_pattern(glob: str) -> str:
    """A glob with * and ? as a regular expression for the whole text."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + r"\z"


def first_rule(rows: DataFrame, name: str, rules: list[tuple[str, str]]) -> DataFrame:
    """rows with `rule_ord` and `rule_value` of the first (glob, value) that matches the name; others null.

    The table is closed and small, so it becomes one ordered CASE; exact patterns compare, only globs use expressions.
    """
    ord_, value = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i in reversed(range(len(rules))):
        glob, v = rules[i]
        hit = F.col(name).rlike(glob_pattern(glob)) if re.search(r"[*?]", glob) else F.col(name) == glob
        ord_, value = F.when(hit, F.lit(i)).otherwise(ord_), F.when(hit, F.lit(v)).otherwise(value)
    return rows.withColumn("rule_ord", ord_).withColumn("rule_value", value)


def prefixes(name: Column, separator: str = ".") -> Column:
    """All prefixes of a dotted name that end before a separator, and the name itself."""
    parts = F.split(name, re.escape(separator))
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), separator))


def longest_prefix(rows: DataFrame, name: str, known: DataFrame, key: str, separator: str = ".") -> DataFrame:
    """rows with the longest value of known[key] that is the name or a prefix of it at a separator; null without one.

    Prefixes are exploded once for each different name and joined by equality.
    """
    names = rows.select(F.col(name).alias("__name")).where(F.col("__name").isNotNull()).distinct()
    found = names.withColumn("__prefix", F.explode(prefixes(F.col("__name"), separator)))
    found = found.join(known.select(F.col(key).alias("__prefix")).distinct(), "__prefix", "left_semi")
    best = found.groupBy("__name").agg(F.max_by("__prefix", F.length("__prefix")).alias("longest"))
    return rows.join(best, rows[name] == best["__name"], "left").drop("__name")


def without_prefix(known: DataFrame, key: str, rows: DataFrame, name: str, separator: str = ".") -> DataFrame:
    """Rows of known whose key is neither a name of rows nor a prefix of one at a separator."""
    covered = rows.where(F.col(name).isNotNull()).select(F.explode(prefixes(F.col(name), separator)).alias("__prefix")).distinct()
    return known.join(covered, known[key] == covered["__prefix"], "left_anti")


def as_of_backward(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: list[str], ties: str) -> DataFrame:
    """left with the `value` columns of the last right row of the same keys at or before `at` (of equal times the least `ties`).

    Both sides are put in one order, and the last right row is carried forward, so nothing is compared pairwise.
    """
    # a right row comes before the left rows of its time; of equal right rows the one with the least tie comes last
    a = left.withColumns({"__side": F.lit(1), "__tie": F.lit(None).cast("long")} | {f"__v_{c}": F.lit(None).cast(right.schema[c].dataType) for c in value})
    b = right.select(*keys, at, *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in (*keys, at)], F.lit(0).alias("__side"), F.col(ties).cast("long").alias("__tie"), *[F.col(c).alias(f"__v_{c}") for c in value])
    order = Window.partitionBy(*keys).orderBy(at, "__side", F.desc_nulls_last("__tie")).rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumns({f"asof_{c}": F.last(F.when(F.col("__side") == 0, F.struct(f"__v_{c}")), ignorenulls=True).over(order)[f"__v_{c}"] for c in value})
    return both.where("__side = 1").select(*left.columns, *[f"asof_{c}" for c in value])


def with_next(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """rows with next_<value> of the row that follows in order, so that each opens a region which the next one ends."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumns({f"next_{v}": F.lead(v).over(w) for v in values})


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, and the order columns of the first row of each key."""
    return rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias("__x")).select(*keys, "__x.*")
