"""Analytics over verdict records: summaries, comparison with a baseline, and what-if studies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLOURS = ["green", "orange", "red", "gray"]


def rule_counts(records: DataFrame, rules: str) -> DataFrame:
    """rule, n (records that have it), place by n descending, then name."""
    n = records.select(F.explode(F.array_distinct(rules)).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "rule")).cast("long"))  # one row a rule


def only_because(rules: Column, allowed: list[str]) -> Column:
    """Aggregate: how many records have no rule outside `allowed`."""
    return F.count_if(F.size(F.array_except(rules, F.array(*map(F.lit, allowed)))) == 0)


def colour_without(colour: Column, rules: Column, silent: list[str]) -> Column:
    """The colour once the rules of `silent` say nothing: red and gray stay, orange turns green if no rule is left."""
    left = F.filter(rules, lambda r: ~r.isin(silent))
    return F.when((colour == "orange") & (F.size(left) == 0), "green").otherwise(colour)


def colour_counts(records: DataFrame) -> DataFrame:
    """colour, n for each of the four colours, 0 included."""
    all_ = records.sparkSession.createDataFrame([(c,) for c in COLOURS], "colour string")
    n = records.groupBy("colour").agg(F.count("*").alias("n"))
    return F.broadcast(all_).join(n, "colour", "left").select("colour", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def summary(records: DataFrame) -> DataFrame:
    """One row: servers, each colour, and the clear share in whole tenths of a percent (rounded down, so engines agree)."""
    counts = [F.count_if(F.col("colour") == c).alias(c) for c in ("red", "orange", "green", "gray")]
    out = records.agg(F.count("*").alias("servers"), *counts)
    return out.withColumn("clear_tenths", F.when(F.col("servers") > 0, F.floor((F.col("servers") - F.col("gray")) * 1000 / F.col("servers")).cast("long")))


def compare(now: DataFrame, baseline: DataFrame) -> DataFrame:
    """id, was, now, change (new, removed, colour, version, same). Both: id, colour, version."""
    b = baseline.select("id", F.col("colour").alias("was"), F.col("version").alias("was_version"))
    both = now.select("id", F.col("colour").alias("now"), F.col("version").alias("now_version")).join(b, "id", "full")
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "colour").when(F.col("was_version") != F.col("now_version"), "version").otherwise("same")
    return both.select("id", "was", "now", change.alias("change"))


def gray_cause(case: Column, error_code: Column, detailed: list[str]) -> Column:
    """The case, with the error code behind a colon for the cases that have one."""
    return F.when(case.isin(detailed) & error_code.isNotNull(), F.concat_ws(":", case, error_code)).otherwise(case)


def verified_reds(now: DataFrame, baseline: DataFrame) -> DataFrame:
    """ids that are red in both, verified in the baseline, with the same red rules. Both: id, colour, rules; baseline: verified."""
    reds = lambda r: F.sort_array(F.filter(r, lambda x: x.startswith("R")))
    b = baseline.where("colour = 'red' AND verified").select("id", reds(F.col("rules")).alias("was"))
    return now.where("colour = 'red'").join(b, "id").where(reds(F.col("rules")) == F.col("was")).select("id")


def needs_caution(colour: Column, rules: Column, silent: list[str], lamps: Column, risky: list[str], most: int = 3) -> Column:
    """Would turn green though `most` lamps or more, or a risky one, are lit."""
    turns = (colour == "orange") & (colour_without(colour, rules, silent) == "green")
    return turns & ((F.size(lamps) >= most) | F.arrays_overlap(lamps, F.array(*map(F.lit, risky))))


def masked(records: DataFrame) -> DataFrame:
    """Names of red records that are not verified are masked, and those rows come last. records: id, colour, verified, version."""
    hide = (F.col("colour") == "red") & ~F.coalesce("verified", F.lit(False))
    return records.withColumn("masked", hide).withColumn("id", F.when(hide, "(masked)").otherwise(F.col("id"))).withColumn("version", F.when(~hide, F.col("version"))).orderBy("masked", "id")


def grade(expected: Column, accepted: Column, got: Column, missing: Column, extra: Column) -> Column:
    """OK, ACCEPTABLE or FAIL of a graded case; missing and extra are arrays of rules."""
    clean = (F.size(missing) == 0) & (F.size(extra) == 0)
    return F.when((got == expected) & clean, "OK").when(F.array_contains(accepted, got) & (F.size(missing) == 0), "ACCEPTABLE").otherwise("FAIL")
