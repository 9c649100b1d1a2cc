"""Queries of the service around the analyses: forms, translations, caches, reputation, file choice, routes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkvet.functions import paths
from sparkvet.functions import text as tx


def form_names(tools: DataFrame, longest: int = 40) -> DataFrame:
    """tools (pkg, ord, name) with form_name: plain characters, cut, and made unique by _2, _3 ... in order; greedy, so state a package."""
    schema = tools.schema.add("form_name", "string")
    parts = max(1, int(tools.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = tools.repartition(parts, "pkg").sortWithinPartitions("pkg", "ord")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        now, taken = None, set()
        for pdf in batches:
            names = []
            for pkg, ord_, name in zip(pdf["pkg"], pdf["ord"], pdf["name"], strict=True):
                if pkg != now:
                    now, taken = pkg, set()
                base = re.sub(r"[^A-Za-z0-9_.-]", "_", name or "")[:longest] or f"tool_{ord_}"
                new, k = base, 1
                while new in taken:
                    k += 1
                    new = f"{base[: longest - len(str(k)) - 1]}_{k}"
                taken.add(new)
                names.append(new)
            pdf["form_name"] = names
            yield pdf

    return dealt.mapInPandas(run, schema)


def lamp_booleans(lamps: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lit map<lamp, boolean>; danger counts as lit."""
    return lamps.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("lamp", (F.col("state") != "off").alias("lit"))))).alias("lit"))


def cited_domains(domains: DataFrame, most: int = 20) -> DataFrame:
    """pkg, domains: valid ones of server code, distinct, sorted, the first `most`."""
    valid = domains.where("location_kind = 'server_code'").where(F.col("domain").rlike(r"^(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}\z"))
    return valid.groupBy("pkg").agg(F.slice(F.sort_array(F.collect_set("domain")), 1, most).alias("domains"))


def content_key(*columns: str) -> Column:
    """SHA-256 of the columns as JSON, in name order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def within_budget(items: DataFrame, keys: list[str], text: str, ord_: str, budget: int = 12_000) -> DataFrame:
    """The items of each key up to the first that would exceed the budget of characters."""
    running = F.sum(F.length(text)).over(Window.partitionBy(*keys).orderBy(ord_).rowsBetween(Window.unboundedPreceding, 0))
    return items.withColumn("__sum", running).where(F.col("__sum") <= budget).drop("__sum")


def translation_problem(translated: Column, original: Column) -> Column:
    """too_long (over 3 times the original and 50), new_link (an address the original lacks), or null."""
    new = F.size(F.array_except(tx.urls(translated), tx.urls(original))) > 0
    return F.when(F.length(translated) > 3 * F.length(original) + 50, "too_long").when(new, "new_link")


def checked_translations(answers: DataFrame, items: DataFrame) -> DataFrame:
    """Answers (text_id, item, ord, translated) to known items (text_id, item, original): the first of each, with its problem."""
    known = answers.join(items, ["text_id", "item"])
    first = known.withColumn("__k", F.row_number().over(Window.partitionBy("text_id", "item").orderBy("ord"))).where("__k = 1").drop("__k")
    return first.withColumn("problem", translation_problem(F.col("translated"), F.col("original")))


def can_retry(status: Column, retry_at: Column, now: Column) -> Column:
    return status.isin("failed", "budget") & (retry_at.isNull() | (retry_at <= now))


def chosen_files(files: DataFrame) -> DataFrame:
    """files (pkg, ord, filename, kind, yanked): of those that aren't yanked a pure wheel, else a source archive, else a wheel; the first in order."""
    rank = F.when(paths.is_pure_wheel(F.col("filename")), 0).when(F.col("kind") == "sdist", 1).when(F.col("kind") == "bdist_wheel", 2)
    best = files.where(~F.coalesce("yanked", F.lit(False))).withColumn("__rank", rank).where("__rank IS NOT NULL")
    return best.groupBy("pkg").agg(F.min_by(F.struct("filename", "kind"), F.struct("__rank", "ord")).alias("x")).select("pkg", "x.*")


def routes(findings: DataFrame, most: int = 3) -> DataFrame:
    """The first `most` findings of each tool with different chains, in order."""
    one = findings.withColumn("__k", F.row_number().over(Window.partitionBy("pkg", "tool", "chain").orderBy("ord"))).where("__k = 1")
    return one.withColumn("__k", F.row_number().over(Window.partitionBy("pkg", "tool").orderBy("ord"))).where(F.col("__k") <= most).drop("__k")


def reputation(dependencies: DataFrame, records: DataFrame, published: DataFrame) -> DataFrame:
    """dependencies (pkg, name, version) ⟕ records (name, report, ranges boolean, versions array): report, all_versions, affects, cleared.

    A report with ranges from 0 and no end, or without versions, covers all versions; one whose versions the registry no longer serves is cleared.
    """
    hit = dependencies.join(records, "name")
    served = published.groupBy("name").agg(F.collect_set("version").alias("served"))
    out = hit.join(served, "name", "left").withColumn("all_versions", F.coalesce(F.col("ranges"), F.lit(False)) | (F.size(F.coalesce("versions", F.array().cast("array<string>"))) == 0))
    gone = F.size(F.array_intersect(F.coalesce("versions", F.array().cast("array<string>")), F.coalesce("served", F.array().cast("array<string>")))) == 0
    return out.select("pkg", "name", "version", "report", "all_versions", (F.col("all_versions") | F.array_contains("versions", F.col("version"))).alias("affects"), (~F.col("all_versions") & F.col("served").isNotNull() & gone).alias("cleared"))


def sha512_of(integrity: Column) -> Column:
    """The digest of the first sha512 entry of an integrity string, as bytes."""
    found = F.filter(F.split(F.trim(integrity), r"\s+"), lambda e: F.startswith(e, F.lit("sha512-")))
    return F.when(F.size(found) > 0, F.unbase64(F.substr(F.element_at(found, 1), F.lit(8))))
