"""What a report shows: alerts by colour and tool, the tool to open, places, domains, lamp and character counts, install reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def of_colour(alerts: DataFrame, colour: str) -> DataFrame:
    return alerts.where(F.col("colour") == colour)


def of_tools(alerts: DataFrame, tools: DataFrame) -> DataFrame:
    """Alerts of tools that are listed. Both: pkg, tool."""
    return alerts.join(tools.select("pkg", "tool").distinct(), ["pkg", "tool"], "left_semi")


def outside_tools(alerts: DataFrame, tools: DataFrame) -> DataFrame:
    """Alerts without a tool, or of one that isn't listed."""
    return alerts.join(tools.select("pkg", "tool").distinct(), ["pkg", "tool"], "left_anti")


def default_tool(tools: DataFrame, alerts: DataFrame) -> DataFrame:
    """pkg, index of the tool to show first: that of the first alert (by ord) with a listed tool, else the first at danger, else at warn, else 0.

    tools: pkg, tool, index, level; of tools of one name the first counts.
    """
    named = tools.groupBy("pkg", "tool").agg(F.min("index").alias("__i"))
    hit = alerts.join(named, ["pkg", "tool"]).groupBy("pkg").agg(F.min_by("__i", "ord").alias("__alert"))
    at = lambda level: F.min(F.when(F.col("level") == level, F.col("index")))
    levels = tools.groupBy("pkg").agg(at("danger").alias("__danger"), at("warn").alias("__warn"))
    return levels.join(hit, "pkg", "left").select("pkg", F.coalesce("__alert", "__danger", "__warn", F.lit(0)).alias("index"))


def place_text(function, file, line):
    """function() and file:line, each as far as it is known."""
    where = F.when(line.isNull(), file).otherwise(F.concat(file, F.lit(":"), line.cast("string")))
    return F.when(function.isNull() | (function == ""), where).otherwise(F.concat(function, F.lit("() · "), where))


def places(findings: DataFrame, limit: int) -> DataFrame:
    """pkg, tool, places (the first `limit` different ones in order), more. findings: pkg, tool, ord, function, file, line, location_kind."""
    own = findings.where("location_kind = 'server_code'").withColumn("__place", place_text(F.col("function"), F.col("file"), F.col("line")))
    one = own.groupBy("pkg", "tool", "__place").agg(F.min("ord").alias("__ord"))
    ranked = one.withColumn("__k", F.row_number().over(Window.partitionBy("pkg", "tool").orderBy("__ord", "__place")))
    kept = F.sort_array(F.collect_list(F.when(F.col("__k") <= limit, F.struct("__k", "__place"))))  # at most `limit`
    return ranked.groupBy("pkg", "tool").agg(F.transform(kept, lambda x: x["__place"]).alias("places"), F.greatest(F.lit(0), F.count("*") - limit).cast("long").alias("more"))


def code_domains(domains: DataFrame) -> DataFrame:
    """pkg, domain: those of server code, each once."""
    return domains.where("location_kind = 'server_code'").select("pkg", "domain").distinct()


def lamp_counts(lamps: DataFrame) -> DataFrame:
    """pkg, danger, on, off: how many lamps are in each state."""
    return lamps.groupBy("pkg").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("danger", "on", "off")])


def character_counts(characters: DataFrame) -> DataFrame:
    """pkg, label, n of the hidden characters in server code."""
    return characters.where("location_kind = 'server_code'").groupBy("pkg", "label").agg(F.count("*").alias("n"))


#: Capabilities that an installer's reads are named by, in order.
INSTALL_READS = ["env_read_secret", "env_read", "fs_read", "exec"]


def install_reads(findings: DataFrame) -> DataFrame:
    """pkg, ord, detail: what install-time code reads, each once, by capability, file, line."""
    rank = F.array_position(F.array(*map(F.lit, INSTALL_READS)), F.col("capability"))
    read = findings.where("tool IS NULL AND at_install AND detail IS NOT NULL AND detail <> ''").withColumn("__rank", rank).where("__rank > 0")
    first = read.groupBy("pkg", "detail").agg(F.min(F.struct("__rank", "file", "line")).alias("__at"))
    return first.select("pkg", F.row_number().over(Window.partitionBy("pkg").orderBy("__at", "detail")).alias("ord"), "detail")


def written_domains(domains: DataFrame) -> DataFrame:
    """pkg, file, ord, domain: those written in each server file, each once, by line."""
    first = domains.where("location_kind = 'server_code'").groupBy("pkg", "file", "domain").agg(F.min("line").alias("__line"))
    return first.select("pkg", "file", F.row_number().over(Window.partitionBy("pkg", "file").orderBy("__line", "domain")).alias("ord"), "domain")


def internet_domains(findings: DataFrame) -> DataFrame:
    """pkg, domains: sorted hosts of the requests of server code; null if one of them is unknown. Packages without requests have no row."""
    calls = findings.where("capability = 'network' AND location_kind = 'server_code'").groupBy("pkg")
    return calls.agg(F.when(F.bool_and(F.col("url_host").isNotNull()), F.sort_array(F.collect_set("url_host"))).alias("domains"))


def representative(findings: DataFrame, n: int = 1) -> DataFrame:
    """The n findings of each tool that explain it best: short chains first, then those whose address is known, then in order."""
    rank = Window.partitionBy("pkg", "tool").orderBy("steps", F.when(F.col("url_kind") == "unknown", 1).otherwise(0), "ord")
    return findings.withColumn("__k", F.row_number().over(rank)).where(F.col("__k") <= n).drop("__k")


def gap_places(gaps: DataFrame, most: int = 20) -> DataFrame:
    """pkg, tool, file, line, gap, ord: each once, sorted, the first `most` of a tool."""
    one = gaps.select("pkg", "tool", "file", "line", "gap").distinct()
    return one.withColumn("ord", F.row_number().over(Window.partitionBy("pkg", "tool").orderBy("file", "line", "gap"))).where(F.col("ord") <= most)


def dominant_language(files: DataFrame) -> DataFrame:
    """pkg, language: the most frequent one of the files that are no tests; of equals the one met first. files: pkg, ord, language, is_test."""
    n = files.where("language IS NOT NULL AND NOT is_test").groupBy("pkg", "language").agg(F.count("*").alias("n"), F.min("ord").alias("met"))
    return n.groupBy("pkg").agg(F.max_by("language", F.struct("n", -F.col("met"))).alias("language"))


def agreement(links: DataFrame) -> DataFrame:
    """request, code: whether the links of a package's metadata name the repository and folder of the request.

    links: request, owner, repo, subdir, link_owner, link_repo, link_folder; a request without links has one row of null link_owner.
    """
    same = (F.lower("link_owner") == F.lower("owner")) & (F.lower("link_repo") == F.lower("repo"))
    folder = lambda c: F.coalesce(F.regexp_replace(c, r"^(?:\./)+|/+$", ""), F.lit(""))
    there = same & F.col("link_folder").isNotNull()
    found = links.groupBy("request").agg(F.bool_or(F.col("link_owner").isNotNull()).alias("any"), F.bool_or(F.coalesce(same, F.lit(False))).alias("same"), F.bool_or(F.coalesce(there, F.lit(False))).alias("located"), F.bool_or(F.coalesce(there & (folder(F.col("link_folder")) == folder(F.col("subdir"))), F.lit(False))).alias("inside"))
    code = F.when(~F.col("any"), "package_without_repository").when(~F.col("same"), "package_repository_mismatch").when(~F.col("located"), "published_matches_repository").when(F.col("inside"), "published_matches_directory").otherwise("package_directory_mismatch")
    return found.select("request", code.alias("code"))
