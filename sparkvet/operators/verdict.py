"""Verdicts: the precedence of colours, reading flags, gray causes, lamps, levels and coverage, as column expressions and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Severity of a colour; green and gray are told apart by the reading.
SEVERITY = {"green": 0, "gray": 0, "orange": 1, "red": 2}

#: Codes of an incomplete reading, in the order in which they are named.
READING = ["compiled_files", "parse_errors", "skipped_files", "tools_missing", "calls_not_followed", "dynamic_descriptions", "network_not_followed"]

#: Lamps in order, each with the capabilities that light it and the red rules that make it red.
LAMPS = [
    ("files_read", ["fs_read"], []),
    ("files_write", ["fs_write"], ["R08"]),
    ("internet", ["network"], ["R04", "R05", "R07", "R10"]),
    ("commands", ["exec", "dynamic_code", "install_script", "docker_socket"], ["R07", "R09", "R10"]),
    ("secrets", ["env_read_secret", "sensitive_path"], ["R03", "R04"]),
    ("hidden_text", ["invisible_character"], ["R01", "R02", "R06", "R12", "R13"]),
]


def colour(severity: Column, incomplete: Column) -> Column:
    """red > orange > gray if the reading is incomplete > green."""
    return F.when(severity >= 2, "red").when(severity == 1, "orange").when(F.coalesce(incomplete, F.lit(False)), "gray").otherwise("green")


def gray_case(status_case: Column, reasons: Column) -> Column:
    """The status' own case, else the first reason, else nothing_analyzable."""
    return F.coalesce(status_case, F.when(F.size(reasons) > 0, F.element_at(reasons, 1)), F.lit("nothing_analyzable"))


def status_case(status: Column, error_code: Column, notes: Column) -> Column:
    """A failed analysis that ran out of time is a timeout; a link list is told apart from what is no server."""
    return (
        F.when((status == "error") & (error_code == "timeout"), "timeout")
        .when((status == "not_a_server") & F.coalesce(F.array_contains(notes, "link_list"), F.lit(False)), "link_list")
        .when(status != "ok", status)
    )


def reading_codes(flags: dict[str, Column]) -> Column:
    """The codes whose flag is true, in the order of READING."""
    return F.array_compact(F.array(*[F.when(F.coalesce(flags[c], F.lit(False)), c) for c in READING if c in flags]))


def level(red: Column, orange: Column) -> Column:
    return F.when(F.coalesce(red, F.lit(False)), "danger").when(F.coalesce(orange, F.lit(False)), "warn").otherwise("none")


def lamps(owners: DataFrame, findings: DataFrame, alerts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lamp, ord, state (off, on, danger), rules: six rows an owner.

    findings: keys, capability (`invisible_character` stands for one in a text); alerts: keys, rule, colour.
    """
    caps = findings.groupBy(*keys).agg(F.collect_set("capability").alias("__caps"))  # at most 12 values
    red = alerts.where("colour = 'red'").groupBy(*keys).agg(F.collect_set("rule").alias("__red"))  # at most 13
    base = owners.select(*keys).distinct().join(caps, keys, "left").join(red, keys, "left")
    none = F.array().cast("array<string>")
    caps_, red_ = F.coalesce("__caps", none), F.coalesce("__red", none)
    rows = []
    for i, (name, capabilities, rules) in enumerate(LAMPS):
        mine = F.sort_array(F.array_intersect(red_, F.array(*map(F.lit, rules)).cast("array<string>")))
        lit = F.arrays_overlap(caps_, F.array(*map(F.lit, capabilities)).cast("array<string>"))
        rows.append(F.struct(F.lit(name).alias("lamp"), F.lit(i).alias("ord"), F.when(F.size(mine) > 0, "danger").when(lit, "on").otherwise("off").alias("state"), mine.alias("rules")))
    return base.select(*keys, F.explode(F.array(*rows)).alias("x")).select(*keys, "x.*")


def verdicts(packages: DataFrame, alerts: DataFrame) -> DataFrame:
    """pkg, colour, reasons, gray_case of each package. packages: pkg, status, error_code, notes, reading (array of codes); alerts: pkg, colour.

    Gray never stands beside an alert; an orange verdict with an incomplete reading gets `coverage` as a reason.
    """
    worst = alerts.groupBy("pkg").agg(F.max(F.when(F.col("colour") == "red", 2).when(F.col("colour") == "orange", 1).otherwise(0)).alias("severity"))
    p = packages.join(worst, "pkg", "left").withColumn("severity", F.coalesce("severity", F.lit(0)))
    failed = status_case(F.col("status"), F.col("error_code"), F.col("notes"))
    incomplete = (F.size("reading") > 0) | failed.isNotNull()
    out = p.withColumn("colour", colour(F.col("severity"), incomplete))
    reasons = F.concat(F.array_compact(F.array(failed)), F.col("reading"), F.when((F.col("colour") == "orange") & incomplete, F.array(F.lit("coverage"))).otherwise(F.array().cast("array<string>")))
    return out.select("pkg", "colour", reasons.alias("reasons"), F.when(F.col("colour") == "gray", gray_case(failed, F.col("reading"))).alias("gray_case"))


def coverage(tools: DataFrame, files: DataFrame, items: DataFrame, first: int = 30) -> DataFrame:
    """pkg, tools_total, tools_followed, files_total, files_read, items (the first by ord), items_total."""
    t = tools.groupBy("pkg").agg(F.count("*").alias("tools_total"), F.count_if("followed").alias("tools_followed"))
    f = files.groupBy("pkg").agg(F.countDistinct("server", "file").alias("files_total"), F.countDistinct(F.when(F.col("read"), F.struct("server", "file"))).alias("files_read"))
    ranked = items.withColumn("k", F.row_number().over(Window.partitionBy("pkg").orderBy("ord")))
    n = ranked.groupBy("pkg").agg(F.count("*").alias("items_total"), F.transform(F.sort_array(F.collect_list(F.when(F.col("k") <= first, F.struct("k", "item")))), lambda x: x["item"]).alias("items"))
    return t.join(f, "pkg", "full").join(n, "pkg", "full")


def contacted_hosts(findings: DataFrame) -> DataFrame:
    """pkg, hosts (distinct, sorted), unknown (any request without a host); a package without requests has no row."""
    network = findings.where("capability = 'network' AND location_kind = 'server_code'")
    return network.groupBy("pkg").agg(F.sort_array(F.collect_set("url_host")).alias("hosts"), F.bool_or(F.col("url_host").isNull()).alias("unknown"))


def budget_reason(month: Column, day: Column, worst: int, month_limit: int, day_limit: int) -> Column:
    """Which budget the worst cost of one more call would break, the month's first; null if none."""
    return F.when(month + worst > month_limit, "month").when(day + worst > day_limit, "day")


def call_cost(input_tokens: Column, output_tokens: Column, input_price: int, output_price: int) -> Column:
    return input_tokens * input_price + output_tokens * output_price
