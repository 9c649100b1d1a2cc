"""The 25 rules: each a function of the fact views that returns alert rows; a registry runs them in order as one union.

Views (columns that rules read):
tools(pkg, tool, ord, name, description, title, parameters array<struct<name, description>>, read_only string, open_world string, location_kind)
findings(pkg, tool, ord, capability, detail, file, line, location_kind, url_kind, url_host, has_address, fixed_site, sends, shared, outside, unused_library, at_install, plain)
flows(pkg, tool, ord, source, sink, kinds, path_kinds, pasted, role, written, file, line, steps, files)
copy_recipients(pkg, address, file, line, location_kind), install_scripts(pkg, file, command, downloads), install_commands(pkg, files)
reputation(pkg, name, dependency, report, all_versions, cleared), invisible(pkg, file, line, category, location_kind, in_description)
text_matches(pkg, tool, quote, file, line), strings(pkg, text, file, line, location_kind), sensitive_paths(pkg, file, line, kind, match)
tool is null outside of tools.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkvet.functions import text as tx

Views = dict[str, DataFrame]
#: Capabilities that are worth an alert of their own.
POWERFUL = ["exec", "fs_write", "env_read_secret", "dynamic_code", "sensitive_path", "install_script", "docker_socket"]
ALERT = ["pkg", "rule", "colour", "kind", "tool", "file", "line", "quote", "detail", "rule_ord", "ord"]


class Registry:
    """Rules by name, in the order in which they were added; a name can't be taken twice."""

    def __init__(self):
        self.rules: dict[str, tuple[str, str, Callable[[Views], DataFrame]]] = {}

    def add(self, name: str, colour: str, kind: str = "behaviour"):
        def register(f):
            if name in self.rules:
                raise ValueError(f"rule {name} is there already")
            self.rules[name] = (colour, kind, f)
            return f

        return register

    def alerts(self, views: Views, only: list[str] | None = None) -> DataFrame:
        """Alert rows of all rules, or of some; order by severity descending, rule_ord, ord for display."""
        found = []
        for i, (name, (colour, kind, f)) in enumerate(self.rules.items()):
            if only is not None and name not in only:
                continue
            rows = f(views)
            missing = {c: F.lit(None).cast(t) for c, t in (("tool", "string"), ("file", "string"), ("line", "int"), ("quote", "string"), ("detail", "string")) if c not in rows.columns}
            rows = rows.withColumns(missing | ({} if "ord" in rows.columns else {"ord": F.lit(0)}))
            found.append(rows.select("pkg", F.lit(name).alias("rule"), F.lit(colour).alias("colour"), F.lit(kind).alias("kind"), "tool", "file", F.col("line").cast("int").alias("line"), F.substring("quote", 1, 200).alias("quote"), "detail", F.lit(i).alias("rule_ord"), F.col("ord").cast("int").alias("ord")))
        return reduce(DataFrame.unionByName, found)


RULES = Registry()


def tool_texts(v: Views, names: bool = False) -> DataFrame:
    """pkg, tool, ord, field, text, parameter, parameters: a row for each text of a tool."""
    t = v["tools"]
    p = F.coalesce("parameters", F.array().cast(t.schema["parameters"].dataType))
    rows = F.concat(
        *([F.array(F.struct(F.lit("name").alias("field"), F.col("name").alias("text"), F.lit(None).cast("string").alias("parameter")))] if names else []),
        F.array(F.struct(F.lit("description").alias("field"), F.col("description").alias("text"), F.lit(None).cast("string").alias("parameter")), F.struct(F.lit("title").alias("field"), F.col("title").alias("text"), F.lit(None).cast("string").alias("parameter"))),
        F.transform(p, lambda x: F.struct(F.lit("parameter").alias("field"), x["description"].alias("text"), x["name"].alias("parameter"))),
    )
    return t.select("pkg", "tool", "ord", F.transform(p, lambda x: x["name"]).alias("parameters"), F.explode(rows).alias("x")).select("pkg", "tool", "ord", "parameters", "x.*").where(F.col("text").isNotNull())


def server(df: DataFrame) -> DataFrame:
    return df.where("location_kind = 'server_code'")


def flows_to(v: Views, sources: list[str], sinks: list[str]) -> DataFrame:
    return v["flows"].where(F.col("source").isin(sources) & F.col("sink").isin(sinks))


def first(df: DataFrame, *keys: str) -> DataFrame:
    """The first row of each key by ord."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy("pkg", *keys).orderBy("ord", "file", "line"))).where("__k = 1").drop("__k")


def tampering(v: Views) -> DataFrame:
    """Flows into paths that start programs or configure clients, with whether an installer of the package does it."""
    f = v["flows"].where((F.col("role") == "path") & F.arrays_overlap("path_kinds", F.array(F.lit("autostart"), F.lit("tool_config"))))
    by = v["install_commands"].select("pkg", F.col("files").alias("__files"))
    return f.join(by, "pkg", "left").withColumn("__installer", F.coalesce(F.arrays_overlap("files", "__files"), F.lit(False))).drop("__files")


def silences(v: Views) -> DataFrame:
    return tool_texts(v).withColumn("quote", tx.silence_request(F.col("text"))).where("quote != ''").withColumn("__serious", tx.silenced_sensitive_action(F.col("text")))


def path_mentions(v: Views) -> DataFrame:
    found = tool_texts(v).withColumn("__paths", tx.sensitive_paths(F.col("text"))).where(F.size("__paths") > 0)
    return found.withColumn("detail", F.element_at("__paths", 1)["match"]).withColumn("quote", tx.transmit_request(F.col("text"), F.col("parameters")))


def blocks(v: Views) -> DataFrame:
    """Hidden blocks of tool texts, with whether they carry a signal of their own."""
    b = tool_texts(v).withColumn("quote", F.explode(tx.directive_blocks(F.col("text"))))
    signal = (F.size(tx.sensitive_paths(F.col("quote"))) > 0) | (tx.silence_request(F.col("quote")) != "") | tx.transmit_request(F.col("quote"), F.col("parameters")).isNotNull()
    return b.withColumn("__signal", F.coalesce(signal, F.lit(False)))


def downloads(v: Views) -> DataFrame:
    return v["install_scripts"].where("downloads").withColumn("__host", tx.plain_download(F.col("command"))).withColumnRenamed("command", "quote")


def install_requests(v: Views) -> DataFrame:
    return v["findings"].where("at_install AND capability = 'network'").withColumn("__plain", F.coalesce(F.col("plain") & F.col("url_host").isNotNull(), F.lit(False)))


@RULES.add("R01", "red")
def invisible_text(v):
    inside = tool_texts(v, names=True).where(tx.hidden_red(F.col("text"))).select("pkg", "tool", F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"), F.col("field").alias("detail"), "ord")
    code = server(v["invisible"]).where("category = 'bidi' AND NOT in_description").select("pkg", F.lit(None).cast("string").alias("tool"), "file", "line", F.lit("bidi").alias("detail"), F.lit(0).alias("ord"))
    return inside.unionByName(code)


@RULES.add("R02", "red")
def asks_for_silence(v):
    return silences(v).where("__serious")


@RULES.add("R03", "red")
def asks_for_sensitive_file(v):
    return path_mentions(v).where("quote IS NOT NULL")


@RULES.add("R04", "red")
def leaks_secrets(v):
    f = flows_to(v, ["sensitive_file", "environment"], ["network"])
    return f.where((F.col("source") == "environment") | F.coalesce(F.array_contains("kinds", "secret"), F.lit(False))).withColumn("detail", F.col("source"))


@RULES.add("R05", "red")
def hidden_copy(v):
    return server(v["copy_recipients"]).withColumn("detail", F.col("address"))


@RULES.add("R06", "red")
def hidden_code(v):
    f = flows_to(v, ["encoded_literal"], ["code", "shell", "process", "run_file"])
    return f.where((F.col("sink") != "run_file") | F.coalesce("written", F.lit(False))).withColumn("detail", F.col("sink"))


@RULES.add("R07", "red")
def download_and_run(v):
    f = flows_to(v, ["network_response"], ["code", "shell", "run_file"]).where((F.col("sink") != "run_file") | F.coalesce("written", F.lit(False)))
    piped = server(v["strings"]).where(tx.pipes_to_shell(F.col("text")))
    return f.select("pkg", "tool", "file", "line", F.col("sink").alias("detail"), "ord").unionByName(piped.select("pkg", F.lit(None).cast("string").alias("tool"), "file", "line", F.lit("pipe").alias("detail"), F.lit(0).alias("ord")))


@RULES.add("R08", "red")
def tampers_with_startup_or_config(v):
    return tampering(v).where("NOT __installer").withColumn("detail", F.array_join("path_kinds", ","))


@RULES.add("R09", "red", "flaw")
def command_injection(v):
    return flows_to(v, ["tool_parameter"], ["shell"]).where("pasted")


@RULES.add("R10", "red")
def install_goes_online(v):
    scripts = downloads(v).where("__host IS NULL").select("pkg", "file", F.lit(None).cast("int").alias("line"), "quote", F.lit("script").alias("detail"), F.lit(0).alias("ord"))
    calls = install_requests(v).where("NOT __plain").select("pkg", "file", "line", F.lit(None).cast("string").alias("quote"), F.lit("request").alias("detail"), "ord")
    return scripts.unionByName(calls)


@RULES.add("R11", "red")
def known_malicious(v):
    return v["reputation"].where("NOT dependency OR all_versions").withColumn("detail", F.concat_ws(" ", "name", "report"))


@RULES.add("R12", "red")
def talks_to_the_analyzer(v):
    seen = v["text_matches"].select("pkg", "tool", "file", "line", "quote", F.lit(0).alias("ord"))
    texts = tool_texts(v, names=True).withColumn("quote", tx.analyzer_talk(F.col("text"))).where("quote != ''")
    known = seen.where("tool IS NOT NULL").groupBy("pkg", "tool").agg(F.collect_set("quote").alias("__known"))  # the quotes of one tool
    fresh = texts.join(known, ["pkg", "tool"], "left").where(~F.coalesce(F.exists("__known", lambda q: F.contains(F.col("text"), q)), F.lit(False)))
    return seen.unionByName(fresh.select("pkg", "tool", F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"), "quote", "ord"))


@RULES.add("R13", "red")
def hidden_directive(v):
    return blocks(v).where("__signal")


@RULES.add("O01", "orange")
def open_network(v):
    """Requests of a tool to an address it doesn't fix: those with a flow, the most direct first; without any flow the first alone."""
    open_ = v["findings"].where("tool IS NOT NULL AND capability = 'network' AND url_kind = 'dynamic' AND url_host IS NULL AND NOT coalesce(fixed_site, false)").where(tx.is_request(F.col("detail"), F.coalesce("has_address", F.lit(False))))
    f = v["flows"].where("source = 'tool_parameter' AND sink = 'network'").groupBy("pkg", "tool", "file", "line").agg(F.min(F.struct(F.when(F.col("pasted"), 1).otherwise(0).alias("directness"), "steps")).alias("__flow"))
    ranked = first(server(open_), "tool", "file", "line").join(f, ["pkg", "tool", "file", "line"], "left")
    rank = Window.partitionBy("pkg", "tool").orderBy(F.coalesce("__flow.directness", F.lit(2)), "__flow.steps", "ord")
    return ranked.withColumn("__k", F.row_number().over(rank)).where("__flow IS NOT NULL OR __k = 1")


@RULES.add("O02", "orange")
def ai_chooses_the_command(v):
    f = flows_to(v, ["tool_parameter"], ["shell", "process", "code"])
    chosen = ((F.col("sink") == "shell") & ~F.coalesce("pasted", F.lit(False))) | ((F.col("sink") == "process") & (F.col("role") == "program")) | (F.col("sink") == "code")
    return f.where(chosen).withColumn("detail", F.col("sink"))


@RULES.add("O03", "orange")
def description_from_internet(v):
    return flows_to(v, ["network_response"], ["tool_description"])


@RULES.add("O04", "orange")
def annotation_mismatch(v):
    t = v["tools"].select("pkg", "tool", "read_only", "open_world")
    f = server(v["findings"].where("tool IS NOT NULL")).join(t, ["pkg", "tool"])
    writes = F.col("capability").isin("fs_write", "fs_delete", "exec", "dynamic_code") | ((F.col("capability") == "network") & F.coalesce("sends", F.lit(False)))
    one = first(f.where((F.col("read_only") == "true") & writes), "tool").withColumn("quote", F.lit("readOnlyHint"))
    two = first(f.where((F.col("open_world") == "false") & (F.col("capability") == "network")), "tool").withColumn("quote", F.lit("openWorldHint"))
    return one.unionByName(two).withColumn("detail", F.col("capability"))


@RULES.add("O05", "orange")
def mentions_sensitive_path(v):
    return path_mentions(v).where("quote IS NULL")


@RULES.add("O06", "orange")
def dependency_was_malicious(v):
    return v["reputation"].where("dependency AND NOT all_versions AND NOT coalesce(cleared, false)").withColumn("detail", F.concat_ws(" ", "name", "report"))


@RULES.add("O07", "orange")
def lone_invisible_character(v):
    return tool_texts(v, names=True).where(tx.hidden_lone(F.col("text"))).withColumn("detail", F.col("field"))


@RULES.add("O08", "orange")
def powerful_capability(v):
    f = server(v["findings"]).where(F.col("capability").isin(POWERFUL))
    own = first(f.where("tool IS NOT NULL"), "tool", "capability")
    outside = first(f.where("tool IS NULL AND NOT coalesce(unused_library, false)"), "capability", "shared", "outside")
    return own.unionByName(outside).withColumn("detail", F.col("capability"))


@RULES.add("O09", "orange")
def silence_to_check(v):
    return silences(v).where("NOT __serious")


@RULES.add("O10", "orange")
def installer_edits_client_config(v):
    """With the client whose configuration is named closest above in the same file."""
    f = tampering(v).where("__installer")
    above = v["sensitive_paths"].where("kind = 'tool_config'").select("pkg", "file", F.col("line").alias("__at"), "match")
    near = f.join(above, ["pkg", "file"], "left").where(F.col("__at").isNull() | (F.col("__at") <= F.col("line")))
    named = near.groupBy("pkg", "file", "line").agg(F.max_by("match", "__at").alias("match"), F.min("ord").alias("ord"))
    return named.withColumn("detail", tx.client_name(F.col("match"))).dropDuplicates(["pkg", "file", "line", "detail"])


@RULES.add("O11", "orange")
def install_contacts_internet(v):
    scripts = downloads(v).where("__host IS NOT NULL").select("pkg", "file", F.lit(None).cast("int").alias("line"), "quote", F.col("__host").alias("detail"), F.lit(0).alias("ord"))
    calls = install_requests(v).where("__plain").select("pkg", "file", "line", F.lit(None).cast("string").alias("quote"), F.col("url_host").alias("detail"), "ord")
    return scripts.unionByName(calls)


@RULES.add("O12", "orange")
def directive_to_read(v):
    return blocks(v).where("NOT __signal")


#: Columns of each view, for views that a caller leaves out.
SCHEMAS = {
    "tools": "pkg string, tool string, ord int, name string, description string, title string, parameters array<struct<name:string,description:string>>, read_only string, open_world string, location_kind string",
    "findings": "pkg string, tool string, ord int, capability string, detail string, file string, line int, location_kind string, url_kind string, url_host string, has_address boolean, fixed_site boolean, sends boolean, shared boolean, outside string, unused_library boolean, at_install boolean, plain boolean",
    "flows": "pkg string, tool string, ord int, source string, sink string, kinds array<string>, path_kinds array<string>, pasted boolean, role string, written boolean, file string, line int, steps int, files array<string>",
    "copy_recipients": "pkg string, address string, file string, line int, location_kind string",
    "install_scripts": "pkg string, file string, command string, downloads boolean",
    "install_commands": "pkg string, files array<string>",
    "reputation": "pkg string, name string, dependency boolean, report string, all_versions boolean, cleared boolean",
    "invisible": "pkg string, file string, line int, category string, location_kind string, in_description boolean",
    "text_matches": "pkg string, tool string, quote string, file string, line int",
    "strings": "pkg string, text string, file string, line int, location_kind string",
    "sensitive_paths": "pkg string, file string, line int, kind string, match string",
}


def alerts(spark, views: Views, only: list[str] | None = None) -> DataFrame:
    """Alert rows of all rules, or of some; views that are missing count as empty."""
    return RULES.alerts({k: views[k] if k in views else spark.createDataFrame([], s) for k, s in SCHEMAS.items()}, only)


def complete(df: DataFrame, view: str) -> DataFrame:
    """df with the columns of a view; those it lacks are null."""
    from pyspark.sql import types as T

    schema = T._parse_datatype_string(SCHEMAS[view])
    column = lambda f: F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
    return df.select(*[column(f).alias(f.name) for f in schema])


def severity(colour: Column) -> Column:
    return F.when(colour == "red", 2).when(colour == "orange", 1).otherwise(0)
