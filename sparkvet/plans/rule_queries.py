"""The rules and report views over fact views that are derived from the driver's tables, each with its DuckDB equivalent.

lineitem stands for flows, events for findings and alerts, their users for packages with five tools each, supplier for reputation
records, customer for copy recipients and domains. Every row takes part.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkvet.operators import admission, report, rules, verdict
from sparkvet.plans import driver_queries

QUERIES, ORACLES = driver_queries.QUERIES, driver_queries.ORACLES
query = driver_queries.query

SOURCES = ["tool_parameter", "environment", "sensitive_file", "network_response", "encoded_literal", "tool_parameter"]
SINKS = ["shell", "process", "code", "network", "run_file", "tool_description", "file"]
ROLES = ["path", "program", "arguments"]
CAPABILITIES = ["network", "fs_write", "exec", "fs_read", "env_read_secret", "network", "dynamic_code", "sensitive_path", "env_read"]
DETAILS = ["requests.get", "httpx.Client", "requests.post", "Thing"]


def _pick(names: list[str], number):
    return F.element_at(F.array(*map(F.lit, names)), (number % len(names) + 1).cast("int"))


def _sql_pick(names: list[str], number: str) -> str:
    return f"({names!r})[{number} % {len(names)} + 1]"


FLOW_SQL = f"""f AS (SELECT 'p' || l_suppkey AS pkg, 't' || (l_partkey % 4) AS tool, CAST(l_orderkey AS INT) AS ord, {_sql_pick(SOURCES, "l_linenumber")} AS source, {_sql_pick(SINKS, "(l_partkey + l_orderkey)")} AS sink,
 CASE WHEN l_quantity >= 25 THEN 'secret' END AS kind, CASE l_orderkey % 5 WHEN 0 THEN 'autostart' WHEN 1 THEN 'tool_config' END AS path_kind, l_returnflag = 'R' AS pasted, {_sql_pick(ROLES, "l_partkey")} AS role, l_linestatus = 'F' AS written,
 'f' || (l_orderkey % 9) || '.py' AS file, CAST(l_quantity AS INT) AS line, l_linenumber AS steps FROM lineitem)"""
FINDING_SQL = f"""e AS (SELECT 'p' || (user_id % 97) AS pkg, CASE WHEN event_id % 4 > 0 THEN 't' || (event_id % 5) END AS tool, CAST(event_id AS INT) AS ord, {_sql_pick(CAPABILITIES, "event_id")} AS capability, {_sql_pick(DETAILS, "(event_id // 9)")} AS detail,
 'f' || (event_id % 3) || '.py' AS file, CAST(event_id % 11 AS INT) AS line, CASE WHEN event_type = 'error' THEN 'test_or_example' ELSE 'server_code' END AS location_kind, CASE WHEN value >= 5 THEN 'dynamic' ELSE 'literal' END AS url_kind,
 CASE WHEN event_id % 6 = 0 THEN 'h' || (event_id % 10) || '.example' END AS url_host, event_id % 7 > 0 AS has_address, event_id % 13 = 0 AS fixed_site, event_type = 'purchase' AS sends, event_id % 2 = 0 AS shared, CASE WHEN event_id % 8 = 0 THEN 'install' ELSE 'startup' END AS outside,
 event_id % 12 = 0 AS unused_library, event_id % 8 = 0 AS at_install, event_id % 16 = 0 AS plain, CAST(event_id % 4 AS INT) AS steps FROM events)"""
TOOL_SQL = """t AS (SELECT 'p' || k AS pkg, 't' || i AS tool, i AS index, CASE (k + i) % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END AS read_only, CASE (k + i) % 4 WHEN 0 THEN 'false' END AS open_world,
 CASE (k * 3 + i) % 5 WHEN 4 THEN 'danger' WHEN 3 THEN 'warn' ELSE 'none' END AS level FROM (SELECT DISTINCT user_id % 97 AS k FROM events), (SELECT CAST(range AS INT) AS i FROM range(4)))"""


def _flows(table):
    x = table("lineitem")
    kind = F.when(F.col("l_quantity") >= 25, F.array(F.lit("secret"))).otherwise(F.array().cast("array<string>"))
    paths = F.when(F.col("l_orderkey") % 5 == 0, F.array(F.lit("autostart"))).when(F.col("l_orderkey") % 5 == 1, F.array(F.lit("tool_config"))).otherwise(F.array().cast("array<string>"))
    file = F.concat(F.lit("f"), (F.col("l_orderkey") % 9).cast("string"), F.lit(".py"))
    return x.select(
        F.concat(F.lit("p"), F.col("l_suppkey").cast("string")).alias("pkg"), F.concat(F.lit("t"), (F.col("l_partkey") % 4).cast("string")).alias("tool"), F.col("l_orderkey").cast("int").alias("ord"), _pick(SOURCES, F.col("l_linenumber")).alias("source"), _pick(SINKS, F.col("l_partkey") + F.col("l_orderkey")).alias("sink"),
        kind.alias("kinds"), paths.alias("path_kinds"), (F.col("l_returnflag") == "R").alias("pasted"), _pick(ROLES, F.col("l_partkey")).alias("role"), (F.col("l_linestatus") == "F").alias("written"), file.alias("file"), F.col("l_quantity").cast("int").alias("line"), F.col("l_linenumber").alias("steps"), F.array(file).alias("files"),
    )


def _findings(table):
    e, i = table("events"), F.col("event_id")
    text = lambda a, b, c="": F.concat(F.lit(a), b.cast("string"), F.lit(c))
    return e.select(
        text("p", F.col("user_id") % 97).alias("pkg"), F.when(i % 4 > 0, text("t", i % 5)).alias("tool"), i.cast("int").alias("ord"), _pick(CAPABILITIES, i).alias("capability"), _pick(DETAILS, F.floor(i / 9)).alias("detail"), text("f", i % 3, ".py").alias("file"), (i % 11).cast("int").alias("line"),
        F.when(F.col("event_type") == "error", "test_or_example").otherwise("server_code").alias("location_kind"), F.when(F.col("value") >= 5, "dynamic").otherwise("literal").alias("url_kind"), F.when(i % 6 == 0, text("h", i % 10, ".example")).alias("url_host"), (i % 7 > 0).alias("has_address"), (i % 13 == 0).alias("fixed_site"),
        (F.col("event_type") == "purchase").alias("sends"), (i % 2 == 0).alias("shared"), F.when(i % 8 == 0, "install").otherwise("startup").alias("outside"), (i % 12 == 0).alias("unused_library"), (i % 8 == 0).alias("at_install"), (i % 16 == 0).alias("plain"), (i % 4).cast("int").alias("steps"),
    )


def _tools(table):
    k, i = F.col("k"), F.col("index")
    t = table("events").select((F.col("user_id") % 97).alias("k")).distinct().withColumn("index", F.explode(F.array(*[F.lit(n) for n in range(4)])))
    name = F.concat(F.lit("t"), i.cast("string"))
    level = F.when((k * 3 + i) % 5 == 4, "danger").when((k * 3 + i) % 5 == 3, "warn").otherwise("none")
    return t.select(F.concat(F.lit("p"), k.cast("string")).alias("pkg"), name.alias("tool"), name.alias("name"), i.alias("ord"), "index", F.when((k + i) % 3 == 0, "true").when((k + i) % 3 == 1, "false").alias("read_only"), F.when((k + i) % 4 == 0, "false").alias("open_world"), level.alias("level"))


def _fired(spark, name, **views):
    found = rules.alerts(spark, {k: rules.complete(v, k) for k, v in views.items()}, [name])
    return found.select("pkg", "rule", "colour", "tool", "file", "line", "detail", "ord")


def _fire_sql(name: str, colour: str, where: str, detail: str, views: str = FLOW_SQL, rows: str = "f") -> str:
    return f"WITH {views} SELECT pkg, '{name}' AS rule, '{colour}' AS colour, tool, file, line, {detail} AS detail, ord FROM {rows} WHERE {where}"


@query(_fire_sql("R04", "red", "sink = 'network' AND (source = 'environment' OR source = 'sensitive_file' AND kind = 'secret')", "source"))
def rule_r04(spark, table):
    return _fired(spark, "R04", flows=_flows(table))


@query("SELECT 'p' || c_nationkey AS pkg, 'R05' AS rule, 'red' AS colour, CAST(NULL AS VARCHAR) AS tool, 'a.py' AS file, CAST(c_custkey AS INT) AS line, c_name AS detail, 0 AS ord FROM customer WHERE c_mktsegment <> 'BUILDING'")
def rule_r05(spark, table):
    c = table("customer").select(F.concat(F.lit("p"), F.col("c_nationkey").cast("string")).alias("pkg"), F.col("c_name").alias("address"), F.lit("a.py").alias("file"), F.col("c_custkey").cast("int").alias("line"), F.when(F.col("c_mktsegment") != "BUILDING", "server_code").otherwise("build_script").alias("location_kind"))
    return _fired(spark, "R05", copy_recipients=c)


@query(_fire_sql("R06", "red", "source = 'encoded_literal' AND (sink IN ('code', 'shell', 'process') OR sink = 'run_file' AND written)", "sink"))
def rule_r06(spark, table):
    return _fired(spark, "R06", flows=_flows(table))


@query(_fire_sql("R07", "red", "source = 'network_response' AND (sink IN ('code', 'shell') OR sink = 'run_file' AND written)", "sink"))
def rule_r07(spark, table):
    return _fired(spark, "R07", flows=_flows(table))


#: Installers of the packages: every seventh package has one, which is the file f1.py.
INSTALLER_SQL = "i AS (SELECT DISTINCT 'p' || l_suppkey AS pkg FROM lineitem WHERE l_suppkey % 7 = 0)"


def _installers(table):
    return table("lineitem").where("l_suppkey % 7 = 0").select(F.concat(F.lit("p"), F.col("l_suppkey").cast("string")).alias("pkg"), F.array(F.lit("f1.py")).alias("files")).distinct()


@query(f"WITH {FLOW_SQL}, {INSTALLER_SQL} SELECT pkg, 'R08' AS rule, 'red' AS colour, tool, file, line, path_kind AS detail, ord FROM f WHERE role = 'path' AND path_kind IS NOT NULL AND NOT (file = 'f1.py' AND pkg IN (SELECT pkg FROM i))")
def rule_r08(spark, table):
    return _fired(spark, "R08", flows=_flows(table), install_commands=_installers(table))


@query(f"""WITH {FLOW_SQL}, {INSTALLER_SQL}, d AS (SELECT * FROM f WHERE role = 'path' AND path_kind IS NOT NULL AND file = 'f1.py' AND pkg IN (SELECT pkg FROM i))
SELECT pkg, 'O10' AS rule, 'orange' AS colour, CAST(NULL AS VARCHAR) AS tool, file, line, CAST(NULL AS VARCHAR) AS detail, min(ord) AS ord FROM d GROUP BY pkg, file, line""")
def rule_o10(spark, table):
    found = _fired(spark, "O10", flows=_flows(table), install_commands=_installers(table))
    return found.groupBy("pkg", "rule", "colour", "tool", "file", "line", "detail").agg(F.min("ord").alias("ord"))


@query(_fire_sql("R09", "red", "source = 'tool_parameter' AND sink = 'shell' AND pasted", "CAST(NULL AS VARCHAR)"))
def rule_r09(spark, table):
    return _fired(spark, "R09", flows=_flows(table))


@query(_fire_sql("R10", "red", "at_install AND capability = 'network' AND NOT (plain AND url_host IS NOT NULL)", "'request'", FINDING_SQL, "(SELECT * REPLACE (CAST(NULL AS VARCHAR) AS tool) FROM e)"))
def rule_r10(spark, table):
    return _fired(spark, "R10", findings=_findings(table))


@query(_fire_sql("O11", "orange", "at_install AND capability = 'network' AND plain AND url_host IS NOT NULL", "url_host", FINDING_SQL, "(SELECT * REPLACE (CAST(NULL AS VARCHAR) AS tool) FROM e)"))
def rule_o11(spark, table):
    return _fired(spark, "O11", findings=_findings(table))


REPUTATION_SQL = "SELECT 'p' || s_nationkey AS pkg, '{}' AS rule, '{}' AS colour, CAST(NULL AS VARCHAR) AS tool, CAST(NULL AS VARCHAR) AS file, CAST(NULL AS INT) AS line, s_name || ' M' || s_suppkey AS detail, 0 AS ord FROM supplier WHERE {}"


def _reputation(table):
    s = F.col("s_suppkey")
    return table("supplier").select(F.concat(F.lit("p"), F.col("s_nationkey").cast("string")).alias("pkg"), F.col("s_name").alias("name"), (s % 3 > 0).alias("dependency"), F.concat(F.lit("M"), s.cast("string")).alias("report"), (F.col("s_acctbal") < 0).alias("all_versions"), (s % 5 == 0).alias("cleared"))


@query(REPUTATION_SQL.format("R11", "red", "s_suppkey % 3 = 0 OR s_acctbal < 0"))
def rule_r11(spark, table):
    return _fired(spark, "R11", reputation=_reputation(table))


@query(REPUTATION_SQL.format("O06", "orange", "s_suppkey % 3 > 0 AND NOT s_acctbal < 0 AND s_suppkey % 5 > 0"))
def rule_o06(spark, table):
    return _fired(spark, "O06", reputation=_reputation(table))


@query(f"""WITH {FINDING_SQL}, l AS (SELECT 'p' || (l_suppkey % 97) AS pkg, 't' || (l_partkey % 5) AS tool, 'f' || (l_orderkey % 3) || '.py' AS file, CAST(l_orderkey % 11 AS INT) AS line, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS pasted, l_linenumber AS steps
 FROM lineitem WHERE l_linestatus = 'F' AND l_tax < 0.02),
o AS (SELECT * FROM e WHERE tool IS NOT NULL AND capability = 'network' AND url_kind = 'dynamic' AND url_host IS NULL AND NOT fixed_site AND location_kind = 'server_code' AND detail <> 'httpx.Client' AND (has_address OR detail <> 'Thing')),
p AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY pkg, tool, file, line ORDER BY ord) = 1),
b AS (SELECT pkg, tool, file, line, min({{'d': pasted, 's': steps}}) AS w FROM l GROUP BY ALL),
k AS (SELECT p.*, b.w, row_number() OVER (PARTITION BY p.pkg, p.tool ORDER BY coalesce(b.w.d, 2), b.w.s NULLS FIRST, p.ord) AS k FROM p LEFT JOIN b USING (pkg, tool, file, line))
SELECT pkg, 'O01' AS rule, 'orange' AS colour, tool, file, line, detail, ord FROM k WHERE w IS NOT NULL OR k = 1""")
def rule_o01(spark, table):
    x = table("lineitem").where("l_linestatus = 'F' AND l_tax < 0.02")
    text = lambda a, b, c="": F.concat(F.lit(a), b.cast("string"), F.lit(c))
    flows = x.select(text("p", F.col("l_suppkey") % 97).alias("pkg"), text("t", F.col("l_partkey") % 5).alias("tool"), F.lit("tool_parameter").alias("source"), F.lit("network").alias("sink"), text("f", F.col("l_orderkey") % 3, ".py").alias("file"), (F.col("l_orderkey") % 11).cast("int").alias("line"), (F.col("l_returnflag") == "R").alias("pasted"), F.col("l_linenumber").alias("steps"))
    return _fired(spark, "O01", findings=_findings(table), flows=flows)


@query(_fire_sql("O02", "orange", "source = 'tool_parameter' AND (sink = 'shell' AND NOT pasted OR sink = 'process' AND role = 'program' OR sink = 'code')", "sink"))
def rule_o02(spark, table):
    return _fired(spark, "O02", flows=_flows(table))


@query(_fire_sql("O03", "orange", "source = 'network_response' AND sink = 'tool_description'", "CAST(NULL AS VARCHAR)"))
def rule_o03(spark, table):
    return _fired(spark, "O03", flows=_flows(table))


@query(f"""WITH {FINDING_SQL}, {TOOL_SQL}, j AS (SELECT e.*, read_only, open_world FROM e JOIN t USING (pkg, tool) WHERE location_kind = 'server_code'),
a AS (SELECT *, 1 AS n FROM j WHERE read_only = 'true' AND (capability IN ('fs_write', 'fs_delete', 'exec', 'dynamic_code') OR capability = 'network' AND sends) QUALIFY row_number() OVER (PARTITION BY pkg, tool ORDER BY ord) = 1),
b AS (SELECT *, 2 AS n FROM j WHERE open_world = 'false' AND capability = 'network' QUALIFY row_number() OVER (PARTITION BY pkg, tool ORDER BY ord) = 1)
SELECT pkg, 'O04' AS rule, 'orange' AS colour, tool, file, line, capability AS detail, ord FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def rule_o04(spark, table):
    return _fired(spark, "O04", findings=_findings(table), tools=_tools(table))


@query(f"""WITH {FINDING_SQL}, s AS (SELECT * FROM e WHERE location_kind = 'server_code' AND capability IN ('exec', 'fs_write', 'env_read_secret', 'dynamic_code', 'sensitive_path', 'install_script', 'docker_socket')),
a AS (SELECT * FROM s WHERE tool IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pkg, tool, capability ORDER BY ord) = 1),
b AS (SELECT * FROM s WHERE tool IS NULL AND NOT unused_library QUALIFY row_number() OVER (PARTITION BY pkg, capability, shared, outside ORDER BY ord) = 1)
SELECT pkg, 'O08' AS rule, 'orange' AS colour, tool, file, line, capability AS detail, ord FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def rule_o08(spark, table):
    return _fired(spark, "O08", findings=_findings(table))


#: Alerts for the report: errors are red, purchases orange.
ALERT_SQL = FINDING_SQL + ", a AS (SELECT 'p' || (user_id % 97) AS pkg, CASE WHEN event_id % 5 > 0 THEN 't' || (event_id % 6) END AS tool, event_id AS ord, CASE event_type WHEN 'error' THEN 'red' ELSE 'orange' END AS colour FROM events WHERE event_type IN ('error', 'purchase'))"


def _alerts(table):
    i = F.col("event_id")
    e = table("events").where("event_type IN ('error', 'purchase')")
    return e.select(F.concat(F.lit("p"), (F.col("user_id") % 97).cast("string")).alias("pkg"), F.when(i % 5 > 0, F.concat(F.lit("t"), (i % 6).cast("string"))).alias("tool"), i.alias("ord"), F.when(F.col("event_type") == "error", "red").otherwise("orange").alias("colour"))


@query(f"WITH {ALERT_SQL} SELECT pkg, tool, ord FROM a WHERE colour = 'red'")
def report_alerts_of_colour(spark, table):
    return report.of_colour(_alerts(table), "red").select("pkg", "tool", "ord")


@query(f"WITH {ALERT_SQL}, {TOOL_SQL} SELECT pkg, tool, ord FROM a SEMI JOIN t USING (pkg, tool)")
def report_alerts_of_tools(spark, table):
    return report.of_tools(_alerts(table), _tools(table)).select("pkg", "tool", "ord")


@query(f"WITH {ALERT_SQL}, {TOOL_SQL} SELECT pkg, tool, ord FROM a ANTI JOIN t USING (pkg, tool)")
def report_alerts_outside_tools(spark, table):
    return report.outside_tools(_alerts(table), _tools(table)).select("pkg", "tool", "ord")


@query(f"""WITH {ALERT_SQL}, {TOOL_SQL}, h AS (SELECT pkg, arg_min(index, ord) AS i FROM a JOIN t USING (pkg, tool) GROUP BY pkg)
SELECT pkg, coalesce(any_value(h.i), min(index) FILTER (WHERE level = 'danger'), min(index) FILTER (WHERE level = 'warn'), 0) AS index FROM t LEFT JOIN h USING (pkg) GROUP BY pkg""")
def report_default_tool(spark, table):
    return report.default_tool(_tools(table), _alerts(table))


@query(f"""WITH {FINDING_SQL}, p AS (SELECT pkg, tool, CASE WHEN line % 3 = 0 THEN file || ':' || line ELSE 'g' || (line % 4) || '() · ' || file || ':' || line END AS place, min(ord) AS o FROM e WHERE location_kind = 'server_code' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY pkg, tool ORDER BY o, place) AS k FROM p)
SELECT pkg, tool, list(place ORDER BY k) FILTER (WHERE k <= 3) AS places, CAST(greatest(0, count(*) - 3) AS BIGINT) AS more FROM r GROUP BY pkg, tool""")
def report_places(spark, table):
    f = _findings(table).withColumn("function", F.when(F.col("line") % 3 > 0, F.concat(F.lit("g"), (F.col("line") % 4).cast("string"))))
    return report.places(f, 3)


@query("SELECT DISTINCT 'p' || c_nationkey AS pkg, lower(c_mktsegment) || '.example' AS domain FROM customer WHERE c_acctbal >= 0")
def report_code_domains(spark, table):
    return report.code_domains(table("customer").select(F.concat(F.lit("p"), F.col("c_nationkey").cast("string")).alias("pkg"), F.concat(F.lower("c_mktsegment"), F.lit(".example")).alias("domain"), F.when(F.col("c_acctbal") >= 0, "server_code").otherwise("build_script").alias("location_kind")))


@query(f"""WITH {ALERT_SQL}, c AS (SELECT DISTINCT pkg, capability FROM e), r AS (SELECT DISTINCT pkg, 'R' || lpad(CAST(1 + ord % 13 AS VARCHAR), 2, '0') AS rule FROM a WHERE colour = 'red'),
l AS (SELECT * FROM (VALUES ('files_read', ['fs_read'], CAST([] AS VARCHAR[])), ('files_write', ['fs_write'], ['R08']), ('internet', ['network'], ['R04', 'R05', 'R07', 'R10']), ('commands', ['exec', 'dynamic_code', 'install_script', 'docker_socket'], ['R07', 'R09', 'R10']),
 ('secrets', ['env_read_secret', 'sensitive_path'], ['R03', 'R04']), ('hidden_text', ['invisible_character'], ['R01', 'R02', 'R06', 'R12', 'R13'])) v(lamp, caps, rules)),
s AS (SELECT p.pkg, CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.pkg = p.pkg AND list_contains(l.rules, r.rule)) THEN 'danger' WHEN EXISTS (SELECT 1 FROM c WHERE c.pkg = p.pkg AND list_contains(l.caps, c.capability)) THEN 'on' ELSE 'off' END AS state FROM (SELECT DISTINCT pkg FROM e) p, l)
SELECT pkg, count(*) FILTER (WHERE state = 'danger') AS danger, count(*) FILTER (WHERE state = 'on') AS "on", count(*) FILTER (WHERE state = 'off') AS off FROM s GROUP BY pkg""")
def report_lamp_counts(spark, table):
    f = _findings(table)
    red = _alerts(table).withColumn("rule", F.concat(F.lit("R"), F.lpad((1 + F.col("ord") % 13).cast("string"), 2, "0")))
    return report.lamp_counts(verdict.lamps(f.select("pkg"), f.select("pkg", "capability"), red.select("pkg", "rule", "colour"), ["pkg"]))


@query(f"""WITH {FINDING_SQL}, i AS (SELECT pkg, detail, min({{'r': list_position(['env_read_secret', 'env_read', 'fs_read', 'exec'], capability), 'f': file, 'l': line}}) AS w FROM e
 WHERE tool IS NULL AND at_install AND list_contains(['env_read_secret', 'env_read', 'fs_read', 'exec'], capability) GROUP BY pkg, detail)
SELECT pkg, row_number() OVER (PARTITION BY pkg ORDER BY w, detail)::INT AS ord, detail FROM i""")
def report_install_reads(spark, table):
    return report.install_reads(_findings(table))


@query("""WITH d AS (SELECT 'p' || (c_custkey % 40) AS pkg, 'f' || (c_custkey % 3) AS file, lower(c_mktsegment) AS domain, min(CAST(c_nationkey AS INT)) AS line FROM customer WHERE c_acctbal >= 0 GROUP BY ALL)
SELECT pkg, file, row_number() OVER (PARTITION BY pkg, file ORDER BY line, domain)::INT AS ord, domain FROM d""")
def report_written_domains(spark, table):
    c = F.col("c_custkey")
    return report.written_domains(table("customer").select(F.concat(F.lit("p"), (c % 40).cast("string")).alias("pkg"), F.concat(F.lit("f"), (c % 3).cast("string")).alias("file"), F.lower("c_mktsegment").alias("domain"), F.col("c_nationkey").alias("line"), F.when(F.col("c_acctbal") >= 0, "server_code").otherwise("build_script").alias("location_kind")))


@query(f"WITH {FINDING_SQL} SELECT pkg, CASE WHEN bool_and(url_host IS NOT NULL) THEN list_sort(list(DISTINCT url_host)) END AS domains FROM e WHERE capability = 'network' AND location_kind = 'server_code' AND (ord % 5 > 0 OR url_host IS NOT NULL) GROUP BY pkg")
def report_internet_domains(spark, table):
    return report.internet_domains(_findings(table).where("ord % 5 > 0 OR url_host IS NOT NULL"))


@query(f"WITH {FINDING_SQL} SELECT pkg, tool, ord FROM e QUALIFY row_number() OVER (PARTITION BY pkg, tool ORDER BY steps, CASE WHEN url_kind = 'unknown' THEN 1 ELSE 0 END, ord) <= 2")
def report_representative(spark, table):
    return report.representative(_findings(table), 2).select("pkg", "tool", "ord")


@query(f"WITH {FINDING_SQL}, g AS (SELECT DISTINCT pkg, tool, file, line, capability AS gap FROM e) SELECT *, row_number() OVER (PARTITION BY pkg, tool ORDER BY file, line, gap)::INT AS ord FROM g QUALIFY row_number() OVER (PARTITION BY pkg, tool ORDER BY file, line, gap) <= 20")
def report_gap_places(spark, table):
    return report.gap_places(_findings(table).withColumnRenamed("capability", "gap"))


@query("WITH n AS (SELECT source AS pkg, lang AS language, count(*) AS n, min(doc_id) AS met FROM documents WHERE lang IS NOT NULL AND n_chars > 20 GROUP BY ALL) SELECT pkg, arg_max(language, {'n': n, 'm': -met}) AS language FROM n GROUP BY pkg")
def report_dominant_language(spark, table):
    return report.dominant_language(table("documents").select(F.col("source").alias("pkg"), F.col("doc_id").alias("ord"), F.col("lang").alias("language"), (F.col("n_chars") <= 20).alias("is_test")))


@query("SELECT 'p' || (p_partkey % 50) AS pkg, p_type AS label, count(*) AS n FROM part WHERE p_size <> 7 GROUP BY ALL")
def report_character_counts(spark, table):
    return report.character_counts(table("part").select(F.concat(F.lit("p"), (F.col("p_partkey") % 50).cast("string")).alias("pkg"), F.col("p_type").alias("label"), F.when(F.col("p_size") != 7, "server_code").otherwise("build_script").alias("location_kind")))


@query("""WITH l AS (SELECT o_custkey AS request, CASE o_custkey % 4 WHEN 0 THEN 'src' WHEN 1 THEN 'a/b' ELSE '' END AS subdir, CASE WHEN o_orderkey % 5 > 0 THEN 'O' || (o_orderkey % 3) END AS lo, 'o' || (o_custkey % 3) AS owner, CASE o_orderkey % 7 WHEN 0 THEN './src' WHEN 1 THEN 'a/b/' END AS lf FROM orders),
f AS (SELECT request, bool_or(lo IS NOT NULL) AS a, bool_or(coalesce(lower(lo) = owner, false)) AS s, bool_or(coalesce(lower(lo) = owner, false) AND lf IS NOT NULL) AS w,
 bool_or(coalesce(lower(lo) = owner, false) AND lf IS NOT NULL AND CASE lf WHEN './src' THEN 'src' ELSE 'a/b' END = subdir) AS i FROM l GROUP BY request)
SELECT request, CASE WHEN NOT a THEN 'package_without_repository' WHEN NOT s THEN 'package_repository_mismatch' WHEN NOT w THEN 'published_matches_repository' WHEN i THEN 'published_matches_directory' ELSE 'package_directory_mismatch' END AS code FROM f""")
def repository_agreement(spark, table):
    o, k = F.col("o_custkey"), F.col("o_orderkey")
    text = lambda a, b: F.concat(F.lit(a), b.cast("string"))
    return report.agreement(table("orders").select(o.alias("request"), text("o", o % 3).alias("owner"), F.lit("r").alias("repo"), F.when(o % 4 == 0, "src").when(o % 4 == 1, "a/b").otherwise("").alias("subdir"), F.when(k % 5 > 0, text("O", k % 3)).alias("link_owner"), F.lit("R").alias("link_repo"), F.when(k % 7 == 0, "./src").when(k % 7 == 1, "a/b/").alias("link_folder")))


@query("""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, ['fetching', 'analyzing', 'done', 'failed', 'quota_exhausted'][event_id % 5 + 1] AS w FROM events),
r AS (SELECT user_id, CAST(0 AS BIGINT) AS k, 'queued' AS state, 0 AS ignored FROM e WHERE k = 1
 UNION ALL SELECT e.user_id, e.k, CASE WHEN ok THEN w ELSE state END, ignored + CASE WHEN ok THEN 0 ELSE 1 END FROM (SELECT r.state, r.ignored, e.user_id, e.k, e.w,
 (r.state = 'queued' AND e.w IN ('fetching', 'quota_exhausted', 'failed')) OR (r.state = 'fetching' AND e.w IN ('analyzing', 'failed')) OR (r.state = 'analyzing' AND e.w IN ('done', 'failed')) AS ok FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1) e)
SELECT user_id, state, ignored FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1""")
def job_states(spark, table):
    wanted = _pick(["fetching", "analyzing", "done", "failed", "quota_exhausted"], F.col("event_id"))
    return admission.state_of(table("events").select("user_id", "ts", "event_id", wanted.alias("state")), "user_id", "ts", "event_id")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN event_id % 3 > 0 ELSE true END ELSE event_id % 6 = 0 OR event_id % 10 = 0 END AS back FROM events")
def token_given_back(spark, table):
    i = F.col("event_id")
    error = _pick(["download", "not_found", "fetch", "unknown"], i)
    code = admission.deciding_code(error, F.when(i % 3 > 0, "download").otherwise("not_found"))
    state = F.when(F.col("event_type") == "error", "failed").otherwise("done")
    return table("events").select("event_id", admission.token_back(state, code, F.when(i % 10 == 0, "multiple_servers"), i % 6 == 0, {"download": True, "not_found": False}).alias("back"))


@query("SELECT event_id, CASE event_id % 5 WHEN 1 THEN epoch_us(ts + INTERVAL 30 SECONDS) WHEN 2 THEN epoch_us(ts + INTERVAL 120 SECONDS) WHEN 3 THEN epoch_us(ts + INTERVAL 600 SECONDS) END AS next_us FROM events")
def mail_retries(spark, table):
    return table("events").select("event_id", F.unix_micros(admission.after_failure(F.col("event_id") % 5, F.col("ts")).cast("timestamp")).alias("next_us"))


@query("SELECT event_id FROM (SELECT event_id, ts, value FROM events WHERE event_type = 'signup' ORDER BY ts, event_id LIMIT 50) WHERE value < 1 OR ts + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-02'")
def mail_deliverable(spark, table):
    box = table("events").where("event_type = 'signup'").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.when(F.col("value") >= 1, F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("next_at"))
    return admission.deliverable(box, F.lit("2024-01-02").cast("timestamp_ntz"), 50).select(F.col("id").alias("event_id"))


@query("SELECT event_id, CAST(CAST(ts AS DATE) + 1 AS VARCHAR) AS next_day, CAST(CAST(date_trunc('month', ts) + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS next_month FROM events")
def quota_resets(spark, table):
    return table("events").select("event_id", admission.next_reset(F.col("ts")).cast("string").alias("next_day"), admission.next_month(F.col("ts")).cast("string").alias("next_month"))


@query()
def address_fingerprints(spark, table):
    """HMAC-SHA256 of each customer's name with a salt a nation; no SQL, tested against a library."""
    return table("customer").select("c_custkey", admission.address_fingerprint(F.col("c_name"), F.concat(F.lit("salt-"), F.col("c_nationkey").cast("string"))).alias("fingerprint"))
