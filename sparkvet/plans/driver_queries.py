"""The relational shapes of the engine on the driver's tables, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvet.functions import text as tx
from sparkvet.functions import versions
from sparkvet.operators import admission, bench_study, graph, joins, rules, service, verdict

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Registers a function (spark, table) -> DataFrame under its name, with its SQL."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


SEVERITY_SQL = "CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 1 ELSE 0 END"


def _severity():
    return F.when(F.col("event_type") == "error", 2).when(F.col("event_type").isin("purchase", "signup"), 1).otherwise(0)


def _cents(column: str = "value"):
    return F.round(F.col(column) * 100).cast("long")


@query(f"""
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, max(CASE WHEN value >= 200 THEN {SEVERITY_SQL} ELSE 0 END) AS severity, count(*) AS n,
  bool_or(event_type = 'view' AND value > 250) AS incomplete FROM events GROUP BY ALL)
SELECT user_id, day, n, CASE WHEN severity = 2 THEN 'red' WHEN severity = 1 THEN 'orange' WHEN incomplete THEN 'gray' ELSE 'green' END AS colour FROM d""")
def verdict_rollup(spark, table):
    found = F.when(F.col("value") >= 200, _severity()).otherwise(0)
    days = table("events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max(found).alias("severity"), F.count("*").alias("n"), F.bool_or((F.col("event_type") == "view") & (F.col("value") > 250)).alias("incomplete"))
    return days.select("user_id", "day", "n", verdict.colour(F.col("severity"), F.col("incomplete")).alias("colour"))


@query(f"""
WITH s AS (SELECT user_id, max({SEVERITY_SQL}) AS severity, list_sort(list(DISTINCT event_type)) AS types FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN severity > 0 THEN NULL WHEN list_contains(types, 'click') THEN 'status_click' ELSE coalesce(types[1], 'nothing_analyzable') END AS gray_case FROM s""")
def gray_case(spark, table):
    s = table("events").groupBy("user_id").agg(F.max(_severity()).alias("severity"), F.sort_array(F.collect_set("event_type")).alias("types"))
    status = F.when(F.array_contains("types", "click"), "status_click")
    return s.select("user_id", F.when(F.col("severity") > 0, None).otherwise(verdict.gray_case(status, F.col("types"))).alias("gray_case"))


RULES_SQL = "SELECT user_id, list_sort(list(DISTINCT event_type)) AS rules FROM events WHERE value > 100 GROUP BY user_id"


def _rules(table):
    return table("events").where("value > 100").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("rules"))


@query(f"SELECT rule, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, rule) AS place FROM (SELECT unnest(rules) AS rule FROM ({RULES_SQL})) GROUP BY rule")
def rule_counts(spark, table):
    return bench_study.rule_counts(_rules(table), "rules")


@query(f"SELECT count(*) FILTER (WHERE len(list_filter(rules, lambda x: x NOT IN ('view', 'click'))) = 0) AS n FROM ({RULES_SQL})")
def only_because(spark, table):
    return _rules(table).agg(bench_study.only_because(F.col("rules"), ["view", "click"]).alias("n"))


WHAT_IF = "CASE WHEN list_contains(rules, 'error') THEN 'red' WHEN len(list_filter(rules, lambda x: x NOT IN ('view', 'click'))) > 0 THEN 'orange' ELSE 'green' END"


@query(f"SELECT user_id, {WHAT_IF} AS colour_without FROM ({RULES_SQL})")
def what_if(spark, table):
    colour = F.when(F.array_contains("rules", "error"), "red").otherwise("orange")
    return _rules(table).select("user_id", bench_study.colour_without(colour, F.col("rules"), ["view", "click"]).alias("colour_without"))


@query(f"SELECT c.colour, count(x.colour) AS n FROM (VALUES ('green'), ('orange'), ('red'), ('gray')) c(colour) LEFT JOIN (SELECT {WHAT_IF} AS colour FROM ({RULES_SQL})) x USING (colour) GROUP BY c.colour")
def colour_histogram_zero_fill(spark, table):
    return bench_study.colour_counts(what_if(spark, table).withColumnRenamed("colour_without", "colour"))


@query(f"""
WITH d AS (SELECT user_id, max(CASE WHEN value >= 200 THEN {SEVERITY_SQL} ELSE 0 END) AS s, bool_or(value > 300) AS big FROM events GROUP BY user_id)
SELECT count(*) AS servers, count(*) FILTER (WHERE s = 2) AS red, count(*) FILTER (WHERE s = 1) AS orange, count(*) FILTER (WHERE s = 0 AND NOT big) AS green, count(*) FILTER (WHERE s = 0 AND big) AS gray,
 CASE WHEN count(*) = 0 THEN NULL ELSE CAST((1000 * count(*) FILTER (WHERE NOT (s = 0 AND big))) // count(*) AS BIGINT) END AS clear_tenths FROM d""")
def bench_summary(spark, table):
    d = table("events").groupBy("user_id").agg(F.max(F.when(F.col("value") >= 200, _severity()).otherwise(0)).alias("s"), F.bool_or(F.col("value") > 300).alias("big"))
    return bench_study.summary(d.select(verdict.colour(F.col("s"), F.col("big")).alias("colour")))


@query("""
WITH b AS (SELECT o_custkey AS id, max(o_orderstatus) AS colour, CAST(count(*) AS VARCHAR) AS version FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1),
n AS (SELECT o_custkey AS id, max(o_orderstatus) AS colour, CAST(count(*) AS VARCHAR) AS version FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1)
SELECT id, b.colour AS was, n.colour AS now, CASE WHEN b.colour IS NULL THEN 'new' WHEN n.colour IS NULL THEN 'removed' WHEN b.colour <> n.colour THEN 'colour' WHEN b.version <> n.version THEN 'version' ELSE 'same' END AS change FROM b FULL JOIN n USING (id)""")
def baseline_compare(spark, table):
    o = table("orders")
    part = lambda when: o.where(when).groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderstatus").alias("colour"), F.count("*").cast("string").alias("version"))
    return bench_study.compare(part(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")), part(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")))


@query("SELECT event_id, user_id, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS nth, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= 3 AS admitted FROM events")
def daily_quota_admit(spark, table):
    out = admission.daily_quota(table("events"), "user_id", "ts", "event_id", 3)
    return out.select("event_id", "user_id", "day", F.col("nth").cast("long").alias("nth"), "admitted")


@query("""
WITH m AS (SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, epoch(minute)::BIGINT AS minute_s, n, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY minute RANGE BETWEEN INTERVAL 3599 SECONDS PRECEDING AND CURRENT ROW) AS BIGINT) AS in_window FROM m""")
def burst_upper_bound(spark, table):
    out = admission.burst_upper_bound(table("events"), "user_id", "ts")
    return out.select("user_id", F.unix_seconds("minute").alias("minute_s"), "n", "in_window")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, event_id, t, k, t // 60000000 * 60000000 AS last, true AS admitted FROM e WHERE k = 1
 UNION ALL SELECT e.user_id, e.event_id, e.t, e.k, CASE WHEN r.last > e.t - 3600000000 THEN r.last ELSE e.t // 60000000 * 60000000 END, NOT (r.last > e.t - 3600000000) FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, event_id, admitted FROM r""")
def burst_admit_greedy(spark, table):
    return admission.burst(table("events").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id", 1).select("user_id", "event_id", "admitted")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, event_id, k, t AS last, true AS admitted FROM e WHERE k = 1
 UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN e.t - r.last < 21600000000 THEN r.last ELSE e.t END, NOT (e.t - r.last < 21600000000) FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, event_id, admitted FROM r""")
def history_dedupe_greedy(spark, table):
    return admission.repeats(table("events").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id", 6 * 3600).select("user_id", "event_id", "admitted")


@query("SELECT c_name, o_orderkey, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 3")
def history_top_n(spark, table):
    top = admission.newest(table("orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate", "o_orderkey", 3)
    return top.join(table("customer"), top["o_custkey"] == F.col("c_custkey")).select("c_name", "o_orderkey", "o_orderdate")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 25")
def queue_claim_order(spark, table):
    return admission.claim(table("orders").where("o_orderstatus = 'O'"), 25, "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderdate")


@query("SELECT event_id FROM events WHERE event_type = 'signup' AND (value < 1 OR ts < TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 10 MINUTES)")
def stale_recover(spark, table):
    running = table("events").where("event_type = 'signup'").withColumn("started", F.when(F.col("value") >= 1, F.col("ts")))
    return admission.stale(running, "started", F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")).select("event_id")


@query("""
WITH done AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS hit FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT o.o_orderkey, d.hit FROM orders o LEFT JOIN done d USING (o_custkey) WHERE o.o_orderstatus = 'P'""")
def cache_lookup(spark, table):
    o = table("orders")
    return admission.reusable(o.where("o_orderstatus = 'P'"), o.where("o_orderstatus = 'F'"), ["o_custkey"], "o_orderkey", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "hit")


@query("""
SELECT user_id, coalesce(sum(CAST(round(value * 100) AS BIGINT)) FILTER (WHERE ts >= TIMESTAMP '2024-01-15'), 0)::BIGINT AS day_cents, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS month_cents,
CASE WHEN sum(CAST(round(value * 100) AS BIGINT)) + 5000 > 300000 THEN 'month' WHEN coalesce(sum(CAST(round(value * 100) AS BIGINT)) FILTER (WHERE ts >= TIMESTAMP '2024-01-15'), 0) + 5000 > 150000 THEN 'day' END AS reason FROM events GROUP BY user_id""")
def budget_windows(spark, table):
    recent = F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")
    spent = table("events").groupBy("user_id").agg(F.coalesce(F.sum(F.when(recent, _cents())), F.lit(0)).cast("long").alias("day_cents"), F.sum(_cents()).alias("month_cents"))
    return spent.withColumn("reason", verdict.budget_reason(F.col("month_cents"), F.col("day_cents"), 5000, 300000, 150000))


@query("SELECT event_id FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-20' AND user_id NOT IN (SELECT DISTINCT user_id FROM events WHERE value > 300)")
def retention_anti(spark, table):
    e = table("events")
    return admission.retained(e.where(F.to_date("ts") >= F.lit("2024-01-20").cast("date")), e.where("value > 300"), ["user_id"]).select("event_id")


@query("SELECT code, n, first_us, last_us FROM (SELECT user_id AS code, count(*) AS n, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM events WHERE event_type = 'error' GROUP BY 1) ORDER BY first_us, code LIMIT 20")
def alert_digest(spark, table):
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return admission.digest(table("events").where("event_type = 'error'"), "user_id", "ts").select("code", "n", us(F.col("first")).alias("first_us"), us(F.col("last")).alias("last_us"))


@query("""
SELECT e.event_id, p.event_id AS previous, p.value AS previous_value FROM (SELECT * FROM events WHERE event_type = 'error') e
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def asof_previous(spark, table):
    e = table("events").select("event_id", "user_id", "ts", "event_type", "value")
    errors = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    bought = e.where("event_type = 'purchase'").select(F.col("event_id").alias("previous"), "user_id", "ts", "value")
    out = joins.as_of_backward(errors, bought, ["user_id"], "ts", ["previous", "value"], "previous")
    return out.select("event_id", F.col("asof_previous").alias("previous"), F.col("asof_value").alias("previous_value"))


@query("""
WITH p AS (SELECT DISTINCT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * 100 + l_linenumber AS place, l_suppkey % 10 AS f FROM lineitem),
s AS (SELECT p_partkey AS span, p_partkey % 10 AS f, (p_size * 97) % 4000 AS a, (p_size * 97) % 4000 + 50 + p_partkey % 900 AS b FROM part),
h AS (SELECT place, f, arg_min(span, (b - a, span)) AS span FROM (SELECT DISTINCT place, f FROM p) JOIN s USING (f) WHERE place >= a AND place < b GROUP BY place, f)
SELECT l_orderkey, l_linenumber, place, f, span FROM p JOIN h USING (place, f)""")
def innermost_region(spark, table):
    at = table("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("long") * 100 + F.col("l_linenumber")).alias("place"), (F.col("l_suppkey") % 10).alias("f")).distinct()
    a = F.col("p_size") * 97 % 4000
    spans = table("part").select(F.col("p_partkey").alias("span"), (F.col("p_partkey") % 10).alias("f"), a.cast("long").alias("a"), (a + 50 + F.col("p_partkey") % 900).alias("b"))
    return joins.innermost(at, spans, ["f"], "place", "a", "b", "span", 512).select("l_orderkey", "l_linenumber", "place", "f", "span")


GLOBS = [("red widget", "exact"), ("red *", "red"), ("* bolt", "bolt"), ("s?all*", "small"), ("*e*", "any_e")]
GLOB_SQL = " UNION ALL ".join(f"SELECT {i} AS ord, '{g.replace('*', '%').replace('?', '_')}' AS pat, '{v}' AS val" for i, (g, v) in enumerate(GLOBS))


@query(f"WITH g AS ({GLOB_SQL}) SELECT p_partkey, arg_min(g.ord, g.ord) AS rule_ord, arg_min(g.val, g.ord) AS rule_value FROM part LEFT JOIN g ON p_name LIKE g.pat GROUP BY p_partkey")
def glob_first_rule(spark, table):
    return joins.first_rule(table("part").select("p_partkey", "p_name"), "p_name", GLOBS).select("p_partkey", "rule_ord", "rule_value")


@query("""
WITH k AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS key FROM part WHERE p_size < 25 UNION SELECT DISTINCT p_name FROM part WHERE p_size = 7)
SELECT p_partkey, (SELECT arg_max(key, length(key)) FROM k WHERE p_name = key OR starts_with(p_name, key || ' ')) AS longest FROM part""")
def prefix_longest(spark, table):
    p = table("part")
    known = p.where("p_size < 25").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("key")).union(p.where("p_size = 7").select("p_name"))
    return joins.longest_prefix(p.select("p_partkey", "p_name"), "p_name", known, "key", " ").select("p_partkey", "longest")


@query("""
WITH k AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS key FROM part UNION SELECT 'green thing')
SELECT key FROM k WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_retailprice < 905 AND (p_name = key OR starts_with(p_name, key || ' ')))""")
def anti_prefix(spark, table):
    p = table("part")
    known = p.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("key")).union(spark.createDataFrame([("green thing",)], "key string")).distinct()
    return joins.without_prefix(known, "key", p.where("p_retailprice < 905"), "p_name", " ").select("key")


@query("SELECT conv_id, turn, role, lead(turn) OVER w AS next_turn, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role)")
def next_marker_region(spark, table):
    return joins.with_next(table("conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn", "role"], ["turn", "role"])


@query("SELECT l_suppkey, l_returnflag, min((l_shipdate, l_orderkey, l_linenumber, l_partkey)).l_orderkey AS l_orderkey FROM (SELECT l_suppkey, l_returnflag, {'l_shipdate': l_shipdate, 'l_orderkey': l_orderkey} AS x, l_shipdate, l_orderkey, l_linenumber, l_partkey FROM lineitem) GROUP BY ALL".replace("min((l_shipdate, l_orderkey, l_linenumber, l_partkey)).l_orderkey", "min(x).l_orderkey"))
def first_seen(spark, table):
    return joins.first_by(table("lineitem"), ["l_suppkey", "l_returnflag"], ["l_shipdate", "l_orderkey"]).select("l_suppkey", "l_returnflag", "l_orderkey")


EDGE_SQL = "SELECT DISTINCT l_suppkey AS caller, l_suppkey * 7 + l_partkey AS callee FROM lineitem"


def _edges(table):
    """Calls of all lineitem rows: supplier l_suppkey calls node 7 * l_suppkey + l_partkey."""
    return table("lineitem").select(F.col("l_suppkey").alias("caller"), (F.col("l_suppkey") * 7 + F.col("l_partkey")).alias("callee")).distinct()


@query(f"""
WITH RECURSIVE e AS ({EDGE_SQL}), r AS (SELECT DISTINCT caller AS root, caller AS node, 0 AS depth FROM e
 UNION SELECT r.root, e.callee, r.depth + 1 FROM r JOIN e ON e.caller = r.node WHERE r.depth < 5)
SELECT root, node, min(depth) AS depth FROM r GROUP BY root, node""")
def bfs_depth5(spark, table):
    """From every caller over the calls of all rows."""
    edges = _edges(table).withColumn("at", F.col("callee"))
    roots = edges.select(F.col("caller").alias("root"), F.col("caller").alias("node")).distinct()
    return graph.walk(roots, edges, 5).select("root", "node", "depth")


@query(f"WITH RECURSIVE e AS ({EDGE_SQL}), r AS (SELECT s_suppkey AS node FROM supplier WHERE s_acctbal < 0 UNION SELECT e.callee FROM r JOIN e ON e.caller = r.node) SELECT node FROM r")
def closure(spark, table):
    """What the suppliers with a negative balance reach over the calls of all rows."""
    return graph.closure(table("supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("node")), _edges(table))


@query("SELECT page_id, regexp_extract_all(html, '(?s)<!--(.*?)-->', 1) AS blocks FROM pages")
def directive_blocks(spark, table):
    return table("pages").select("page_id", tx.html_comments(F.col("html")).alias("blocks"))


@query("SELECT page_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host FROM pages")
def url_hosts(spark, table):
    return table("pages").select("page_id", tx.url_host(F.col("url")).alias("host"))


@query("SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}') AS emails FROM documents")
def emails(spark, table):
    return table("documents").select("doc_id", tx.emails(F.col("text")).alias("emails"))


@query("SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1\x01', 'g'), '\x01'), lambda x: x <> '') AS sentences FROM documents")
def sentences(spark, table):
    return table("documents").select("doc_id", tx.plain_sentences(F.col("text")).alias("sentences"))


@query("""
SELECT doc_id, (len(t) - len(regexp_replace(t, '[\u200b\u202e\U000e0041]', '', 'g'))) AS invisible, regexp_matches(t, '[\u202a-\u202e\u2066-\u2069]') AS bidi
FROM (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN text || chr(8203) WHEN 1 THEN chr(8238) || text WHEN 2 THEN text || chr(917569) || chr(917569) ELSE text END AS t FROM documents)""")
def invisible_injected(spark, table):
    t = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("\u200b"))).when(F.col("doc_id") % 7 == 1, F.concat(F.lit("\u202e"), "text")).when(F.col("doc_id") % 7 == 2, F.concat("text", F.lit("\U000e0041\U000e0041"))).otherwise(F.col("text"))
    return table("documents").select("doc_id", t.alias("t")).select("doc_id", tx.invisible_count(F.col("t")).cast("long").alias("invisible"), tx.has_bidi(F.col("t")).alias("bidi"))


@query("SELECT page_id, contains(url, '.min.') OR list_max(list_transform(string_split(html, '\n'), lambda x: length(x))) > 1000 AS minified FROM pages")
def minified(spark, table):
    return table("pages").select("page_id", tx.is_minified(F.col("url"), F.col("html")).alias("minified"))


@query("SELECT p_partkey, [p_size, p_partkey % 10, p_partkey % 3] >= [10, 5, 1] AND [p_size, p_partkey % 10, p_partkey % 3] < [20, 0, 0] AS inside FROM part")
def semver_order(spark, table):
    v = F.array(F.col("p_size").cast("long"), F.col("p_partkey") % 10, F.col("p_partkey") % 3)
    return table("part").select("p_partkey", versions.within(v, [10, 5, 1], [20, 0, 0]).alias("inside"))


@query("SELECT p_partkey, 'name' AS field, p_name AS text FROM part UNION ALL SELECT p_partkey, 'description', p_type FROM part UNION ALL SELECT p_partkey, 'title', p_brand FROM part")
def tool_text_unpivot(spark, table):
    p = table("part").select(F.lit("p").alias("pkg"), F.col("p_partkey").cast("string").alias("tool"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.col("p_brand").alias("title"))
    return rules.tool_texts({"tools": rules.complete(p, "tools")}, names=True).select(F.col("tool").cast("long").alias("p_partkey"), "field", "text")


@query("SELECT event_id, CAST(round(value * 100) AS BIGINT) * 3 + event_id % 1000 * 15 AS micro_usd FROM events")
def tokens_cost(spark, table):
    return table("events").select("event_id", verdict.call_cost(_cents(), F.col("event_id") % 1000, 3, 15).alias("micro_usd"))


@query("SELECT event_type AS code, count(*) AS n, CASE WHEN event_type IN ('error', 'view') THEN true WHEN event_type = 'click' THEN false ELSE true END AS gives_back FROM events GROUP BY event_type")
def refund_lookup(spark, table):
    n = table("events").groupBy(F.col("event_type").alias("code")).agg(F.count("*").alias("n"))
    return n.select("code", "n", admission.gives_back(F.col("code"), {"error": True, "view": True, "click": False}).alias("gives_back"))


@query("SELECT o_custkey, count(*) AS items, CAST(coalesce(sum(len), 0) AS BIGINT) AS chars FROM (SELECT o_custkey, length(o_orderpriority) AS len, sum(length(o_orderpriority)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS running FROM orders) WHERE running <= 60 GROUP BY o_custkey")
def items_within_budget(spark, table):
    kept = service.within_budget(table("orders").select("o_custkey", "o_orderkey", "o_orderpriority"), ["o_custkey"], "o_orderpriority", "o_orderkey", 60)
    return kept.groupBy("o_custkey").agg(F.count("*").alias("items"), F.sum(F.length("o_orderpriority")).alias("chars"))


@query("SELECT c_mktsegment AS kind, CAST(c_custkey % 30 AS BIGINT) AS day, count(*) AS refusals FROM customer WHERE c_acctbal < 0 OR c_custkey % 3 = 0 GROUP BY ALL")
def refusal_counters(spark, table):
    return admission.counted_refusals(table("customer").where("c_acctbal < 0 OR c_custkey % 3 = 0"), F.col("c_mktsegment"), F.col("c_custkey") % 30)


@query("SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, greatest(0, count(*) FILTER (WHERE event_type <> 'click') - count(*) FILTER (WHERE event_type = 'error'))::BIGINT AS used FROM events WHERE event_type <> 'click' GROUP BY user_id, CAST(ts AS DATE)")
def refunds_once(spark, table):
    e = table("events").where("event_type <> 'click'")
    taken = e.select(F.col("event_id").alias("analysis_id"), F.to_date("ts").cast("string").alias("day"), F.col("user_id").alias("subject"))
    asked = e.where("event_type = 'error'").select(F.col("event_id").alias("analysis_id"))
    return admission.used_after_refunds(taken, asked.union(asked)).withColumnRenamed("subject", "user_id")
