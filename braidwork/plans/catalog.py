"""The registered queries over the fixture tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.functions import text as X
from braidwork.operators import claims as C
from braidwork.operators import expand, graph, hashing, ledger, report, trace
from braidwork.plans import file_catalog  # registers its queries
from braidwork.plans import models as M
from braidwork.plans.models import table
from braidwork.plans.registry import QUERIES, SQL, query  # noqa: F401
from braidwork.plans.session import cut_lineage
from braidwork.sources import bucketed
from braidwork.streaming import folds, ordered


def rounded(df: DataFrame, *columns: str, places: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# Ledger and telemetry


@query(f"WITH {M.RUNS} SELECT count(*) AS total, count(*) FILTER (hit_type = 'LOGICAL_HIT') AS logical_hits, count(*) FILTER (hit_type = 'CONTENT_HIT') AS content_hits, count(*) FILTER (hit_type = 'MISS') AS misses, round(sum(duration_ms), 2) AS duration_ms FROM runs")
def d3_hit_stats(spark, d):
    return rounded(ledger.hit_stats(M.runs(spark, d), F.col("hit_type"), F.col("duration_ms")), "duration_ms", places=2)


@query(f"WITH {M.RUNS} SELECT round(sum(k) FILTER (hit_type = 'LOGICAL_HIT'), 2) AS tax_ms, round(sum(duration_ms) FILTER (hit_type = 'LOGICAL_HIT'), 2) AS duration_ms, count(*) FILTER (hit_type = 'LOGICAL_HIT') AS hits, round(sum(k), 2) AS jitter_ms, round(sum(k) FILTER (hit_type = 'LOGICAL_HIT') / sum(duration_ms) FILTER (hit_type = 'LOGICAL_HIT'), 6) AS ratio FROM runs")
def d1_tax_saved(spark, d):
    k = ledger.json_number("props", "$.k")
    return rounded(rounded(ledger.tax_saved(M.runs(spark, d), F.col("hit_type"), k, F.col("duration_ms"), k), "tax_ms", "duration_ms", "jitter_ms", places=2), "ratio", places=6)


@query(f"WITH {M.RUNS} SELECT CAST(task_id AS VARCHAR) AS task_id, duration_ms FROM runs ORDER BY duration_ms DESC, CAST(task_id AS VARCHAR) LIMIT 1")
def d2_bottleneck(spark, d):
    return ledger.bottleneck(M.runs(spark, d), "task_id", "duration_ms")


@query("SELECT count(*) AS n FROM events")
def d4_ledger_count(spark, d):
    return M.runs(spark, d).agg(F.count(F.lit(1)).alias("n"))


_FORECAST = """WITH {runs}, r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY seq DESC) AS n FROM runs),
f AS (SELECT task_id, avg(duration_ms) FILTER (n <= {cap}) AS mean_ms, stddev_pop(duration_ms) FILTER (n <= {cap}) AS sd_ms, avg(CASE WHEN hit_type <> 'MISS' THEN 0.0 ELSE 1.0 END) AS miss_probability FROM r GROUP BY task_id)
SELECT task_id, round(mean_ms, 4) AS mean_ms, round(sd_ms, 4) AS sd_ms, round(miss_probability, 4) AS miss_probability, round(CASE WHEN mean_ms > 0 THEN least(1.0, greatest(0.0, sd_ms / mean_ms)) ELSE 0.0 END, 4) AS score FROM f"""


def _forecast(spark, d, cap):
    runs = M.runs(spark, d).withColumn("hit", F.col("hit_type") != ledger.MISS)
    return rounded(ledger.forecast(runs, cap), "mean_ms", "sd_ms", "miss_probability", "score")


@query(_FORECAST.format(runs=M.RUNS, cap=100))
def d5_forecast(spark, d):
    return _forecast(spark, d, 100)


@query(_FORECAST.format(runs=M.RUNS, cap=10))
def d5_forecast_short(spark, d):
    return _forecast(spark, d, 10)


@query("SELECT c_custkey AS task_id, CAST(1000 AS DOUBLE) AS mean_ms, CAST(0 AS DOUBLE) AS sd_ms, CAST(0.5 AS DOUBLE) AS miss_probability, CAST(0.5 AS DOUBLE) AS score FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def d5_forecast_unknown(spark, d):
    known = _forecast(spark, d, 100)
    tasks = table(spark, d, "customer").select(F.col("c_custkey").alias("task_id"))
    return ledger.forecast_for(tasks.join(known, "task_id", "left_anti"), known)


@query("SELECT event_type, count(*) AS tasks, round(count(*) * 450.0 * 0.25 * 100 / 3.6e6, 4) AS hours, round(count(*) * 5 / 60, 2) AS saved, printf('%.1f%%', CAST(count(*) AS DOUBLE)) AS gain FROM events GROUP BY event_type")
def d7_forecast_hours_and_d8_savings(spark, d):
    n = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("tasks"))
    s = report.savings(F.col("tasks"), F.lit(5))
    return n.select("event_type", "tasks", F.round(report.forecast_hours(F.col("tasks"), F.lit(0.25)), 4).alias("hours"), s.hours.alias("saved"), s.gain.alias("gain"))


@query("SELECT l_returnflag, round(least_ms, 2) AS least_ms, round(actual_ms, 2) AS actual_ms, round(least_ms / actual_ms * 100, 4) AS efficiency, round(actual_ms - least_ms, 2) AS saved_ms, CASE WHEN least_ms / actual_ms * 100 >= 90 THEN 'A+' WHEN least_ms / actual_ms * 100 >= 80 THEN 'A' WHEN least_ms / actual_ms * 100 >= 70 THEN 'B' WHEN least_ms / actual_ms * 100 >= 50 THEN 'C' ELSE 'D' END AS grade FROM (SELECT l_returnflag || CAST(l_linenumber AS VARCHAR) AS l_returnflag, sum(l_extendedprice * (1 - l_discount) * l_linenumber / 8) AS least_ms, sum(l_extendedprice) AS actual_ms FROM lineitem GROUP BY l_returnflag, l_linenumber)")
def d10_optimisation(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("l_returnflag")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * F.col("l_linenumber") / 8).alias("least_ms"), F.sum("l_extendedprice").alias("actual_ms"))
    return rounded(rounded(report.optimisation(g), "least_ms", "actual_ms", "saved_ms", places=2), "efficiency")


@query("WITH s AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'cached' WHEN o_orderpriority LIKE '5%' THEN 'condition-skip' WHEN o_orderpriority LIKE '4%' THEN 'dep-skip' WHEN o_orderkey % 7 <> 0 THEN 'failed' ELSE 'ok' END AS status FROM orders) SELECT count(*) FILTER (status <> 'condition-skip') AS total, count(*) FILTER (status = 'cached') AS cached, count(*) FILTER (status = 'dep-skip') AS skipped, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'ok') AS executed FROM s")
def d11_build_summary_b26_status(spark, d):
    s = ledger.status(F.col("o_orderstatus") == "F", F.col("o_orderpriority").startswith("5"), F.col("o_orderpriority").startswith("4"), F.col("o_orderkey") % 7)
    return ledger.build_summary(table(spark, d, "orders").select(s.alias("status")))


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, round(median(value), 4) AS median, max(value) FILTER (r = floor(n * 0.99)) AS p99, min(value) AS least, max(value) AS greatest FROM r GROUP BY event_type")
def d13_order_statistics(spark, d):
    return rounded(ledger.order_statistics(table(spark, d, "events"), ["event_type"], "value"), "median")


@query("SELECT count(*) FILTER (value < 50) AS hits, count(*) FILTER (value >= 50) AS misses, CAST(coalesce(sum(length(props)) FILTER (value < 50), 0) AS BIGINT) AS bytes FROM events")
def d22_counters(spark, d):
    return ledger.counters(table(spark, d, "events"), F.col("value") < 50, F.length("props")).select("hits", "misses", "bytes")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS path_ms, count(*) AS tasks FROM lineitem GROUP BY 1, 2")
def d10_path_totals(spark, d):
    return rounded(report.path_totals(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity"), "path_ms", places=2)


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id = 17")
def a7_point_lookup(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").cast("string").alias("logic_hash"), "event_id", "user_id", "event_type")
    return ledger.lookup(rows, "17").drop("logic_hash")


@query("SELECT event_id AS logic_hash, user_id AS task_id FROM events WHERE user_id = 8 AND event_type = 'click' AND event_id % 3 = 0 ORDER BY ts DESC, event_id LIMIT 1")
def a8_latest_success(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("logic_hash"), F.col("user_id").alias("task_id"), F.col("event_type").alias("content_hash"), F.col("ts").alias("timestamp"), (F.col("event_id") % 3).alias("exit_code"))
    return ledger.latest_success(rows, 8, "content_hash", "click").select("logic_hash", "task_id")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS n FROM events) WHERE n = 1")
def a8_latest_by_key(spark, d):
    return ledger.latest(table(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("WITH a AS (SELECT user_id, event_id, value FROM events WHERE event_id % 2 = 0), b AS (SELECT user_id, event_id, value FROM events WHERE event_id % 2 = 1 AND user_id % 3 = 0), la AS (SELECT user_id, max(event_id) AS event_id FROM a GROUP BY 1), lb AS (SELECT user_id, max(event_id) AS event_id FROM b GROUP BY 1) SELECT e.user_id, e.event_id, e.value FROM events e WHERE (e.user_id, e.event_id) IN (SELECT user_id, event_id FROM lb) OR ((e.user_id, e.event_id) IN (SELECT user_id, event_id FROM la) AND e.user_id NOT IN (SELECT user_id FROM lb))")
def s2_upsert(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "value")
    old = ledger.latest(e.where("event_id % 2 = 0"), ["user_id"], [F.desc("event_id")])
    return ledger.upsert(old, e.where("event_id % 2 = 1 AND user_id % 3 = 0"), "user_id", "event_id")


@query(SQL["s2_upsert"])
def s2_copy_on_write(spark, d):
    """The same in a ledger of buckets, of which an upsert writes those it touches, in two steps."""
    e, base = table(spark, d, "events").select("user_id", "event_id", "value"), file_catalog.folder(spark, "ledger")
    bucketed.create(e.where("event_id % 2 = 0"), base, "user_id", "event_id", 16)
    new = e.where("event_id % 2 = 1 AND user_id % 3 = 0")
    bucketed.upsert(new.where("user_id % 2 = 0"), base)
    bucketed.upsert(new.where("user_id % 2 = 1"), base)
    return bucketed.read(spark, base)


@query("SELECT p_partkey AS id, CASE WHEN p_size % 10 = 0 THEN 'condition-skip' WHEN p_partkey % 1000 IN (SELECT s_suppkey % 1000 FROM supplier WHERE s_suppkey % 3 = 0) THEN 'l2-hit' WHEN p_partkey % 1000 IN (SELECT c_custkey % 1000 FROM customer WHERE c_custkey % 5 = 0) AND (p_size % 2 = 1 OR p_partkey % 1000 IN (SELECT c_custkey % 1000 FROM customer WHERE c_custkey % 10 = 0)) THEN 'l1-hit' ELSE 'execute' END AS source FROM part")
def c7_waterfall(spark, d):
    tasks = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 1000).alias("key"), (F.col("p_size") % 10 != 0).alias("gate"), (F.col("p_size") % 2 == 0).alias("has_outputs"))
    keys = lambda t, c, k: table(spark, d, t).where(F.col(c) % k == 0).select((F.col(c) % 1000).alias("key"))
    return ledger.waterfall(tasks, keys("supplier", "s_suppkey", 3), keys("customer", "c_custkey", 5), keys("customer", "c_custkey", 10))


@query("SELECT s_suppkey, round(s_acctbal, 2) AS v, CASE WHEN s_suppkey % 2 = 1 OR s_suppkey = 0 THEN 'RED' WHEN s_nationkey = s_suppkey THEN 'GREEN' ELSE 'YELLOW' END AS grade FROM supplier")
def b33_repository_grade(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.round("s_acctbal", 2).alias("v"), report.repository_grade(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey"), F.col("s_nationkey")).alias("grade"))


@query("SELECT count(*) FILTER (lang = 'en' AND doc_id % 3 = 0) AS events, count(*) AS files, round(count(*) FILTER (lang = 'en' AND doc_id % 3 = 0) * 100.0 / count(*), 1) AS rate, round(count(*) FILTER (lang = 'en' AND doc_id % 3 = 0) * 300 / 3600, 2) AS hours FROM documents")
def d21_tax_rate(spark, d):
    return report.tax_rate(table(spark, d, "documents").select(((F.col("lang") == "en") & (F.col("doc_id") % 3 == 0)).alias("comment_only")))


@query(r"""WITH f AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN ' ' ELSE '/* ' || regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 ]', ' ', 'g') || ' */ let a = ' || doc_id || '; // end' || chr(10) || chr(10) || chr(9) || 'b = "' || repeat('/* kept */', doc_id % 5) || '";' END AS raw, 'let a = ' || doc_id || '; b = "' || repeat('/* kept */', doc_id % 5) || '";' AS logic FROM documents),
v AS (SELECT CASE WHEN raw = ' ' THEN 0.0 ELSE greatest(0.0, 1 - length(logic) / length(raw)) END AS v FROM f) SELECT round(avg(v), 6) AS volatility, count(*) AS files, count(*) FILTER (v >= 0.3) AS volatile FROM v""")
def d6_volatility(spark, d):
    """documents as the comments of source files, whose comments and white space are stripped."""
    k = F.col("doc_id").cast("string")
    words = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9 ]", " ")
    source = F.concat(F.lit("/* "), words, F.lit(" */ let a = "), k, F.lit('; // end\n\n\tb = "'), F.repeat(F.lit("/* kept */"), (F.col("doc_id") % 5).cast("int")), F.lit('";'))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 9 == 0, " ").otherwise(source).alias("content"), F.lit("typescript").alias("language"))
    return rounded(report.scan_volatility(docs), "volatility", places=6)


@query("SELECT CASE WHEN event_type = 'view' THEN 'warning' ELSE event_type END AS severity, CASE WHEN user_id % 4 = 0 THEN 'unknown' ELSE CAST(user_id % 4 AS VARCHAR) END AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def d12_finding_counts(spark, d):
    e = table(spark, d, "events").select(F.when(F.col("event_type") != "view", F.col("event_type")).alias("severity"), F.when(F.col("user_id") % 4 != 0, (F.col("user_id") % 4).cast("string")).alias("kind"))
    return report.finding_counts(e)


@query("SELECT count(*) FILTER (event_id % 5 <> 0 AND CAST(json_extract_string(props, '$.k') AS INT) = 29) AS n FROM events")
def d20_attested(spark, d):
    doc = F.when(F.col("event_id") % 5 == 0, F.lit("{broken")).otherwise(F.replace("props", F.lit('"k"'), F.lit('"level"')))
    return report.attested(table(spark, d, "events").select(doc.alias("doc")), "29")


@query("SELECT CAST(sum(n) AS BIGINT) AS tasks, count(*) AS waves, CAST(round(sum(h) * 100.0 / sum(n)) AS BIGINT) AS hit_rate FROM (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'click') AS h FROM events GROUP BY user_id)")
def d23_dashboard(spark, d):
    w = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("size"), F.count(F.when(F.col("event_type") == "click", 1)).alias("h"))
    return report.dashboard(w, F.col("h"), F.col("size"))


@query("WITH m AS (SELECT event_type AS kind, avg(value) AS mean_ms, sum(user_id) AS b, sum(value) AS ms FROM events GROUP BY 1) SELECT kind, round(mean_ms, 4) AS mean_ms, round(mean_ms / (SELECT min(mean_ms) FROM m) - 1, 4) AS overhead, round(b / 1e3 / ms, 6) AS mb_s FROM m")
def d27_timing_means(spark, d):
    t = table(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("value").alias("ms"), F.col("user_id").alias("bytes"))
    return rounded(rounded(report.timing_means(t), "mean_ms", "overhead"), "mb_s", places=6)


@query("""WITH f AS (SELECT p_size + 2 * (p_size % 7 + 1) AS l, p_size % 7 + 1 AS d, p_size % 9 AS p FROM part UNION ALL SELECT 1, 1, 5 FROM part WHERE p_size % 2 = 0)
SELECT count(*) AS functions, count(*) FILTER (l > 32) AS over_lines, count(*) FILTER (d > 3) AS over_depth, count(*) FILTER (p > 4) AS over_parameters, count(*) FILTER (l > 32 OR d > 3 OR p > 4) AS over_any FROM f""")
def d28_oversized(spark, d):
    """parts as source files of a function each, and of a method that never ends in every other."""
    n, deep = F.col("p_size").cast("int"), (F.col("p_size") % 7).cast("int")
    names = F.array_join(F.when(n % 9 > 0, F.transform(F.sequence(F.lit(1), F.greatest(n % 9, F.lit(1))), lambda i: F.concat(F.lit("p"), i.cast("string")))).otherwise(F.array()), ", ")
    body = F.concat(F.repeat(F.lit("  if (x) {\n"), deep), F.repeat(F.lit("    x = call(1); // }\n".replace("// }", "")), n), F.repeat(F.lit("  }\n"), deep), F.lit("}\n"))
    source = F.concat(F.lit("export async function f"), F.col("p_partkey").cast("string"), F.lit("("), names, F.lit(") {\n"), body, F.when(n % 2 == 0, "  static m(a, b, c, d, e): void {\n").otherwise(""))
    return report.function_report(table(spark, d, "part").select(F.col("p_partkey").alias("path"), source.alias("content")))


# Claims


@query(f"WITH {M.CLAIMS} SELECT a.task_id AS inner_id, a.path AS inner_path, b.task_id AS outer_id, b.path AS outer_path FROM claims a JOIN claims b ON a.path = b.path OR starts_with(a.path, b.path || '/')")
def c3_containment_join(spark, d):
    c = M.claims(spark, d).select("task_id", "path")
    return C.containment_join(c, c)


@query(f"WITH {M.CLAIMS}, w AS (SELECT ta % 4 AS wave, least(ta, tb) AS task_a, greatest(ta, tb) AS task_b, pa FROM pairs WHERE ta % 4 = tb % 4 AND (ma = 'write' OR mb = 'write')) SELECT wave, task_a, task_b, min(pa) AS resource FROM w GROUP BY 1, 2, 3")
def c4_wave_conflicts(spark, d):
    return C.wave_conflicts(M.claims(spark, d).withColumn("wave", F.col("task_id") % 4).withColumn("proto", F.lit("fs")))


@query(f"WITH {M.CLAIMS}, w AS (SELECT ta % 4 AS wave, least(ta, tb) AS task_a, greatest(ta, tb) AS task_b, pa FROM pairs WHERE ta % 4 = tb % 4 AND (ma = 'write' OR mb = 'write')) SELECT 'collision' AS type, task_a AS task_id, '{{\"task_b\":' || task_b || ',\"resource\":\"' || min(pa) || '\"}}' AS payload FROM w GROUP BY wave, task_a, task_b")
def j3_collision_events(spark, d):
    return folds.collision_events(C.wave_conflicts(M.claims(spark, d).withColumn("wave", F.col("task_id") % 4).withColumn("proto", F.lit("fs"))))


@query("WITH c AS (SELECT page_id AS task_id, page_id % 4 AS wave, split_part(split_part(url, '//', 2), '/', 1) AS path FROM pages) SELECT a.wave, a.task_id AS task_a, b.task_id AS task_b, a.path AS resource FROM c a JOIN c b ON a.wave = b.wave AND a.path = b.path AND a.task_id < b.task_id")
def c5_exact_claims(spark, d):
    host = F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1))
    p = table(spark, d, "pages").select(F.col("page_id").alias("task_id"), (F.col("page_id") % 4).alias("wave"), F.lit("port").alias("proto"), host.alias("path"), F.lit(False).alias("is_dir"), F.lit("read").alias("mode"))
    return C.wave_conflicts(p)


_SHADOW = f"""WITH {M.CLAIMS}, w AS (SELECT least(ta, tb) AS a, greatest(ta, tb) AS b, pa, ma = 'write' AND mb = 'write' AS ww, CASE WHEN (ma = 'write') = (ta < tb) THEN 1 ELSE 2 END AS writer FROM pairs WHERE ma = 'write' OR mb = 'write'),
g AS (SELECT a, b, min(pa) FILTER (ww) AS shadow, min(pa) FILTER (NOT ww AND writer = 2) AS second_writes, min(pa) FILTER (NOT ww AND writer = 1) AS first_writes FROM w GROUP BY a, b),
k AS (SELECT *, a % 10 = b % 10 AS declared FROM g)
SELECT CASE WHEN shadow IS NULL AND second_writes IS NOT NULL THEN b ELSE a END AS task_a, CASE WHEN shadow IS NULL AND second_writes IS NOT NULL THEN a ELSE b END AS task_b, coalesce(shadow, second_writes, first_writes) AS resource,
CASE WHEN shadow IS NOT NULL AND declared THEN 'declared' ELSE 'implicit' END AS ordering, CASE WHEN shadow IS NOT NULL THEN 'shadow' ELSE 'implicit-dependency' END AS kind FROM k WHERE shadow IS NOT NULL OR NOT declared"""


@query(_SHADOW)
def c6_shadow_audit(spark, d):
    """Every page's task declares the one ten before it, so it comes behind all that end in the same digit."""
    p = table(spark, d, "pages").where("page_id >= 10").select((F.col("page_id") - 10).alias("src"), F.col("page_id").alias("dst"))
    return C.shadow_audit(M.claims(spark, d), p)


@query(f"WITH {M.CLAIMS}, s AS (SELECT DISTINCT least(ta, tb) AS a, greatest(ta, tb) AS b FROM pairs WHERE ma = 'write' AND mb = 'write') SELECT 'error' AS severity, 'collision' AS kind, count(*) AS n FROM s")
def b32_findings(spark, d):
    found = C.wave_conflicts(M.claims(spark, d).where("mode = 'write'").withColumn("wave", F.lit(0)).withColumn("proto", F.lit("fs")))
    none = found.limit(0).withColumn("kind", F.lit("shadow"))
    return C.findings(found, none).groupBy("severity", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH p AS (SELECT page_id, url, regexp_replace(regexp_extract(url, '{M.URL}', 1), '/+$', '') AS path FROM pages) SELECT page_id, url, path, NOT starts_with(path, '/') AND NOT list_contains(string_split(path, '/'), '..') AS safe, split_part(url, ':', 1) AS proto, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '.' END AS dir, regexp_extract(path, '([^/]*)/*$', 1) AS base, CASE WHEN path = '' THEN '.' ELSE path END AS folded, page_id % 2 = 1 AS is_dir FROM p")
def b1_b2_b3_b4_paths(spark, d):
    bare = F.regexp_extract("url", M.URL, 1)
    path = X.normalise_fs_path(F.concat(F.lit("fs:./"), bare))
    claim = C.normalised_claim(F.concat(F.lit("fs:x/.//../"), F.regexp_replace(bare, "/+$", ""), F.when(F.col("page_id") % 2 == 1, "/").otherwise("")))
    p = table(spark, d, "pages").select("page_id", "url", path.alias("path"), X.protocol(F.col("url")).alias("proto"), claim.alias("c"))
    return p.select("page_id", "url", "path", X.is_safe_path(F.col("path")).alias("safe"), "proto", X.dirname(F.col("path")).alias("dir"), X.basename(F.col("path")).alias("base"), F.col("c.path").alias("folded"), F.when(F.col("path") == "", F.col("page_id") % 2 == 1).otherwise(F.col("c.is_dir")).alias("is_dir"))


@query(f"""WITH p AS (SELECT page_id, regexp_replace(regexp_extract(url, '{M.URL}', 1), '/+$', '') AS path FROM pages), q AS (SELECT DISTINCT path, CASE WHEN length(path) % 2 = 0 THEN '/' ELSE '' END AS e FROM p WHERE path <> ''),
n AS (SELECT path AS x, lead(path) OVER (ORDER BY path) AS y FROM q),
k AS (SELECT a.path AS x, b.path AS y FROM q a JOIN q b ON a.path = b.path OR starts_with(a.path, b.path || '/') UNION SELECT b.path, a.path FROM q a JOIN q b ON starts_with(a.path, b.path || '/') UNION SELECT x, y FROM n WHERE y IS NOT NULL)
SELECT a.path || a.e AS a, b.path || b.e AS b, a.path = b.path OR starts_with(b.path, a.path || '/') AS covers, a.path = b.path OR starts_with(a.path, b.path || '/') OR starts_with(b.path, a.path || '/') AS overlap,
CASE WHEN a.path = b.path THEN a.path || a.e WHEN a.e = '/' AND starts_with(b.path || b.e, a.path || '/') THEN b.path || b.e WHEN b.e = '/' AND starts_with(a.path || a.e, b.path || '/') THEN a.path || a.e END AS contained
FROM k JOIN q a ON a.path = x JOIN q b ON b.path = y""")
def b9_b10_b11_predicates(spark, d):
    """All paths of pages against those that hold them, those they hold, and their neighbours in order; every other length a directory."""
    path = F.regexp_replace(F.regexp_extract("url", M.URL, 1), "/+$", "")
    q = table(spark, d, "pages").select(path.alias("path")).where("path != ''").distinct()
    t = q.select(F.col("path").alias("task_id"), "path")
    held = C.containment_join(t, t).select(F.col("inner_path").alias("x"), F.col("outer_path").alias("y"))
    placed = graph._placed(q, ["path"], 0)
    after = placed.select(F.col("path").alias("x"), (F.col("_pos") + 1).alias("_pos")).join(placed.select(F.col("path").alias("y"), "_pos"), "_pos").select("x", "y")
    end = lambda c: F.concat(F.col(c), F.when(F.length(c) % 2 == 0, "/").otherwise(""))
    both = held.unionByName(held.select(F.col("y").alias("x"), F.col("x").alias("y"))).unionByName(after).distinct().select(end("x").alias("a"), end("y").alias("b"))
    fs = lambda c: F.concat(F.lit("fs:"), F.col(c))
    return both.select("a", "b", C.write_covers(F.concat(F.lit("./"), "a"), fs("b")).alias("covers"), C.segments_overlap(fs("a"), fs("b")).alias("overlap"), C.directory_contains(F.col("a"), F.col("b")).alias("contained"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'fs' WHEN 'click' THEN 'fs' WHEN 'signup' THEN 'env' WHEN 'purchase' THEN 'port' END AS proto, CASE event_type WHEN 'view' THEN 'write' WHEN 'click' THEN 'read' WHEN 'signup' THEN 'read' WHEN 'purchase' THEN 'write' END AS mode, CASE event_type WHEN 'purchase' THEN 'port:' || CAST(user_id AS VARCHAR) WHEN 'error' THEN NULL ELSE CAST(user_id AS VARCHAR) END AS path FROM events")
def b5_b6_claim_arguments(spark, d):
    arg = F.concat(F.element_at(F.create_map(*[F.lit(x) for x in ("view", "fs:", "click", "fs:read:", "signup", "env:", "purchase", "port:", "error", "db:")]), F.col("event_type")), F.col("user_id").cast("string"))
    return table(spark, d, "events").select("event_id", C.parsed_argument(arg).alias("c")).select("event_id", "c.proto", "c.mode", "c.path")


@query(r"SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'unknown' WHEN s_suppkey % 2 = 0 THEN regexp_extract(c, '^(.*)-(v.*)$', 1) ELSE c END AS name, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 5 <> 0 THEN regexp_extract(c, '^(.*)-(v.*)$', 2) ELSE 'unknown' END AS version FROM (SELECT s_suppkey, 'agent-' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '-vm' || s_suppkey % 3 || '-v1.' || s_suppkey ELSE '' END AS c FROM supplier)")
def b7_callers(spark, d):
    k = F.col("s_suppkey")
    name = F.concat(F.lit("agent-"), k.cast("string"))
    caller = F.when(k % 2 == 0, F.concat(name, F.lit("-vm"), (k % 3).cast("string"), F.lit("-v1."), k.cast("string"))).otherwise(name)
    caller = F.when(k % 10 == 0, F.lit("")).when(k % 5 == 0, F.lit(None)).otherwise(caller)
    return table(spark, d, "supplier").select("s_suppkey", X.caller_name(caller).alias("name"), X.caller_version(caller).alias("version"))


@query("WITH t AS (SELECT DISTINCT l_orderkey AS id, 'r/' || l_suppkey AS path FROM lineitem UNION SELECT DISTINCT l_orderkey, 'q/' || l_partkey FROM lineitem UNION SELECT DISTINCT l_orderkey, 'w/' || l_linenumber FROM lineitem) SELECT id, path FROM t WHERE (id % 2 = 1 OR path NOT LIKE 'r/%') AND (id % 3 <> 0 OR path <> 'w/2')")
def b8_cache_inputs(spark, d):
    """Reads with ./ and trailing slashes, claims of several protocols, writes of directories and files in other spellings."""
    k = F.col("l_linenumber")
    arr = lambda p, c, e="": F.collect_list(F.concat(F.lit(p), F.col(c).cast("string"), F.lit(e)))
    t = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.concat(arr("./r/", "l_suppkey"), arr("w\\", "l_linenumber", "/"), F.collect_set(F.when(k == 1, ""))).alias("reads"), F.concat(arr("fs:q/", "l_partkey"), arr("env:", "l_partkey"), arr("FS:no/", "l_partkey")).alias("claims"))
    return C.cache_inputs(t.withColumn("writes", F.array_compact(F.array(F.when(F.col("id") % 2 == 0, "fs:./r/"), F.when(F.col("id") % 3 == 0, "w/2"), F.lit("./")))))


@query("SELECT o_orderkey, (o_orderstatus IN ('F', 'O')) AND (o_orderpriority = '1-URGENT' OR o_orderpriority LIKE '%LOW' OR o_orderkey % 10 = 0) AS open FROM orders")
def b12_gate(spark, d):
    branch = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderpriority"))
    ok = X.branch_matches(branch, F.lit("1-URGENT")) | X.branch_matches(branch, F.lit("*LOW"))
    return table(spark, d, "orders").select("o_orderkey", expand.gate(F.array(F.lit("F"), F.lit("O")), F.col("o_orderstatus"), ok).alias("open"))


@query("SELECT c_custkey, array_to_string(list_sort(CASE WHEN c_custkey % 2 = 0 THEN [c_mktsegment, 'HOME', 'PATH', 'TERM'] ELSE ['HOME', 'PATH', 'TERM'] END), ',') AS passed FROM customer")
def b13_allowed_env(spark, d):
    env = F.create_map(*[F.lit(x) for x in ("PATH", "/bin", "SECRET", "s", "TERM", "t", "SHELL", "sh", "HOME", "h")], F.col("c_mktsegment"), F.lit("1"))
    claimed = F.when(F.col("c_custkey") % 2 == 0, F.array("c_mktsegment", F.lit("ABSENT"))).otherwise(F.array(F.lit("none")))
    return table(spark, d, "customer").select("c_custkey", F.array_join(F.array_sort(F.map_keys(expand.allowed_env(env, claimed))), ",").alias("passed"))


@query("SELECT 'env' AS kind, p_brand AS name, CASE WHEN p_brand = 'Brand#2' THEN 'platform' ELSE 'claim' END AS class FROM (SELECT DISTINCT p_brand FROM part) WHERE p_brand <> 'Brand#1' UNION ALL SELECT 'flag', p_type, 'logic' FROM (SELECT DISTINCT p_type FROM part)")
def b14_settings(spark, d):
    p = table(spark, d, "part")
    s = p.select(F.lit("env").alias("kind"), F.col("p_brand").alias("name")).unionByName(p.select(F.lit("flag").alias("kind"), F.col("p_type").alias("name"))).distinct()
    dim = spark.createDataFrame([("env", "Brand#1", "noise"), ("env", "Brand#2", "platform")], "kind string, name string, class string")
    return expand.classified_settings(s, dim)


@query("WITH s AS (SELECT p_partkey AS seq, coalesce(nullif(trim(regexp_replace(regexp_replace('@' || p_name || CASE WHEN p_partkey % 3 = 0 THEN '  c.d:e ' ELSE '' END, '[^a-zA-Z0-9_-]', '-', 'g'), '-', ' ', 'g')), ''), 'task') AS slug FROM part), n AS (SELECT seq, replace(slug, ' ', '-') AS slug, row_number() OVER (PARTITION BY slug ORDER BY seq) AS n FROM s) SELECT seq, CASE WHEN n = 1 THEN slug ELSE slug || '-' || n END AS id FROM n")
def b15_unique_ids(spark, d):
    """Names with runs of characters that ids don't have; natural collisions are tested against the sequential rule."""
    name = F.concat(F.lit("@"), "p_name", F.when(F.col("p_partkey") % 3 == 0, "  c.d:e ").otherwise(""))
    return expand.unique_ids(table(spark, d, "part").select(F.col("p_partkey").alias("seq"), name.alias("name")))


@query("SELECT o_orderkey AS id, list_sort(list(DISTINCT 'p' || l_partkey)) AS dependencies, list_sort(list(DISTINCT 'd/' || l_suppkey)) AS inputs, CAST(CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 7 ELSE 300000 END AS INTEGER) AS timeout, o_orderkey % 2 = 1 AS cache, CASE WHEN o_orderkey % 5 <> 0 THEN 'w/x' END AS cwd FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def b16_normal_tasks(spark, d):
    arr = lambda p, c: F.collect_list(F.concat(F.lit(p), F.col(c).cast("string")))
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(arr("p", "l_partkey").alias("dependencies"), F.concat(arr("d\\", "l_suppkey"), arr("d/", "l_suppkey")).alias("inputs"))
    k = F.col("id")
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).join(li, "id")
    return expand.normal_tasks(t.select("id", "dependencies", "inputs", F.when(k % 3 == 0, 0).when(k % 3 == 1, 7).alias("timeout"), F.when(k % 2 == 0, False).alias("cache"), F.when(k % 5 != 0, "w\\x").when(k % 2 == 0, "").alias("cwd")))


@query("SELECT s_suppkey AS id FROM supplier WHERE s_suppkey NOT IN (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_linenumber = 7)")
def b20_missing_outputs(spark, d):
    w = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").cast("string").alias("path"))
    f = table(spark, d, "lineitem").where("l_quantity > 49 AND l_linenumber = 7").select(F.col("l_suppkey").cast("string").alias("path")).distinct()
    return C.missing_outputs(w, f).select("id")


@query("SELECT doc_id, right(text, 50) AS tail, length(text) AS n FROM documents")
def b24_log_tail(spark, d):
    return table(spark, d, "documents").select("doc_id", X.tail(F.col("text"), 50).alias("tail"), F.length("text").cast("bigint").alias("n"))


@query("SELECT p_partkey, regexp_matches(p_type || '.' || p_partkey, '^[a-zA-Z0-9_.-]+$') AS ok, regexp_matches(p_name, '^[a-zA-Z0-9_.-]+$') AS bad FROM part")
def b25_hash_names(spark, d):
    return table(spark, d, "part").select("p_partkey", X.is_hash_name(F.concat_ws(".", "p_type", F.col("p_partkey").cast("string"))).alias("ok"), X.is_hash_name(F.col("p_name")).alias("bad"))


@query("SELECT o_orderkey, o_orderkey % 4 = 0 OR epoch_ms(o_orderdate) > 900000000000 AS stale FROM orders")
def b27_stale(spark, d):
    lock = F.when(F.col("o_orderkey") % 4 != 0, F.lit(900_000_000_000))
    return table(spark, d, "orders").select("o_orderkey", hashing.stale(X.epoch_ms(F.col("o_orderdate")), lock).alias("stale"))


@query("""WITH t AS (SELECT s_suppkey AS k, CASE s_suppkey % 6 WHEN 0 THEN 'a b' WHEN 1 THEN 'x@' WHEN 2 THEN 'a.b' WHEN 3 THEN 'é' ELSE 'ok_-' END || s_suppkey AS id FROM supplier)
SELECT id, 'id' AS rule FROM t WHERE k % 6 < 4 UNION ALL SELECT id, 'self-dependency' FROM t WHERE k % 5 = 0 UNION ALL SELECT id, 'unknown-dependency' FROM t WHERE k % 7 = 0 UNION ALL SELECT id, 'cmd' FROM t WHERE k % 11 = 0
UNION ALL SELECT id, 'matrix-axes' FROM t WHERE k % 13 = 0 UNION ALL SELECT id, 'matrix-rows' FROM t WHERE k % 13 = 1""")
def b28_violations(spark, d):
    k = F.col("s_suppkey")
    start = F.when(k % 6 == 0, "a b").when(k % 6 == 1, "x@").when(k % 6 == 2, "a.b").when(k % 6 == 3, "é").otherwise("ok_-")
    deps = F.array_compact(F.array(F.when(k % 5 == 0, F.col("id")), F.when(k % 7 == 0, F.lit("nowhere"))))
    axes = F.map_from_arrays(F.array(*[F.lit(x) for x in "abcde"]), F.array(*[F.array(F.lit("1"))] * 5))
    many = F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array(*[F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x.cast("string")) for n in (16, 17)]))
    t = table(spark, d, "supplier").select(k, F.concat(start, k.cast("string")).alias("id")).select("id", F.when(k % 11 != 0, F.array(F.lit("x"))).alias("cmd"), deps.alias("deps"), F.when(k % 13 == 0, axes).when(k % 13 == 1, many).alias("matrix"))
    return expand.constraint_violations(t)


@query(r"""WITH d AS (SELECT doc_id, text AS a, CASE WHEN doc_id % 2 = 0 THEN text || ' /* note' || chr(10) || 'more */ // end' ELSE text || 'changed' END AS b FROM documents),
x AS (SELECT doc_id, a, b, regexp_replace(regexp_replace(regexp_replace(a, '(?s)/\*.*?\*/', '', 'g'), '//[^\n]*', '', 'g'), '[ \t\n\x0B\f\r]+', '', 'g') AS p, regexp_replace(regexp_replace(regexp_replace(b, '(?s)/\*.*?\*/', '', 'g'), '//[^\n]*', '', 'g'), '[ \t\n\x0B\f\r]+', '', 'g') AS q FROM d)
SELECT doc_id, a <> b AND p = q AS comment_only FROM x""")
def b30_comment_only(spark, d):
    after = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" /* note\nmore */ // end"))).otherwise(F.concat("text", F.lit("changed")))
    return table(spark, d, "documents").select("doc_id", hashing.comment_only(F.col("text"), after).alias("comment_only"))


# Joins and expansion


@query("SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def c1_c2_unresolved(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    return graph.unresolved(e, table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")))


@query("SELECT 'd/' || doc_id AS path, CASE WHEN doc_id % 5 = 0 AND doc_id % 10 <> 4 THEN 'logically-unchanged' ELSE 'changed' END AS change FROM documents WHERE doc_id % 5 IN (0, 1, 2) OR doc_id % 10 = 4")
def c8_snapshot_diff(spark, d):
    return hashing.snapshot_diff(*M.snapshots(spark, d))


@query("WITH f AS (SELECT DISTINCT user_id AS pid, event_type, CAST(floor(value) AS INT) AS path FROM events) SELECT DISTINCT w.pid AS producer, r.pid AS consumer FROM f w JOIN f r ON w.path = r.path AND w.event_type = 'purchase' AND r.event_type = 'click' AND w.pid < r.pid")
def c9_read_after_write(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("pid"), F.floor("value").cast("string").alias("path"), F.when(F.col("event_type") == "purchase", "write").when(F.col("event_type") == "click", "read").alias("mode")).where("mode is not null").distinct()
    return trace.read_after_write(e, e.select("pid", F.col("pid").alias("idx")).distinct())


@query("""WITH p AS (SELECT p_partkey, replace(p_name, ' ', '/') AS n FROM part),
f AS (SELECT DISTINCT CASE p_partkey % 7 WHEN 0 THEN 'src/' || n || '.ts' WHEN 1 THEN 'src/' || n || '/index.ts' WHEN 2 THEN 'src/' || n || '.tsx' WHEN 3 THEN 'src/' || n || '/__init__.ts' WHEN 4 THEN 'src/' || n || '/index.tsx' WHEN 5 THEN 'src/' || n ELSE n || '.tsx' END AS id FROM p),
i AS (SELECT DISTINCT 'src/main.ts' AS source, CASE WHEN p_partkey % 11 = 0 THEN '../../' || n WHEN p_partkey % 2 = 0 THEN './' || n ELSE n END AS target, n, CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE 1 END AS inside FROM p),
c AS (SELECT source, target, b.r * 10 + t.r AS rank, b.base || t.tail AS id FROM i, LATERAL (VALUES (0, 'src/' || n), (1, n)) b(r, base), (VALUES (0, ''), (1, '.ts'), (2, '/index.ts'), (3, '/__init__.ts'), (4, '.tsx'), (5, '/index.tsx'), (6, '/__init__.tsx')) t(r, tail) WHERE inside = 1)
SELECT source, target, 'static' AS kind, arg_min(id, rank) AS resolved FROM c WHERE id IN (SELECT id FROM f) GROUP BY source, target""")
def c10_imports(spark, d):
    """Part names as files in every form that an import may mean, imported from src/main.ts relatively, from the root, and out of it."""
    n, k = F.replace("p_name", F.lit(" "), F.lit("/")), F.col("p_partkey")
    forms = ["src/{}.ts", "src/{}/index.ts", "src/{}.tsx", "src/{}/__init__.ts", "src/{}/index.tsx", "src/{}", "{}.tsx"]
    form = F.element_at(F.array(*[F.lit(x) for x in forms]), (k % 7 + 1).cast("int"))
    p = table(spark, d, "part")
    files = p.select(F.replace(form, F.lit("{}"), n).alias("id")).distinct()
    target = F.when(k % 11 == 0, F.concat(F.lit("../../"), n)).when(k % 2 == 0, F.concat(F.lit("./"), n)).otherwise(n)
    return expand.resolve_imports(files, p.select(F.lit("src/main.ts").alias("source"), target.alias("target"), F.lit("static").alias("kind")).distinct(), (".ts", ".tsx"))


_PACKAGES = """pk AS (SELECT DISTINCT p_brand AS package FROM part), sc AS (SELECT package, script FROM pk, (VALUES ('build'), ('test')) v(script) WHERE script = 'build' OR length(package) = 7),
inner_ AS (SELECT a.package, b.package AS other FROM pk a JOIN pk b ON b.package = a.package || '0')"""


@query(f"WITH {_PACKAGES} SELECT other || '#build' AS src, package || '#build' AS dst FROM inner_ UNION SELECT package || '#build', package || '#test' FROM sc WHERE script = 'test'")
def c11_workspace(spark, d):
    pk = table(spark, d, "part").select(F.col("p_brand").alias("package")).distinct()
    scripts = pk.select(F.explode(F.array(F.lit("build"), F.lit("test"))).alias("script"), "package").where("script = 'build' OR length(package) = 7")
    inner = pk.join(pk.select(F.col("package").alias("o")), F.concat("package", F.lit("0")) == F.col("o"), "left").select("package", F.array_compact(F.array("o")).alias("internal"))
    dep = spark.createDataFrame([("build", "^build"), ("test", "build")], "script string, on string")
    return expand.workspace_tasks(inner, scripts, dep)[1]


@query("SELECT DISTINCT l_returnflag AS package, CAST(l_suppkey AS VARCHAR) AS name FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def c12_internal_dependencies(spark, d):
    dep = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("package"), F.col("l_suppkey").cast("string").alias("name")).distinct()
    return expand.internal_dependencies(dep, table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("package")))


@query("WITH a AS (SELECT DISTINCT regexp_replace(o_orderpriority, '[^A-Za-z0-9]', '.', 'g') AS v FROM orders), o AS (SELECT unnest(['linux', 'mac']) AS os) SELECT r_name || '-os=' || os || '-pri=' || v AS id, os, v AS pri, 'me' AS own FROM region, a, o UNION ALL SELECT 'plain', NULL, NULL, 'me'")
def c13_matrix(spark, d):
    """Two axes and a task without a matrix; what the task sets stays beside the axes' variables."""
    pri = table(spark, d, "orders").agg(F.array_sort(F.collect_set(F.regexp_replace("o_orderpriority", "[^A-Za-z0-9]", "."))).alias("pri"))
    env = F.create_map(F.lit("OWN"), F.lit("me"), F.lit("MATRIX_OS"), F.lit("older"))
    t = table(spark, d, "region").crossJoin(F.broadcast(pri)).select(F.col("r_name").alias("id"), F.create_map(F.lit("pri"), F.col("pri"), F.lit("os"), F.array(F.lit("mac"), F.lit("linux"))).alias("matrix"), env.alias("env"))
    plain = t.limit(1).select(F.lit("plain").alias("id"), F.expr("cast(map() as map<string, array<string>>)").alias("matrix"), F.create_map(F.lit("OWN"), F.lit("me")).alias("env"))
    return expand.matrix_rows(t.unionByName(plain)).select("id", F.col("env")["MATRIX_OS"].alias("os"), F.col("env")["MATRIX_PRI"].alias("pri"), F.col("env")["OWN"].alias("own"))


@query("SELECT c_custkey AS package, coalesce(min(o_orderpriority), 'echo none') AS command FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_custkey")
def c15_scripts(spark, d):
    s = table(spark, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("package")).agg(F.min("o_orderpriority").alias("command"))
    return expand.with_scripts(table(spark, d, "customer").select(F.col("c_custkey").alias("package")), s, "echo none")


@query("SELECT p_name AS id, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def c16_duplicate_ids(spark, d):
    return expand.duplicate_ids(table(spark, d, "part").select(F.col("p_name").alias("id")))


@query("SELECT s_suppkey AS id, CAST(2 AS BIGINT) AS axes, true AS large FROM supplier WHERE (s_suppkey % 5 * 40 + 2) * (s_suppkey % 5 * 40 + 3) > 256")
def d25_cartesian_size(spark, d):
    seq = lambda n: F.transform(F.sequence(F.lit(1), F.col("s_suppkey") % 5 * 40 + n), lambda x: x.cast("string"))
    t = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.create_map(F.lit("a"), seq(2), F.lit("b"), seq(3)).alias("matrix"))
    return expand.matrix_violations(t).select("id", F.col("axes").cast("bigint").alias("axes"), (F.col("rows") > 256).alias("large"))


# Hashes


@query("SELECT source, sha256('tree' || chr(0) || string_agg(lpad(CAST(doc_id AS VARCHAR), 9, '0') || chr(0) || sha256(coalesce(text, '')) || chr(0), '' ORDER BY doc_id)) AS hash FROM documents GROUP BY source")
def d14_merkle_level(spark, d):
    f = table(spark, d, "documents").select("source", F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("name"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    return hashing.merkle_level(f, ["source"])


@query("WITH l AS (SELECT lang, source, sha256('tree' || chr(0) || string_agg(lpad(CAST(doc_id AS VARCHAR), 9, '0') || chr(0) || sha256(text) || chr(0), '' ORDER BY doc_id)) AS hash FROM documents WHERE text IS NOT NULL GROUP BY 1, 2), m AS (SELECT lang, sha256('tree' || chr(0) || string_agg(source || chr(0) || hash || chr(0), '' ORDER BY source)) AS hash FROM l GROUP BY 1) SELECT lang || '/' || source AS path, hash FROM l UNION ALL SELECT lang, hash FROM m UNION ALL SELECT '.', sha256('tree' || chr(0) || string_agg(lang || chr(0) || hash || chr(0), '' ORDER BY lang)) FROM m")
def d14_merkle_tree(spark, d):
    f = table(spark, d, "documents").where("text IS NOT NULL").select(F.concat_ws("/", "lang", "source", F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), F.sha2("text", 256).alias("hash"))
    return hashing.merkle(f)


@query("WITH d AS (SELECT lang, source, doc_id, sha256(text || CASE WHEN doc_id % 11 = 5 THEN 'x' ELSE '' END) AS h FROM documents WHERE text IS NOT NULL AND doc_id % 11 <> 3), l AS (SELECT lang, source, sha256('tree' || chr(0) || string_agg(lpad(CAST(doc_id AS VARCHAR), 9, '0') || chr(0) || h || chr(0), '' ORDER BY doc_id)) AS hash FROM d GROUP BY 1, 2), m AS (SELECT lang, sha256('tree' || chr(0) || string_agg(source || chr(0) || hash || chr(0), '' ORDER BY source)) AS hash FROM l GROUP BY 1) SELECT lang || '/' || source AS path, hash FROM l UNION ALL SELECT lang, hash FROM m UNION ALL SELECT '.', sha256('tree' || chr(0) || string_agg(lang || chr(0) || hash || chr(0), '' ORDER BY lang)) FROM m UNION ALL SELECT lang || '/' || source || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0'), h FROM d")
def d14_merkle_maintained(spark, d):
    """A stored tree of documents, of which some change, some go (3 mod 11) and some come (7 mod 11)."""
    k = F.col("doc_id")
    docs = table(spark, d, "documents").where("text IS NOT NULL").withColumn("path", F.concat_ws("/", "lang", "source", F.lpad(k.cast("string"), 9, "0")))
    before = docs.where(k % 11 != 7).select("path", F.sha2("text", 256).alias("hash"))
    tree = cut_lineage(before.unionByName(hashing.merkle(before)), "tree")
    changes = docs.where((k % 11).isin(3, 5, 7)).select("path", F.when(k % 11 == 5, F.sha2(F.concat("text", F.lit("x")), 256)).when(k % 11 == 7, F.sha2("text", 256)).alias("hash"))
    return hashing.merkle_updated(tree, changes)


@query("SELECT l_returnflag, sha256(string_agg(m, chr(0) ORDER BY m)) AS hash FROM (SELECT DISTINCT l_returnflag, CAST(l_suppkey AS VARCHAR) AS m FROM lineitem) GROUP BY 1")
def d16_set_hash(spark, d):
    return hashing.set_hash(table(spark, d, "lineitem").select("l_returnflag", F.col("l_suppkey").cast("string").alias("m")), ["l_returnflag"], "m")


@query("SELECT doc_id, sha256('blob' || chr(0) || text) AS hash FROM documents")
def h_blob(spark, d):
    return table(spark, d, "documents").select("doc_id", hashing.blob_hash(F.col("text")).alias("hash"))


@query("SELECT o_orderkey, sha256(sha256(o_orderstatus) || chr(0) || sha256(CAST(o_custkey AS VARCHAR)) || chr(0) || sha256(o_orderpriority)) AS identity FROM orders")
def h_identity(spark, d):
    i = hashing.identity(F.col("o_orderstatus"), F.col("o_custkey").cast("string"), F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", i.combined.alias("identity"))


@query("""WITH f AS (SELECT l_orderkey AS id, string_agg(DISTINCT 'p' || l_partkey || chr(0) || sha256(CAST(l_partkey AS VARCHAR)), chr(0) ORDER BY 'p' || l_partkey || chr(0) || sha256(CAST(l_partkey AS VARCHAR))) AS files FROM lineitem GROUP BY 1)
SELECT id, sha256('1' || chr(0) || id || chr(0) || '["run","' || o_orderstatus || '"]' || chr(0) || files || chr(0) || 'HOME' || chr(0) || 'MODE=m') AS key FROM f JOIN orders ON o_orderkey = id""")
def d15_cache_keys(spark, d):
    """Orders as tasks whose inputs are their lines' parts."""
    inputs = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("path"))
    part = F.col("p_partkey").cast("string")
    files = table(spark, d, "part").select(F.concat(F.lit("p"), part).alias("path"), F.sha2(part, 256).alias("content_hash")).withColumn("logic_hash", F.col("content_hash"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.array(F.lit("run"), F.col("o_orderstatus")).alias("cmd"), F.array(F.lit("out")).alias("writes"), F.array(F.lit("MODE"), F.lit("HOME")).alias("env_reads"))
    tasks = o.join(inputs.select("id"), "id", "left_semi")
    env = spark.createDataFrame([("MODE", "m")], "name string, value string")
    keys = hashing.cache_keys(tasks, inputs, files, env)
    return keys.select(F.col("id").cast("bigint").alias("id"), "key")


# Graph


@query(f"WITH RECURSIVE {M.CHAIN}, w AS (SELECT id, 0 AS depth FROM nodes WHERE id NOT IN (SELECT dst FROM edges JOIN nodes ON src = id) UNION SELECT dst, depth + 1 FROM w JOIN edges ON src = id) SELECT id, max(depth) AS depth FROM w GROUP BY id")
def g1_depths(spark, d):
    return graph.depths(M.chain_nodes(spark, d), M.chain(spark, d))


_REACH = f"WITH RECURSIVE {M.RING}, r(src, dst) AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM r JOIN edges e ON e.src = r.dst)"


@query(f"WITH RECURSIVE {M.RING}, sound AS (SELECT DISTINCT e.src, e.dst FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst), r(src, dst) AS (SELECT src, dst FROM sound UNION SELECT r.src, e.dst FROM r JOIN sound e ON e.src = r.dst) SELECT DISTINCT id FROM nodes WHERE id IN (SELECT src FROM r WHERE src = dst) OR id IN (SELECT b.dst FROM r a JOIN r b ON a.src = a.dst AND b.src = a.src)")
def g2_cyclic(spark, d):
    return graph.cyclic(M.ring_nodes(spark, d), M.ring(spark, d))


@query(f"{_REACH} SELECT src, dst FROM r")
def g3_closure(spark, d):
    return graph.closure(M.ring(spark, d))


@query(f"{_REACH} SELECT src, dst FROM r")
def g3_closure_by_joins(spark, d):
    """The form for graphs of any size."""
    return graph.closure(M.ring(spark, d), small=0)


@query(f"{_REACH} SELECT DISTINCT p.src AS a, p.src // 8 * 8 + k AS b FROM (SELECT DISTINCT src FROM r) p, range(7) x(k) WHERE (p.src, p.src // 8 * 8 + k) IN (SELECT (src, dst) FROM r)")
def g3_leads_to(spark, d):
    """Each station that leads anywhere, against all of its customer."""
    pairs = M.ring(spark, d).select(F.col("src").alias("a")).distinct().withColumn("f", F.floor(F.col("a") / 8) * 8).select("a", F.explode(F.sequence("f", F.col("f") + 6)).alias("b"))
    return graph.leads_to(M.ring(spark, d), pairs)


_COMPONENTS = f"{_REACH} SELECT a.src AS id, least(a.src, min(a.dst)) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src"


@query(_COMPONENTS)
def g4_strong_components(spark, d):
    return graph.strong_components(M.ring(spark, d))


@query(_COMPONENTS)
def g4_components_by_joins(spark, d):
    """The form for graphs of any size."""
    return graph.strong_components(M.ring(spark, d), small=0)


@query(f"""WITH RECURSIVE {M.RING}, own AS (SELECT 'd' || id // 64 || '/n' || id || '.ts' AS f, id FROM nodes), e AS (SELECT src, dst FROM edges WHERE src // 8 % 4 <> 1 AND dst % 8 < 7),
r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst), c AS (SELECT a.src AS id, least(a.src, min(a.dst)) AS k FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src),
lone AS (SELECT id FROM nodes WHERE id NOT IN (SELECT src FROM e UNION SELECT dst FROM e) AND id NOT IN (SELECT id FROM c)),
m AS (SELECT k, string_agg(f, ',' ORDER BY f) AS files, string_agg(DISTINCT split_part(f, '/', 1), '-' ORDER BY split_part(f, '/', 1)) AS ds FROM c JOIN own USING (id) GROUP BY k)
SELECT 'combined-' || ds AS id, 'combined' AS type, files, CAST(0.6 AS DOUBLE) AS confidence FROM m
UNION ALL SELECT 'orphan-n' || id, 'orphan', f, 0.8 FROM lone JOIN own USING (id)
UNION ALL SELECT 'isolated-' || split_part(f, '/', 1), 'isolated', string_agg(f, ',' ORDER BY f), 0.9 FROM own WHERE id NOT IN (SELECT id FROM c) AND id NOT IN (SELECT id FROM lone) GROUP BY split_part(f, '/', 1)""")
def g5_proposals(spark, d):
    """Stations as files, eight customers a directory; every fourth customer's are on no edge."""
    f = lambda c: F.concat(F.lit("d"), F.floor(F.col(c) / 64).cast("string"), F.lit("/n"), F.col(c).cast("string"), F.lit(".ts"))
    e = M.ring(spark, d).where("floor(src / 8) % 4 <> 1 AND dst % 8 < 7")
    found = graph.proposals(M.ring_nodes(spark, d).select(f("id").alias("id")), e.select(f("src").alias("src"), f("dst").alias("dst")))
    return found.select("id", "type", F.array_join("files", ",").alias("files"), "confidence")


@query(f"""WITH RECURSIVE {M.CLAIMS}, k AS (SELECT DISTINCT least(ta, tb) AS a, greatest(ta, tb) AS b FROM pairs WHERE ma = 'write' OR mb = 'write'),
e AS (SELECT CASE WHEN a % 7 < b % 7 THEN a ELSE b END AS src, CASE WHEN a % 7 < b % 7 THEN b ELSE a END AS dst FROM k WHERE a % 7 <> b % 7 UNION SELECT page_id - 10, page_id FROM pages WHERE page_id % 30 = 10),
r(id) AS (SELECT dst FROM e WHERE src % 23 = 5 UNION SELECT e.dst FROM r JOIN e ON e.src = r.id) SELECT id FROM r WHERE id % 23 <> 5""")
def g7_skipped_by_claims(spark, d):
    """Failures of pages' tasks along declared edges and those that claims inject, in seven waves."""
    p = table(spark, d, "pages").select(F.col("page_id").alias("id"))
    e = p.where("id % 30 = 10").select((F.col("id") - 10).alias("src"), F.col("id").alias("dst"))
    return graph.skipped_by_claims(e, p.withColumn("wave", (F.col("id") % 7).cast("int")), M.claims(spark, d), p.where("id % 23 = 5"))


@query(f"WITH {M.CHAIN} SELECT DISTINCT conv_id * 1000 + turn AS id FROM conversations c JOIN (SELECT conv_id AS k, min(turn) AS t FROM conversations WHERE turn >= 1 AND conv_id % 5 = 0 GROUP BY 1) f ON c.conv_id = f.k AND c.turn > f.t")
def g7_skipped(spark, d):
    failed = table(spark, d, "conversations").where("turn >= 1 AND conv_id % 5 = 0").groupBy("conv_id").agg(F.min("turn").alias("t")).select((F.col("conv_id") * 1000 + F.col("t")).alias("id"))
    return graph.skipped(M.chain(spark, d), failed)


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def d19_orphans(spark, d):
    e = table(spark, d, "orders").select((-F.col("o_orderkey")).alias("src"), F.col("o_custkey").alias("dst"))
    return graph.orphans(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), e)


@query("SELECT id, (SELECT count(*) FROM lineitem WHERE l_suppkey = id) AS in_degree, CAST(0 AS BIGINT) AS dependents FROM (SELECT s_suppkey AS id FROM supplier)")
def d9_degrees(spark, d):
    e = table(spark, d, "lineitem").select((-F.col("l_orderkey") - 1).alias("src"), F.col("l_suppkey").alias("dst"))
    return graph.degrees(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), e)


@query("SELECT dir, count(*) AS files FROM (SELECT DISTINCT 'src/' || split_part(p_name, ' ', 1) AS dir, p_name FROM part) GROUP BY dir")
def d18_by_directory(spark, d):
    return M.parts(spark, d).select(X.dirname(F.col("id")).alias("dir"), "id").distinct().groupBy("dir").agg(F.count(F.lit(1)).alias("files"))


def _colouring(spark, d):
    c = M.claims(spark, d)
    tasks = c.select("task_id").distinct().select((F.col("task_id") % 3).alias("depth"), F.col("task_id").alias("id"))
    return c, graph.claim_colours(tasks, c)


# First fit one task after another: each takes the least colour that no earlier task of its depth in conflict with it has.
_FIT = f"""WITH RECURSIVE {M.CLAIMS}, t AS (SELECT id, id % 3 AS depth, row_number() OVER (ORDER BY id % 3, id) AS i FROM (SELECT DISTINCT task_id AS id FROM claims)),
k AS (SELECT DISTINCT least(ta, tb) AS a, greatest(ta, tb) AS b FROM pairs WHERE ma = 'write' OR mb = 'write'),
n AS (SELECT x.i, list(y.i) FILTER (y.i IS NOT NULL) AS before FROM t x LEFT JOIN k ON x.id IN (k.a, k.b) LEFT JOIN t y ON y.id IN (k.a, k.b) AND y.i < x.i AND y.depth = x.depth GROUP BY x.i),
r AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS INTEGER[]) AS colours UNION ALL SELECT n.i, list_append(colours, CAST(list_filter(range(0, len(colours) + 1), lambda c: NOT list_contains(list_transform(coalesce(before, []), lambda x: colours[x]), CAST(c AS INTEGER)))[1] AS INTEGER)) FROM r JOIN n ON n.i = r.i + 1),
f AS (SELECT depth, id, colours[t.i] AS colour FROM t, (SELECT colours FROM r ORDER BY i DESC LIMIT 1))"""


@query(f"{_FIT} SELECT * FROM f")
def g6_wave_colours(spark, d):
    """First fit of all pages' tasks."""
    return _colouring(spark, d)[1]


@query(f"{_FIT}, w AS (SELECT id, dense_rank() OVER (ORDER BY depth, colour) AS w FROM f) SELECT CASE WHEN x.w < y.w THEN a ELSE b END AS src, CASE WHEN x.w < y.w THEN b ELSE a END AS dst FROM k JOIN w x ON x.id = a JOIN w y ON y.id = b WHERE x.w <> y.w")
def g6_injected_edges(spark, d):
    c, coloured = _colouring(spark, d)
    waves = graph.waves(coloured).withColumnRenamed("id", "task_id")
    return graph.edges_of_waves(C.conflicts(c.join(waves, "task_id").withColumn("proto", F.lit("fs")), also=("wave",)))


@query(f"WITH RECURSIVE {M.CHAIN}, leaf AS (SELECT conv_id AS c, max(turn) AS t FROM conversations GROUP BY 1) SELECT DISTINCT c * 1000 + t AS pid, role AS path, CASE WHEN role = 'user' THEN 'read' ELSE 'write' END AS mode FROM leaf JOIN conversations ON conv_id = c")
def g8_push_down(spark, d):
    n = M.chain_nodes(spark, d).select(F.col("id").alias("pid")).join(M.chain(spark, d).select(F.col("dst").alias("pid"), F.col("src").alias("ppid")), "pid", "left").na.fill(-1, ["ppid"])
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pid"), F.col("role").alias("path"), F.when(F.col("role") == "user", "read").otherwise("write").alias("mode"))
    return graph.push_down(n, c)


# One edge of each customer after another past a bit mask a station of what it reaches: an edge goes if it leads out, or if its end reaches its start.
@query(f"""WITH RECURSIVE {M.RING}, e AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY seq) AS i FROM ring),
r AS (SELECT DISTINCT CAST(0 AS BIGINT) AS seq, c, CAST(0 AS BIGINT) AS i, list_transform(range(0, 7), lambda x: CAST(0 AS BIGINT)) AS reach, false AS gone FROM ring
  UNION ALL SELECT seq, c, i, CASE WHEN bad THEN reach ELSE list_transform(reach, lambda x, j: CASE WHEN j - 1 = s OR (x >> s) & 1 = 1 THEN x | (CAST(1 AS BIGINT) << t) | reach[t + 1] ELSE x END) END, bad
  FROM (SELECT r.reach, e.seq, e.c, e.i, e.s, e.t, e.t >= 7 OR e.s = e.t OR (r.reach[e.t + 1] >> e.s) & 1 = 1 AS bad FROM r JOIN e ON e.c = r.c AND e.i = r.i + 1))
SELECT seq, c * 8 + s AS src, c * 8 + t AS dst FROM r JOIN ring USING (seq, c) WHERE gone""")
def c14_edge_pruning(spark, d):
    return graph.without_cycles(M.ring_nodes(spark, d), M.ring(spark, d))[1]


# Conversations queue in the order of their turns; a task starts no earlier than the one before it, a step after the turn before, a step after the eighth before.
@query("""WITH RECURSIVE p AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, row_number() OVER (ORDER BY turn, conv_id) AS pos FROM conversations), q AS (SELECT a.pos, b.pos AS dep FROM p a LEFT JOIN p b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1),
r AS (SELECT CAST(0 AS BIGINT) AS pos, CAST([] AS BIGINT[]) AS steps UNION ALL SELECT q.pos, list_append(steps, greatest(coalesce(steps[q.pos - 1], 0), CASE WHEN dep IS NULL THEN 0 ELSE steps[dep] + 1 END, CASE WHEN q.pos > 8 THEN steps[q.pos - 8] + 1 ELSE 0 END)) FROM r JOIN q ON q.pos = r.pos + 1)
SELECT id, steps[p.pos] AS step FROM p, (SELECT steps FROM r ORDER BY pos DESC LIMIT 1)""")
def j6_schedule(spark, d):
    """A queue of eight places over all conversations."""
    return graph.schedule(M.chain_nodes(spark, d), M.chain(spark, d), 8)


@query("WITH f AS (SELECT user_id, least(1.0, stddev_pop(value) / avg(value)) AS score FROM events GROUP BY 1) SELECT user_id % 4 AS depth, user_id AS id, row_number() OVER (PARTITION BY user_id % 4 ORDER BY round(score, 6) DESC, user_id) - 1 AS place FROM f")
def s27_by_volatility(spark, d):
    runs = M.runs(spark, d).withColumn("hit", F.lit(True))
    f = rounded(ledger.forecast(runs, 1 << 30), "score", places=6)
    return graph.by_volatility(f.select((F.col("task_id") % 4).alias("depth"), F.col("task_id").alias("id")), f).select("depth", "id", F.col("place").cast("bigint").alias("place"))


# Traces and streams


def _trace(spark, d):
    """events as a trace of their users' processes: signups exec, errors change directory, the others open files."""
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "signup", "exec").when(F.col("event_type") == "error", "chdir").otherwise("open")
    path = F.when(kind == "chdir", F.concat(F.lit("/w/d"), (F.col("event_id") % 3).cast("string"))).when(kind == "open", F.concat(F.lit("f"), F.floor("value").cast("string")))
    mode = F.when(F.col("event_type") == "purchase", "w").when(F.col("event_type") == "click", "rw").when(F.col("event_type") == "view", "r")
    return e.select(F.col("event_id").alias("seq"), kind.alias("type"), F.col("user_id").alias("pid"), F.lit(-1).cast("bigint").alias("ppid"), F.when(kind == "exec", F.array(F.lit("/bin/tool"), F.col("user_id").cast("string"))).alias("cmd"), path.alias("path"), mode.alias("mode"), F.when(kind == "exec", F.lit("/w")).alias("cwd"))


_FOLDED = """WITH e AS (SELECT user_id AS pid, event_id AS seq, event_type AS t, CAST(floor(value) AS BIGINT) AS f FROM events), x AS (SELECT pid, max(seq) AS last FROM e WHERE t = 'signup' GROUP BY pid),
o AS (SELECT e.pid, e.seq, t, f, (SELECT max(c.seq) FROM e c WHERE c.pid = e.pid AND c.t = 'error' AND c.seq < e.seq AND c.seq > last) AS cd FROM e JOIN x ON e.pid = x.pid AND e.seq > last WHERE t IN ('purchase', 'click', 'view')),
q AS (SELECT DISTINCT pid, CASE WHEN t = 'view' THEN 'read' ELSE 'write' END AS mode, CASE WHEN cd IS NULL THEN '' ELSE 'd' || cd % 3 || '/' END || 'f' || f AS path FROM o)"""


@query(f"{_FOLDED} SELECT pid, path, mode FROM q")
def j1_trace_fold(spark, d):
    return trace.node_claims(trace.fold(_trace(spark, d), "/w"))


def _in_files(events: DataFrame, ts: str, label: str, key: str) -> str:
    """Events in four times BATCH_FILES files, four batches, dealt by a number of theirs so that neighbours are in different ones, and a last file with a row far ahead, which moves the watermark past all."""
    base = file_catalog.folder(events.sparkSession, label)
    for i in range(4):
        events.where(F.col(key) % 4 == (i * 3 + 1) % 4).repartition(file_catalog.BATCH_FILES).write.mode("append").parquet(base)
    last = events.agg(F.max(ts).alias("m")).select((F.col("m") + F.expr("INTERVAL 20000 DAYS")).alias(ts))
    last.select(*[(F.col(ts) if c == ts else F.lit(-1).cast(t) if c in ("pid", "user_id") else F.lit(None).cast(t)).alias(c) for c, t in events.dtypes]).coalesce(1).write.mode("append").parquet(base)
    return base


@query(f"{_FOLDED} SELECT pid, path, mode FROM q")
def j1_ordered_stream(spark, d):
    """The trace from files that come out of order, in four batches and a last one, folded in the order of event time."""
    ordered.use_rocksdb(spark)
    events = _trace(spark, d).withColumn("ts", F.timestamp_seconds("seq"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", file_catalog.BATCH_FILES).parquet(_in_files(events, "ts", "trace", "seq")).withWatermark("ts", "10000 days")
    rows = file_catalog.streamed(ordered.ordered_fold(stream, "/w"), "ordered")
    return trace.node_claims(ledger.latest(rows, ["pid"], [F.desc("_batch")]))


_GAP, _BUSY = 6 * 3_600_000, 2 * 86_400_000


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS k, epoch_us(ts) // 1000 AS ms, lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts) AS last FROM events), s AS (SELECT k, ms, sum(CASE WHEN last IS NULL OR ms - last >= {_GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY ms) AS burst FROM e),
t AS (SELECT k, max(ms) + {_GAP} AS ms, count(*) AS n, row_number() OVER (PARTITION BY k ORDER BY max(ms)) AS i FROM s GROUP BY k, burst),
r AS (SELECT k, ms, n, i, true AS started, ms + {_BUSY} AS free FROM t WHERE i = 1 UNION ALL SELECT t.k, t.ms, t.n, t.i, t.ms >= r.free, CASE WHEN t.ms >= r.free THEN t.ms + {_BUSY} ELSE r.free END FROM r JOIN t ON t.k = r.k AND t.i = r.i + 1)
SELECT k AS user_id, ms, n, started FROM r""")
def j2_busy_stream(spark, d):
    """Bursts of users' events that trigger runs, from files that come out of order; triggers while one is going on are dropped."""
    ordered.use_rocksdb(spark)
    events = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", file_catalog.BATCH_FILES).parquet(_in_files(events, "ts", "changes", "event_id")).withWatermark("ts", "10000 days")
    return file_catalog.streamed(ordered.debounced_runs(stream, "user_id", "ts", _GAP, _BUSY), "runs").select("user_id", "ms", "n", "started")


@query(f"{_FOLDED} SELECT pid, path, mode FROM q")
def j1_stream_fold(spark, d):
    """The same trace as a stream of files, folded as state by process; the last row of each process counts."""
    events = _trace(spark, d)
    base = file_catalog.folder(spark, "trace")
    events.write.parquet(base)
    kind = ", ".join(f"{c} {t}" for c, t in events.dtypes)
    rows = file_catalog.streamed(folds.stream_fold(folds.watch(spark, base, kind), "/w"), "folded", "update")
    return trace.node_claims(ledger.latest(rows, ["pid"], [F.desc("_batch")]))


@query(f"{_FOLDED}, c AS (SELECT pid, mode, path, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*/)[^/]*$', 1) END AS dir FROM q), n AS (SELECT *, count(dir) OVER (PARTITION BY pid, mode, dir) AS k FROM c) SELECT DISTINCT pid * 10 + CASE mode WHEN 'read' THEN 0 ELSE 1 END AS task_id, CASE WHEN dir IS NOT NULL AND k > 5 THEN dir ELSE path END AS path FROM n")
def d17_collapsed_claims(spark, d):
    c = trace.node_claims(trace.fold(_trace(spark, d), "/w"))
    return C.collapsed(c.select((F.col("pid") * 10 + F.when(F.col("mode") == "read", 0).otherwise(1)).alias("task_id"), "path"))


@query(f"{_FOLDED} SELECT DISTINCT w.pid AS producer, r.pid AS consumer FROM q w JOIN q r ON w.path = r.path AND w.mode = 'write' AND r.mode = 'read' AND w.pid < r.pid")
def g10_trace_pipeline(spark, d):
    n = trace.fold(_trace(spark, d), "/w")
    return trace.synthesise(n, n.select("pid", F.col("pid").alias("idx")))[1]


@query(f"{_FOLDED}, c AS (SELECT pid, mode, path, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*/)[^/]*$', 1) END AS dir FROM q), n AS (SELECT *, count(dir) OVER (PARTITION BY pid, mode, dir) AS k FROM c), z AS (SELECT DISTINCT pid, 'fs:' || mode || ':' || CASE WHEN dir IS NOT NULL AND k > 5 THEN dir ELSE path END AS claim FROM n) SELECT pid, 'tool_' || pid AS name, '/bin/tool ' || pid AS cmd, string_agg(claim, ' ' ORDER BY claim) AS claims FROM z GROUP BY pid")
def g10_trace_tasks(spark, d):
    n = trace.fold(_trace(spark, d), "/w")
    return trace.synthesise(n, n.select("pid", F.col("pid").alias("idx")))[0].select("pid", "name", F.array_join("cmd", " ").alias("cmd"), F.array_join("claims", " ").alias("claims"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 60 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, k")
def j2_debounced(spark, d):
    return folds.debounced(table(spark, d, "events"), "user_id", "ts", "60 minutes")


@query("WITH RECURSIVE e AS (SELECT user_id, ts, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events), r AS (SELECT user_id, ts, n, ms + 3600000 AS free, true AS started FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.ts, e.n, CASE WHEN e.ms >= r.free THEN e.ms + 3600000 ELSE r.free END, e.ms >= r.free FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1) SELECT user_id, ts, started FROM r")
def j2_dropped_while_busy(spark, d):
    return folds.dropped_while_busy(table(spark, d, "events"), "user_id", "ts", 3_600_000)


@query("SELECT 'task_complete' AS type, o_orderkey AS task_id FROM orders WHERE o_orderstatus = 'F'")
def j3_completion_events(spark, d):
    r = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("duration_ms"))
    return folds.completion_events(r).select("type", "task_id")
