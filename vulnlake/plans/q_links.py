"""Joins between findings, packages, memory, checks and events (J*, W01-W07)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vulnlake.functions import score as S
from vulnlake.functions import versions as V
from vulnlake.operators import enrich as J
from vulnlake.plans.q_findings import QUEUE_SQL, queue
from vulnlake.plans.q_graph import values
from vulnlake.plans.registry import query
from vulnlake.rules import assignment as R
from vulnlake.rules.report_rules import TYPE_RULES


@query("J02_second_order", """
WITH k AS (SELECT tbl, col, sanitization, COUNT(*) AS stores, min(store_id) AS first_store FROM fx_store_points GROUP BY 1, 2, 3)
SELECT use_id, tbl, col, output_sanitization, usage_sink, sanitization, stores, first_store,
 CASE WHEN sanitization = 'none' AND output_sanitization = 'none' THEN 'high' WHEN sanitization = 'full' AND output_sanitization = 'full' THEN 'safe'
 WHEN sanitization = 'partial' OR output_sanitization = 'partial' THEN 'candidate' ELSE 'medium' END AS risk,
 CASE usage_sink WHEN 'DB::raw' THEN 'SQLi' WHEN 'echo' THEN 'XSS' WHEN 'include' THEN 'LFI' WHEN 'system' THEN 'RCE' ELSE 'other' END AS vuln_type
FROM fx_use_points JOIN k USING (tbl, col)""")
def second_order(t):
    return J.second_order_classes(t.fx_store_points, t.fx_use_points)


@query("S15_second_order_risk", """
WITH x AS (SELECT s.sanitization, u.output_sanitization, u.usage_sink FROM fx_store_points s JOIN fx_use_points u USING (tbl, col))
SELECT sanitization, output_sanitization, usage_sink, COUNT(*) AS pairs, CASE WHEN sanitization = 'none' AND output_sanitization = 'none' THEN 'high'
 WHEN sanitization = 'full' AND output_sanitization = 'full' THEN 'safe' WHEN sanitization = 'partial' OR output_sanitization = 'partial' THEN 'candidate' ELSE 'medium' END AS risk
FROM x GROUP BY 1, 2, 3""")
def second_order_risk(t):
    c = J.second_order_classes(t.fx_store_points, t.fx_use_points)
    return c.groupBy("sanitization", "output_sanitization", "usage_sink", "risk").agg(F.sum("stores").alias("pairs"))


@query("S16_version_keys", """
SELECT version, CAST(v_major * 1000000 + v_minor * 1000 + v_patch AS BIGINT) AS key, COUNT(*) AS n FROM fx_packages GROUP BY 1, 2""")
def version_keys(t):
    k = V.version_key("version")
    return t.fx_packages.groupBy("version", (V.part(k, 0) * 1000000 + V.part(k, 1) * 1000 + V.part(k, 2)).alias("key")).agg(F.count("*").alias("n"))


#: Constraints, and the ranges [lo, hi) they mean over ((major * 100 + minor) * 100 + patch) * 10 + 5, pre-releases with + 0.
CONSTRAINTS = {
    "^10.4": [(1004005, 1100000)], "~20.3": [(2003005, 2100000)], "~20.3.2": [(2003025, 2004000)], "30.*": [(3000005, 3100000)], ">=12.0 <15.0": [(1200005, 1500005)],
    "^5.1 || ^40": [(501005, 600000), (4000005, 4100000)], "<=8.2.1": [(0, 802016)], "7.2.x || 1.0 - 3.4": [(702005, 703000), (100005, 304006)], ">11.3.3,<11.6": [(1103036, 1106005)], "*": [(0, 99999999)],
}
RANGES = [(rule, lo, hi) for rule, spans in CONSTRAINTS.items() for lo, hi in spans]


@query("S16_constraints", f"""WITH c(rule, lo, hi) AS (VALUES {values(RANGES)}),
v AS (SELECT version || CASE WHEN is_dev THEN '-beta2' ELSE '' END AS version, ((v_major * 100 + v_minor) * 100 + v_patch) * 10 + CASE WHEN is_dev THEN 0 ELSE 5 END AS key FROM fx_packages)
SELECT rule, version, COUNT(*) AS n FROM v JOIN c ON key >= lo AND key < hi GROUP BY 1, 2""")
def constraints(t):
    rules = F.explode(F.array(*[F.lit(r) for r in CONSTRAINTS])).alias("rule")
    v = t.fx_packages.select(F.concat("version", F.when(F.col("is_dev"), "-beta2").otherwise("")).alias("version")).groupBy("version").agg(F.count("*").alias("n"))
    return v.select("version", "n", rules).where(V.satisfies(V.version_key("version"), F.col("rule")))


RANGE_SQL = """v AS (SELECT package, version, v_major, COUNT(*) AS installs, COUNT(DISTINCT project) AS projects FROM fx_packages GROUP BY 1, 2, 3)"""


@query("J03_affected_versions", f"""WITH {RANGE_SQL}
SELECT v.package, version, installs, projects, vuln_id, cvss FROM v JOIN fx_advisories a ON v.package = a.package AND v_major >= intro_major AND v_major < fixed_major""")
def affected(t):
    key = lambda c: V.version_key(F.concat(F.col(c).cast("string"), F.lit(".0.0")))
    adv = t.fx_advisories.select("package", "vuln_id", "cvss", key("intro_major").alias("lo"), key("fixed_major").alias("hi"))
    return V.match_advisories(t.fx_packages, adv).select("package", "version", "installs", "projects", "vuln_id", "cvss")


VERSION_VALUES = values(R.VERSION_AREAS)


@query("J04_platform_alerts", f"""
WITH r(framework, lo, hi, area, note) AS (VALUES {VERSION_VALUES})
SELECT project, fx_targets.framework, fw_major, string_agg(area || ':' || note, '; ' ORDER BY area) AS alerts
FROM fx_targets JOIN r ON fx_targets.framework = r.framework AND fw_major >= lo AND fw_major < hi GROUP BY 1, 2, 3""")
def alerts(t):
    rules = t.spark.createDataFrame(R.VERSION_AREAS, "framework string, lo int, hi int, area string, note string")
    j = J.rule_lookup(t.fx_targets, rules, ["framework"], "inner").where((F.col("fw_major") >= F.col("lo")) & (F.col("fw_major") < F.col("hi")))
    # at most one alert per rule and project, so the list has a fixed bound
    lines = F.array_sort(F.collect_list(F.concat_ws(":", "area", "note")))
    return j.groupBy("project", "framework", "fw_major").agg(F.array_join(lines, "; ").alias("alerts"))


@query("J05_feed_cross_check", """
WITH l AS (SELECT DISTINCT package, v_major AS major FROM fx_packages), f AS (SELECT DISTINCT package, intro_major AS major FROM fx_advisories)
SELECT COALESCE(l.package, f.package) AS package, COALESCE(l.major, f.major) AS major, CASE WHEN l.package IS NOT NULL AND f.package IS NOT NULL THEN 'high_confidence'
 WHEN f.package IS NOT NULL THEN 'pending' ELSE 'local_only' END AS status FROM l FULL JOIN f ON l.package = f.package AND l.major = f.major""")
def cross_check(t):
    return J.feed_cross_check(t.fx_packages.withColumn("major", F.col("v_major")), t.fx_advisories.withColumn("major", F.col("intro_major")), ["package", "major"])


AREA_SQL = f"m(sink_function, area) AS (VALUES {values(R.FUNCTION_AREAS.items())})"


@query("J06_work_assignment", f"""WITH {AREA_SQL}
SELECT project, COALESCE(area, 'unassigned') AS area, COUNT(*) AS findings FROM fx_tool_findings LEFT JOIN m USING (sink_function) GROUP BY 1, 2""")
def assignment(t):
    rules = t.spark.createDataFrame(list(R.FUNCTION_AREAS.items()), "sink_function string, area string")
    return J.rule_lookup(t.fx_tool_findings, rules, ["sink_function"]).groupBy(
        "project", F.coalesce("area", F.lit("unassigned")).alias("area")).agg(F.count("*").alias("findings"))


@query("J07_forced_areas", f"""
WITH r(fw, area) AS (VALUES {values(R.FORCED_AREAS)}) SELECT DISTINCT project, area FROM fx_targets JOIN r ON fw IS NULL OR fw = framework""")
def forced(t):
    return J.forced_areas(t.fx_targets.select("project", "framework"), R.FORCED_AREAS)


@query("J08_version_areas", f"""
WITH r(framework, lo, hi, area, note) AS (VALUES {VERSION_VALUES})
SELECT area, note, COUNT(*) AS projects FROM fx_targets JOIN r ON fx_targets.framework = r.framework AND fw_major >= lo AND fw_major < hi GROUP BY 1, 2""")
def version_areas(t):
    rules = t.spark.createDataFrame(R.VERSION_AREAS, "framework string, lo int, hi int, area string, note string")
    return J.rule_lookup(t.fx_targets, rules, ["framework"], "inner").where("fw_major >= lo AND fw_major < hi").groupBy("area", "note").agg(F.count("*").alias("projects"))


@query("J11_not_consumed", "SELECT event_id FROM events WHERE event_id % 3 <> 1")
def not_consumed(t):
    from vulnlake.plans.fixtures import board
    return J.uncollected_for(board(t), "reader1").select("event_id")


@query("J12_uncovered_findings", f"""WITH {QUEUE_SQL}, r AS (SELECT DISTINCT file, line FROM fx_sinks WHERE verdict = 'confirmed')
SELECT priority, q.file, q.line, sink_function FROM q WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.file = q.file AND r.line = q.line)""")
def uncovered(t):
    done = t.fx_sinks.where("verdict = 'confirmed'")
    return J.uncovered(queue(t), done, ["file", "line"]).select("priority", "file", "line", "sink_function")


@query("J13_untested_admin_routes", """
SELECT route_id, url FROM fx_routes WHERE auth_level = 'admin' AND route_id NOT IN (SELECT k.route_id FROM fx_packs k JOIN fx_tool_findings f USING (file))""")
def untested(t):
    tested = t.fx_tool_findings.select("file").distinct().join(t.fx_packs, "file").select("route_id")
    return J.uncovered(t.fx_routes.where("auth_level = 'admin'"), tested, ["route_id"]).select("route_id", "url")


@query("J14_areas_without_run", f"""WITH {AREA_SQL}, need AS (SELECT DISTINCT project, area FROM fx_tool_findings JOIN m USING (sink_function)),
ran AS (SELECT DISTINCT project, CASE vuln_type WHEN 'sqli' THEN 'sqli' WHEN 'rce' THEN 'rce' WHEN 'ssrf' THEN 'ssrf' ELSE 'xss_ssti' END AS area FROM fx_nodes WHERE status = 'confirmed')
SELECT * FROM need EXCEPT SELECT * FROM ran""")
def no_run(t):
    rules = t.spark.createDataFrame(list(R.FUNCTION_AREAS.items()), "sink_function string, area string")
    need = J.rule_lookup(t.fx_tool_findings, rules, ["sink_function"], "inner").select("project", "area").distinct()
    area = S.pick(F.col("vuln_type"), {"sqli": "sqli", "rce": "rce", "ssrf": "ssrf"}, "xss_ssti")
    ran = t.fx_nodes.where("status = 'confirmed'").select("project", area.alias("area"))
    return J.uncovered(need, ran, ["project", "area"])


@query("J15_auth_mismatch", """
SELECT route_id, r.auth_level AS matrix_level, p.auth AS claimed FROM fx_routes r JOIN (SELECT concat('route_', CAST(p_partkey AS VARCHAR)) AS route_id,
 CASE p_partkey % 3 WHEN 0 THEN 'anonymous' WHEN 1 THEN 'authenticated' ELSE NULL END AS auth FROM part) p USING (route_id) WHERE p.auth IS DISTINCT FROM r.auth_level""")
def mismatch(t):
    claimed = t.part.select(F.concat(F.lit("route_"), F.col("p_partkey").cast("string")).alias("route_id"),
                            S.pick(F.col("p_partkey") % 3, {0: "anonymous", 1: "authenticated"}).alias("claimed"))
    j = t.fx_routes.join(claimed, "route_id")
    return j.where(~F.col("claimed").eqNullSafe(F.col("auth_level"))).select("route_id", F.col("auth_level").alias("matrix_level"), "claimed")


@query("J16_unaddressed_filters", """
WITH f AS (SELECT DISTINCT file, filter_name FROM fx_sinks), a AS (SELECT DISTINCT file, filter_name FROM fx_sinks WHERE verdict = 'confirmed')
SELECT file, COUNT(*) AS open_filters FROM (SELECT * FROM f EXCEPT SELECT * FROM a) GROUP BY 1""")
def unaddressed(t):
    f = t.fx_sinks.select("file", "filter_name").distinct()
    a = t.fx_sinks.where("verdict = 'confirmed'")
    return J.uncovered(f, a, ["file", "filter_name"]).groupBy("file").agg(F.count("*").alias("open_filters"))


@query("J25_memory_tiers", """
WITH m AS (SELECT sink_type, framework, php_major, waf, COUNT(*) AS n, COUNT(*) FILTER (status = 'confirmed') AS c FROM fx_memory GROUP BY 1, 2, 3, 4),
j AS (SELECT t.project, CASE WHEN t.framework = m.framework AND t.php_major = m.php_major AND t.waf = m.waf THEN 1 WHEN t.framework = m.framework AND t.php_major = m.php_major THEN 2
 WHEN t.php_major = m.php_major THEN 3 ELSE 4 END AS tier, n, c FROM fx_targets t JOIN m ON t.sink_type = m.sink_type),
g AS (SELECT project, tier, SUM(n)::BIGINT AS memories, SUM(c)::BIGINT AS confirmed FROM j GROUP BY 1, 2)
SELECT project, tier, memories, confirmed FROM g WHERE tier = (SELECT min(tier) FROM g h WHERE h.project = g.project)""")
def tiers(t):
    return J.memory_tiers(t.fx_targets, t.fx_memory, "project")


@query("J27_trace_agreement", """
WITH a AS (SELECT trace_id, list(DISTINCT function) AS fn FROM fx_frames GROUP BY 1), b AS (SELECT o_orderkey AS trace_id,
 CASE o_orderkey % 3 WHEN 0 THEN ['DB::raw', 'system'] WHEN 1 THEN ['Router::dispatch', 'UserController->show', 'system', 'DB::raw'] ELSE ['eval'] END AS st FROM orders)
SELECT trace_id, CAST(len(list_intersect(fn, st)) AS INT) AS shared, CAST(len(st) AS INT) AS total, CASE WHEN len(list_intersect(fn, st)) * 100 >= len(st) * 80 THEN 'high'
 WHEN len(list_intersect(fn, st)) * 100 >= len(st) * 50 THEN 'medium' ELSE 'low' END AS level FROM a JOIN b USING (trace_id)""")
def agreement(t):
    lit = lambda xs: F.array(*[F.lit(x) for x in xs])
    m = F.col("o_orderkey") % 3
    st = F.when(m == 0, lit(["DB::raw", "system"])).when(m == 1, lit(["Router::dispatch", "UserController->show", "system", "DB::raw"])).otherwise(lit(["eval"]))
    return J.path_agreement(t.fx_frames, t.orders.select(F.col("o_orderkey").alias("trace_id"), st.alias("static_path")))


@query("J28_binding_backfill", """
SELECT o_orderkey AS trace_id, 'index' AS layer FROM orders
UNION SELECT trace_id, function FROM fx_frames WHERE function LIKE '%->%' AND trace_id IN (SELECT o_orderkey FROM orders)""")
def backfill(t):
    packs = t.orders.select(F.col("o_orderkey").alias("trace_id"))
    bound = t.fx_frames.where(F.col("function").contains("->")).select("trace_id", F.col("function").alias("layer")).distinct()
    return packs.withColumn("layer", F.lit("index")).unionByName(bound.join(packs, "trace_id", "left_semi")).distinct()


@query("J29_near_names", """
WITH k AS (SELECT DISTINCT vendor, name AS known_name FROM fx_names WHERE known), n AS (SELECT DISTINCT vendor, name FROM fx_names)
SELECT vendor, name, known_name, CAST(levenshtein(name, known_name) AS INT) AS distance FROM n JOIN k USING (vendor) WHERE levenshtein(name, known_name) BETWEEN 1 AND 2""")
def near(t):
    n = t.fx_names
    return V.near_names(n.select("vendor", "name"), n.where("known").select("vendor", "name"))


@query("J30_dev_in_production", """
SELECT project, package, version FROM fx_packages p WHERE is_dev AND EXISTS (SELECT 1 FROM fx_packages q WHERE NOT q.is_dev AND q.project = p.project AND q.v_major = p.v_major)""")
def dev_loaded(t):
    prod = t.fx_packages.where(~F.col("is_dev")).select("project", "v_major")
    return t.fx_packages.where("is_dev").join(prod, ["project", "v_major"], "left_semi").select("project", "package", "version")


@query("J31_incremental_scope", """
WITH ch AS (SELECT DISTINCT callee AS file FROM fx_calls JOIN orders ON callee = concat('f', CAST(o_custkey AS VARCHAR)) WHERE o_orderstatus = 'P')
SELECT file FROM ch UNION SELECT caller FROM fx_calls WHERE callee IN (SELECT file FROM ch)""")
def scope(t):
    changed = t.orders.where("o_orderstatus = 'P'").select(F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("file")).distinct()
    return J.incremental_scope(changed, t.fx_calls.select(F.col("callee").alias("file"), F.col("caller").alias("included")))


CHANGE_SQL = """c AS (SELECT concat('proj', CAST(CAST(floor(l_orderkey / 3) AS BIGINT) AS VARCHAR)) AS project, concat(CASE l_linenumber WHEN 7 THEN 'routes/' ELSE 'app/' END, CAST(l_partkey % 97 AS VARCHAR), '.php') AS path,
 l_returnflag AS change_type FROM lineitem)"""


@query("J32_run_mode", f"""WITH {CHANGE_SQL}, g AS (SELECT project, COUNT(DISTINCT path) AS changed, bool_or(change_type = 'A' AND path LIKE 'routes/%') AS new_routes FROM c GROUP BY 1)
SELECT *, CASE WHEN changed < 10 AND NOT new_routes THEN 'incremental' ELSE 'full' END AS mode FROM g""")
def mode(t):
    c = t.lineitem.select(
        F.concat(F.lit("proj"), F.floor(F.col("l_orderkey") / 3).cast("string")).alias("project"),
        F.concat(F.when(F.col("l_linenumber") == 7, "routes/").otherwise("app/"), (F.col("l_partkey") % 97).cast("string"), F.lit(".php")).alias("path"),
        F.col("l_returnflag").alias("change_type"))
    return J.run_mode(c)


@query("J36_reconciliation", f"""WITH {QUEUE_SQL}, qa AS (SELECT file, line, COUNT(*) AS queued FROM q GROUP BY 1, 2), qb AS (SELECT file, line, COUNT(*) AS reported FROM fx_sinks WHERE verdict = 'confirmed' GROUP BY 1, 2)
SELECT file, line, COALESCE(queued, 0) AS queued, COALESCE(reported, 0) AS reported, CASE WHEN reported IS NULL THEN 'missing' WHEN queued IS NULL THEN 'unknown'
 WHEN reported > queued THEN 'repeated' ELSE 'ok' END AS state FROM qa FULL JOIN qb USING (file, line)""")
def reconcile(t):
    return J.reconcile(queue(t), t.fx_sinks.where("verdict = 'confirmed'"), ["file", "line"])


REMEDIES = [("RCE", "avoid shell and eval; use an allow list"), ("SQLi", "bind parameters"), ("XSS", "encode on output"), ("LFI", "map ids to files"),
            ("FileWrite", "generate names, store outside the web root"), ("SSRF", "allow list hosts"), ("Deserialization", "use json"), ("XXE", "disable external entities")]


@query("J38_remediation", f"""WITH m(sink_type, fix) AS (VALUES {values(REMEDIES)})
SELECT sink_type, COALESCE(fix, 'none') AS fix, CASE WHEN fix IS NULL THEN 'no template for this type' END AS skip_reason, COUNT(*) AS findings FROM fx_tool_findings LEFT JOIN m USING (sink_type) GROUP BY 1, 2, 3""")
def remedies(t):
    rules = t.spark.createDataFrame(REMEDIES, "sink_type string, fix string")
    j = J.rule_lookup(t.fx_tool_findings.groupBy("sink_type").agg(F.count("*").alias("findings")), rules, ["sink_type"])
    return j.select("sink_type", F.coalesce("fix", F.lit("none")).alias("fix"),
                    F.when(F.col("fix").isNull(), "no template for this type").alias("skip_reason"), "findings")


@query("J39_events_without_log", """
WITH e AS (SELECT * FROM events WHERE event_type = 'error'), l AS (SELECT * FROM events WHERE event_type = 'view')
SELECT event_id, user_id FROM e WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.user_id = e.user_id AND l.ts BETWEEN e.ts AND e.ts + INTERVAL 12 HOUR)""")
def unlogged(t):
    from vulnlake.operators.behaviour import without_followup
    e = t.events
    return without_followup(e.where("event_type = 'error'"), e.where("event_type = 'view'"), "user_id", hours=12).select("event_id", "user_id")


@query("J40_responsible_producer", f"""
WITH m(subject, producer) AS (VALUES {values(R.QC_PRODUCERS.items())}),
f AS (SELECT qc_id, CASE redo_count WHEN 0 THEN 'route_map' WHEN 1 THEN 'auth_matrix' WHEN 2 THEN 'ast_sinks' ELSE 'dep_risk' END AS subject FROM fx_qc WHERE verdict = 'fail')
SELECT producer, subject, COUNT(*) AS failures FROM f JOIN m USING (subject) GROUP BY 1, 2""")
def responsible(t):
    rules = t.spark.createDataFrame(list(R.QC_PRODUCERS.items()), "subject string, producer string")
    subject = S.pick(F.col("redo_count"), {0: "route_map", 1: "auth_matrix", 2: "ast_sinks"}, "dep_risk")
    return J.rule_lookup(t.fx_qc.where("verdict = 'fail'").withColumn("subject", subject), rules, ["subject"], "inner").groupBy("producer", "subject").agg(F.count("*").alias("failures"))


# --- exports -------------------------------------------------------------------------------

@query("W01_sarif_runs", """
SELECT project, COUNT(*) AS results, CAST(ceil(COUNT(*) / 500e0) AS BIGINT) AS shards FROM fx_sinks s WHERE verdict <> 'not_vulnerable' GROUP BY 1""")
def sarif_runs(t):
    from vulnlake.sources.sinks import to_sarif
    runs, _ = to_sarif(t.fx_sinks.withColumn("sink_function", F.lit("call")), shard_rows=500)
    return runs.where(F.get_json_object("document", "$.version") == "2.1.0").select("project", "results", "shards")


@query("W01_sarif_shards", """
SELECT project, CAST(ceil(COUNT(*) / 500e0) AS BIGINT) AS shards, COUNT(*) AS items, COUNT(*) AS parsed FROM fx_sinks WHERE verdict <> 'not_vulnerable' GROUP BY 1""")
def sarif_shards(t):
    from vulnlake.sources.sinks import to_sarif
    runs, s = to_sarif(t.fx_sinks.withColumn("sink_function", F.lit("call")), shard_rows=500)
    n = F.json_array_length(F.get_json_object("document", "$.results")).cast("long")
    got = s.groupBy("project").agg(F.sum("items").alias("items"), F.sum(n).alias("parsed"))
    return runs.select("project", "shards").join(got, "project")


def described(t):
    """Findings some of which lack a path, a priority or a flow."""
    n = F.col("evidence_score")
    steps = F.array(F.struct(F.lit(1).alias("layer"), F.col("file"), F.col("line"), F.lit("SINK").alias("role"), F.lit("call").alias("function")))
    from vulnlake.sources.sinks import code_flow
    return t.fx_sinks.select(
        "project", "sink_type", "verdict", F.when(n != 1, F.col("file")).alias("file"), "line", F.lit("call").alias("sink_function"),
        F.when(n != 2, F.concat(F.lit("P"), F.col("r").cast("string"))).alias("priority"), F.col("c").alias("rounds_executed"),
        F.when(n != 3, code_flow(steps)).alias("flow"))


SARIF_SQL = f"""t(id, name, cwe) AS (VALUES {values([(k, n, c) for k, (n, c) in TYPE_RULES.items()])}),
f AS (SELECT project, sink_type, verdict, line, r, c, file AS src, CASE WHEN evidence_score <> 1 THEN file END AS file, CASE WHEN evidence_score <> 2 THEN concat('P', r) END AS priority, evidence_score <> 3 AS flow
 FROM fx_sinks WHERE verdict <> 'not_vulnerable')"""


@query("W01_sarif_documents", f"""WITH {SARIF_SQL},
k AS (SELECT DISTINCT project, sink_type FROM f),
u AS (SELECT project, string_agg(concat('{{"id":"', sink_type, '","name":"', COALESCE(name, sink_type), '","shortDescription":{{"text":"', COALESCE(name, sink_type), ' vulnerability"}}',
 CASE WHEN cwe IS NULL THEN '' ELSE concat(',"helpUri":"https://cwe.mitre.org/data/definitions/', cwe, '.html"') END,
 ',"properties":{{"tags":["security","', replace(lower(COALESCE(name, sink_type)), ' ', '-'), '"]}}}}'), ',' ORDER BY sink_type) AS rules FROM k LEFT JOIN t ON id = sink_type GROUP BY project),
g AS (SELECT project, COUNT(*) AS n, COUNT(*) - COUNT(file) AS a, COUNT(*) - COUNT(priority) AS b, COUNT(*) FILTER (NOT flow) AS d FROM f GROUP BY project),
m AS (SELECT project, n, list_filter([CASE WHEN a > 0 THEN concat(a, ' results without a file path') END, CASE WHEN b > 0 THEN concat(b, ' results without a priority') END,
 CASE WHEN d > 0 THEN concat(d, ' results without a code flow') END], lambda x: x IS NOT NULL) AS w FROM g)
SELECT project, concat('{{"version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"vulnlake","rules":[', rules, ']}}}},"invocations":[{{"executionSuccessful":true,"toolExecutionNotifications":[',
 array_to_string(list_transform(w, lambda x: concat('{{"level":"warning","message":{{"text":"', x, '"}}}}')), ','), ']}}],"externalPropertyFileReferences":{{"results":[',
 array_to_string(list_transform(range(CAST(ceil(n / 500e0) AS BIGINT)), lambda i: concat('{{"location":{{"uri":"results-', i, '.sarif-external-properties"}}}}')), ','), ']}}}}]}}') AS document FROM m JOIN u USING (project)""")
def sarif_documents(t):
    from vulnlake.sources.sinks import to_sarif
    runs, _ = to_sarif(described(t), shard_rows=500, flows="flow", properties=["priority", "verdict", "rounds_executed"])
    return runs.select("project", "document")


@query("W01_sarif_result_documents", f"""WITH {SARIF_SQL}, p AS (SELECT *, concat('{{"physicalLocation":{{"artifactLocation":{{"uri":"', COALESCE(file, 'unknown'), '"}},"region":{{"startLine":', line, '}}}}}}') AS place,
 concat('"physicalLocation":{{"artifactLocation":{{"uri":"', src, '"}},"region":{{"startLine":', line, '}}}}') AS step FROM f)
SELECT project, concat('{{"ruleId":"', sink_type, '","level":"', CASE verdict WHEN 'confirmed' THEN 'error' WHEN 'suspected' THEN 'warning' ELSE 'note' END, '","message":{{"text":"', sink_type, ' at call"}},"locations":[', place,
 '],"properties":{{', CASE WHEN priority IS NULL THEN '' ELSE concat('"priority":"', priority, '",') END, '"verdict":"', verdict, '","rounds_executed":', c, '}}',
 CASE WHEN flow THEN concat(',"codeFlows":[{{"threadFlows":[{{"locations":[{{"location":{{', step, ',"message":{{"text":"SINK: call"}}}}}}]}}]}}]') ELSE '' END, '}}') AS result, COUNT(*) AS n FROM p GROUP BY 1, 2""")
def sarif_result_documents(t):
    from vulnlake.sources.sinks import to_sarif
    _, shards = to_sarif(described(t), shard_rows=500, flows="flow", properties=["priority", "verdict", "rounds_executed"])
    # read back from the written documents, one row per result
    result = t.spark.tvf.variant_explode(F.expr("variant_get(parse_json(document), '$.results', 'variant')").outer()).select(F.col("value").alias("parsed"))
    schema = ("struct<ruleId string, level string, message struct<text:string>, locations array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>, "
              "properties struct<priority:string,verdict:string,rounds_executed:int>, codeFlows array<struct<threadFlows:array<struct<locations:array<struct<location:struct<"
              "physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>,message:struct<text:string>>>>>>>>>")
    rows = shards.lateralJoin(result).select("project", F.expr(f"variant_get(parsed, '$', '{schema}')").alias("r"))
    return rows.select("project", F.to_json("r").alias("result")).groupBy("project", "result").agg(F.count("*").alias("n"))


@query("W02_sarif_levels", """
SELECT result, CASE result WHEN 'confirmed' THEN 'error' WHEN 'suspected' THEN 'warning' END AS level, COUNT(*) AS n FROM fx_rounds WHERE result <> 'failed' GROUP BY 1, 2""")
def sarif_levels(t):
    from vulnlake.sources.sinks import sarif_level
    r = t.fx_rounds.withColumn("level", sarif_level("result")).where(F.col("level").isNotNull())
    return r.groupBy("result", "level").agg(F.count("*").alias("n"))


@query("W03_code_flows", """
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_size % 3 AS INT) END AS steps, CASE WHEN p_size % 3 = 0 THEN NULL ELSE concat('L', CAST(p_size % 3 AS VARCHAR)) END AS first_file FROM part""")
def code_flows(t):
    from vulnlake.sources.sinks import code_flow
    n = (F.col("p_size") % 3).cast("int")
    none = F.array().cast("array<struct<layer:int,file:string,line:int,role:string,function:string>>")
    layers = F.when(n == 0, none).otherwise(F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(
        i.alias("layer"), F.concat(F.lit("L"), i.cast("string")).alias("file"), (i * 10).alias("line"), F.lit("step").alias("role"), F.lit("f").alias("function"))))
    flow = code_flow(layers)
    locs = F.col("flow")[0]["threadFlows"][0]["locations"]
    return t.part.select("p_partkey", flow.alias("flow")).select(
        "p_partkey", F.when(F.col("flow").isNotNull(), F.size(locs)).alias("steps"),
        locs[0]["location"]["physicalLocation"]["artifactLocation"]["uri"].alias("first_file"))


@query("W04_sarif_validity", """
SELECT project, COUNT(*) AS results, COUNT(*) FILTER (line IN (10, 20)) AS invalid, COUNT(*) FILTER (line = 20) AS no_line FROM fx_sinks WHERE verdict <> 'not_vulnerable' GROUP BY 1""")
def sarif_valid(t):
    from vulnlake.sources.sinks import sarif_problems, sarif_results
    results = sarif_results(t.fx_sinks.withColumn("sink_function", F.lit("call")))
    # two kinds of damage, so that there is something to find
    damaged = F.when(F.col("line") == 10, F.regexp_replace("result", '"ruleId":"[^"]*",', "")).when(F.col("line") == 20, F.replace(F.col("result"), F.lit('"startLine":20'), F.lit('"startLine":0')))
    r = sarif_problems(results.withColumn("result", F.coalesce(damaged, "result")))
    return r.groupBy("project").agg(F.count("*").alias("results"), F.count_if(F.size("problems") > 0).alias("invalid"),
                                    F.count_if(F.array_contains("problems", "startLine not positive")).alias("no_line"))


@query("W06_quality_rows", """
WITH s AS (SELECT phase, COUNT(*) AS c, COUNT(*) FILTER (verdict = 'pass') AS p, COUNT(*) FILTER (verdict = 'fail') AS f, SUM(redo_count) AS r,
 round(avg(pass_count * 100e0 / nullif(total_count, 0)), 1) AS a FROM fx_qc GROUP BY ROLLUP(phase))
SELECT COALESCE(phase, 'total') AS phase, concat('| ', COALESCE(phase, 'total'), ' | ', c, ' | ', p, ' | ', f, ' | ', r, ' | ', a, '% |') AS line FROM s""")
def quality_rows(t):
    from vulnlake.operators.aggregate import qc_stats
    from vulnlake.sources.sinks import quality_lines
    return quality_lines(qc_stats(t.fx_qc, overall=True))


@query("W07_audit_summary", f"""WITH {QUEUE_SQL}
SELECT project, priority, sink_type, COUNT(*) AS findings, SUM(source_count)::BIGINT AS reports, COUNT(*) FILTER (route_id = 'unknown') AS unlinked FROM q GROUP BY 1, 2, 3""")
def audit_summary(t):
    return queue(t).groupBy("project", "priority", "sink_type").agg(
        F.count("*").alias("findings"), F.sum("source_count").alias("reports"), F.count_if(F.col("route_id") == "unknown").alias("unlinked"))
