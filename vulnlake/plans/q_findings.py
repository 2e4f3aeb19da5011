"""Findings: merge, link, number, order, retain (R03, X*, D*, E*, T*, W*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vulnlake.functions import score as S
from vulnlake.functions.values import micros
from vulnlake.operators.selection import medians, timing_gaps
from vulnlake.operators import aggregate as A
from vulnlake.operators import windows as W
from vulnlake.plans.pipeline import scored_queue
from vulnlake.operators.ordered import dealt, spread_join
from vulnlake.plans.registry import query

QUEUE_SQL = """d AS (SELECT file, line, sink_function, min(project) AS project, min(sink_type) AS sink_type,
 COUNT(DISTINCT source) AS source_count, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources
 FROM fx_tool_findings GROUP BY file, line, sink_function),
j AS (SELECT d.*, COALESCE(p.route_id, 'unknown') AS route_id, COALESCE(r.auth_level, 'anonymous') AS auth_level, r.url, r.controller,
 CASE WHEN sink_type IN ('RCE','Deserialization','LFI') THEN 0 WHEN sink_type IN ('SQLi','FileWrite','SSRF','XXE') THEN 1 ELSE 2 END AS step
 FROM d LEFT JOIN fx_packs p ON d.file = p.file LEFT JOIN fx_routes r ON p.route_id = r.route_id),
b AS (SELECT *, CASE auth_level WHEN 'admin' THEN 3 WHEN 'anonymous' THEN step ELSE step + 1 END
 - CASE WHEN source_count >= 3 THEN 1 ELSE 0 END - CASE WHEN url IN ('/api/payment', '/login') THEN 1 ELSE 0 END AS lvl FROM j),
q AS (SELECT *, concat('P', CAST(greatest(lvl, 0) AS VARCHAR)) AS priority FROM b)"""


def queue(t):
    return scored_queue(t.fx_tool_findings, t.fx_packs, t.fx_routes)


@query("T01_priority_queue", f"WITH {QUEUE_SQL} SELECT priority, auth_level, COUNT(*) AS findings FROM q GROUP BY 1, 2")
def slice_query(t):
    return queue(t).groupBy("priority", "auth_level").agg(F.count("*").alias("findings"))


@query("T01_queue_rows", f"""WITH {QUEUE_SQL} SELECT priority, source_count, sources, file, line, sink_function, route_id, auth_level FROM q
ORDER BY priority, source_count DESC, file, line, sink_function""")
def queue_rows(t):
    return W.queue_order(queue(t).select("priority", "source_count", F.array_join("sources", ",").alias("sources"), "file",
                                         "line", "sink_function", "route_id", "auth_level"))


@query("J01_route_auth", f"WITH {QUEUE_SQL} SELECT route_id = 'unknown' AS unlinked, auth_level, url, COUNT(*) AS findings FROM j GROUP BY 1, 2, 3")
def route_auth(t):
    return queue(t).groupBy((F.col("route_id") == "unknown").alias("unlinked"), "auth_level", "url").agg(F.count("*").alias("findings"))


TOOLS = ["ast_sinks", "psalm", "progpilot", "semgrep", "codeql"]


def _per_tool(t):
    """The reports as one frame per tool, the way they arrive."""
    f = t.fx_tool_findings
    return [f.where(F.col("source") == tool).drop("source").withColumn("source", F.lit(tool)) for tool in TOOLS]


@query("X01_union_reports", "SELECT source, sink_type, COUNT(*) AS n FROM fx_tool_findings GROUP BY 1, 2")
def union_reports(t):
    from vulnlake.operators.sets import union_findings
    return union_findings(_per_tool(t)).groupBy("source", "sink_type").agg(F.count("*").alias("n"))


def report_documents(t):
    """Reports as the tools write them: nested documents of one file (or package, or pack) each."""
    f = t.fx_tool_findings.groupBy("source", "file").agg(F.collect_list(F.struct("line", "sink_function", "sink_type")).alias("x"))  # the findings of one file
    lit, file = F.lit, F.col("file")

    def entries(make):
        return F.transform("x", lambda e: F.struct(*[c.alias(n) for n, c in make(e).items()]))

    shapes = {
        "ast_sinks": F.struct(lit(3).alias("total"), entries(lambda e: {"file": file, "line": e["line"], "function": e["sink_function"], "sink_type": e["sink_type"]}).alias("sinks")),
        "psalm": entries(lambda e: {"severity": lit("error"), "file_name": file, "line_from": e["line"], "selected_text": e["sink_function"], "type": e["sink_type"],
                                    "taint_trace": F.array(F.struct(file.alias("file_name"), lit(1).alias("line_from")))}),
        "progpilot": entries(lambda e: {"source_file": F.array(file), "source_line": F.array(lit(1)), "sink_name": e["sink_function"], "sink_line": e["line"], "sink_file": file, "vuln_name": e["sink_type"]}),
        "semgrep": F.struct(F.array().cast("array<string>").alias("errors"), entries(lambda e: {
            "check_id": e["sink_function"], "path": file, "start": F.struct(e["line"].alias("line"), lit(1).alias("col")),
            "extra": F.struct(F.struct(e["sink_type"].alias("category")).alias("metadata"))}).alias("results")),
        "codeql": F.struct(lit("2.1.0").alias("version"), F.array(F.struct(entries(lambda e: {
            "ruleId": e["sink_function"], "properties": F.struct(e["sink_type"].alias("kind")),
            "locations": F.array(F.struct(F.struct(F.struct(file.alias("uri")).alias("artifactLocation"), F.struct(e["line"].alias("startLine")).alias("region")).alias("physicalLocation")))}).alias("results"))).alias("runs")),
    }
    docs = {tool: f.where(F.col("source") == tool).select(F.to_json(doc).alias("value")) for tool, doc in shapes.items()}
    message = F.struct(F.col("line"), lit("variable.undefined").alias("identifier"), lit("Undefined variable").alias("message"), lit(True).alias("ignorable"))
    lines = t.fx_lines.groupBy("path").agg(F.collect_list(message).alias("messages"))
    docs["phpstan"] = lines.select(F.to_json(F.struct(F.struct(F.size("messages").alias("file_errors")).alias("totals"), F.create_map("path", F.struct("messages")).alias("files"))).alias("value"))
    docs["composer_audit"] = t.fx_advisories.select(F.to_json(F.struct(F.create_map("package", F.array(
        F.struct(F.col("vuln_id").alias("advisoryId"), F.col("package").alias("packageName")))).alias("advisories"), F.create_map().cast("map<string,string>").alias("abandoned"))).alias("value"))
    layer = lambda role, at: F.struct(lit(role).alias("role"), file.alias("file"), lit(at).alias("lines"))
    docs["context_extractor"] = t.fx_packs.select(F.to_json(F.struct(
        lit("system").alias("sink_function"), lit("RCE").alias("sink_type"), F.array(layer("SINK", "40-44"), layer("CALLER", "7-9")).alias("layers"))).alias("value"))
    failed = t.nation.select(F.to_json(F.struct(lit("failed").alias("status"), F.col("n_name").alias("error"), F.array().cast("array<string>").alias("results"))).alias("value"))
    broken = t.region.select(F.concat(F.lit("PHP Fatal error: "), "r_name").alias("value"))  # what a crashed tool leaves
    return {tool: d.unionByName(failed).unionByName(broken) for tool, d in docs.items()}


@query("R03_normalised_findings", """
SELECT file, line, sink_function, sink_type, source, COUNT(*) AS n FROM (
 SELECT file, line, sink_function, sink_type, source FROM fx_tool_findings UNION ALL
 SELECT path, line, 'variable.undefined', 'Undefined variable', 'phpstan' FROM fx_lines UNION ALL
 SELECT file, 40, 'system', 'RCE', 'context_extractor' FROM fx_packs UNION ALL
 SELECT 'composer.json', 0, package, 'known_vuln', 'composer_audit' FROM fx_advisories) GROUP BY 1, 2, 3, 4, 5""")
def normalised(t):
    from vulnlake.operators.sets import union_findings
    from vulnlake.sources.reports import read_findings
    rows = union_findings([read_findings(t.spark, docs, tool) for tool, docs in report_documents(t).items()])
    keys = ["file", "line", "sink_function", "sink_type", "source"]
    return dealt(rows, *keys).groupBy(*keys).agg(F.count("*").alias("n"))  # nearly as many groups as findings


@query("R04_failed_tools", """
WITH r AS (SELECT o_orderkey % 7 AS tool, CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'ok' END AS status, o_custkey AS v FROM orders)
SELECT tool, COUNT(*) AS reports, SUM(CASE WHEN status = 'failed' THEN 1 ELSE 0 END)::BIGINT AS failed,
 SUM(CASE WHEN status = 'failed' THEN 0 ELSE 1 END)::BIGINT AS results FROM r GROUP BY tool""")
def failed_tools(t):
    from vulnlake.sources.reports import report_rows
    reports = t.orders.select(
        (F.col("o_orderkey") % 7).alias("tool"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("ok").alias("status"),
        F.when(F.col("o_orderstatus") != "F", F.array("o_custkey")).alias("results"))
    rows = report_rows(reports)
    status = reports.groupBy("tool").agg(F.count("*").alias("reports"), F.count_if(F.col("status") == "failed").alias("failed"))
    return status.join(rows.groupBy("tool").agg(F.count("result").alias("results")), "tool")


@query("D01_dedup_findings", """
SELECT file, line, sink_function, min(project) AS project, min(sink_type) AS sink_type,
 array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, COUNT(DISTINCT source) AS source_count
FROM fx_tool_findings GROUP BY file, line, sink_function""")
def dedup(t):
    return A.dedup_findings(t.fx_tool_findings).withColumn("sources", F.array_join("sources", ","))


ADV_SQL = """a AS (SELECT vuln_id, package, 'osv' AS source, [vuln_id || '-a', 'X' || package] AS al, ['r1', 'r' || CAST(intro_major AS VARCHAR)] AS rf,
 CASE WHEN cvss >= 9 THEN 'critical' WHEN cvss >= 7 THEN 'high' WHEN cvss >= 4 THEN 'medium' ELSE 'low' END AS severity, 1 AS seq FROM fx_advisories
 UNION ALL SELECT vuln_id, package, 'vendor', [vuln_id || '-a', vuln_id || '-b'], ['r1', 'r7', 'r8', 'r' || CAST(fixed_major AS VARCHAR)], 'high', 2 FROM fx_advisories WHERE cvss > 3
 UNION ALL SELECT vuln_id, package, 'vendor', [vuln_id || '-b'], ['r9'], 'low', 3 FROM fx_advisories WHERE cvss > 5)"""


def advisories(t):
    a = t.fx_advisories
    s = lambda c: F.col(c).cast("string")
    base = lambda df, src, al, rf, sev, seq: df.select(
        "vuln_id", "package", F.lit(src).alias("source"), F.array(*al).alias("aliases"), F.array(*rf).alias("references"),
        sev.alias("severity"), F.lit(seq).alias("seq"))
    ida, idb = F.concat("vuln_id", F.lit("-a")), F.concat("vuln_id", F.lit("-b"))
    r = lambda c: F.concat(F.lit("r"), s(c))
    return (
        base(a, "osv", [ida, F.concat(F.lit("X"), "package")], [F.lit("r1"), r("intro_major")], S.score_bucket("cvss"), 1)
        .unionByName(base(a.where("cvss > 3"), "vendor", [ida, idb], [F.lit("r1"), F.lit("r7"), F.lit("r8"), r("fixed_major")], F.lit("high"), 2))
        .unionByName(base(a.where("cvss > 5"), "vendor", [idb], [F.lit("r9")], F.lit("low"), 3)))


@query("D02_dedup_advisories", f"""WITH {ADV_SQL}
SELECT vuln_id, package, array_to_string(list_sort(list(DISTINCT source)), '+') AS source,
 array_to_string(list_sort(list_distinct(flatten(list(al)))), ',') AS aliases,
 array_to_string(list_slice(list_sort(list_distinct(flatten(list(rf)))), 1, 5), ',') AS refs,
 min_by(severity, seq) AS severity FROM a GROUP BY 1, 2""")
def dedup_adv(t):
    d = A.dedup_advisories(advisories(t))
    return d.select("vuln_id", "package", "source", F.array_join("aliases", ",").alias("aliases"),
                    F.array_join("references", ",").alias("refs"), "severity")


@query("D03_severity_histogram", f"""WITH {ADV_SQL}
SELECT package, COUNT(*) AS total, COUNT(*) FILTER (severity = 'critical') AS critical, COUNT(*) FILTER (severity = 'high') AS high,
 COUNT(*) FILTER (severity = 'medium') AS medium, COUNT(*) FILTER (severity = 'low') AS low,
 COUNT(*) FILTER (severity NOT IN ('critical','high','medium','low')) AS other FROM a GROUP BY package""")
def histogram(t):
    return A.severity_histogram(advisories(t), ["package"])


@query("D04_memory_stats", """
SELECT 'status' AS facet, result AS value, COUNT(*) AS n, COUNT(*) FILTER (result = 'confirmed') AS confirmed FROM fx_rounds GROUP BY result
UNION ALL SELECT * FROM (SELECT 'strategy', strategy, COUNT(*) AS n, COUNT(*) FILTER (result = 'confirmed') FROM fx_rounds GROUP BY strategy
 ORDER BY n DESC, strategy LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'subject', CAST(sink_no AS VARCHAR), COUNT(*) AS n, COUNT(*) FILTER (result = 'confirmed') FROM fx_rounds GROUP BY sink_no
 ORDER BY n DESC, CAST(sink_no AS VARCHAR) LIMIT 10)
UNION ALL SELECT 'total', 'all', COUNT(*), COUNT(*) FILTER (result = 'confirmed') FROM fx_rounds""")
def memory_stats(t):
    from vulnlake.operators.memory import facet_stats
    return facet_stats(t.fx_rounds, F.col("result") == "confirmed",
                       {"status": ("result", None), "strategy": ("strategy", 5), "subject": ("sink_no", 10)})


@query("D05_board_stats", """
SELECT CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' ELSE 'normal' END AS priority, event_type AS finding_type,
 COUNT(*) AS n, COUNT(*) FILTER (event_id % 3 = 0) AS unconsumed FROM events GROUP BY 1, 2""")
def board_stats(t):
    from vulnlake.operators.memory import board_stats as stats
    from vulnlake.plans.fixtures import board
    return stats(board(t), ["priority", "finding_type"])


QC_COLS = """COUNT(*) AS checks, COUNT(*) FILTER (verdict = 'pass') AS passed, COUNT(*) FILTER (verdict = 'fail') AS failed,
 SUM(redo_count)::BIGINT AS redos, CAST(round(avg(pass_count * 100e0 / nullif(total_count, 0)), 1) AS DOUBLE) AS avg_pass_rate"""


@query("D06_qc_stats", f"SELECT phase, {QC_COLS} FROM fx_qc GROUP BY phase")
def qc_stats(t):
    return A.qc_stats(t.fx_qc)


@query("D07_qc_rollup", f"SELECT phase, {QC_COLS} FROM fx_qc GROUP BY ROLLUP(phase)")
def qc_rollup(t):
    return A.qc_stats(t.fx_qc, overall=True)


@query("D08_pass_percent", """
SELECT target_agent, CASE WHEN SUM(total_count) > 0 THEN CAST(CAST(floor(SUM(pass_count) * 100e0 / SUM(total_count)) AS BIGINT) AS VARCHAR) ELSE 'N/A' END AS percent
FROM fx_qc GROUP BY target_agent""")
def percent(t):
    return t.fx_qc.groupBy("target_agent").agg(A.pass_percent(F.sum("pass_count"), F.sum("total_count")).alias("percent"))


@query("D09_grade", """
WITH g AS (SELECT phase, target_agent, COUNT(*) FILTER (verdict = 'fail') AS failed, COUNT(*) FILTER (verdict = 'fail' AND redo_count >= 2) AS degraded
 FROM fx_qc GROUP BY 1, 2)
SELECT *, CASE WHEN failed = 0 THEN 'A' WHEN degraded = 0 THEN 'B' WHEN degraded <= 2 THEN 'C' ELSE 'D' END AS grade FROM g""")
def grades(t):
    fail = F.col("verdict") == "fail"
    g = t.fx_qc.groupBy("phase", "target_agent").agg(
        F.count_if(fail).alias("failed"), F.count_if(fail & (F.col("redo_count") >= 2)).alias("degraded"))
    return g.withColumn("grade", A.grade(F.col("failed"), F.col("degraded")))


@query("D10_assessment_summary", """
SELECT strategy, COUNT(*) AS total, COUNT(*) FILTER (result = 'confirmed') AS confirmed, COUNT(*) FILTER (result = 'suspected') AS suspected,
 COUNT(DISTINCT sink_no) AS subjects FROM fx_rounds GROUP BY strategy""")
def summary(t):
    r = F.col("result")
    return t.fx_rounds.groupBy("strategy").agg(
        F.count("*").alias("total"), F.count_if(r == "confirmed").alias("confirmed"), F.count_if(r == "suspected").alias("suspected"),
        F.countDistinct("sink_no").alias("subjects"))


@query("D11_high_value_objects", """
SELECT project, data_object, COUNT(*) AS nodes, array_to_string(list_sort(list(DISTINCT vuln_type)), ',') AS types,
 CASE min(CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END) WHEN 0 THEN 'critical' WHEN 1 THEN 'high'
 WHEN 2 THEN 'medium' ELSE 'low' END AS max_severity FROM fx_nodes GROUP BY 1, 2 HAVING COUNT(*) >= 3""")
def objects(t):
    return A.high_value_objects(t.fx_nodes).withColumn("types", F.array_join("types", ","))


@query("D12_technique_feedback", """
WITH g AS (SELECT strategy, COUNT(DISTINCT sink_no) AS subjects, COUNT(DISTINCT CASE WHEN result = 'confirmed' THEN sink_no END) AS won
 FROM fx_rounds GROUP BY strategy)
SELECT *, CASE WHEN subjects < 3 THEN 'pending' WHEN won = 0 THEN 'low_yield' WHEN won = subjects THEN 'high_yield' ELSE 'conditional' END AS verdict FROM g""")
def feedback(t):
    return A.technique_feedback(t.fx_rounds)


@query("D13_race_significance", """
WITH g AS (SELECT user_id, COUNT(*) AS attempts, COUNT(*) FILTER (event_type IN ('purchase', 'signup')) AS successes FROM events GROUP BY 1)
SELECT *, CASE WHEN attempts >= 20 AND successes * 1e0 > 0.3e0 * attempts THEN 'confirmed' WHEN successes > 0 THEN 'needs_verification' ELSE 'none' END AS verdict FROM g""")
def race(t):
    return A.race_significance(t.events, ["user_id"], F.col("event_type").isin("purchase", "signup"))


@query("D14_coverage", """
WITH p AS (SELECT route_id, MAX(1) AS has_pack FROM fx_packs GROUP BY 1), s AS (SELECT DISTINCT f.project, k.route_id FROM fx_tool_findings f JOIN fx_packs k USING (file)),
g AS (SELECT CAST(split_part(r.controller, 'Ctl', 2) AS BIGINT) % 10 AS area, COUNT(*) AS routes, COUNT(*) FILTER (r.middleware <> '') AS with_auth,
 COUNT(s.route_id) AS analysed FROM fx_routes r LEFT JOIN s ON r.route_id = s.route_id GROUP BY 1)
SELECT area, routes, with_auth, analysed, CAST(round(with_auth * 100e0 / routes, 2) AS DOUBLE) AS auth_pct, with_auth * 100 >= 80 * routes AS auth_ok,
 CAST(round(analysed * 100e0 / routes, 2) AS DOUBLE) AS route_pct, analysed * 100 >= 90 * routes AS route_ok FROM g""")
def coverage(t):
    from vulnlake.operators.quality import coverage as cov
    routes = t.fx_routes.withColumn("area", F.regexp_extract("controller", "[0-9]+", 0).cast("long") % 10)
    analysed = t.fx_tool_findings.select("file").distinct().join(t.fx_packs, "file").select("route_id").distinct()
    return cov(routes, analysed, ["area"], F.col("middleware") != "")


@query("D15_queue_sanity", f"""WITH {QUEUE_SQL} SELECT project, COUNT(*) AS total, COUNT(*) FILTER (priority = 'P0') AS p0,
 COUNT(*) FILTER (priority = 'P0') = 0 AS warn_empty, COUNT(*) FILTER (priority = 'P0') > 20 AS warn_many, COUNT(*) > 200 AS sample_low FROM q GROUP BY project""")
def sanity(t):
    p0 = F.count_if(F.col("priority") == "P0")
    return queue(t).groupBy("project").agg(
        F.count("*").alias("total"), p0.alias("p0"), (p0 == 0).alias("warn_empty"), (p0 > 20).alias("warn_many"),
        (F.count("*") > 200).alias("sample_low"))


@query("D16_producer_matrix", """
SELECT target_agent, COUNT(*) FILTER (verdict = 'pass') AS pass, COUNT(*) FILTER (verdict = 'fail') AS fail FROM fx_qc GROUP BY 1""")
def matrix(t):
    return t.fx_qc.groupBy("target_agent").pivot("verdict", ["pass", "fail"]).count().fillna(0)


@query("D17_auth_gaps", """
SELECT controller, COUNT(*) AS routes, COUNT(*) FILTER (NOT prot) AS unprotected, COUNT(*) FILTER (NOT prot AND method <> 'GET') AS high_risk
FROM (SELECT *, regexp_matches(middleware, '(^|,)(auth|can:)') AS prot FROM fx_routes) GROUP BY 1""")
def auth_gaps(t):
    prot = F.col("middleware").rlike("(^|,)(auth|can:)")
    return t.fx_routes.groupBy("controller").agg(
        F.count("*").alias("routes"), F.count_if(~prot).alias("unprotected"),
        F.count_if(~prot & (F.col("method") != "GET")).alias("high_risk"))


@query("D18_progress_dashboard", """
SELECT user_id, MAX(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END)::INT AS phase_reached,
 COUNT(*) AS records, COUNT(*) FILTER (event_type = 'error') AS errors, CAST(epoch_us(MAX(ts)) - epoch_us(MIN(ts)) AS BIGINT) AS elapsed_us FROM events GROUP BY 1""")
def dashboard(t):
    phase = S.pick(F.col("event_type"), {"view": 1, "click": 2, "signup": 3, "purchase": 4}, 0)
    return t.events.groupBy("user_id").agg(
        F.max(phase).alias("phase_reached"), F.count("*").alias("records"), F.count_if(F.col("event_type") == "error").alias("errors"),
        (micros(F.max("ts")) - micros(F.min("ts"))).alias("elapsed_us"))


@query("D19_timing_channel", """
SELECT user_id, COUNT(*) AS samples, CAST(round(median(value), 6) AS DOUBLE) AS median_value FROM events GROUP BY 1 HAVING COUNT(*) >= 50""")
def timing(t):
    return medians(t.events, ["user_id"], "value", 50).select("user_id", "samples", F.round("median", 6).alias("median_value"))


@query("D19_case_medians", """
WITH m AS (SELECT user_id % 40 AS subject, event_type, COUNT(*) AS samples, median(value) AS median FROM events GROUP BY 1, 2 HAVING COUNT(*) >= 10)
SELECT subject, COUNT(*) AS cases, arg_min(event_type, {'m': median, 'e': event_type}) AS fastest, arg_max(event_type, {'m': median, 'e': event_type}) AS slowest,
 round(max(median) - min(median), 6) AS gap FROM m GROUP BY 1 HAVING COUNT(*) >= 2""")
def case_medians(t):
    e = t.events.select((F.col("user_id") % 40).alias("subject"), "event_type", "value")
    return timing_gaps(e, ["subject"], "event_type", "value", 10).withColumn("gap", F.round("gap", 6))


@query("D20_response_differential", """
WITH b AS (SELECT split_part(url, '/', 3) AS host, page_id, status, body_len, h_acao IS NULL AS baseline FROM fx_http),
base AS (SELECT host, min_by(status, page_id) AS bs, min_by(body_len, page_id) AS bl FROM b WHERE baseline GROUP BY host),
g AS (SELECT b.host, COUNT(*) AS variants, COUNT(*) FILTER (b.status <> bs) AS status_diff, COUNT(*) FILTER (abs(b.body_len - bl) > 1000) AS length_diff
 FROM b JOIN base ON b.host = base.host WHERE NOT baseline GROUP BY b.host)
SELECT *, CASE WHEN status_diff + length_diff >= 3 THEN 'highly_likely' WHEN status_diff + length_diff >= 1 THEN 'possible' ELSE 'none' END AS verdict FROM g""")
def differential(t):
    h = t.fx_http.select(F.split("url", "/")[2].alias("host"), "page_id", "status", "body_len", F.col("h_acao").isNull().alias("baseline"))
    base = h.where("baseline").groupBy("host").agg(F.min_by("status", "page_id").alias("bs"), F.min_by("body_len", "page_id").alias("bl"))
    g = spread_join(h.where(~F.col("baseline")), base, "host").groupBy("host").agg(
        F.count("*").alias("variants"), F.count_if(F.col("status") != F.col("bs")).alias("status_diff"),
        F.count_if(F.abs(F.col("body_len") - F.col("bl")) > 1000).alias("length_diff"))
    return g.withColumn("verdict", A.differential_verdict(F.col("status_diff") + F.col("length_diff")))


@query("D21_user_enumeration", """
WITH g AS (SELECT event_type, user_id % 2 = 0 AS known, CAST(floor(value) AS BIGINT) AS msg FROM events),
k AS (SELECT event_type, msg, MAX(CASE WHEN known THEN 1 ELSE 0 END) AS seen_known, MAX(CASE WHEN known THEN 0 ELSE 1 END) AS seen_unknown FROM g GROUP BY 1, 2)
SELECT event_type, COUNT(*) AS responses, COUNT(*) FILTER (seen_known + seen_unknown = 1) AS telling FROM k GROUP BY 1""")
def enumeration(t):
    g = t.events.select("event_type", (F.col("user_id") % 2 == 0).alias("known"), F.floor("value").alias("msg"))
    k = g.groupBy("event_type", "msg").agg(F.bool_or("known").alias("a"), F.bool_or(~F.col("known")).alias("b"))
    return k.groupBy("event_type").agg(F.count("*").alias("responses"), F.count_if(F.col("a") != F.col("b")).alias("telling"))


@query("D22_id_entropy", """
WITH c AS (SELECT source, i AS pos, substr(md5(text), CAST(i + 1 AS BIGINT), 1) AS ch FROM documents, range(0, 32) r(i)),
n AS (SELECT source, pos, ch, COUNT(*) AS n FROM c GROUP BY 1, 2, 3)
SELECT source, CAST(pos AS INT) AS pos, SUM(n)::BIGINT AS ids, CAST(round(log2(SUM(n)) - SUM(n * log2(n)) / SUM(n), 6) AS DOUBLE) AS entropy FROM n GROUP BY 1, 2 HAVING SUM(n) >= 20""")
def entropy(t):
    return A.position_entropy(t.documents.select("source", F.md5("text").alias("sid")), ["source"], "sid")


@query("D24_schema_merge", """
WITH c AS (SELECT concat('t', CAST(l_suppkey AS VARCHAR)) AS tbl, concat('c', CAST(l_linenumber AS VARCHAR)) AS col,
 CASE l_partkey % 4 WHEN 0 THEN 'migration' WHEN 1 THEN 'model' WHEN 2 THEN 'sql' ELSE 'validation' END AS origin,
 CASE l_partkey % 4 WHEN 0 THEN 'BIGINT' WHEN 1 THEN 'INT' WHEN 2 THEN NULL ELSE 'TEXT' END AS type FROM lineitem),
r AS (SELECT *, CASE origin WHEN 'migration' THEN 0 WHEN 'model' THEN 1 WHEN 'sql' THEN 2 ELSE 3 END AS k FROM c)
SELECT tbl, col, COALESCE(min_by(type, k) FILTER (type IS NOT NULL), 'VARCHAR(255)') AS type, min_by(origin, k) AS origin, COUNT(DISTINCT origin) AS origins FROM r GROUP BY 1, 2""")
def schema_merge(t):
    m = F.col("l_partkey") % 4
    return A.merge_schema(t.lineitem.select(
        F.concat(F.lit("t"), F.col("l_suppkey").cast("string")).alias("tbl"), F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("col"),
        S.pick(m, {0: "migration", 1: "model", 2: "sql"}, "validation").alias("origin"),
        S.pick(m, {0: "BIGINT", 1: "INT", 2: None}, "TEXT").alias("type")))


@query("D25_redirect_assessment", """
WITH g AS (SELECT split_part(url, '/', 3) AS host, COUNT(*) FILTER (status = 302) AS hits FROM fx_http GROUP BY 1)
SELECT *, CASE WHEN hits >= 3 THEN 'highly_vulnerable' WHEN hits >= 1 THEN 'vulnerable' ELSE 'safe' END AS verdict FROM g""")
def redirects(t):
    g = t.fx_http.groupBy(F.split("url", "/")[2].alias("host")).agg(F.count_if(F.col("status") == 302).alias("hits"))
    return g.withColumn("verdict", A.redirect_verdict(F.col("hits")))


@query("D26_run_triggers", """
SELECT sink_no, event_id, rn FROM (SELECT sink_no, event_id, row_number() OVER (PARTITION BY sink_no ORDER BY ts, event_id) AS rn FROM fx_rounds
 WHERE result = 'failed') WHERE rn <= 10""")
def triggers(t):
    from vulnlake.operators.ordered import top_k
    r = top_k(t.fx_rounds.where("result = 'failed'"), ["sink_no"], ["ts", "event_id"], 10, "rn")
    return r.select("sink_no", "event_id", F.col("rn").cast("long").alias("rn"))


# --- windows -------------------------------------------------------------------------------

@query("E01_finding_numbers", """
WITH h AS (SELECT project, file, line, sink_type AS type, MAX(r * 40 + i * 35 + c * 25) AS score FROM fx_sinks GROUP BY 1, 2, 3, 4),
l AS (SELECT *, CASE WHEN score >= 270 THEN 'C' WHEN score >= 210 THEN 'H' WHEN score >= 120 THEN 'M' WHEN score >= 10 THEN 'L' END AS level FROM h),
n AS (SELECT *, row_number() OVER (PARTITION BY project, level, type ORDER BY score DESC, file, line) AS n FROM l WHERE level IS NOT NULL)
SELECT project, file, line, type, score, level, concat(level, '-', upper(type), '-', CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END) AS vuln_id FROM n""")
def numbers(t):
    h = S.severity_hundredths("r", "i", "c")
    g = t.fx_sinks.groupBy("project", "file", "line", F.col("sink_type").alias("type")).agg(F.max(h).alias("score"))
    g = g.withColumn("level", S.severity_level("score")).where(F.col("level").isNotNull())
    return W.finding_ids(g)


@query("E02_queue_ids", f"""WITH {QUEUE_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY priority, source_count DESC, file, line, sink_function) AS n FROM q)
SELECT project, file, line, sink_function, concat('sink_', CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END) AS sink_id FROM n""")
def queue_ids(t):
    q = queue(t).select("project", "file", "line", "sink_function", "priority", "source_count")
    return W.queue_ids(q, ["priority", F.col("source_count").desc(), "file", "line", "sink_function"]).drop("priority", "source_count")


@query("E03_stuck_detection", """
WITH w AS (SELECT *, row_number() OVER (PARTITION BY sink_no ORDER BY ts, event_id) AS rn,
 SUM(CASE WHEN result = 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY sink_no ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS f3 FROM fx_rounds)
SELECT sink_no, event_id, rn FROM w WHERE rn >= 4 AND f3 = 3""")
def stuck(t):
    return W.stuck_rounds(t.fx_rounds).select("sink_no", "event_id", "rn")


@query("E04_blocked_streak", """
WITH w AS (SELECT *, SUM(CASE WHEN result = 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY sink_no ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS f5,
 SUM(CASE WHEN result = 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY sink_no ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS f8 FROM fx_rounds)
SELECT sink_no, event_id, f8 = 8 AS pivot_again FROM w WHERE f5 = 5 AND filter_score >= 61""")
def blocked(t):
    return W.blocked_rounds(t.fx_rounds).select("sink_no", "event_id", "pivot_again")


@query("E05_round_blocks", """
WITH w AS (SELECT *, row_number() OVER (PARTITION BY sink_no ORDER BY ts, event_id) AS rn FROM fx_rounds)
SELECT sink_no, CAST(floor((rn - 1) / 3e0) AS BIGINT) AS block, COUNT(*) AS rounds,
 string_agg(concat('R', CAST(rn AS VARCHAR), ':', strategy, ':', result), ' | ' ORDER BY rn) AS summary,
 max_by(event_id, rn) AS last_event_id, COUNT(*) FILTER (result = 'failed') AS failed FROM w GROUP BY 1, 2""")
def blocks(t):
    return W.compress_rounds(t.fx_rounds)


def memory(t):
    return t.fx_rounds.select(F.col("event_id").alias("id"), "sink_no", F.col("result").alias("status"), F.col("ts").alias("created_at"))


@query("E06_memory_retention", """
SELECT event_id AS id, sink_no, result AS status FROM fx_rounds WHERE (SELECT COUNT(*) FROM fx_rounds) <= 1000 OR result = 'confirmed'
 OR event_id IN (SELECT event_id FROM fx_rounds ORDER BY ts DESC, event_id DESC LIMIT 500)""")
def retention(t):
    return W.retain_memory(memory(t)).select("id", "sink_no", "status")


@query("E07_graph_retention", """
WITH n AS (SELECT COUNT(*) AS n FROM fx_nodes), o AS (SELECT node_id, row_number() OVER (ORDER BY seq, node_id) AS rn FROM fx_nodes WHERE status = 'potential'),
gone AS (SELECT node_id FROM o, n WHERE n.n > 1000 AND rn <= n.n - 900)
SELECT relation, COUNT(*) AS edges FROM fx_edges WHERE source_node NOT IN (SELECT node_id FROM gone) AND target_node NOT IN (SELECT node_id FROM gone) GROUP BY 1""")
def graph_retention(t):
    _, edges = W.retain_graph(t.fx_nodes, t.fx_edges, status="potential", capacity=1000, keep=900)
    return edges.groupBy("relation").agg(F.count("*").alias("edges"))


@query("E08_latest_checks", """
WITH l AS (SELECT *, row_number() OVER (PARTITION BY phase, target_agent ORDER BY ts DESC, qc_id DESC) AS k FROM fx_qc)
SELECT phase, target_agent, qc_id, verdict, redo_count, ts, verdict = 'fail' AND redo_count < CASE phase WHEN '1' THEN 3 ELSE 2 END AS may_redo FROM l WHERE k = 1""")
def latest(t):
    return W.latest_checks(t.fx_qc)


@query("E09_down_sampling", f"""WITH {QUEUE_SQL},
c AS (SELECT file, priority, line, sink_function, source_count, COUNT(*) OVER (PARTITION BY file) AS routes, COUNT(*) OVER (PARTITION BY file, priority) AS n,
 row_number() OVER (PARTITION BY file, priority ORDER BY source_count DESC, line, sink_function) AS rn FROM q)
SELECT file, priority, line, sink_function, source_count FROM c WHERE rn <= ceil(n * CASE WHEN priority IN ('P0','P1') THEN 100
 WHEN priority = 'P2' THEN CASE WHEN routes <= 100 THEN 100 WHEN routes <= 200 THEN 50 ELSE 30 END
 ELSE CASE WHEN routes <= 50 THEN 100 WHEN routes <= 100 THEN 50 WHEN routes <= 200 THEN 25 ELSE 0 END END / 100e0)""")
def sampling(t):
    return W.down_sample(queue(t), "file").select("file", "priority", "line", "sink_function", "source_count")


@query("E10_mixed_protection", """
SELECT route_id, controller, 'HIGH_RISK' AS risk FROM fx_routes WHERE auth_level = 'anonymous'
 AND controller IN (SELECT controller FROM fx_routes WHERE auth_level <> 'anonymous')""")
def mixed(t):
    return W.mixed_protection(t.fx_routes).select("route_id", "controller", "risk")


@query("E11_conflicts", """
WITH k AS (SELECT *, row_number() OVER (PARTITION BY sink_no ORDER BY has_evidence DESC, ts DESC, event_id DESC) AS k,
 MIN(result) OVER (PARTITION BY sink_no) <> MAX(result) OVER (PARTITION BY sink_no) AS conflict, bool_or(has_evidence) OVER (PARTITION BY sink_no) AS evidenced FROM fx_rounds)
SELECT sink_no, result AS verdict, evidenced, conflict FROM k WHERE k = 1""")
def conflicts(t):
    return W.resolve_conflicts(t.fx_rounds)


@query("E14_time_in_state", """
WITH p AS (SELECT user_id, event_id, ts, lag(ts) OVER w AS prev_ts, lag(event_type) OVER w AS prev_state FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, prev_state, COUNT(*) AS spells, SUM(epoch_us(ts) - epoch_us(prev_ts))::BIGINT AS total_us,
 COUNT(*) FILTER (epoch_us(ts) - epoch_us(prev_ts) > 600000000) AS stuck FROM p WHERE prev_ts IS NOT NULL GROUP BY 1, 2""")
def in_state(t):
    d = W.state_durations(t.events.select("user_id", "event_id", "ts", "event_type"), "user_id", "ts", "event_type", ["ts", "event_id"])
    return d.groupBy("user_id", "prev_state").agg(F.count("*").alias("spells"), F.sum("gap_us").alias("total_us"), F.count_if("stuck").alias("stuck"))


@query("E15_session_fixation", """
WITH s AS (SELECT user_id, event_id, ts, event_type, CAST(floor(value / 20) AS BIGINT) AS session_id FROM events),
p AS (SELECT *, lag(session_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM s)
SELECT user_id, event_id, session_id FROM p WHERE event_type = 'signup' AND prev = session_id""")
def fixation(t):
    from vulnlake.operators.ordered import previous
    s = t.events.select("user_id", "event_id", "ts", "event_type", F.floor(F.col("value") / 20).alias("session_id"))
    p = previous(s, ["user_id"], ["ts", "event_id"], {"prev": "session_id"})
    return p.where((F.col("event_type") == "signup") & (F.col("prev") == F.col("session_id"))).select("user_id", "event_id", "session_id")


# --- orders and limits that are the feature ------------------------------------------------

@query("T02_memory_lookup", """
SELECT id, status, created_at FROM (SELECT event_id AS id, result AS status, ts AS created_at FROM fx_rounds WHERE strategy = 'strategy_3')
ORDER BY CASE status WHEN 'confirmed' THEN 0 WHEN 'failed' THEN 2 ELSE 3 END, created_at DESC, id LIMIT 20""")
def lookup(t):
    m = t.fx_rounds.select(F.col("event_id").alias("id"), F.col("strategy").alias("sink_type"), F.col("result").alias("status"), F.col("ts").alias("created_at"))
    return W.memory_lookup(m, "strategy_3").select("id", "status", "created_at")


@query("T03_board_read", """
SELECT event_id, priority, ts FROM (SELECT event_id, ts, CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' ELSE 'normal' END AS priority FROM events WHERE event_id % 3 = 0)
ORDER BY CASE priority WHEN 'critical' THEN 1 WHEN 'high' THEN 2 ELSE 3 END, ts DESC, event_id""")
def board_read(t):
    from vulnlake.plans.fixtures import board
    b = board(t).where(F.size("consumed_by") == 0)
    return b.orderBy(*W.board_order(b), "event_id").select("event_id", "priority", "ts")


@query("T04_advisories_by_severity", f"""WITH {ADV_SQL} SELECT vuln_id, package, severity, seq FROM a
ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, vuln_id, package, seq""")
def adv_order(t):
    return W.by_severity(advisories(t), "vuln_id", "package", "seq").select("vuln_id", "package", "severity", "seq")


@query("T05_top_groups", "SELECT sink_type, COUNT(*) AS n FROM fx_tool_findings GROUP BY 1 ORDER BY n DESC, sink_type LIMIT 5")
def top_groups(t):
    return t.fx_tool_findings.groupBy("sink_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "sink_type").limit(5)


@query("T07_schedule_order", """
SELECT route_id, CASE WHEN regexp_matches(url, 'login|auth|token|session') THEN 0 ELSE 1 END AS k1, CASE WHEN auth_level = 'anonymous' THEN 0 ELSE 1 END AS k2,
 CASE WHEN method IN ('POST','PUT','DELETE') THEN 0 ELSE 1 END AS k3 FROM fx_routes ORDER BY k1, k2, k3, route_id""")
def schedule(t):
    k1, k2, k3 = W.schedule_order()
    return t.fx_routes.select("route_id", k1.alias("k1"), k2.alias("k2"), k3.alias("k3")).orderBy("k1", "k2", "k3", "route_id")


@query("T08_fix_order", """
SELECT node_id, CASE WHEN status = 'confirmed' AND severity IN ('critical','high') THEN 1 WHEN status = 'confirmed' AND severity = 'medium' THEN 2
 WHEN status = 'suspected' AND severity IN ('critical','high') THEN 3 ELSE 4 END AS place FROM fx_nodes""")
def fix(t):
    return t.fx_nodes.select("node_id", W.fix_order().alias("place")).orderBy("place", "node_id")


@query("T09_newest_shared", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 3")
def newest(t):
    return t.events.select("event_id", "ts").orderBy(F.desc("ts"), "event_id").limit(3)


# --- keyed writes --------------------------------------------------------------------------

@query("W09_insert_or_ignore", """
SELECT file, line, sink_function, min(source) AS source FROM fx_tool_findings GROUP BY 1, 2, 3""")
def insert_ignore(t):
    from vulnlake.sources.sinks import upsert
    f = t.fx_tool_findings.select("file", "line", "sink_function", "source")
    half = (F.hash("file", "line", "sink_function", "source") % 2) == 0
    return upsert(f.where(half), f.where(~half), ["file", "line", "sink_function"], F.col("source"), keep="first")


@query("W10_insert_or_replace", """
SELECT phase, target_agent, arg_max(qc_id, (ts, qc_id)) AS qc_id, arg_max(verdict, (ts, qc_id)) AS verdict FROM fx_qc GROUP BY 1, 2""")
def replace(t):
    from vulnlake.sources.sinks import upsert
    q = t.fx_qc.select("phase", "target_agent", "qc_id", "verdict", "ts")
    r = upsert(q.where("verdict = 'pass'"), q.where("verdict = 'fail'"), ["phase", "target_agent"], F.struct("ts", "qc_id"), keep="last")
    return r.drop("ts")


@query("W11_append_defaults", """
SELECT sink_no, result, 'none' AS waf_type, CASE WHEN strategy = 'strategy_0' THEN 0 ELSE 1 END AS eliminated, COUNT(*) AS n FROM fx_rounds GROUP BY 1, 2, 4""")
def defaults(t):
    from vulnlake.sources.sinks import with_defaults
    rows = t.fx_rounds.select("sink_no", "result", F.lit(None).cast("string").alias("waf_type"),
                              F.when(F.col("strategy") != "strategy_0", F.array("strategy")).alias("eliminated"))
    rows = with_defaults(rows, {"waf_type": F.lit("none"), "eliminated": F.array().cast("array<string>")})
    return rows.groupBy("sink_no", "result", "waf_type", F.size("eliminated").alias("eliminated")).agg(F.count("*").alias("n"))


# --- set operations ------------------------------------------------------------------------

@query("X02_neighbour_union", """
SELECT node, COUNT(*) AS n FROM (SELECT source_node AS node FROM fx_edges UNION ALL SELECT target_node FROM fx_edges) GROUP BY 1""")
def both_ends(t):
    e = t.fx_edges
    return e.select(F.col("source_node").alias("node")).unionByName(e.select(F.col("target_node").alias("node"))).groupBy("node").agg(F.count("*").alias("n"))


@query("X03_retention_union", """
SELECT event_id FROM fx_rounds WHERE result = 'confirmed' UNION SELECT event_id FROM (SELECT event_id FROM fx_rounds ORDER BY ts DESC, event_id DESC LIMIT 500)""")
def keep_union(t):
    r = t.fx_rounds
    newest = r.orderBy(F.desc("ts"), F.desc("event_id")).limit(500).select("event_id")
    return r.where("result = 'confirmed'").select("event_id").union(newest).distinct()


AREAS_RUN = "CASE WHEN l_suppkey % 3 = 0 THEN 'RCE' WHEN l_suppkey % 3 = 1 THEN 'SQLi' ELSE 'XSS' END"


@query("X04_types_not_run", """
WITH need AS (SELECT DISTINCT project, sink_type FROM fx_tool_findings), ran AS (SELECT DISTINCT project, sink_type FROM fx_sinks WHERE verdict = 'confirmed')
SELECT project, COUNT(*) AS missing FROM (SELECT * FROM need EXCEPT SELECT * FROM ran) GROUP BY 1""")
def not_run(t):
    from vulnlake.operators.sets import missing_types
    ran = t.fx_sinks.where("verdict = 'confirmed'").select("project", "sink_type")
    return missing_types(t.fx_tool_findings.select("project", "sink_type"), ran).groupBy("project").agg(F.count("*").alias("missing"))


@query("X05_constraint_floor", """
SELECT project, MAX(v_major * 100 + v_minor)::INT AS floor_key FROM fx_packages GROUP BY 1""")
def constraint_floor(t):
    from vulnlake.functions.versions import lowest_satisfying, part
    k = lowest_satisfying(t.fx_packages.select("project", F.concat(F.lit(">="), "v_major", F.lit("."), "v_minor").alias("rule")), "rule")
    return k.select("project", (part(F.col("floor"), 0) * 100 + part(F.col("floor"), 1)).cast("int").alias("floor_key"))


@query("X06_feed_intersection", "SELECT package FROM fx_packages INTERSECT SELECT package FROM fx_advisories")
def feeds(t):
    return t.fx_packages.select("package").intersect(t.fx_advisories.select("package"))


@query("X07_role_difference", """
WITH g AS (SELECT controller, CASE auth_level WHEN 'anonymous' THEN 0 WHEN 'authenticated' THEN 1 ELSE 2 END AS need, url FROM fx_routes),
a AS (SELECT DISTINCT controller, url, min(need) AS need FROM g GROUP BY 1, 2)
SELECT controller, COUNT(*) FILTER (need = 2) AS admin_only, COUNT(*) FILTER (need = 1) AS user_only, COUNT(*) FILTER (need = 0) AS everyone FROM a GROUP BY 1""")
def roles(t):
    from vulnlake.operators.sets import role_gain
    hierarchy = {"admin": ["authenticated", "anonymous"], "authenticated": ["anonymous"], "anonymous": []}
    grants = t.fx_routes.select("controller", F.col("auth_level").alias("role"), "url")
    gain = role_gain(grants, hierarchy, ["controller"], "url")
    return gain.groupBy("controller").agg(
        F.count_if(F.col("role") == "admin").alias("admin_only"), F.count_if(F.col("role") == "authenticated").alias("user_only"),
        F.count_if(F.col("role") == "anonymous").alias("everyone"))
