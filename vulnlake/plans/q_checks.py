"""Evidence, checks, memory rules, helpers and behaviour (D23, S42-S51, A*, U*, B*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vulnlake.functions import score as S
from vulnlake.functions import values as A
from vulnlake.operators import behaviour as B
from vulnlake.operators import checks as CK
from vulnlake.operators import evidence as E
from vulnlake.operators import memory as M
from vulnlake.operators import report as RP
from vulnlake.plans.q_findings import QUEUE_SQL, queue
from vulnlake.plans.q_graph import values
from vulnlake.operators.ordered import spread_join
from vulnlake.plans.q_scores import cvss as _scores_first  # noqa: F401 (its SQL is read below)
from vulnlake.plans.registry import BODIES, query
from vulnlake.rules import checks as RC
from vulnlake.rules import evidence as RE

CONFIRM = {k: [RE.required(f, False), RE.required(f)] for k, f in RE.FAMILY_EVIDENCE.items()}


def results(t):
    """Assessment results: each holds some of its evidence points, some only as a note."""
    s = t.fx_sinks
    need = E.required_points("sink_type", F.lit(True))
    entry = lambda p, i: F.struct(p.alias("k"), F.when((F.col("evidence_score") + i) % 5 == 0, F.lit("[未获取: timeout]"))
                                  .when((F.col("evidence_score") + i) % 7 == 0, F.lit("")).otherwise(F.lit("seen")).alias("v"))
    m = F.map_from_entries(F.filter(F.transform(need, entry), lambda e: ~((F.col("r") == 0) & e["k"].endswith("RESPONSE"))))
    return s.select("project", "file", "line", "sink_type", "verdict", "evidence_score", "r", m.alias("evidence"))


EV_SQL = f"""need(sink_type, base, full_p) AS (VALUES {values([(k, b, f) for k, (b, f) in CONFIRM.items()])}),
s AS (SELECT x.*, base, full_p, list_transform(full_p, lambda p, i: {{'k': p, 'v': CASE WHEN (evidence_score + i - 1) % 5 = 0 THEN '[未获取: timeout]' WHEN (evidence_score + i - 1) % 7 = 0 THEN '' ELSE 'seen' END}}) AS ev
 FROM fx_sinks x JOIN need USING (sink_type)),
v AS (SELECT *, list_filter(ev, lambda e: NOT (r = 0 AND suffix(e.k, 'RESPONSE'))) AS held FROM s),
g AS (SELECT *, list_filter(CASE WHEN verdict = 'confirmed' THEN full_p ELSE base END, lambda p: NOT list_contains(list_transform(list_filter(held, lambda e: e.v <> '' AND NOT starts_with(e.v, '[未获取')), lambda e: e.k), p)) AS missing FROM v)"""


@query("D23_evidence_gaps", f"WITH {EV_SQL} SELECT sink_type, verdict, array_to_string(missing, ',') AS missing, COUNT(*) AS n FROM g GROUP BY 1, 2, 3")
def evidence_gaps(t):
    g = E.evidence_gaps(results(t))
    return g.groupBy("sink_type", "verdict", F.array_join("missing", ",").alias("missing")).agg(F.count("*").alias("n"))


@query("S49_pending_pool", f"""WITH {EV_SQL}, p AS (SELECT sink_type, list_filter([CASE WHEN verdict IN ('suspected','potential') AND len(missing) > 0 THEN 'missing_evidence' END,
 CASE WHEN verdict = 'failed' THEN 'rounds_exhausted' END, CASE WHEN len(list_filter(held, lambda e: starts_with(e.v, '[未获取'))) > 0 THEN 'not_obtained' END], lambda x: x IS NOT NULL) AS reasons FROM g)
SELECT sink_type, array_to_string(reasons, ',') AS reasons, COUNT(*) AS n FROM p WHERE len(reasons) > 0 GROUP BY 1, 2""")
def pending(t):
    g = E.evidence_gaps(results(t)).withColumn("rounds", F.col("r")).withColumn("max_rounds", F.lit(3)).withColumn("reachable", F.lit(True))
    p = E.pending_pool(g)
    return p.groupBy("sink_type", F.array_join("reasons", ",").alias("reasons")).agg(F.count("*").alias("n"))


@query("S42_memory_rules", """
WITH m AS (SELECT sink_type, status, rounds_used FROM fx_memory WHERE status <> 'failed' OR rounds_used >= 3) SELECT sink_type, status, COUNT(*) AS kept FROM m GROUP BY 1, 2""")
def memory_rules(t):
    return M.worth_remembering(t.fx_memory).groupBy("sink_type", "status").agg(F.count("*").alias("kept"))


@query("S42_scrubbed_notes", rf"""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(concat('see ', url, ' at 10.1.2.3 in /var/www/app'), '{M.URL.replace("'", "''")}', '<url>', 'g'), '{M.IP}', '<ip>', 'g'), '{M.PATH}', '<path>', 'g') AS note FROM pages""")
def scrubbed(t):
    return t.pages.select("page_id", M.scrub(F.concat(F.lit("see "), "url", F.lit(" at 10.1.2.3 in /var/www/app"))).alias("note"))


GATES = {"gate1": ["a1.json"], "gate2": ["a2.json", "a3.json"], "gate3": ["a4.json"], "gate4": ["a5.json", "a6.json"], "gate5": ["a7.json"]}


@query("S46_phase_gates", """
WITH h AS (SELECT l_orderkey AS run, list(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1), g(gate, need) AS (VALUES ('gate1', [1]), ('gate2', [2, 3]), ('gate3', [4]), ('gate4', [5, 6]), ('gate5', [7]))
SELECT gate, list_has_all(n, need) AS passed, COUNT(*) AS runs FROM h, g GROUP BY 1, 2""")
def gates(t):
    from vulnlake.operators.quality import gate_results
    m = t.lineitem.select(F.col("l_orderkey").alias("run"), F.concat(F.lit("a"), F.col("l_linenumber").cast("string"), F.lit(".json")).alias("path"))
    return gate_results(m, GATES).groupBy("gate", "passed").agg(F.count("*").alias("runs"))


@query("S47_agent_diagnosis", """
WITH s AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'spawned' ELSE 'passed' END AS status, o_custkey % 4 AS redo FROM orders)
SELECT status, CASE status WHEN 'spawned' THEN 'restart' WHEN 'failed' THEN CASE WHEN redo < 2 THEN 'redo' ELSE 'degrade' END ELSE 'none' END AS action, COUNT(*) AS agents FROM s GROUP BY 1, 2""")
def diagnosis(t):
    status = S.pick(F.col("o_orderstatus"), {"F": "failed", "O": "spawned"}, "passed")
    state = F.struct(status.alias("status"), F.lit(None).cast("timestamp").alias("completed_at"), (F.col("o_custkey") % 4).cast("int").alias("redo_count"))
    c = t.orders.select(F.col("o_orderkey").alias("project"), F.create_map(F.lit("auditor"), state).alias("agent_states"))
    return E.agent_diagnosis(c).groupBy("status", "action").agg(F.count("*").alias("agents"))


@query("S48_research_triggers", """
WITH x AS (SELECT list_filter([CASE WHEN p_size = 1 THEN 'MR-1' END, CASE WHEN p_partkey % 10 = 0 AND p_size % 2 = 0 THEN 'MR-2' END, CASE WHEN p_size % 7 >= 5 AND p_partkey % 101 >= 61 THEN 'MR-3' END,
 CASE WHEN p_partkey % 4 = 0 AND p_size % 7 >= 3 THEN 'MR-4' END, CASE WHEN p_size = 50 THEN 'MR-5' END], lambda e: e IS NOT NULL) AS t FROM part) SELECT array_to_string(t, ',') AS triggers, COUNT(*) AS n FROM x GROUP BY 1""")
def triggers(t):
    p, z = F.col("p_partkey"), F.col("p_size")
    s = t.part.select((z == 1).alias("unknown_component"), (p % 10 == 0).alias("critical_alert"), (z % 2 != 0).alias("known_poc"), (z % 7).alias("fail_streak"),
                      (p % 101).alias("filter_score"), (p % 4 == 0).alias("pivoted"), (z == 50).alias("unknown_filter"))
    return E.research_triggers(s).groupBy(F.array_join("triggers", ",").alias("triggers")).agg(F.count("*").alias("n"))


@query("S50_phase_checks", """
WITH m AS (SELECT phase, COUNT(*) AS n, COUNT(*) FILTER (verdict = 'pass') AS p, SUM(pass_count) AS pc, SUM(total_count) AS tc, MAX(redo_count) AS rd FROM fx_qc GROUP BY 1),
c AS (SELECT phase, n > 0 AS a, p * 100 >= 50 * n AS b, pc * 100 >= 40 * tc AS c, rd <= 2 AS d, p * 100 >= 70 * n AS e FROM m)
SELECT phase, 5::BIGINT AS total, (a::INT + b::INT + c::INT + d::INT + e::INT)::BIGINT AS passed, ((NOT a)::INT + (NOT b)::INT)::BIGINT AS hard_fails, ((NOT c)::INT + (NOT d)::INT + (NOT e)::INT)::BIGINT AS warnings,
 CASE WHEN NOT a OR NOT b OR ((NOT c)::INT + (NOT d)::INT + (NOT e)::INT) > 2 THEN 'fail' ELSE 'pass' END AS verdict FROM c""")
def phase_checks(t):
    m = t.fx_qc.groupBy("phase").agg(
        F.count("*").alias("n"), F.count_if(F.col("verdict") == "pass").alias("p"), F.sum("pass_count").alias("pc"), F.sum("total_count").alias("tc"), F.max("redo_count").alias("rd"))
    checks = [("1", "records exist", F.col("n") > 0, True), ("2", "half pass", F.col("p") * 100 >= F.col("n") * 50, True), ("3", "items 40%", F.col("pc") * 100 >= F.col("tc") * 40, False),
              ("4", "redo <= 2", F.col("rd") <= 2, False), ("5", "70% pass", F.col("p") * 100 >= F.col("n") * 70, False)]
    return E.phase_verdict(E.check_rows(m, checks))


CHECK_INPUTS = {"probes": "fx_probes", "outputs": "fx_outputs", "routes": "fx_route_state", "findings": "fx_tool_findings", "layers": "fx_layers", "queue": "q",
                "credentials": "fx_credentials", "chains": "fx_chains", "exploits": "fx_exploits", "agents": "fx_agents", "nodes": "fx_nodes", "edges": "fx_edges"}


def check_sql(n, c):
    """One check alone, as a statement over its own table: membership is a subquery per row, not a grouping."""
    src = CHECK_INPUTS[c.source]
    if c.kind == "share":
        return f"SELECT project, {n} AS n, COUNT(*) FILTER (({c.scope}) AND ({c.good})) AS good, COUNT(*) FILTER ({c.scope}) AS total FROM {src} GROUP BY project"
    k = f"SELECT project, CAST({c.key} AS VARCHAR) AS k, COUNT(*) AS times FROM {src} WHERE {c.scope} GROUP BY 1, 2"
    ok = {"unique": "times = 1", "distinct": "true"}.get(c.kind)
    if ok is None:
        there = f"(project, k) IN (SELECT (project, CAST({c.other_key or c.key} AS VARCHAR)) FROM {CHECK_INPUTS[c.other]} WHERE {c.other_scope})"
        ok = there if c.kind == "inside" else f"NOT {there}"
    return f"SELECT project, {n}, COUNT(*) FILTER ({ok}), COUNT(*) FROM ({k}) GROUP BY project"


CHECK_SQL = f"""{QUEUE_SQL},
n AS ({' UNION ALL '.join(check_sql(i, c) for i, c in enumerate(RC.CHECKS))}),
p AS ({' UNION '.join(f'SELECT project FROM {x}' for x in CHECK_INPUTS.values())}),
rule(n, phase, item, lvl, pct, least, most) AS (VALUES {values([(i, c.phase, c.item, c.level, c.pct, c.least, -1 if c.most is None else c.most) for i, c in enumerate(RC.CHECKS)])}),
x AS (SELECT project, phase, item, lvl AS level, COALESCE(good, 0) AS g, COALESCE(total, 0) AS t, pct, least, most FROM p CROSS JOIN rule LEFT JOIN n USING (project, n)),
checked AS (SELECT project, phase, item, level, CAST(SUM(g) AS BIGINT) AS good, CAST(SUM(t) AS BIGINT) AS total,
 bool_and(g * 100 >= pct * t AND g >= least AND (most < 0 OR g <= most)) AS ok FROM x GROUP BY 1, 2, 3, 4)"""


def check_inputs(t):
    return {k: queue(t) if v == "q" else getattr(t, v) for k, v in CHECK_INPUTS.items()}


@query("D14_published_checks", f"WITH {CHECK_SQL} SELECT * FROM checked")
def published_checks(t):
    return CK.run_checks(check_inputs(t))


@query("S50_published_verdicts", f"""WITH {CHECK_SQL}, v AS (SELECT project, phase, COUNT(*) AS items, COUNT(*) FILTER (ok) AS passed,
 COUNT(*) FILTER (NOT ok AND level <> 'warn') AS hard_fails, COUNT(*) FILTER (NOT ok AND level = 'warn') AS warnings,
 COALESCE(string_agg(item, ',' ORDER BY item) FILTER (NOT ok), '') AS failed FROM checked GROUP BY 1, 2)
SELECT *, CASE WHEN hard_fails > 0 OR (phase = 'cross' AND warnings > 2) THEN 'fail' ELSE 'pass' END AS verdict FROM v""")
def published_verdicts(t):
    return CK.verdicts(CK.run_checks(check_inputs(t)))


REPORT_SQL = f"""{EV_SQL}, o AS (SELECT project, file, line, sink_type, verdict, missing, list_filter([CASE WHEN verdict IN ('suspected','potential') AND len(missing) > 0 THEN 'missing_evidence' END,
 CASE WHEN len(list_filter(held, lambda e: starts_with(e.v, '[未获取'))) > 0 THEN 'not_obtained' END], lambda x: x IS NOT NULL) AS reasons FROM g),
graded AS (SELECT *, CASE WHEN len(reasons) > 0 THEN 'pool' WHEN verdict = 'confirmed' AND len(missing) > 0 THEN 'suspected' ELSE verdict END AS grp FROM o)"""


def reported(t):
    return results(t).withColumns({"rounds": F.col("r"), "max_rounds": F.lit(3), "reachable": F.lit(True)})


@query("W07_verdict_groups", f"""WITH {REPORT_SQL} SELECT project, grp, COUNT(*) AS entries, COUNT(DISTINCT sink_type) AS types, COUNT(*) FILTER (len(missing) > 0) AS incomplete FROM graded GROUP BY 1, 2""")
def verdict_groups(t):
    return RP.verdict_groups(reported(t))


@query("W07_risk_pool", f"""WITH {REPORT_SQL}, e AS (SELECT project, sink_type, file, line, verdict, array_to_string(missing, ',') AS missing, array_to_string(reasons, ',') AS reasons, COUNT(*) AS times
 FROM graded WHERE grp = 'pool' GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY sink_type, file, line, verdict, missing, reasons) AS k FROM e)
SELECT project, sink_type, file, line, verdict, missing, reasons, times, concat('RP-', CASE WHEN k < 1000 THEN lpad(CAST(k AS VARCHAR), 3, '0') ELSE CAST(k AS VARCHAR) END) AS id,
 CASE WHEN contains(reasons, 'not_obtained') THEN 'restore the environment and repeat' ELSE 'replay by hand' END AS next_step FROM n""")
def risk_pool(t):
    return RP.risk_pool(reported(t))


@query("W07_agent_matrix", """
WITH a AS (SELECT project, agent, state, CASE state WHEN 'executed' THEN 1 WHEN 'failed' THEN 2 WHEN 'deferred' THEN 3 WHEN 'not_applicable' THEN 4 END AS p FROM fx_agents),
every AS (SELECT project, agent FROM (SELECT DISTINCT project FROM fx_agents) CROSS JOIN (SELECT concat('agent', x) AS agent FROM range(22) r(x)))
SELECT project, agent, CASE min(p) WHEN 1 THEN 'executed' WHEN 2 THEN 'failed' WHEN 3 THEN 'deferred' WHEN 4 THEN 'not_applicable' ELSE 'missing' END AS state, COUNT(a.state) AS records
FROM every LEFT JOIN a USING (project, agent) GROUP BY 1, 2""")
def agent_matrix(t):
    return RP.agent_matrix(t.fx_agents, [f"agent{n}" for n in range(22)])


@query("W07_route_coverage", """
WITH g AS (SELECT project, COUNT(*) AS routes, COUNT(*) FILTER (state = 'audited') AS audited, COUNT(*) FILTER (state = 'skipped') AS skipped, COUNT(*) FILTER (state = 'open') AS gap FROM fx_route_state GROUP BY 1)
SELECT *, CAST(round(audited * 100e0 / routes, 2) AS DOUBLE) AS audited_pct FROM g""")
def route_coverage(t):
    return RP.route_coverage(t.fx_route_state)


@query("S51_alert_lines", """
SELECT concat('[', CASE WHEN cvss >= 9 THEN 'CRITICAL' ELSE 'HIGH' END, '] ', package, ' ', CAST(intro_major AS VARCHAR), '.x: ', vuln_id) AS line FROM fx_advisories WHERE cvss >= 7""")
def alert_lines(t):
    a = t.fx_advisories.select(S.score_bucket("cvss").alias("severity"), F.col("package").alias("component"),
                               F.concat(F.col("intro_major").cast("string"), F.lit(".x")).alias("version"), F.col("vuln_id").alias("advisory"))
    return E.alert_lines(a).select("line")


# --- helper functions ----------------------------------------------------------------------

@query("A01_mark_consumed", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'me' WHEN 1 THEN 'reader1,me' ELSE 'reader2,me' END AS consumed_by FROM events")
def consumed(t):
    from vulnlake.operators.enrich import mark_consumed
    from vulnlake.plans.fixtures import board
    return mark_consumed(mark_consumed(board(t), "me"), "me").select("event_id", F.array_join("consumed_by", ",").alias("consumed_by"))


@query("A02_json_defaults", "SELECT event_id, COALESCE(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k'), 'x') AS v FROM events")
def json_defaults(t):
    return t.events.select("event_id", A.json_or("props", "$.missing", "$.k", default="x").alias("v"))


@query("A03_object_projection", "SELECT event_id, event_type AS data_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS data_key FROM events")
def projection(t):
    doc = F.to_json(F.struct("event_id", F.struct(F.col("event_type").alias("type"), F.from_json("props", "k bigint")["k"].alias("key")).alias("data")))
    o = F.from_json(doc, "event_id bigint, data struct<type:string,key:bigint>")
    return t.events.select(o.alias("o")).select("o.event_id", F.col("o.data.type").alias("data_type"), F.col("o.data.key").alias("data_key"))


@query("A04_nested_objects", """SELECT node_id, '{"id":"' || node_id || '","info":{"type":"' || vuln_type || '","severity":"' || severity || '"}}' AS doc FROM fx_nodes""")
def nested(t):
    return t.fx_nodes.select("node_id", F.to_json(F.struct(F.col("node_id").alias("id"), F.struct(F.col("vuln_type").alias("type"), "severity").alias("info"))).alias("doc"))


@query("A05_map_entries", "SELECT page_id, 'acao' AS k, h_acao AS v FROM fx_http WHERE h_acao IS NOT NULL UNION ALL SELECT page_id, 'hsts', h_hsts FROM fx_http WHERE h_hsts IS NOT NULL")
def entries(t):
    m = F.create_map(F.lit("acao"), "h_acao", F.lit("hsts"), "h_hsts")
    return t.fx_http.select("page_id", F.explode(F.map_filter(m, lambda k, v: v.isNotNull())).alias("k", "v"))


@query("A06_short_lists", "SELECT package, array_to_string(list_slice(list_sort(list_distinct(flatten(list([version, CAST(v_minor AS VARCHAR)])))), 1, 3), ',') AS sample FROM fx_packages GROUP BY 1")
def short_lists(t):
    from vulnlake.operators.ordered import top_k
    v = t.fx_packages.select("package", F.explode(F.array("version", F.col("v_minor").cast("string"))).alias("v")).distinct()
    g = top_k(v, ["package"], ["v"], 3).groupBy("package").agg(F.collect_list(F.array("v")).alias("v"))
    return g.select("package", F.array_join(A.short_list("v", 3), ",").alias("sample"))


@query("A07_filled_evidence", f"WITH {EV_SQL} SELECT sink_type, CAST(len(list_filter(held, lambda e: e.v <> '' AND NOT starts_with(e.v, '[未获取'))) AS INT) AS filled, COUNT(*) AS n FROM g GROUP BY 1, 2")
def filled(t):
    r = results(t).select("sink_type", F.size(A.filled_evidence("evidence")).alias("filled"))
    return r.groupBy("sink_type", "filled").agg(F.count("*").alias("n"))


@query("A08_string_helpers", """SELECT c_custkey, '''' || replace(concat(c_name, '''s'), '''', '''''') || '''' AS quoted, regexp_replace(lower(c_name), '^customer#', '') AS stripped, substr(repeat(c_mktsegment, 30), 1, 200) AS cut FROM customer""")
def strings(t):
    return t.customer.select("c_custkey", A.quoted(F.concat("c_name", F.lit("'s"))).alias("quoted"), F.regexp_replace(F.lower("c_name"), "^customer#", "").alias("stripped"),
                             F.substring(F.repeat("c_mktsegment", 30), 1, 200).alias("cut"))


@query("A09_date_helpers", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, CAST(o_orderdate AS DATE) + INTERVAL 24 MONTH < DATE '2000-06-01' AS older FROM orders""")
def dates(t):
    return t.orders.select("o_orderkey", A.iso("o_orderdate").alias("iso"), A.older_than("o_orderdate", F.lit("2000-06-01"), 2).alias("older"))


@query("A10_rates", """SELECT target_agent, CAST(round(SUM(pass_count) * 100e0 / nullif(SUM(total_count), 0), 1) AS DOUBLE) AS pct, CAST(ceil(COUNT(*) / 3e0) AS BIGINT) AS thirds FROM fx_qc GROUP BY 1""")
def rates(t):
    return t.fx_qc.groupBy("target_agent").agg(A.rate(F.sum("pass_count"), F.sum("total_count")).alias("pct"), F.ceil(F.count("*") / 3).alias("thirds"))


@query("U01_custom_rules", """SELECT project, COUNT(*) AS hits FROM fx_lines WHERE regexp_matches(text, 'phpinfo\\s*\\(') OR regexp_matches(text, 'JWT::decode\\s*\\(') GROUP BY 1""")
def custom_rules(t):
    from vulnlake.operators import scan as X
    h = X.pattern_hits(t.fx_lines, [("own-1", r"phpinfo\s*\("), ("own-2", r"JWT::decode\s*\(")], text="text")
    return h.select("project", "path", "line").distinct().groupBy("project").agg(F.count("*").alias("hits"))


@query("U05_sql_functions", """
SELECT r, i, c, CASE WHEN r * 40 + i * 35 + c * 25 >= 270 THEN 'C' WHEN r * 40 + i * 35 + c * 25 >= 210 THEN 'H' WHEN r * 40 + i * 35 + c * 25 >= 120 THEN 'M' WHEN r * 40 + i * 35 + c * 25 >= 10 THEN 'L' END AS level, COUNT(*) AS n FROM fx_sinks GROUP BY 1, 2, 3, 4""")
def sql_functions(t):
    from vulnlake.functions.registration import register
    register(t.spark)
    return t.fx_sinks.groupBy("r", "i", "c").agg(F.count("*").alias("n")).selectExpr("r", "i", "c", "vl_severity_level(vl_severity_hundredths(r, i, c)) AS level", "n")


@query("U05_cvss_functions", f"""SELECT vector, score, band, SUM(findings)::BIGINT AS findings FROM ({BODIES["S05_cvss31"]}) GROUP BY 1, 2, 3""")
def cvss_functions(t):
    from vulnlake.functions.registration import register
    register(t.spark)
    vector = S.cvss_vector(S.cvss_metrics("auth_level", F.col("filtered"), "sink_type"))
    g = t.fx_sinks.groupBy(vector.alias("vector")).agg(F.count("*").alias("findings"))
    return g.selectExpr("vector", "round(vl_cvss_base(vector), 1) AS score", "vl_cvss_band(vl_cvss_base(vector)) AS band", "findings")


# --- business tables, logs and inventories --------------------------------------------------

@query("B01_value_violations", """
WITH x AS (SELECT l_orderkey, l_linenumber, list_filter([CASE WHEN l_quantity - 2 < 0 THEN 'negative_quantity' END, CASE WHEN l_quantity - 2 = 0 THEN 'zero_quantity' END, CASE WHEN l_quantity - 2 > 45 THEN 'extreme_quantity' END,
 CASE WHEN l_discount > 0.09 THEN 'rate_out_of_range' END], lambda e: e IS NOT NULL) AS r FROM lineitem) SELECT array_to_string(r, ',') AS reasons, COUNT(*) AS n FROM x WHERE len(r) > 0 GROUP BY 1""")
def violations(t):
    l = t.lineitem.withColumn("l_quantity", F.col("l_quantity") - 2)
    v = B.value_violations(l, max_quantity=45, max_rate=0.09)
    return v.groupBy(F.array_join("reasons", ",").alias("reasons")).agg(F.count("*").alias("n"))


@query("B02_price_mismatch", """
SELECT p_partkey, COUNT(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE abs(l_extendedprice - p_retailprice * l_quantity) > p_retailprice * l_quantity * 0.5e0 GROUP BY 1""")
def mismatch(t):
    l = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), "l_quantity", "l_extendedprice")
    m = B.price_mismatch(l, t.part.select("p_partkey", "p_retailprice"), "p_partkey", F.col("l_extendedprice"), F.col("p_retailprice") * F.col("l_quantity"), 0.5)
    return m.groupBy("p_partkey").agg(F.count("*").alias("n"))


@query("B03_coupon_reuse", """
WITH a AS (SELECT CAST(l_suppkey AS VARCHAR) AS subject, COUNT(DISTINCT l_orderkey) AS n, CAST(round(SUM(l_discount), 2) AS DOUBLE) AS discount FROM lineitem GROUP BY 1),
b AS (SELECT CAST(l_orderkey AS VARCHAR) AS subject, COUNT(DISTINCT l_suppkey) AS n, CAST(round(SUM(l_discount), 2) AS DOUBLE) AS discount FROM lineitem GROUP BY 1)
SELECT *, 'code_reused' AS issue FROM a WHERE n > 590 UNION ALL SELECT *, 'stacked_discount' FROM b WHERE discount > 0.5""")
def coupons(t):
    return B.coupon_reuse(t.lineitem, "l_suppkey", "l_orderkey", 590, "l_discount", 0.5)


@query("B03_coupon_misuse", """
WITH g AS (SELECT l_suppkey AS code, o_custkey AS customer, COUNT(DISTINCT l_orderkey) AS orders, COUNT(*) FILTER (CAST(l_shipdate AS DATE) > DATE '1995-01-01' + CAST(l_suppkey % 1000 AS INT)) AS late
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT *, 'reused_by_user' AS issue FROM g WHERE orders > 1 UNION ALL SELECT *, 'used_after_expiry' FROM g WHERE late > 0""")
def coupon_misuse(t):
    # merged: the order table is too large to copy to every executor, whatever its files' size says
    uses = t.lineitem.join(t.orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_suppkey").alias("code"), F.col("o_custkey").alias("customer"), "l_orderkey", F.col("l_shipdate").cast("date").alias("used_on"),
        F.date_add(F.lit("1995-01-01").cast("date"), (F.col("l_suppkey") % 1000).cast("int")).alias("expires"))
    return B.coupon_misuse(uses, "code", "customer", "l_orderkey", "used_on", "expires")


@query("B05_self_approval", """
SELECT o_orderkey AS item, CAST(o_custkey % 50 AS BIGINT) AS actor FROM orders WHERE o_custkey % 50 = o_orderkey % 50""")
def approvals(t):
    log = t.orders.select(F.col("o_orderkey").alias("item"), F.inline(F.array(
        F.struct((F.col("o_custkey") % 50).cast("long").alias("actor"), F.lit("submit").alias("step")),
        F.struct((F.col("o_orderkey") % 50).cast("long").alias("actor"), F.lit("approve").alias("step")))))
    return B.self_approval(log, "item", "actor", "step", "submit", "approve")


@query("B04_settlement_gaps", """
WITH p AS (SELECT l_orderkey, SUM(l_extendedprice) AS paid FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN paid IS NULL THEN 'unpaid' ELSE 'underpaid' END AS issue FROM orders LEFT JOIN p ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND (paid IS NULL OR paid < o_totalprice - 0.01)""")
def settlement(t):
    pay = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice")
    return B.settlement_gaps(t.orders, pay, "o_orderkey", "o_totalprice", "l_extendedprice", F.col("o_orderstatus") == "F").select("o_orderkey", "issue")


@query("B04_refunds", """
WITH g AS (SELECT l_orderkey, COUNT(*) AS refunds, CAST(round(SUM(l_extendedprice), 2) AS DOUBLE) AS refunded, max(o_totalprice) AS lim FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1)
SELECT l_orderkey, refunds, refunded, CASE WHEN refunded > lim THEN 'oversized' ELSE 'repeated' END AS issue FROM g WHERE refunded > lim OR refunds > 1""")
def refunds(t):
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return B.refund_issues(spread_join(t.lineitem.where("l_returnflag = 'R'"), o, "l_orderkey"), "l_orderkey", "l_extendedprice", "o_totalprice")


@query("B05_missing_step", """
SELECT event_id, user_id FROM events e WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'signup' AND s.ts < e.ts)""")
def step(t):
    return B.missing_step(t.events, "user_id", "event_type", "signup", "purchase").select("event_id", "user_id")


@query("B06_illegal_transitions", """
WITH p AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_state FROM events)
SELECT user_id, prev_state, event_type, COUNT(*) AS n FROM p WHERE prev_state IS NOT NULL AND prev_state || '>' || event_type NOT IN ('view>click', 'click>signup', 'signup>purchase', 'view>view') GROUP BY 1, 2, 3""")
def transitions(t):
    ok = {("view", "click"), ("click", "signup"), ("signup", "purchase"), ("view", "view")}
    return B.illegal_transitions(t.events, "user_id", "event_type", ["ts", "event_id"], ok).groupBy("user_id", "prev_state", "event_type").agg(F.count("*").alias("n"))


@query("B07_message_flooding", "SELECT user_id, date_trunc('day', ts) AS start, COUNT(*) AS n FROM events GROUP BY 1, 2 HAVING COUNT(*) > 5")
def flood(t):
    return B.flooding(t.events, "user_id", "ts", "1 day", 5)


@query("B08_replayed_tokens", "SELECT md5(text) AS token, COUNT(*) FILTER (lang <> 'de') AS accepted FROM documents GROUP BY 1 HAVING COUNT(*) FILTER (lang <> 'de') > 1")
def replayed(t):
    return B.replayed_tokens(t.documents.select(F.md5("text").alias("token"), "lang"), "token", F.col("lang") != "de")


@query("B09_over_limit", """
WITH w AS (SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) - i * INTERVAL 1 HOUR AS start FROM events, range(0, 12) r(i) WHERE event_type <> 'error') SELECT user_id, start, COUNT(*) AS n FROM w GROUP BY 1, 2 HAVING COUNT(*) > 4""")
def over_limit(t):
    return B.flooding(t.events.where("event_type <> 'error'"), "user_id", "ts", "12 hours", 4, "1 hour")


@query("B10_imbalance", """
WITH a AS (SELECT o_custkey, CAST(round(SUM(o_totalprice), 2) AS DOUBLE) AS before_total FROM orders GROUP BY 1), b AS (SELECT o_custkey, CAST(round(SUM(o_totalprice), 2) AS DOUBLE) AS after_total FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1)
SELECT COALESCE(a.o_custkey, b.o_custkey) AS o_custkey, COALESCE(before_total, 0) AS before_total, COALESCE(after_total, 0) AS after_total FROM a FULL JOIN b ON a.o_custkey = b.o_custkey WHERE abs(COALESCE(before_total, 0) - COALESCE(after_total, 0)) > 0.005""")
def imbalance(t):
    return B.imbalance(t.orders, t.orders.where("o_orderpriority <> '5-LOW'"), "o_custkey", "o_totalprice")


@query("B10_overdrawn", """
WITH m AS (SELECT o_custkey, o_orderkey, CAST(round(CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END * 100) AS BIGINT) AS cents, o_orderdate FROM orders),
b AS (SELECT *, SUM(cents) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS balance FROM m) SELECT o_custkey, o_orderkey, balance FROM b WHERE balance < 0""")
def overdrawn(t):
    cents = F.round(F.when(F.col("o_orderstatus") == "F", -F.col("o_totalprice")).otherwise(F.col("o_totalprice")) * 100).cast("long")
    return B.overdrawn(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], cents).select("o_custkey", "o_orderkey", "balance")


@query("B10_oversold", """
WITH s AS (SELECT l_partkey, SUM(l_quantity) AS sold FROM lineitem GROUP BY 1) SELECT p_partkey, sold FROM part JOIN s ON p_partkey = l_partkey WHERE sold > p_size * 20""")
def oversold(t):
    s = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("sold"))
    return t.part.join(s, "p_partkey").where(F.col("sold") > F.col("p_size") * 20).select("p_partkey", "sold")


@query("B11_used_after_logout", """
SELECT event_id, user_id FROM events e WHERE event_type <> 'signup' AND ts > (SELECT max(ts) FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'signup')""")
def after_logout(t):
    return B.used_after_logout(t.events, "user_id", "ts", F.col("event_type") == "signup").select("event_id", "user_id")


@query("B13_key_inventory", """
WITH g AS (SELECT sha256(text) AS key_sha, COUNT(DISTINCT source) AS envs, COUNT(DISTINCT lang) AS purposes, min(n_chars) AS bits, max(doc_id % 500) AS age_days FROM documents GROUP BY 1),
x AS (SELECT *, list_filter([CASE WHEN envs > 1 THEN 'shared_between_environments' END, CASE WHEN purposes > 1 THEN 'several_purposes' END, CASE WHEN bits < 256 THEN 'short_key' END, CASE WHEN age_days > 365 THEN 'no_rotation' END], lambda e: e IS NOT NULL) AS i FROM g)
SELECT key_sha, envs, purposes, array_to_string(i, ',') AS issues FROM x WHERE len(i) > 0""")
def keys(t):
    k = t.documents.select(F.sha2("text", 256).alias("key_sha"), F.col("source").alias("env"), F.col("lang").alias("purpose"), F.col("n_chars").alias("bits"), (F.col("doc_id") % 500).alias("age_days"))
    return B.key_inventory(k).select("key_sha", "envs", "purposes", F.array_join("issues", ",").alias("issues"))


@query("B14_repeated_blocks", """
SELECT source, COUNT(*) FILTER (doc_id % 3 = 0) AS repeated, COUNT(*) AS n FROM documents GROUP BY 1""")
def blocks(t):
    h = F.md5("text")
    value = F.when(F.col("doc_id") % 3 == 0, F.concat(h, F.md5("source"), h)).otherwise(F.concat(h, F.md5(F.concat("text", F.lit("x")))))
    return t.documents.select("source", B.repeated_blocks(value).alias("r")).groupBy("source").agg(F.count_if("r").alias("repeated"), F.count("*").alias("n"))


@query("B15_shared_hashes", "SELECT md5(text) AS h, COUNT(DISTINCT doc_id) AS accounts FROM documents GROUP BY 1 HAVING COUNT(DISTINCT doc_id) > 1")
def shared(t):
    return B.shared_hashes(t.documents.select("doc_id", F.md5("text").alias("h")), "h", "doc_id")


@query("B23_progress_rows", """
WITH g AS (SELECT event_type AS phase, COUNT(*) FILTER (value > 20) AS done, COUNT(*) AS total FROM events GROUP BY 1)
SELECT phase, done, total, CAST(floor(done * 100e0 / total) AS BIGINT) AS percent, repeat('▓', CAST(floor(done * 20e0 / total) AS BIGINT)) || repeat('░', 20 - CAST(floor(done * 20e0 / total) AS BIGINT)) AS bar FROM g""")
def progress(t):
    g = t.events.groupBy(F.col("event_type").alias("phase")).agg(F.count_if(F.col("value") > 20).alias("done"), F.count("*").alias("total"))
    return g.withColumn("percent", F.floor(F.col("done") * 100 / F.col("total"))).withColumn("bar", B.progress_bar(F.col("done"), F.col("total")))
