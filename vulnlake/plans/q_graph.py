"""Graph correlation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vulnlake.functions import score as S
from vulnlake.operators.paths import k_best_paths
from vulnlake.operators import graph as G
from vulnlake.plans.registry import query
from vulnlake.rules import correlation as R


def values(rows) -> str:
    """A rule table as SQL VALUES text."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(lit(x) for x in v) + "]"
        return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


@query("J09_neighbours", """
WITH n AS (SELECT source_node AS node_id, target_node AS other, relation, 'out' AS direction FROM fx_edges
 UNION ALL SELECT target_node, source_node, relation, 'in' FROM fx_edges)
SELECT n.node_id, direction, relation, COUNT(*) AS edges, COUNT(*) FILTER (o.status = 'confirmed') AS confirmed_ends
FROM n JOIN fx_nodes o ON n.other = o.node_id GROUP BY 1, 2, 3""")
def neighbours(t):
    return G.neighbours(t.fx_nodes, t.fx_edges).groupBy("node_id", "direction", "relation").agg(
        F.count("*").alias("edges"), F.count_if(F.col("status") == "confirmed").alias("confirmed_ends"))


@query("J10_edges_by_object", """
WITH x AS (SELECT n.data_object, e.seq FROM fx_edges e JOIN fx_nodes n ON e.source_node = n.node_id
 UNION SELECT n.data_object, e.seq FROM fx_edges e JOIN fx_nodes n ON e.target_node = n.node_id)
SELECT data_object, COUNT(*) AS edges FROM x GROUP BY 1""")
def by_object(t):
    return G.edges_by_object(t.fx_nodes, t.fx_edges).groupBy("data_object").agg(F.count("*").alias("edges"))


ESC_SQL = f"""r(pattern, family, needs, severity) AS (VALUES {values(R.ESCALATIONS)}),
c AS (SELECT project, list(DISTINCT vuln_type) AS types, list(DISTINCT condition) AS conditions FROM fx_nodes GROUP BY 1),
esc AS (SELECT project, pattern, family, severity FROM c, r WHERE list_contains(types, family) AND list_has_all(conditions, needs))"""
CHAIN_SQL = f"""k(chain, first_f, second_f, severity) AS (VALUES {values(R.CROSS_CHAINS)}),
bs AS (SELECT project, vuln_type, min(CASE status WHEN 'confirmed' THEN 0 WHEN 'suspected' THEN 1 ELSE 2 END) AS best FROM fx_nodes GROUP BY 1, 2),
ch AS (SELECT a.project, 'cross_auditor_chain::' || chain AS pattern, first_f AS family, severity,
 CASE WHEN a.best = 0 AND b.best = 0 THEN 'confirmed' WHEN a.best = 0 OR b.best = 0 THEN 'probable' ELSE 'speculative' END AS confidence
 FROM k JOIN bs a ON a.vuln_type = first_f JOIN bs b ON b.project = a.project AND b.vuln_type = second_f)"""


@query("J17_escalations", f"WITH {ESC_SQL} SELECT * FROM esc")
def escalations(t):
    return G.escalations(t.fx_nodes)


@query("J18_cross_chains", f"""WITH {ESC_SQL}, {CHAIN_SQL},
u AS (SELECT project, family, pattern, severity, 0 AS src FROM esc UNION ALL SELECT project, family, pattern, severity, 1 FROM ch WHERE confidence <> 'speculative'),
p AS (SELECT *, row_number() OVER (PARTITION BY project, family ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, src, pattern) AS k FROM u)
SELECT project, family, pattern, severity FROM p WHERE k = 1""")
def chains(t):
    return G.merge_escalations(G.escalations(t.fx_nodes), G.cross_chains(t.fx_nodes))


@query("J18_chain_confidence", f"WITH {CHAIN_SQL} SELECT pattern, confidence, COUNT(*) AS projects FROM ch GROUP BY 1, 2")
def confidence(t):
    return G.cross_chains(t.fx_nodes).groupBy("pattern", "confidence").agg(F.count("*").alias("projects"))


@query("S40_combined_patterns", f"WITH {ESC_SQL} SELECT pattern, severity, COUNT(*) AS projects FROM esc GROUP BY 1, 2")
def combined(t):
    return G.escalations(t.fx_nodes).groupBy("pattern", "severity").agg(F.count("*").alias("projects"))


@query("J19_implicit_edges", """
WITH o AS (SELECT data_object, min(node_id) AS hub FROM fx_nodes GROUP BY 1), r AS (SELECT route_id, min(node_id) AS hub FROM fx_nodes GROUP BY 1)
SELECT hub AS source_node, node_id AS target_node, 'shares_data_object' AS relation FROM fx_nodes JOIN o USING (data_object) WHERE node_id <> hub
UNION ALL SELECT hub, node_id, 'same_entry_point' FROM fx_nodes JOIN r USING (route_id) WHERE node_id <> hub""")
def implicit(t):
    a = G.implicit_edges(t.fx_nodes, "data_object", "shares_data_object").drop("data_object")
    return a.unionByName(G.implicit_edges(t.fx_nodes, "route_id", "same_entry_point").drop("route_id"))


@query("J20_capability_edges", f"""
WITH r(grants, capability, needs) AS (VALUES {values(R.CAPABILITIES)}),
x AS (SELECT project, node_id, capability, 'grants' AS role FROM fx_nodes JOIN r ON vuln_type = grants
 UNION ALL SELECT project, node_id, capability, 'requires' FROM fx_nodes JOIN r ON vuln_type = needs),
u AS (SELECT project, capability FROM x GROUP BY 1, 2 HAVING COUNT(DISTINCT role) = 2)
SELECT project, capability, CASE role WHEN 'grants' THEN node_id ELSE project || '/' || capability END AS source_node,
 CASE role WHEN 'grants' THEN project || '/' || capability ELSE node_id END AS target_node, role FROM x JOIN u USING (project, capability)""")
def capability(t):
    return G.capability_edges(t.fx_nodes)


ENDS = "fx_edges e JOIN fx_nodes s ON e.source_node = s.node_id JOIN fx_nodes t ON e.target_node = t.node_id"


@query("J21_data_flow_chains", f"""
SELECT e.seq, e.source_node, e.target_node, t.status AS t_status FROM {ENDS} WHERE relation = 'data_flows_to' AND s.status = 'confirmed'""")
def data_flow(t):
    return G.data_flow_chains(t.fx_nodes, t.fx_edges).select("seq", "source_node", "target_node", "t_status")


@query("J22_reassessments", f"""
SELECT e.seq, e.target_node, 'conditionally_exploitable' AS judgment FROM {ENDS} WHERE relation = 'enables' AND s.status = 'confirmed' AND t.status = 'potential'""")
def reassess(t):
    return G.reassessments(t.fx_nodes, t.fx_edges, F.col("t_status") == "potential").select("seq", "target_node", "judgment")


@query("J23_graph_escalations", f"""
WITH x AS (SELECT e.seq, s.severity AS a, t.severity AS b, CASE s.severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS ra,
 CASE t.severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS rb FROM {ENDS} WHERE relation = 'escalates_to' AND confidence <> 'speculative'),
y AS (SELECT *, least(ra, rb) AS hi, greatest(ra, rb) AS lo FROM x)
SELECT seq, a AS s_severity, b AS t_severity, CASE WHEN hi = 0 THEN 'critical' WHEN hi = 1 AND lo <= 2 THEN 'critical' WHEN hi = 2 AND lo = 2 THEN 'high'
 WHEN hi = 1 THEN 'high' WHEN hi = 2 THEN 'medium' ELSE 'low' END AS combined FROM y""")
def graph_esc(t):
    return G.graph_escalations(t.fx_nodes, t.fx_edges).select("seq", "s_severity", "t_severity", "combined")


@query("J24_historical_gaps", f"""
WITH l AS (SELECT DISTINCT e.project, s.vuln_type AS a, t.vuln_type AS b FROM {ENDS}), sup AS (SELECT a, b, COUNT(*) AS projects FROM l GROUP BY 1, 2),
ty AS (SELECT DISTINCT project, vuln_type FROM fx_nodes)
SELECT x.project, x.vuln_type AS a, y.vuln_type AS b, projects FROM ty x JOIN ty y ON x.project = y.project JOIN sup ON sup.a = x.vuln_type AND sup.b = y.vuln_type
WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.project = x.project AND l.a = x.vuln_type AND l.b = y.vuln_type)""")
def gaps(t):
    return G.historical_gaps(t.fx_nodes, t.fx_edges)


@query("J33_report_bridge", """
SELECT node_id, data_object FROM fx_nodes WHERE status = 'confirmed' AND data_object NOT IN (SELECT data_object FROM fx_nodes WHERE severity = 'critical' AND status = 'confirmed')""")
def bridge(t):
    shared = t.fx_nodes.where("severity = 'critical' AND status = 'confirmed'").select("data_object")
    return G.report_bridge(t.fx_nodes, shared).select("node_id", "data_object")


SOURCES = "vuln_type = 'infoleak' AND severity = 'high' AND status = 'confirmed'"


@query("J34_caller_walk", f"""
WITH RECURSIVE src AS (SELECT concat('f', substr(node_id, 2)) AS node FROM fx_nodes WHERE {SOURCES}), e AS (SELECT DISTINCT caller, callee FROM fx_calls),
d(node, depth) AS (SELECT node, 0 FROM src UNION SELECT e.callee, d.depth + 1 FROM d JOIN e ON e.caller = d.node WHERE d.depth < 10),
u(node, origin, n) AS (SELECT caller, callee, 1 FROM e UNION SELECT e.caller, u.origin, u.n + 1 FROM u JOIN e ON e.callee = u.node WHERE u.n < 10),
m AS (SELECT node, min(depth) AS depth FROM d GROUP BY 1), a AS (SELECT DISTINCT origin FROM u WHERE n = 10)
SELECT concat('f', substr(x.node_id, 2)) AS node, m.depth, CASE WHEN m.depth IS NOT NULL THEN 'source_found' WHEN a.origin IS NOT NULL THEN 'depth_limit' ELSE 'no_caller' END AS stop
FROM fx_nodes x LEFT JOIN m ON m.node = concat('f', substr(x.node_id, 2)) LEFT JOIN a ON a.origin = concat('f', substr(x.node_id, 2)) WHERE x.vuln_type = 'rce'""")
def walk(t):
    fn = F.concat(F.lit("f"), F.expr("substr(node_id, 2)")).alias("node")
    return G.caller_walk(t.fx_nodes.where("vuln_type = 'rce'").select(fn), t.fx_calls, t.fx_nodes.where(SOURCES).select(fn))


@query("D27_dependency_depth", """
WITH RECURSIVE e AS (SELECT DISTINCT source_node AS src, target_node AS dst FROM fx_edges WHERE relation = 'enables'),
d(node, depth) USING KEY (node) AS (SELECT DISTINCT node_id, 0 FROM fx_nodes WHERE severity = 'critical'
 UNION SELECT DISTINCT e.dst, d.depth + 1 FROM d JOIN e ON e.src = d.node WHERE e.dst NOT IN (SELECT node FROM recurring.d))
SELECT node, min(depth) AS depth FROM d GROUP BY 1""")
def dependency_depth(t):
    e = t.fx_edges.where("relation = 'enables'").select(F.col("source_node").alias("src"), F.col("target_node").alias("dst"))
    return G.levels(e, t.fx_nodes.where("severity = 'critical'").select(F.col("node_id").alias("node")))


@query("J37_dangling_references", """
SELECT target_node, COUNT(*) AS edges FROM fx_edges WHERE target_node NOT IN (SELECT node_id FROM fx_nodes WHERE status <> 'potential') GROUP BY 1""")
def dangling(t):
    refs = t.fx_edges
    return G.dangling(refs, t.fx_nodes.where("status <> 'potential'"), "target_node", "node_id").groupBy("target_node").agg(F.count("*").alias("edges"))


START, GOAL = "severity = 'low' AND status = 'confirmed'", "vuln_type = 'rce' AND severity IN ('critical', 'high', 'medium')"
PATH_EDGES = "relation IN ('enables', 'escalates_to')"
PATH_SQL = f"""e AS (SELECT DISTINCT source_node AS src, target_node AS dst FROM fx_edges WHERE {PATH_EDGES} AND source_node <> target_node),
p(path, fin) AS (SELECT [node_id], node_id FROM fx_nodes WHERE {START}
 UNION ALL SELECT list_append(path, dst), dst FROM p JOIN e ON e.src = p.fin WHERE len(path) < 4 AND NOT list_contains(path, dst)),
g AS (SELECT array_to_string(path, '>') AS path_key, path FROM p WHERE fin IN (SELECT node_id FROM fx_nodes WHERE {GOAL})),
s AS (SELECT path_key, len(path) AS n, x.node FROM g, unnest(path) AS x(node)),
sc AS (SELECT path_key, min(project) AS project, min(n) AS n, SUM(CASE status WHEN 'confirmed' THEN 10 WHEN 'suspected' THEN 6 ELSE 3 END) AS pts,
 bool_or(status = 'potential') AS pot, bool_or(status = 'suspected') AS sus FROM s JOIN fx_nodes f ON f.node_id = s.node GROUP BY 1),
fin AS (SELECT path_key, project, n AS len, CAST(round(pts * CASE n WHEN 1 THEN 1.0e0 WHEN 2 THEN 1.5e0 WHEN 3 THEN 2.0e0 ELSE 2.5e0 END
 * CASE WHEN pot THEN 0.4e0 WHEN sus THEN 0.7e0 ELSE 1.0e0 END, 2) AS DOUBLE) AS path_score FROM sc)"""


def paths(t):
    edges = t.fx_edges.where(PATH_EDGES)
    found = G.find_paths(t.fx_nodes, edges, F.expr(START), F.expr(GOAL))
    return G.score_paths(found, t.fx_nodes)


@query("S37_exposure_paths", f"WITH RECURSIVE {PATH_SQL} SELECT path_key, project, CAST(len AS INT) AS len, path_score FROM fin")
def exposure_paths(t):
    return paths(t).select("path_key", "project", F.size("steps").alias("len"), "path_score")


@query("S36_path_scores", f"""WITH RECURSIVE {PATH_SQL}
SELECT CAST(len AS INT) AS len, path_score, COUNT(*) AS paths FROM fin GROUP BY 1, 2""")
def path_scores(t):
    return paths(t).groupBy(F.size("steps").alias("len"), "path_score").agg(F.count("*").alias("paths"))


@query("T06_top_paths", f"""WITH RECURSIVE {PATH_SQL},
k AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY path_score DESC, path_key) AS place FROM fin)
SELECT project, path_key, path_score, CAST(place AS INT) AS place FROM k WHERE place <= 3""")
def best_paths(t):
    best = k_best_paths(t.fx_nodes, t.fx_edges.where(PATH_EDGES), F.expr(START), F.expr(GOAL))
    return best.select("project", "path_key", "path_score", "place")


LONG_SQL = PATH_SQL.replace("len(path) < 4", "len(path) < 7")


@query("T06_top_paths_any_length", f"""WITH RECURSIVE {LONG_SQL},
k AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY path_score DESC, path_key) AS place FROM fin)
SELECT project, path_key, path_score, CAST(len AS INT) AS len, CAST(place AS INT) AS place FROM k WHERE place <= 5""")
def best_long_paths(t):
    best = k_best_paths(t.fx_nodes, t.fx_edges.where(PATH_EDGES), F.expr(START), F.expr(GOAL), k=5, steps=7)
    return best.select("project", "path_key", "path_score", "len", "place")


CM_SQL = f"""c(chain, steps) AS (VALUES {values(R.CHAINS.items())}), f(vuln_type, gives) AS (VALUES {values(R.FAMILY_STEPS.items())}),
h AS (SELECT project, list_distinct(flatten(list(gives))) AS have FROM (SELECT DISTINCT project, {list(R.FAMILY_STEPS)}[CAST(seq % {len(R.FAMILY_STEPS)} AS INT) + 1] AS vuln_type FROM fx_nodes WHERE status <> 'potential') JOIN f USING (vuln_type) GROUP BY 1),
m AS (SELECT project, chain, len(list_intersect(steps, have)) AS matched, len(steps) AS n, array_to_string(list_filter(steps, lambda x: NOT list_contains(have, x)), ',') AS missing FROM h, c)"""


@query("S38_chain_matches", f"""WITH {CM_SQL} SELECT project, chain, CAST(matched AS BIGINT) AS matched, missing, CASE WHEN matched = n THEN 'full_match'
 WHEN matched * 100 >= n * 60 THEN 'partial_match' ELSE 'no_match' END AS match_type FROM m""")
def chain_matches(t):
    family = F.array(*[F.lit(f) for f in R.FAMILY_STEPS])[F.col("seq") % len(R.FAMILY_STEPS)]
    return G.chain_matches(t.fx_nodes.where("status <> 'potential'").withColumn("vuln_type", family))


CHECKS = list(R.FEASIBILITY)
FEAS_SQL = " + ".join(
    f"CASE (seq * {i + 3} + {i}) % 4 WHEN 0 THEN 10 WHEN 1 THEN 5 WHEN 2 THEN 0 ELSE -3 END * {R.FEASIBILITY[c]}" for i, c in enumerate(CHECKS))


@query("S39_feasibility", f"""WITH s AS (SELECT node_id, ({FEAS_SQL}) / 10e0 AS score FROM fx_nodes)
SELECT node_id, score, CASE WHEN score >= 80 THEN 'high' WHEN score >= 50 THEN 'medium' WHEN score >= 20 THEN 'low' ELSE 'infeasible' END AS band FROM s""")
def feasibility(t):
    status = lambda i: S.pick((F.col("seq") * (i + 3) + i) % 4, {0: "confirmed", 1: "suspected", 2: "unknown"}, "not_met")
    checks = {c: status(i) for i, c in enumerate(CHECKS)}
    return t.fx_nodes.select("node_id", G.feasibility(checks).alias("score")).withColumn("band", G.feasibility_band("score"))


@query("W05_graph_lines", """
WITH st AS (SELECT COALESCE(a.project, b.project) AS project, COALESCE(n, 0) AS n, COALESCE(m, 0) AS m FROM (SELECT project, COUNT(*) AS n FROM fx_nodes GROUP BY 1) a
 FULL JOIN (SELECT project, COUNT(*) AS m FROM fx_edges GROUP BY 1) b ON a.project = b.project)
SELECT project, 'node' AS kind, concat('{"node_id":"', node_id, '","vuln_type":"', vuln_type, '","severity":"', severity, '","status":"', status, '","data_object":"', data_object, '"}') AS json FROM fx_nodes
UNION ALL SELECT project, 'edge', concat('{"source_node":"', source_node, '","target_node":"', target_node, '","relation":"', relation, '","confidence":"', confidence, '"}') FROM fx_edges
UNION ALL SELECT project, 'stats', concat('{"nodes":', n, ',"edges":', m, '}') FROM st""")
def graph_lines(t):
    from vulnlake.sources.sinks import graph_lines as lines
    return lines(t.fx_nodes, t.fx_edges).select("project", "kind", "json")


@query("W08_mermaid", f"""WITH RECURSIVE {PATH_SQL},
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY path_score DESC, path_key) AS place FROM fin) WHERE place <= 30),
st AS (SELECT project, place, path_key, i - 1 AS pos, string_split(path_key, '>')[i] AS node FROM b, range(1, 10) r(i) WHERE i <= len),
nd AS (SELECT project, node, min(place * 1000 + pos) AS o FROM st GROUP BY 1, 2),
nk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY o) AS rn FROM nd) WHERE rn <= 30),
ln AS (SELECT nk.project, o, concat('    ', node, '[', vuln_type, ']', chr(10), '    style ', node, ' fill:', CASE WHEN status = 'confirmed' AND severity IN ('critical', 'high') THEN '#ff4444'
  WHEN status = 'suspected' OR severity = 'medium' THEN '#ffaa00' ELSE '#ffdd00' END) AS line FROM nk JOIN fx_nodes f ON f.node_id = nk.node
 UNION ALL SELECT DISTINCT x.project, 1000000000, concat('    ', x.node, ' --> ', y.node) FROM st x JOIN st y ON x.project = y.project AND x.path_key = y.path_key AND y.pos = x.pos + 1
  JOIN nk u ON u.project = x.project AND u.node = x.node JOIN nk v ON v.project = y.project AND v.node = y.node)
SELECT project, concat('graph TD', chr(10), string_agg(line, chr(10) ORDER BY o, line)) AS text FROM ln GROUP BY 1""")
def mermaid(t):
    from vulnlake.sources.sinks import mermaid as draw
    return draw(paths(t))
