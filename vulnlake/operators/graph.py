"""Graph correlation over nodes and typed edges.

Nodes of one project or object are never paired with each other. Group facts
(families, worst status) are aggregated first, and membership edges go through
a hub, so the work grows with nodes and edges even when one object is hot.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.functions.score import SEVERITY_ORDER, pick, rank_of
from vulnlake.rules import correlation as R
from vulnlake.session import durable

STATUS_ORDER = ["confirmed", "suspected", "potential"]


def neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every edge seen from both ends, with the node on the other side."""
    far = nodes.select(F.col("node_id").alias("other"), "vuln_type", "severity", "status")
    out = edges.select(F.col("source_node").alias("node_id"), F.col("target_node").alias("other"), "relation", "confidence", F.lit("out").alias("direction"))
    inc = edges.select(F.col("target_node").alias("node_id"), F.col("source_node").alias("other"), "relation", "confidence", F.lit("in").alias("direction"))
    return out.unionByName(inc).join(far, "other")


def edges_by_object(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that touch a node of each object; an edge inside one object counts once."""
    obj = nodes.select("node_id", "data_object")
    a = edges.join(obj.withColumnRenamed("node_id", "source_node"), "source_node", "left").withColumnRenamed("data_object", "_a")
    b = a.join(obj.withColumnRenamed("node_id", "target_node"), "target_node", "left").withColumnRenamed("data_object", "_b")
    return b.withColumn("data_object", F.explode(F.array_distinct(F.array_compact(F.array("_a", "_b"))))).drop("_a", "_b")


def project_conditions(nodes: DataFrame) -> DataFrame:
    """Families and conditions present per project (two fixed vocabularies)."""
    return nodes.groupBy("project").agg(F.collect_set("vuln_type").alias("types"), F.collect_set("condition").alias("conditions"))


def escalations(nodes: DataFrame, rules=R.ESCALATIONS) -> DataFrame:
    """Patterns whose family and conditions are all present in a project."""
    table = nodes.sparkSession.createDataFrame(rules, "pattern string, family string, needs array<string>, severity string")
    hit = F.array_contains("types", F.col("family")) & (F.size(F.array_except("needs", "conditions")) == 0)
    return project_conditions(nodes).join(F.broadcast(table), hit).select("project", "pattern", "family", "severity")


def best_status(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("project", "vuln_type").agg(F.min(rank_of("status", STATUS_ORDER)).alias("best"))


def cross_chains(nodes: DataFrame, rules=R.CROSS_CHAINS) -> DataFrame:
    """Chains across two specialists with the confidence of their weakest part."""
    table = nodes.sparkSession.createDataFrame(rules, "chain string, first string, second string, severity string")
    best = best_status(nodes)
    a = best.select("project", F.col("vuln_type").alias("first"), F.col("best").alias("_a"))
    b = best.select("project", F.col("vuln_type").alias("second"), F.col("best").alias("_b"))
    j = a.join(F.broadcast(table), "first").join(b, ["project", "second"])
    both, one = (F.col("_a") == 0) & (F.col("_b") == 0), (F.col("_a") == 0) | (F.col("_b") == 0)
    return j.select(
        "project", F.concat(F.lit("cross_auditor_chain::"), "chain").alias("pattern"), F.col("first").alias("family"), "severity",
        F.when(both, "confirmed").when(one, "probable").otherwise("speculative").alias("confidence"))


def merge_escalations(patterns: DataFrame, chains: DataFrame) -> DataFrame:
    """One escalation per (project, family): the more severe one, patterns first on a tie."""
    rows = patterns.select("project", "family", "pattern", "severity", F.lit(0).alias("_src")).unionByName(
        chains.where(F.col("confidence") != "speculative").select("project", "family", "pattern", "severity", F.lit(1).alias("_src")))
    return rows.groupBy("project", "family").agg(
        F.min_by(F.struct("pattern", "severity"), F.struct(rank_of("severity", SEVERITY_ORDER), "_src", "pattern")).alias("e")
    ).select("project", "family", "e.*")


def implicit_edges(nodes: DataFrame, key: str, relation: str) -> DataFrame:
    """Connect nodes that share a key through the group's first node.

    A star has the same connected groups as all pairs with one edge per node."""
    hubs = nodes.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("node_id").alias("source_node"), F.count(F.lit(1)).alias("_n"))
    hubs = hubs.where(F.col("_n") > 1).drop("_n")
    return nodes.join(hubs, key).where(F.col("node_id") != F.col("source_node")).select(
        "source_node", F.col("node_id").alias("target_node"), F.lit(relation).alias("relation"), key)


def capability_edges(nodes: DataFrame, rules=R.CAPABILITIES) -> DataFrame:
    """Edges node -> capability (grants) and capability -> node (requires) that are used on both sides."""
    table = nodes.sparkSession.createDataFrame(rules, "grants string, capability string, needs string")
    hub = F.concat_ws("/", "project", "capability")
    g = nodes.join(F.broadcast(table.withColumnRenamed("grants", "vuln_type")), "vuln_type").select("project", "node_id", "capability", F.lit("grants").alias("role"))
    r = nodes.join(F.broadcast(table.withColumnRenamed("needs", "vuln_type")), "vuln_type").select("project", "node_id", "capability", F.lit("requires").alias("role"))
    rows = g.unionByName(r)
    used = rows.groupBy("project", "capability").agg(F.count_distinct("role").alias("_n")).where(F.col("_n") == 2).drop("_n")
    rows = rows.join(used, ["project", "capability"], "left_semi")
    gives = F.col("role") == "grants"
    return rows.select("project", "capability", F.when(gives, F.col("node_id")).otherwise(hub).alias("source_node"),
                       F.when(gives, hub).otherwise(F.col("node_id")).alias("target_node"), "role")


def _with_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    s = nodes.select(F.col("node_id").alias("source_node"), F.col("status").alias("s_status"), F.col("severity").alias("s_severity"))
    t = nodes.select(F.col("node_id").alias("target_node"), F.col("status").alias("t_status"), F.col("severity").alias("t_severity"))
    return edges.join(s, "source_node").join(t, "target_node")


def data_flow_chains(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    e = _with_ends(nodes, edges.where(F.col("relation") == "data_flows_to"))
    return e.where((F.col("s_status") == "confirmed") & F.col("t_status").isin(STATUS_ORDER))


def reassessments(nodes: DataFrame, edges: DataFrame, blocked: Column) -> DataFrame:
    """Targets judged not exploitable although what enables them is confirmed."""
    e = _with_ends(nodes, edges.where(F.col("relation") == "enables"))
    return e.where((F.col("s_status") == "confirmed") & blocked).withColumn("judgment", F.lit("conditionally_exploitable"))


def combined_severity(a: Column, b: Column, given: Column | None = None) -> Column:
    ra, rb = rank_of(a, SEVERITY_ORDER), rank_of(b, SEVERITY_ORDER)
    hi, lo = F.least(ra, rb), F.greatest(ra, rb)
    rule = (F.when(hi == 0, "critical").when((hi == 1) & (lo <= 2), "critical").when((hi == 2) & (lo == 2), "high")
            .when((hi == 1) & (lo >= 3), "high").when(hi == 2, "medium").otherwise("low"))
    return F.coalesce(given, rule) if given is not None else rule


def graph_escalations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    e = _with_ends(nodes, edges.where((F.col("relation") == "escalates_to") & (F.col("confidence") != "speculative")))
    return e.withColumn("combined", combined_severity(F.col("s_severity"), F.col("t_severity")))


def historical_gaps(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Family pairs present in a project, linked elsewhere, unlinked here.

    Works on families per project, never on node pairs."""
    kind = nodes.select("node_id", "vuln_type")
    linked = (edges.join(kind.select(F.col("node_id").alias("source_node"), F.col("vuln_type").alias("a")), "source_node")
              .join(kind.select(F.col("node_id").alias("target_node"), F.col("vuln_type").alias("b")), "target_node")
              .select("project", "a", "b").distinct())
    support = linked.groupBy("a", "b").agg(F.count(F.lit(1)).alias("projects"))
    types = nodes.groupBy("project").agg(F.collect_set("vuln_type").alias("_t"))
    pairs = types.select("project", F.explode("_t").alias("a"), "_t").select("project", "a", F.explode("_t").alias("b"))
    return pairs.join(linked, ["project", "a", "b"], "left_anti").join(support, ["a", "b"])


# --- reachability --------------------------------------------------------------------------

def levels(edges: DataFrame, seeds: DataFrame, steps: int | None = None) -> DataFrame:
    """Fewest steps from any seed: (node, depth); with ``steps``, nodes that are no further away than that.

    ``edges`` has src and dst. Each round joins the edges with the new nodes
    only and writes them to the checkpoint folder, so lineage stays short."""
    edges = edges.select("src", "dst").distinct()
    reached = durable(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = reached
    for depth in itertools.count(1) if steps is None else range(1, steps + 1):
        nxt = edges.join(frontier.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = durable(nxt.join(reached, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def caller_walk(sinks: DataFrame, calls: DataFrame, sources: DataFrame, limit: int = 10) -> DataFrame:
    """Distance from each sink function to the nearest input source, with the stop reason.

    One search from all sources down to callees, and one count of how far the
    callers go up, replace a walk per sink."""
    down = levels(calls.select(F.col("caller").alias("src"), F.col("callee").alias("dst")), sources, limit)
    up = calls.select("callee", "caller").distinct()
    alive = up.select(F.col("callee").alias("node")).distinct()
    for _ in range(limit - 1):
        alive = durable(up.join(alive.select(F.col("node").alias("caller")), "caller", "left_semi").select(F.col("callee").alias("node")).distinct())
        if alive.isEmpty():
            break
    j = sinks.join(down, "node", "left").join(alive.withColumn("_alive", F.lit(True)), "node", "left")
    return j.withColumn(
        "stop", F.when(F.col("depth").isNotNull(), "source_found").when(F.col("_alive"), "depth_limit").otherwise("no_caller")).drop("_alive")


def find_paths(nodes: DataFrame, edges: DataFrame, starts: Column, goals: Column, steps: int = 4) -> DataFrame:
    """Simple paths of up to ``steps`` nodes from start nodes to goal nodes.

    Edges that cannot reach a goal in the steps left are removed before each
    join, so only partial paths that can still finish are carried."""
    e = edges.select(F.col("source_node").alias("src"), F.col("target_node").alias("dst")).where("src <> dst").distinct()
    goal_nodes = nodes.where(goals).select(F.col("node_id").alias("node"))
    back = levels(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), goal_nodes, steps - 1)
    e = durable(e.join(back.select(F.col("node").alias("dst"), F.col("depth").alias("_left")), "dst"))
    frontier = nodes.where(starts).select("node_id").join(back.select(F.col("node").alias("node_id")), "node_id", "left_semi")
    frontier = frontier.select(F.array("node_id").alias("path"), F.col("node_id").alias("_end"))
    found = frontier
    for used in range(1, steps):
        usable = e.where(F.col("_left") <= steps - 1 - used)
        nxt = frontier.join(usable.select(F.col("src").alias("_end"), "dst"), "_end").where(~F.array_contains("path", F.col("dst")))
        frontier = durable(nxt.select(F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("_end")))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found.join(goal_nodes.select(F.col("node").alias("_end")), "_end", "left_semi").select("path")


def path_score(statuses: Column) -> Column:
    """Sum of node points x length bonus x confidence of the weakest node."""
    points = F.aggregate(statuses, F.lit(0), lambda acc, s: acc + pick(s, R.NODE_POINTS, 0))
    bonus = pick(F.size(statuses), R.LENGTH_BONUS, R.LONG_BONUS)
    conf = (F.when(F.array_contains(statuses, "potential"), R.CONFIDENCE["potential"])
            .when(F.array_contains(statuses, "suspected"), R.CONFIDENCE["suspected"]).otherwise(R.CONFIDENCE["confirmed"]))
    return F.round(points * bonus * conf, 2)


def score_paths(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Attach project, statuses, steps and score to each path."""
    info = nodes.select(F.col("node_id").alias("node"), "project", "vuln_type", "status", "severity")
    keyed = paths.withColumn("path_key", F.array_join("path", ">"))
    steps = keyed.select("path_key", F.posexplode("path").alias("pos", "node")).join(info, "node")
    row = F.struct("pos", "node", F.col("vuln_type").alias("label"), "status", "severity")
    # a path has at most a handful of steps, so this list is bounded
    g = steps.groupBy("path_key").agg(F.min("project").alias("project"), F.array_sort(F.collect_list(row)).alias("_s"))
    clean = F.transform("_s", lambda x: F.struct(x["node"].alias("node"), x["label"].alias("label"), x["status"].alias("status"), x["severity"].alias("severity")))
    return g.select("path_key", "project", clean.alias("steps")).withColumn(
        "path_score", path_score(F.transform("steps", lambda x: x["status"])))


def chain_matches(nodes: DataFrame, chains=R.CHAINS, family_steps=R.FAMILY_STEPS) -> DataFrame:
    """Known chains per project: full, partial (60 percent) and the steps that are missing."""
    fam = nodes.sparkSession.createDataFrame([(k, v) for k, v in family_steps.items()], "vuln_type string, gives array<string>")
    have = nodes.select("project", "vuln_type").distinct().join(F.broadcast(fam), "vuln_type").groupBy("project").agg(
        F.array_distinct(F.flatten(F.collect_list("gives"))).alias("_have"))  # one list per family, a fixed vocabulary
    known = F.array(*[F.struct(F.lit(k).alias("chain"), F.array(*[F.lit(x) for x in v]).alias("steps")) for k, v in chains.items()])
    j = have.select("project", "_have", F.explode(known).alias("_c")).select("project", "_have", "_c.*")
    hit, size = F.size(F.array_intersect("steps", "_have")), F.size("steps")
    return j.select(
        "project", "chain", hit.cast("long").alias("matched"), F.array_join(F.array_except("steps", "_have"), ",").alias("missing"),
        F.when(hit == size, "full_match").when(hit * 100 >= size * 60, "partial_match").otherwise("no_match").alias("match_type"))


def raise_for_chain(priority: Column, match_type: Column) -> Column:
    n = F.substring(priority, 2, 1).cast("int")
    return F.when(match_type == "full_match", F.concat(F.lit("P"), F.greatest(n - 1, F.lit(0)).cast("string"))).otherwise(priority)


def feasibility(checks: dict[str, Column], weights=R.FEASIBILITY) -> Column:
    """Weighted feasibility in 0..100 (negative when defences dominate)."""
    total = F.lit(0)
    for name, weight in weights.items():
        total = total + pick(checks[name], R.FEASIBILITY_POINTS, 0) * weight
    return (total / 10).cast("double")


def feasibility_band(score: str | Column) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s >= 80, "high").when(s >= 50, "medium").when(s >= 20, "low").otherwise("infeasible")


def report_bridge(nodes: DataFrame, board: DataFrame) -> DataFrame:
    """Confirmed nodes with an object nobody has shared yet."""
    known = board.select(F.col("data_object")).distinct()
    return nodes.where((F.col("status") == "confirmed") & F.col("data_object").isNotNull()).join(known, "data_object", "left_anti")


def dangling(refs: DataFrame, ids: DataFrame, ref: str, key: str) -> DataFrame:
    return refs.join(ids, refs[ref] == ids[key], "left_anti")


def neighbours_of(nodes: DataFrame, edges: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Lookup for a few given nodes."""
    return neighbours(nodes, edges.where(F.col("source_node").isin(list(ids)) | F.col("target_node").isin(list(ids)))).where(
        F.col("node_id").isin(list(ids)))
