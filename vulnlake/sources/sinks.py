"""Keyed writes, SARIF, graph and report exports (W*).

No export collects a whole project into one row: documents are split into
bounded shards that reference each other, or written as ordered lines.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.functions.score import pick
from vulnlake.rules.report_rules import HELP, TYPE_RULES, WARNINGS


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Column, keep: str = "last") -> DataFrame:
    """Merge two tables on a unique key, keeping the first or last row in ``order``.

    A max_by/min_by aggregate combines before the shuffle, so repeated keys cost little."""
    rest = [c for c in current.columns if c not in keys]
    picked = (F.max_by if keep == "last" else F.min_by)(F.struct(*rest), order)
    merged = current.unionByName(incoming).groupBy(*keys).agg(picked.alias("_v"))
    return merged.select(*keys, "_v.*")


def with_defaults(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    return rows.select(*[F.coalesce(F.col(c), defaults[c]).alias(c) if c in defaults else F.col(c) for c in rows.columns])


def sarif_level(verdict: str | Column) -> Column:
    v = F.col(verdict) if isinstance(verdict, str) else verdict
    return pick(v, {"confirmed": "error", "suspected": "warning", "potential": "note"}, None)


def code_flow(layers: Column) -> Column:
    """Locations from source to sink; no layers means no flow."""
    ordered = F.reverse(F.array_sort(layers))
    steps = F.transform(ordered, lambda x: F.struct(F.struct(
        F.struct(F.struct(F.coalesce(x["file"], F.lit("unknown")).alias("uri")).alias("artifactLocation"),
                 F.struct(F.greatest(F.coalesce(x["line"], F.lit(1)), F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"),
        F.struct(F.concat_ws(": ", x["role"], x["function"]).alias("text")).alias("message")).alias("location")))
    return F.when(F.size(layers) > 0, F.array(F.struct(F.array(F.struct(steps.alias("locations"))).alias("threadFlows"))))


def sarif_results(findings: DataFrame, flows: str | None = None, properties: Sequence[str] = ("verdict",)) -> DataFrame:
    """One SARIF result object per finding; findings judged not vulnerable are left out.

    Needs project, sink_type, verdict, file, line, sink_function. ``properties`` names columns for the property bag (null:
    left out). ``missing`` lists what the result lacks: a path, a line, a priority, a code flow."""
    location = F.struct(F.struct(
        F.struct(F.coalesce("file", F.lit("unknown")).alias("uri")).alias("artifactLocation"),
        F.struct(F.greatest(F.coalesce("line", F.lit(1)), F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    parts = [
        F.col("sink_type").alias("ruleId"), sarif_level("verdict").alias("level"),
        F.struct(F.concat_ws(" ", F.col("sink_type"), F.lit("at"), F.col("sink_function")).alias("text")).alias("message"),
        F.array(location).alias("locations"), F.struct(*properties).alias("properties")]
    flags = {"no_path": F.col("file").isNull(), "no_line": F.col("line").isNull()}
    if "priority" in properties:
        flags["no_priority"] = F.col("priority").isNull()
    if flows:
        parts.append(F.col(flows).alias("codeFlows"))
        flags["no_flow"] = F.col(flows).isNull()
    kept = findings.where(sarif_level("verdict").isNotNull())
    missing = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]))
    return kept.select("project", "sink_type", "file", "line", F.to_json(F.struct(*parts)).alias("result"), missing.alias("missing"))


def sarif_rule(kind: Column) -> Column:
    """Rule object of a finding type; a type without a description has its own name and no help link."""
    known = F.try_element_at(F.from_json(F.lit(json.dumps({k: {"name": n, "cwe": c} for k, (n, c) in TYPE_RULES.items()})), "map<string,struct<name:string,cwe:int>>"), kind)
    name = F.coalesce(known["name"], kind)
    return F.struct(
        kind.alias("id"), name.alias("name"), F.struct(F.concat(name, F.lit(" vulnerability")).alias("text")).alias("shortDescription"),
        F.concat(F.lit(HELP), known["cwe"].cast("string"), F.lit(".html")).alias("helpUri"),
        F.struct(F.array(F.lit("security"), F.replace(F.lower(name), F.lit(" "), F.lit("-"))).alias("tags")).alias("properties"))


def to_sarif(findings: DataFrame, shard_rows: int = 20_000, flows: str | None = None, properties: Sequence[str] = ("verdict",)) -> tuple[DataFrame, DataFrame]:
    """SARIF 2.1.0 as (runs, shards).

    ``runs`` has one log per project: the tool, its rules with names and help
    links, warnings about what results lack, and references to external
    property files. ``shards`` holds the results in files of about
    ``shard_rows`` each, so a large project never becomes one row."""
    results = sarif_results(findings, flows, properties)
    lacking = [F.count_if(F.array_contains("missing", n)).alias(n) for n in WARNINGS]
    sizes = results.groupBy("project").agg(F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_set("sink_type")).alias("_rules"), *lacking)
    counted = sizes.withColumn("_shards", F.ceil(F.col("_n") / shard_rows))
    spread = results.drop("missing").join(counted.select("project", "_shards"), "project").withColumn(
        "shard", F.pmod(F.xxhash64("result"), F.col("_shards")))
    # Dealt by shard: else all shards of a project would be built where the join put the project.
    spread = spread.repartition("project", "shard")
    shards = spread.groupBy("project", "shard").agg(F.count(F.lit(1)).alias("items"), F.sort_array(F.collect_list("result")).alias("_r"))
    shards = shards.select(
        "project", "shard", "items", F.concat(F.lit('{"version":"2.1.0","results":['), F.array_join("_r", ","), F.lit("]}")).alias("document"))
    uri = lambda i: F.concat(F.lit("results-"), i.cast("string"), F.lit(".sarif-external-properties"))
    notes = F.array_compact(F.array(*[F.when(F.col(n) > 0, F.struct(
        F.lit("warning").alias("level"), F.struct(F.concat_ws(" ", F.col(n).cast("string"), F.lit(text)).alias("text")).alias("message"))) for n, text in WARNINGS.items()]))
    log = F.struct(
        F.lit("2.1.0").alias("version"),
        F.array(F.struct(
            F.struct(F.struct(F.lit("vulnlake").alias("name"), F.transform("_rules", sarif_rule).alias("rules")).alias("driver")).alias("tool"),
            F.array(F.struct(F.lit(True).alias("executionSuccessful"), notes.alias("toolExecutionNotifications"))).alias("invocations"),
            F.struct(F.transform(F.sequence(F.lit(0), F.col("_shards").cast("int") - 1),
                                 lambda i: F.struct(F.struct(uri(i).alias("uri")).alias("location"))).alias("results")).alias("externalPropertyFileReferences"),
        )).alias("runs"))
    runs = counted.select("project", F.col("_n").alias("results"), F.col("_shards").cast("long").alias("shards"), F.to_json(log).alias("document"))
    return runs, shards


def sarif_problems(results: DataFrame) -> DataFrame:
    """Reasons a result object is not valid SARIF."""
    r = F.from_json("result", "ruleId string, level string, message struct<text:string>, "
                    "locations array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>")
    x = results.withColumn("_r", r)
    loc = F.col("_r.locations")[0]["physicalLocation"]
    reasons = F.array_compact(F.array(
        F.when(F.col("_r.ruleId").isNull(), "ruleId missing"),
        F.when(~F.coalesce(F.col("_r.level").isin("error", "warning", "note", "none"), F.lit(False)), "level outside domain"),
        F.when(F.col("_r.message.text").isNull(), "message missing"),
        F.when(loc["artifactLocation"]["uri"].isNull(), "uri missing"),
        F.when(~F.coalesce(loc["region"]["startLine"] >= 1, F.lit(False)), "startLine not positive")))
    return x.withColumn("problems", reasons).drop("_r")


def graph_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Graph export as one JSON line per node, edge and statistic, newest first inside each part.

    Lines instead of one document, because a graph may not fit one row."""
    n = nodes.select(F.lit(0).alias("part"), F.lit("node").alias("kind"), (-F.col("seq")).alias("place"), "project",
                     F.to_json(F.struct("node_id", "vuln_type", "severity", "status", "data_object")).alias("json"))
    e = edges.select(F.lit(1).alias("part"), F.lit("edge").alias("kind"), (-F.col("seq")).alias("place"), "project",
                     F.to_json(F.struct("source_node", "target_node", "relation", "confidence")).alias("json"))
    stats = (nodes.groupBy("project").agg(F.count(F.lit(1)).alias("nodes"))
             .join(edges.groupBy("project").agg(F.count(F.lit(1)).alias("edges")), "project", "full_outer").fillna(0, ["nodes", "edges"]))
    s = stats.select(F.lit(2).alias("part"), F.lit("stats").alias("kind"), F.lit(0).cast("long").alias("place"), "project",
                     F.to_json(F.struct("nodes", "edges")).alias("json"))
    return n.unionByName(e).unionByName(s)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    lines = graph_lines(nodes, edges).repartitionByRange("project", "part", "place").sortWithinPartitions("project", "part", "place")
    lines.select("project", "json").write.mode("overwrite").partitionBy("project").text(path)


def mermaid(paths: DataFrame, max_nodes: int = 30) -> DataFrame:
    """Graph text of each project's best paths, up to ``max_nodes`` nodes.

    The node limit is part of the drawing; ``paths`` has project, path_score,
    path_key and steps array<struct<node, label, status, severity>>."""
    from vulnlake.operators.ordered import top_k

    best = top_k(paths, ["project"], [F.col("path_score").desc(), "path_key"], max_nodes, "_place")
    steps = best.select("project", "_place", F.posexplode("steps").alias("_pos", "s"))
    order = F.col("_place") * 1000 + F.col("_pos")
    nodes = steps.groupBy("project", F.col("s.node").alias("node")).agg(F.min(order).alias("_o"), F.first("s").alias("s"))
    nodes = top_k(nodes, ["project"], ["_o"], max_nodes)
    color = (F.when((F.col("s.status") == "confirmed") & F.col("s.severity").isin("critical", "high"), "#ff4444")
             .when((F.col("s.status") == "suspected") | (F.col("s.severity") == "medium"), "#ffaa00").otherwise("#ffdd00"))
    box = nodes.select("project", "_o", F.format_string("    %s[%s]\n    style %s fill:%s", "node", "s.label", "node", color).alias("line"))
    pairs = best.select("project", F.explode(F.transform(F.sequence(F.lit(1), F.size("steps") - 1), lambda i: F.struct(
        F.element_at("steps", i)["node"].alias("a"), F.element_at("steps", i + 1)["node"].alias("b")))).alias("p")).select("project", "p.*").distinct()
    drawn = nodes.select("project", "node")
    pairs = pairs.join(drawn.withColumnRenamed("node", "a"), ["project", "a"], "left_semi").join(
        drawn.withColumnRenamed("node", "b"), ["project", "b"], "left_semi")
    arrows = pairs.select("project", F.lit(10 ** 9).alias("_o"), F.format_string("    %s --> %s", "a", "b").alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_o", "line"))), lambda x: x["line"])
    return box.unionByName(arrows).groupBy("project").agg(F.concat(F.lit("graph TD\n"), F.array_join(lines, "\n")).alias("text"))


def quality_lines(stats: DataFrame) -> DataFrame:
    """Markdown table rows of a quality report."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("N/A"))
    return stats.select(F.coalesce("phase", F.lit("total")).alias("phase"), F.concat(
        F.lit("| "), F.concat_ws(" | ", F.coalesce("phase", F.lit("total")), cell("checks"), cell("passed"), cell("failed"), cell("redos"),
                                 F.concat(cell("avg_pass_rate"), F.lit("%"))), F.lit(" |")).alias("line"))
