"""Joins that attach routes, access levels, rules and history to findings (J*).

Rule tables have a fixed number of rows and are broadcast. Tables that grow
with the data carry no hint: Catalyst broadcasts them only under its size
limit, otherwise it sorts and adaptive execution splits skewed keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.functions.score import second_order_risk, second_order_type


def attach_routes(findings: DataFrame, packs: DataFrame, routes: DataFrame) -> DataFrame:
    """Left joins finding -> context pack -> route; unlinked means unknown and anonymous."""
    link = packs.join(routes.drop("project"), "route_id", "left")
    return findings.join(link, "file", "left").withColumn(
        "route_id", F.coalesce("route_id", F.lit("unknown"))).withColumn(
        "auth_level", F.coalesce("auth_level", F.lit("anonymous")))


def second_order_classes(stores: DataFrame, uses: DataFrame) -> DataFrame:
    """Second-order candidates per use point and store class.

    Store points are counted per (table, column, sanitiser) first, so a busy
    column yields three rows per use point instead of every pair."""
    kinds = stores.groupBy("tbl", "col", "sanitization").agg(
        F.count(F.lit(1)).alias("stores"), F.min("store_id").alias("first_store"))
    return uses.join(kinds, ["tbl", "col"]).withColumn(
        "risk", second_order_risk("sanitization", "output_sanitization")).withColumn(
        "vuln_type", second_order_type("usage_sink"))


def feed_cross_check(local: DataFrame, feed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Where local rules and the feed agree."""
    a = local.select(*keys).distinct().withColumn("_l", F.lit(True))
    b = feed.select(*keys).distinct().withColumn("_f", F.lit(True))
    both = F.col("_l").isNotNull() & F.col("_f").isNotNull()
    return a.join(b, list(keys), "full_outer").withColumn(
        "status", F.when(both, "high_confidence").when(F.col("_f").isNotNull(), "pending").otherwise("local_only")
    ).drop("_l", "_f")


def uncovered(queue: DataFrame, results: DataFrame, keys: Sequence[str]) -> DataFrame:
    return queue.join(results.select(*keys), list(keys), "left_anti")


def reconcile(queue: DataFrame, report: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key on both sides with what is missing, extra or repeated."""
    q = queue.groupBy(*keys).agg(F.count(F.lit(1)).alias("queued"))
    r = report.groupBy(*keys).agg(F.count(F.lit(1)).alias("reported"))
    j = q.join(r, list(keys), "full_outer").fillna(0, ["queued", "reported"])
    return j.withColumn(
        "state",
        F.when(F.col("reported") == 0, "missing").when(F.col("queued") == 0, "unknown")
        .when(F.col("reported") > F.col("queued"), "repeated").otherwise("ok"))


def memory_tiers(targets: DataFrame, memory: DataFrame, target_key: str) -> DataFrame:
    """Best memory match tier per target and how many rows support it.

    Both sides are reduced to their distinct (type, framework, version,
    firewall) profiles before they meet, so the join that has only a few types
    as key handles profiles; targets are looked up by profile afterwards."""
    cols = ["sink_type", "framework", "php_major", "waf"]
    profiles = memory.groupBy(*cols).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("status") == "confirmed").alias("confirmed"))
    t, m = targets.select(*cols).distinct().alias("t"), profiles.alias("m")
    fw = F.col("t.framework") == F.col("m.framework")
    php = F.col("t.php_major") == F.col("m.php_major")
    waf = F.col("t.waf") == F.col("m.waf")
    tier = F.when(fw & php & waf, 1).when(fw & php, 2).when(php, 3).otherwise(4)
    j = t.join(m, F.col("t.sink_type") == F.col("m.sink_type")).select("t.*", tier.alias("tier"), "m.rows", "m.confirmed")
    g = j.groupBy(*cols, "tier").agg(F.sum("rows").alias("memories"), F.sum("confirmed").alias("confirmed"))
    best = F.min_by(F.struct("tier", "memories", "confirmed"), F.col("tier"))
    g = g.groupBy(*cols).agg(best.alias("b")).select(*cols, "b.*")
    same = F.lit(True)
    for c in cols:
        same = same & F.col(f"x.{c}").eqNullSafe(F.col(f"g.{c}"))
    return targets.alias("x").join(g.alias("g"), same).select(F.col(f"x.{target_key}"), "g.tier", "g.memories", "g.confirmed")


def rule_lookup(rows: DataFrame, rules: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join a fixed rule table; its row count does not depend on the data."""
    return rows.join(F.broadcast(rules), list(on), how)


def forced_areas(projects: DataFrame, rules: list[tuple[str | None, str]]) -> DataFrame:
    """Work areas every project gets, plus those its framework adds."""
    spark = projects.sparkSession
    table = spark.createDataFrame(rules, "fw string, area string")
    cond = F.col("fw").isNull() | (F.col("fw") == F.col("framework"))
    return projects.join(F.broadcast(table), cond).select("project", "area").distinct()


def overlap_level(shared: Column, total: Column) -> Column:
    """Agreement between a recorded and a static path."""
    pct = shared * 100
    return F.when(pct >= total * 80, "high").when(pct >= total * 50, "medium").otherwise("low")


def path_agreement(frames: DataFrame, static: DataFrame, key: str = "trace_id") -> DataFrame:
    """Share of each static path (an array of functions) that the recorded trace confirms.

    The short static side is exploded and matched by (trace, function), so the
    functions of a long trace are never gathered in one row."""
    steps = static.select(key, F.explode(F.array_distinct("static_path")).alias("function"))
    seen = frames.select(key, "function").distinct().withColumn("_seen", F.lit(1))
    j = steps.join(frames.select(key).distinct(), key, "left_semi").join(seen, [key, "function"], "left")
    g = j.groupBy(key).agg(F.count("_seen").cast("int").alias("shared"), F.count(F.lit(1)).cast("int").alias("total"))
    return g.withColumn("level", overlap_level(F.col("shared"), F.col("total")))


def uncollected_for(board: DataFrame, reader: str) -> DataFrame:
    """Shared findings a reader has not consumed yet."""
    return board.where(~F.array_contains("consumed_by", reader))


def mark_consumed(board: DataFrame, reader: str) -> DataFrame:
    return board.withColumn("consumed_by", F.array_union("consumed_by", F.array(F.lit(reader))))


def incremental_scope(changed: DataFrame, includes: DataFrame) -> DataFrame:
    """Changed files and the files they include (depth one)."""
    one = includes.join(changed, includes["file"] == changed["file"], "left_semi").select(F.col("included").alias("file"))
    return changed.select("file").unionByName(one).distinct()


def run_mode(changes: DataFrame, keys=("project",), limit: int = 10) -> DataFrame:
    """Incremental for fewer than ``limit`` changed files and no new route file."""
    return changes.groupBy(*keys).agg(
        F.countDistinct("path").alias("changed"),
        F.coalesce(F.bool_or((F.col("change_type") == "A") & F.col("path").rlike("routes?/")), F.lit(False)).alias("new_routes"),
    ).withColumn("mode", F.when((F.col("changed") < limit) & ~F.col("new_routes"), "incremental").otherwise("full"))
