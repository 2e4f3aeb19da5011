"""Numbering, streaks, retention and report orders (E*, T*).

Per-key order goes through ``ordered`` so that one large key is split; limits
over a whole table use orderBy + limit (TakeOrderedAndProject), not a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.functions.score import SEVERITY_ORDER, pick, rank_of
from vulnlake.functions.values import micros
from vulnlake.operators.ordered import failure_streak, previous, rank_in_group, top_k
from vulnlake.session import durable

MEMORY_ORDER = ["confirmed", "partial", "failed"]  # fixed values: lookup order
REDO_LIMITS = {"1": 3, "2": 2, "3": 2, "4": 2, "4.5": 1, "5": 2}  # fixed values: redo limit per phase


def finding_ids(scored: DataFrame, keys=("project", "level", "type"), order=None) -> DataFrame:
    """``{Level}-{Type}-{Seq}`` numbered inside (project, level, type)."""
    order = order or [F.col("score").desc(), "file", "line"]
    ranked = rank_in_group(durable(scored), list(keys), order, "_n")
    seq = F.when(F.col("_n") < 1000, F.lpad(F.col("_n").cast("string"), 3, "0")).otherwise(F.col("_n").cast("string"))
    return ranked.withColumn("vuln_id", F.concat_ws("-", "level", F.upper("type"), seq)).drop("_n")


def queue_ids(queue: DataFrame, order, keys=("project",)) -> DataFrame:
    """``sink_001`` ... in queue order, per project."""
    ranked = rank_in_group(durable(queue), list(keys), order, "_n")
    seq = F.when(F.col("_n") < 1000, F.lpad(F.col("_n").cast("string"), 3, "0")).otherwise(F.col("_n").cast("string"))
    return ranked.withColumn("sink_id", F.concat(F.lit("sink_"), seq)).drop("_n")


def stuck_rounds(rounds: DataFrame, keys=("sink_no",), order=("ts", "event_id"), last: int = 3, start: int = 4) -> DataFrame:
    """Rounds from ``start`` on where the last ``last`` results all failed."""
    s = failure_streak(rounds, list(keys), list(order), F.col("result") == "failed")
    return s.where((F.col("rn") >= start) & (F.col("streak") >= last))


def blocked_rounds(rounds: DataFrame, keys=("sink_no",), order=("ts", "event_id"), streak: int = 5, filter_score: int = 61) -> DataFrame:
    """Five failures in a row behind a strong filter; ``pivot_again`` marks three more."""
    s = failure_streak(rounds, list(keys), list(order), F.col("result") == "failed")
    return s.where((F.col("streak") >= streak) & (F.col("filter_score") >= filter_score)).withColumn(
        "pivot_again", F.col("streak") >= streak + 3)


def compress_rounds(rounds: DataFrame, keys=("sink_no",), order=("ts", "event_id"), block: int = 3) -> DataFrame:
    """One summary row per block of three rounds; a block holds at most three rows."""
    r = rank_in_group(rounds, list(keys), list(order), "rn").withColumn(
        "block", F.floor((F.col("rn") - 1) / block).cast("long"))
    rows = F.array_sort(F.collect_list(F.struct("rn", "strategy", "result")))
    return r.groupBy(*keys, "block").agg(
        F.count(F.lit(1)).alias("rounds"),
        F.array_join(F.transform(rows, lambda x: F.concat_ws(":", F.concat(F.lit("R"), x["rn"].cast("string")), x["strategy"], x["result"])), " | ").alias("summary"),
        F.max_by("event_id", "rn").alias("last_event_id"), F.count_if(F.col("result") == "failed").alias("failed"))


def retain_memory(memory: DataFrame, capacity: int = 1000, newest: int = 500, id_col: str = "id") -> DataFrame:
    """Above capacity: every confirmed row and the newest ``newest`` rows."""
    if memory.limit(capacity + 1).count() <= capacity:  # reads at most capacity + 1 rows
        return memory
    recent = memory.orderBy(F.col("created_at").desc(), F.col(id_col).desc()).limit(newest).select(id_col)
    kept_new = memory.where(~F.col("status").eqNullSafe("confirmed")).join(recent, id_col, "left_semi")
    return memory.where(F.col("status") == "confirmed").unionByName(kept_new)


def retain_graph(nodes: DataFrame, edges: DataFrame, status: str = "speculative", capacity: int = 5000, keep: int = 4500):
    """Above capacity: drop the oldest (n - keep) nodes of a status and the edges that touch them."""
    n = nodes.count()  # the only driver number: compared with the capacity
    if n <= capacity:
        return nodes, edges
    old = nodes.where(F.col("status") == status).select("node_id", "seq", F.lit(1).alias("_all"))
    ranked = rank_in_group(old, ["_all"], ["seq", "node_id"], "_rank", limit=0)  # by ranges, in any number of tasks
    gone = ranked.where(F.col("_rank") <= n - keep).select("node_id")
    left = edges.join(gone, edges["source_node"] == gone["node_id"], "left_anti")
    return nodes.join(gone, "node_id", "left_anti"), left.join(gone, left["target_node"] == gone["node_id"], "left_anti")


def latest_checks(qc: DataFrame, order: Column | None = None) -> DataFrame:
    """The newest check per (phase, producer) and whether it may be redone."""
    order = order if order is not None else F.struct("ts", "qc_id")
    last = qc.groupBy("phase", "target_agent").agg(F.max_by(F.struct("qc_id", "verdict", "redo_count", "ts"), order).alias("_l"))
    limit = pick(F.col("phase"), REDO_LIMITS, 2)
    return last.select("phase", "target_agent", "_l.*").withColumn(
        "may_redo", (F.col("verdict") == "fail") & (F.col("redo_count") < limit))


def sampling_rate(routes: Column, priority: Column) -> Column:
    """Percent kept per priority as the number of routes grows."""
    p2 = F.when(routes <= 100, 100).when(routes <= 200, 50).otherwise(30)
    p3 = F.when(routes <= 50, 100).when(routes <= 100, 50).when(routes <= 200, 25).otherwise(0)
    return F.when(priority.isin("P0", "P1"), 100).when(priority == "P2", p2).otherwise(p3)


def down_sample(queue: DataFrame, scope="project", order=None) -> DataFrame:
    """Deterministic down-sampling that keeps the most corroborated findings."""
    order = order or [F.col("source_count").desc(), "file", "line", "sink_function"]
    queue = durable(queue)  # read three times below: written once instead of derived three times
    sizes = queue.groupBy(scope, "priority").agg(F.count(F.lit(1)).alias("_n"))
    totals = sizes.groupBy(scope).agg(F.sum("_n").alias("_routes"))
    quota = sizes.join(totals, scope).select(
        scope, "priority",
        F.ceil(F.col("_n") * sampling_rate(F.col("_routes"), F.col("priority")) / 100).alias("_quota"))
    ranked = rank_in_group(queue, [scope, "priority"], order, "_rn")
    return ranked.join(quota, [scope, "priority"]).where(F.col("_rn") <= F.col("_quota")).drop("_rn", "_quota")


def mixed_protection(routes: DataFrame, keys=("controller",), has_auth: Column | None = None) -> DataFrame:
    """Unprotected routes of a controller that protects other routes."""
    flagged = routes.withColumn("has_auth", has_auth if has_auth is not None else F.col("auth_level") != "anonymous")
    mixed = flagged.groupBy(*keys).agg(F.max("has_auth").alias("_any"), F.min("has_auth").alias("_all"))
    mixed = mixed.where(F.col("_any") & ~F.col("_all")).select(*keys)
    return flagged.where(~F.col("has_auth")).join(mixed, list(keys), "left_semi").withColumn("risk", F.lit("HIGH_RISK"))


def resolve_conflicts(results: DataFrame, keys=("sink_no",)) -> DataFrame:
    """One verdict per subject: evidence beats no evidence, then the newest; conflicts are flagged."""
    order = F.struct(F.col("has_evidence").cast("int"), "ts", "event_id")
    return results.groupBy(*keys).agg(
        F.max_by("result", order).alias("verdict"), F.max("has_evidence").alias("evidenced"),
        (F.min("result") != F.max("result")).alias("conflict"))


def state_durations(log: DataFrame, key: str, ts: str, state: str, order) -> DataFrame:
    """Time each producer spent before its next record; stuck means over ten minutes."""
    prev = previous(log, [key], order, {"prev_ts": ts, "prev_state": state})
    secs = micros(ts) - micros("prev_ts")
    return prev.where(F.col("prev_ts").isNotNull()).withColumn("gap_us", secs).withColumn("stuck", secs > 600_000_000)


# --- report orders -------------------------------------------------------------------------

def queue_order(queue: DataFrame) -> DataFrame:
    return queue.orderBy("priority", F.col("source_count").desc(), "file", "line", "sink_function")


def memory_lookup(memory: DataFrame, sink_type: str, framework=None, php_major=None, waf=None, limit: int = 20) -> DataFrame:
    """Confirmed before partial before failed, newest first, ``limit`` rows."""
    hit = memory.where(F.col("sink_type") == sink_type)
    if framework:
        hit = hit.where(F.col("framework") == framework)
    if php_major:
        hit = hit.where(F.col("php_version").startswith(f"{php_major}."))
    if waf:
        hit = hit.where(F.col("waf_type") == waf)
    return hit.orderBy(rank_of("status", MEMORY_ORDER), F.col("created_at").desc(), "id").limit(limit)


def board_order(board: DataFrame) -> list[Column]:
    return [F.when(F.col("priority") == "critical", 1).when(F.col("priority") == "high", 2).otherwise(3), F.col("ts").desc()]


def by_severity(rows: DataFrame, *ties) -> DataFrame:
    return rows.orderBy(rank_of("severity", SEVERITY_ORDER), *ties)


def schedule_order() -> list[Column]:
    """Sign-in routes, then anonymous ones, then writes."""
    return [
        F.when(F.col("url").rlike("login|auth|token|session"), 0).otherwise(1),
        F.when(F.col("auth_level") == "anonymous", 0).otherwise(1),
        F.when(F.col("method").isin("POST", "PUT", "DELETE"), 0).otherwise(1),
    ]


def fix_order() -> Column:
    urgent = F.col("severity").isin("critical", "high")
    return (
        F.when((F.col("status") == "confirmed") & urgent, 1)
        .when((F.col("status") == "confirmed") & (F.col("severity") == "medium"), 2)
        .when((F.col("status") == "suspected") & urgent, 3).otherwise(4)
    )


def top_paths(paths: DataFrame, k: int = 3) -> DataFrame:
    return top_k(paths, ["project"], [F.col("path_score").desc(), "path_key"], k, "place")
