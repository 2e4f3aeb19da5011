"""Report tables: verdict groups, the pool of open risks, coverage and the matrix of producers.

Input are assessment results with project, file, line, sink_type, verdict, evidence (map), rounds, max_rounds and reachable.
Equal entries are counted, not repeated; numbers follow the whole entry, so ties do not move between runs. A null verdict
has the group ``none``; an empty input gives no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.functions.score import pick
from vulnlake.operators.evidence import evidence_gaps, open_reasons
from vulnlake.operators.ordered import rank_in_group
from vulnlake.session import durable

# fixed values: what is proposed per reason, most telling reason first
NEXT_STEP = {"not_obtained": "restore the environment and repeat", "rounds_exhausted": "review by hand", "missing_evidence": "replay by hand"}
STATES = ("executed", "failed", "deferred", "not_applicable")


def graded(results: DataFrame) -> DataFrame:
    """Add ``missing``, ``reasons`` (why an entry stays open) and ``grp``: confirmed needs every evidence point, a confirmed
    entry that lacks one counts as suspected, and an entry with a reason is in the pool."""
    held = F.coalesce("evidence", F.create_map().cast("map<string,string>"))
    g = evidence_gaps(results.withColumn("evidence", held)).withColumn("reasons", open_reasons())
    downgraded = F.when((F.col("verdict") == "confirmed") & (F.size("missing") > 0), "suspected").otherwise(F.coalesce("verdict", F.lit("none")))
    return g.withColumn("grp", F.when(F.size("reasons") > 0, "pool").otherwise(downgraded))


def verdict_groups(results: DataFrame, by: str = "project") -> DataFrame:
    return graded(results).groupBy(by, "grp").agg(
        F.count(F.lit(1)).alias("entries"), F.countDistinct("sink_type").alias("types"), F.count_if(F.size("missing") > 0).alias("incomplete"))


def risk_pool(results: DataFrame, by: str = "project") -> DataFrame:
    """Numbered pool entries: none is left out, equal ones carry their number of occurrences."""
    lists = [F.array_join(c, ",").alias(c) for c in ("missing", "reasons")]
    entry = ["sink_type", "file", "line", "verdict", "missing", "reasons"]
    pool = graded(results).where("grp = 'pool'").select(by, "sink_type", "file", "line", "verdict", *lists).groupBy(by, *entry).agg(F.count(F.lit(1)).alias("times"))
    step = F.coalesce(*[F.when(F.col("reasons").contains(r), s) for r, s in NEXT_STEP.items()])
    numbered = rank_in_group(durable(pool), [by], entry, "_n")
    text = F.col("_n").cast("string")
    return numbered.withColumn("id", F.concat(F.lit("RP-"), F.when(F.col("_n") < 1000, F.lpad(text, 3, "0")).otherwise(text))).withColumn("next_step", step).drop("_n")


def agent_matrix(agents: DataFrame, names: Sequence[str], by: str = "project") -> DataFrame:
    """One row per (project, producer), also for a producer that left nothing: its furthest state and its records."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, STATES)), F.col("state")).cast("int"), F.lit(0))
    seen = agents.groupBy(by, "agent").agg(F.min(F.when(place > 0, place)).alias("p"), F.count(F.lit(1)).alias("records"))
    every = agents.select(by).distinct().select(by, F.explode(F.array(*map(F.lit, names))).alias("agent"))
    state = pick(F.col("p"), {i: s for i, s in enumerate(STATES, 1)}, "missing")
    return every.join(seen, [by, "agent"], "left").select(by, "agent", state.alias("state"), F.coalesce("records", F.lit(0)).cast("long").alias("records"))


def route_coverage(routes: DataFrame, by: str = "project") -> DataFrame:
    """Audited, skipped and open routes; ``gap`` is what neither was audited nor has a reason to be skipped."""
    n = lambda s: F.count_if(F.col("state") == s)
    g = routes.groupBy(by).agg(F.count(F.lit(1)).alias("routes"), n("audited").alias("audited"), n("skipped").alias("skipped"))
    return g.withColumn("gap", F.col("routes") - F.col("audited") - F.col("skipped")).withColumn("audited_pct", F.round(F.col("audited") * 100.0 / F.col("routes"), 2))
