"""Evidence completeness, risk pool, research triggers and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.functions.values import filled_evidence
from vulnlake.rules import evidence as E


def required_points(sink_type: str | Column, confirming: Column) -> Column:
    t = F.col(sink_type) if isinstance(sink_type, str) else sink_type
    out = F.array().cast("array<string>")
    for sink, family in E.FAMILY_EVIDENCE.items():
        full = F.array(*[F.lit(x) for x in E.required(family)])
        base = F.array(*[F.lit(x) for x in E.required(family, confirming=False)])
        out = F.when(t == sink, F.when(confirming, full).otherwise(base)).otherwise(out)
    return out


def evidence_gaps(results: DataFrame) -> DataFrame:
    """Add the missing required evidence points of each result."""
    need = required_points("sink_type", F.col("verdict") == "confirmed")
    missing = F.array_except(need, F.map_keys(filled_evidence("evidence")))
    return results.withColumn("missing", missing).withColumn("complete", F.size("missing") == 0)


def open_reasons() -> Column:
    """Why a result stays open: an unproven suspicion, exhausted rounds on a reachable sink, evidence that could not be obtained."""
    noted = F.exists(F.map_values("evidence"), lambda v: v.startswith("[未获取"))
    return F.array_compact(F.array(
        F.when(F.col("verdict").isin("suspected", "potential") & (F.size("missing") > 0), "missing_evidence"),
        F.when((F.col("verdict") == "failed") & (F.col("rounds") >= F.col("max_rounds")) & F.col("reachable"), "rounds_exhausted"),
        F.when(noted, "not_obtained")))


def pending_pool(results: DataFrame) -> DataFrame:
    """Results that stay open, with the reasons."""
    return results.withColumn("reasons", open_reasons()).where(F.size("reasons") > 0)


def research_triggers(state: DataFrame) -> DataFrame:
    """The five conditions that call for research, as one array."""
    t = F.array_compact(F.array(
        F.when(F.col("unknown_component"), "MR-1"), F.when(F.col("critical_alert") & ~F.col("known_poc"), "MR-2"),
        F.when((F.col("fail_streak") >= 5) & (F.col("filter_score") >= 61), "MR-3"),
        F.when(F.col("pivoted") & (F.col("fail_streak") >= 3), "MR-4"), F.when(F.col("unknown_filter"), "MR-5")))
    return state.withColumn("triggers", t)


def agent_diagnosis(checkpoints: DataFrame) -> DataFrame:
    """What to do with each producer recorded in a checkpoint's state map."""
    rows = checkpoints.select("project", F.explode("agent_states").alias("agent", "s"))
    status = F.col("s.status")
    action = (F.when((status == "spawned") & F.col("s.completed_at").isNull(), "restart")
              .when((status == "failed") & (F.col("s.redo_count") < 2), "redo").when(status == "failed", "degrade")
              .when(status == "timeout", "keep_partial").when(status == "passed", "none").otherwise("spawn"))
    return rows.select("project", "agent", status.alias("status"), action.alias("action"))


def check_rows(metrics: DataFrame, checks: list[tuple[str, str, Column, bool]], keys=("phase",)) -> DataFrame:
    """One row per check: (id, expected text, condition, must pass)."""
    rows = F.array(*[F.struct(F.lit(i).alias("item"), F.lit(exp).alias("expected"), F.coalesce(ok, F.lit(False)).alias("ok"), F.lit(must).alias("must"))
                     for i, exp, ok, must in checks])
    return metrics.select(*keys, F.explode(rows).alias("c")).select(*keys, "c.*")


def phase_verdict(rows: DataFrame, keys=("phase",), max_warnings: int = 2) -> DataFrame:
    """Fail on any failed must-pass item or on more than ``max_warnings`` warnings."""
    g = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("passed"), F.count_if(~F.col("ok") & F.col("must")).alias("hard_fails"),
        F.count_if(~F.col("ok") & ~F.col("must")).alias("warnings"))
    return g.withColumn("verdict", F.when((F.col("hard_fails") > 0) | (F.col("warnings") > max_warnings), "fail").otherwise("pass"))


def alert_lines(alerts: DataFrame) -> DataFrame:
    return alerts.where(F.col("severity").isin("critical", "high")).withColumn(
        "line", F.format_string("[%s] %s %s: %s", F.upper("severity"), "component", "version", "advisory"))
