"""The batch plan a user runs end to end: normalise, merge, link, score, order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.functions import score as S
from vulnlake.operators.aggregate import dedup_findings
from vulnlake.operators.enrich import attach_routes


def scored_queue(findings: DataFrame, packs: DataFrame, routes: DataFrame) -> DataFrame:
    """Findings deduplicated, linked to route and auth level, with a priority."""
    linked = attach_routes(dedup_findings(findings), packs, routes)
    tags = S.business_tags("url", "controller")
    base = S.base_priority("auth_level", S.danger_class("sink_type"))
    return linked.withColumn("business_impact", tags).withColumn(
        "priority", S.final_priority(base, F.col("source_count"), F.coalesce(tags, F.array().cast("array<string>"))))


def run_pipeline(findings: DataFrame, packs: DataFrame, routes: DataFrame, results: DataFrame | None = None) -> dict[str, DataFrame]:
    """Queue, counts per priority and, with recorded results, what is still uncovered."""
    from vulnlake.operators.enrich import uncovered

    queue = scored_queue(findings, packs, routes)
    out = {
        "queue": queue,
        "summary": queue.groupBy("priority", "auth_level").agg(F.count(F.lit(1)).alias("findings")),
    }
    if results is not None:
        out["uncovered"] = uncovered(queue, results, ["file", "line", "sink_function"])
    return out
