"""Entity-shaped inputs built from the given tables for the registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F


def board(t):
    """Shared findings from the event stream; two of three were read by someone."""
    read = F.when(F.col("event_id") % 3 == 0, F.array().cast("array<string>")).otherwise(
        F.array(F.concat(F.lit("reader"), (F.col("event_id") % 3).cast("string"))))
    return t.events.select(
        "event_id", "ts", F.concat(F.lit("agent"), F.col("user_id").cast("string")).alias("source_agent"),
        F.col("event_type").alias("finding_type"),
        F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "purchase", "high").otherwise("normal").alias("priority"),
        F.get_json_object("props", "$.k").alias("data_key"), F.round("value").cast("int").alias("data_value"), read.alias("consumed_by"))
