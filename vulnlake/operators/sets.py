"""Set operations (X*)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FINDING_COLUMNS = ["file", "line", "sink_function", "sink_type", "source"]


def union_findings(reports: Sequence[DataFrame]) -> DataFrame:
    """All normalised reports as one bag."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), reports)


def missing_types(needed: DataFrame, ran: DataFrame) -> DataFrame:
    """Types that need work but have none: empty means needed is a subset of ran."""
    return needed.distinct().join(ran.distinct(), needed.columns, "left_anti")


def role_gain(grants: DataFrame, hierarchy: dict[str, list[str]], keys: Sequence[str], item: str) -> DataFrame:
    """What each role can reach that none of its juniors can.

    The lowest role that reaches an item owns it, so one aggregation replaces
    the closure join."""
    seniority = {role: len(below) for role, below in hierarchy.items()}
    rank = F.lit(None).cast("int")
    for role, n in seniority.items():
        rank = F.when(F.col("role") == role, n).otherwise(rank)
    low = grants.groupBy(*keys, item).agg(F.min_by("role", rank).alias("role"))
    return low
