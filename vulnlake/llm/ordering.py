"""Positions within keys, for keys of any size: ranges of the order instead of one task per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from vulnlake.llm.common import written


def in_ranges(rows: DataFrame, ranges: Sequence[Column], order: Sequence[Column], keep: Sequence[Column | str], kind: str) -> DataFrame:
    """``keep`` and ``_part``, ``_at`` of all rows in global order, as a written table.

    ``ranges`` deals the rows out and must not contradict ``order`` (a prefix of it, or prefixes of its texts)."""
    sorted_rows = rows.repartitionByRange(*ranges).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()  # the partition's number, then the row's number in it
    numbered = sorted_rows.select(*keep, at.alias("_at"))
    return written(numbered, kind).withColumn("_part", F.shiftright("_at", 33))


def runs_of(numbered: DataFrame, key: str) -> DataFrame:
    """A row per (key, range): where the run starts, the key's rows in earlier ranges (``_before``) and in all (``_total``).

    A key has at most as many runs as there are ranges."""
    runs = numbered.groupBy(key, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    return runs.select(key, "_part", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(W.partitionBy(key)).alias("_total"))


def placed(numbered: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """Rows with ``_pos``, their number (from 0) within their key. Joined by (key, range), so a hot key stays dealt out."""
    return numbered.join(runs, [key, "_part"]).withColumn("_pos", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_first", "_before", "_part")
