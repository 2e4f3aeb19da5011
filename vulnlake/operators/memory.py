"""Statistics over assessment memory and the shared board."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.functions.score import rank_of

IP = r"\b[0-9]{1,3}(\.[0-9]{1,3}){3}\b"
URL = r"https?://[^\s\"']+"
PATH = r"(/[A-Za-z0-9_.-]+){2,}"


def facet_stats(rows: DataFrame, won: Column, facets: dict[str, tuple[str, int | None]]) -> DataFrame:
    """Counts per facet value; a facet with a number keeps only its top groups."""
    parts = []
    for name, (col, top) in facets.items():
        g = rows.groupBy(F.col(col).cast("string").alias("value")).agg(
            F.count(F.lit(1)).alias("n"), F.count_if(won).alias("confirmed"))
        if top:
            g = g.orderBy(F.desc("n"), "value").limit(top)
        parts.append(g.select(F.lit(name).alias("facet"), "value", "n", "confirmed"))
    parts.append(rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(won).alias("confirmed")).select(
        F.lit("total").alias("facet"), F.lit("all").alias("value"), "n", "confirmed"))
    return reduce(DataFrame.unionByName, parts)


def board_stats(board: DataFrame, keys: Sequence[str]) -> DataFrame:
    return board.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.size("consumed_by") == 0).alias("unconsumed"))


def scrub(text: str | Column) -> Column:
    """Remove addresses and paths before a note is kept."""
    t = F.col(text) if isinstance(text, str) else text
    t = F.regexp_replace(t, URL, "<url>")
    t = F.regexp_replace(t, IP, "<ip>")
    return F.regexp_replace(t, PATH, "<path>")


def worth_remembering(memory: DataFrame) -> DataFrame:
    """Failures count only after three rounds; confirmed and partial always do."""
    return memory.where((F.col("status") != "failed") | (F.col("rounds_used") >= 3))


def keep_edges(edges: DataFrame) -> DataFrame:
    return edges.where(~((F.col("confidence") == "speculative") & F.col("evidence").isNull()))


def newest_first(memory: DataFrame):
    return [rank_of("status", ["confirmed", "partial", "failed"]), F.col("created_at").desc()]
