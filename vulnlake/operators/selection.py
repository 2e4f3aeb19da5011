"""Exact order statistics of all keys at once, without holding a key's values in one place.

Each round counts the values of every key into ``BUCKETS`` ranges between the smallest and largest value that may still be the
one wanted, combined before the shuffle, and goes on inside the range that holds the wanted rank. The ends of a range are
ranges of their own, so every round leaves fewer distinct values and the search ends, whatever the distribution.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from vulnlake.session import durable

BUCKETS = 256


def _bucket(v: Column, lo: Column, hi: Column) -> Column:
    share = (v / 2 - lo / 2) / (hi / 2 - lo / 2)
    inner = F.floor(F.nanvl(share, F.lit(0.0)) * (BUCKETS - 2)).cast("int")
    return F.when(v <= lo, 0).when(v >= hi, BUCKETS - 1).otherwise(1 + F.greatest(F.lit(0), F.least(inner, F.lit(BUCKETS - 3))))


def order_statistics(values: DataFrame, keys: Sequence[str], value: str, wanted: DataFrame) -> DataFrame:
    """keys, rank, value: the value of each wanted (keys, rank), ranks from 0 in ascending order. Nulls and NaN are left out."""
    keys = list(keys)
    v = values.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    ends = v.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    open_ = durable(wanted.select(*keys, F.col("rank").cast("long")).distinct().join(ends, keys).withColumn("_left", F.col("rank")))
    done = open_.where("_lo = _hi")
    open_ = open_.where("_lo < _hi")
    order = W.partitionBy(*keys, "rank").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    while not open_.isEmpty():
        inside = v.join(open_, keys).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        counts = inside.select(*keys, "rank", "_left", "_v", _bucket(F.col("_v"), F.col("_lo"), F.col("_hi")).alias("_b"))
        counts = counts.groupBy(*keys, "rank", "_left", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0)))
        hit = counts.where((F.col("_before") <= F.col("_left")) & (F.col("_left") < F.col("_before") + F.col("_n")))
        hit = durable(hit.select(*keys, "rank", "_lo", "_hi", (F.col("_left") - F.col("_before")).alias("_left")))
        done = done.unionByName(hit.where("_lo = _hi"))
        open_ = hit.where("_lo < _hi")
    return done.select(*keys, "rank", F.col("_lo").alias(value))


def medians(values: DataFrame, keys: Sequence[str], value: str, least: int = 1) -> DataFrame:
    """keys, samples, median of every key with ``least`` values or more."""
    keys = list(keys)
    valid = values.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    sizes = durable(valid.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples")).where(F.col("samples") >= least))
    half = lambda n: F.floor(n / 2)
    wanted = sizes.select(*keys, F.explode(F.array_distinct(F.array(half(F.col("samples") - 1), half(F.col("samples"))))).alias("rank"))
    found = order_statistics(valid, keys, value, wanted)
    # The mean of one or two middle values.
    middle = found.groupBy(*keys).agg((F.min(value) / 2 + F.max(value) / 2).alias("median"))
    return sizes.join(middle, keys)


def timing_gaps(values: DataFrame, subject: Sequence[str], case: str, value: str, least: int = 50) -> DataFrame:
    """Per subject the cases with the lowest and highest median, and the difference; at least two cases with ``least`` samples."""
    m = medians(values, [*subject, case], value, least)
    g = m.groupBy(*subject).agg(F.count(F.lit(1)).alias("cases"), F.min(F.struct("median", case)).alias("lo"), F.max(F.struct("median", case)).alias("hi"))
    return g.where("cases >= 2").select(*subject, "cases", F.col(f"lo.{case}").alias("fastest"), F.col(f"hi.{case}").alias("slowest"), (F.col("hi.median") - F.col("lo.median")).alias("gap"))
