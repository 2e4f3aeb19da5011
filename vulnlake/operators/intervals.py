"""Points in ranges without comparing every point of a key with every range of it.

Points and bounds of a key stand on one ordered line. A bound's place is the number of points before it, so a range is a run
of point numbers, which is cut into dyadic blocks (aligned runs of 2**level points, at most two per level). A point lies in
one block of each level, so points and ranges meet by equality of (key, level, block): every pair that comes out is a match,
and what goes in grows with points + ranges, times a logarithm. Blocks stop at ``TOP`` levels, so that a range over all
points of a hot key is dealt out by blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.operators.ordered import running
from vulnlake.session import durable

#: Level of the largest blocks: 2**TOP points.
TOP = 10


def _ceil_shift(n: Column, k: Column) -> Column:
    """n / 2**k, rounded up."""
    return F.call_function("shiftright", n + F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1, k)


def blocks(first: Column, end: Column, top: int = TOP) -> Column:
    """array<struct<level, block>> whose disjoint union is the run [first, end)."""
    node = lambda k, b: F.struct(k.alias("level"), b.alias("block"))

    def sides(k: Column) -> Column:
        lo, hi = _ceil_shift(first, k), F.call_function("shiftright", end, k)
        return F.array_compact(F.array(F.when((lo < hi) & (lo % 2 == 1), node(k, lo)), F.when((lo < hi) & (hi % 2 == 1), node(k, hi - 1))))

    last = F.lit(top)
    lo, hi = _ceil_shift(first, last), F.call_function("shiftright", end, last)
    none = F.array().cast("array<bigint>")
    whole = F.transform(F.when(lo < hi, F.sequence(lo, hi - 1)).otherwise(none), lambda b: node(last, b))
    small = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(top - 1)), sides)) if top else whole
    return F.concat(small, whole) if top else whole


def interval_join(points: DataFrame, ranges: DataFrame, keys: Sequence[str], at: str, lo: str, hi: str,
                  lo_inclusive: Column | bool = True, hi_inclusive: Column | bool = False, top: int = TOP) -> DataFrame:
    """All pairs of points and ranges of a key with lo <= at < hi (by default), with all columns of both.

    A null bound is open. Points without a value and ranges without a key match nothing."""
    flag = lambda x: x if isinstance(x, Column) else F.lit(x)
    keys = list(keys)
    p = durable(points.where(F.col(at).isNotNull()).withColumn("_id", F.monotonically_increasing_id()))
    r = durable(ranges.withColumn("_id", F.monotonically_increasing_id()).withColumn("_lo_in", flag(lo_inclusive)).withColumn("_hi_in", flag(hi_inclusive)))
    # On the line: bounds that let an equal point in stand before (lo) or behind (hi) it. Open ends need no place.
    row = lambda df, value, kind, order: df.select(*keys, F.col(value).alias("_v"), order.cast("int").alias("_o"), "_id", F.lit(kind).alias("_kind"))
    line = reduce(DataFrame.unionByName, [row(p, at, "p", F.lit(1)), row(r.where(F.col(lo).isNotNull()), lo, "l", F.when(F.col("_lo_in"), 0).otherwise(2)),
                                          row(r.where(F.col(hi).isNotNull()), hi, "h", F.when(F.col("_hi_in"), 2).otherwise(0))])
    line = durable(running(line, keys, ["_v", "_o", "_kind", "_id"], {"_n": ("sum", (F.col("_kind") == "p").cast("long"))}, inclusive=False).withColumn("_n", F.coalesce("_n", F.lit(0).cast("long"))))
    placed = line.where("_kind = 'p'").select(*keys, "_id", F.col("_n").alias("_pos"))
    found = line.where("_kind <> 'p'").groupBy(*keys, "_id").agg(F.max(F.when(F.col("_kind") == "l", F.col("_n"))).alias("_first"), F.max(F.when(F.col("_kind") == "h", F.col("_n"))).alias("_end"))
    total = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    runs = r.select(*keys, "_id").join(total, keys).join(found, [*keys, "_id"], "left")
    runs = runs.select(*keys, "_id", blocks(F.coalesce("_first", F.lit(0).cast("long")), F.coalesce("_end", "_total"), top).alias("_b"))
    nodes = durable(runs.select(*keys, F.col("_id").alias("_rid"), F.explode("_b").alias("_b")).select(*keys, "_rid", F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block")))
    used = nodes.groupBy(*keys).agg(F.collect_set("_level").alias("_levels"))  # at most TOP + 1
    spots = placed.join(used, keys).select(*keys, F.col("_id").alias("_pid"), "_pos", F.explode("_levels").alias("_level"))
    spots = spots.withColumn("_block", F.call_function("shiftright", F.col("_pos"), F.col("_level"))).drop("_pos")
    pairs = spots.join(nodes, [*keys, "_level", "_block"]).select("_pid", "_rid")
    own = [c for c in ranges.columns if c not in keys]
    left = p.withColumnRenamed("_id", "_pid").join(pairs, "_pid")
    return left.join(r.select(F.col("_id").alias("_rid"), *own), "_rid").select(*points.columns, *own)
