"""Ordered analytics that stay balanced when one key holds most of the rows.

A plain window sends a whole key to one task. ``running`` uses it only while
every key fits a task; rows of larger keys go through a two-level scan: range
partition by (key, order), scan inside each range, then add what the earlier
ranges of the same key contributed. Running sum, min, max and "last value" are
enough to express ranks, lags, streaks and carried state exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vulnlake.session import durable

# Rows of one key that a single task may sort; read at call time.
HOT_KEY_ROWS = 2_000_000

Spec = tuple[str, str | Column]


def _fold(kind: str, col: Column) -> Column:
    if kind == "sum":
        return F.sum(col)
    if kind == "min":
        return F.min(col)
    if kind == "max":
        return F.max(col)
    raise ValueError(f"running supports sum, min and max, not {kind}")


def _merge(kind: str, carried: Column, local: Column) -> Column:
    if kind == "sum":
        return F.when(carried.isNull(), local).when(local.isNull(), carried).otherwise(carried + local)
    if kind == "min":
        return F.when(carried.isNull() | (local < carried), local).otherwise(carried)
    return F.when(carried.isNull() | (local > carried), local).otherwise(carried)


def _order(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> DataFrame | None:
    """Keys with more than ``limit`` rows (at most rows/limit exist), or None when there are none.

    Only the key columns are read; counting combines on the map side."""
    limit = HOT_KEY_ROWS if limit is None else limit
    hot = _over_limit(df, keys, limit)
    return None if hot.isEmpty() else durable(hot)


def _over_limit(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > limit).drop("_rows")


def _same_keys(left: str, right: str, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    specs: dict[str, Spec],
    inclusive: bool = True,
    limit: int | None = None,
    hot: DataFrame | None | bool = True,
) -> DataFrame:
    """Add running aggregates per key in a total order.

    ``specs`` maps a new column to (kind, expression), kind in sum/min/max.
    With ``inclusive=False`` the current row is left out. ``hot`` passes on the
    result of ``hot_keys`` when several scans share their keys.
    """
    order_cols = _order(order)
    last = 0 if inclusive else -1
    specs = {n: (k, F.col(c) if isinstance(c, str) else c) for n, (k, c) in specs.items()}

    def local(rows: DataFrame, part_keys: Sequence[str]) -> DataFrame:
        w = Window.partitionBy(*part_keys).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, last)
        return rows.select("*", *[_fold(kind, col).over(w).alias(n) for n, (kind, col) in specs.items()])

    if hot is True:
        hot = hot_keys(df, keys, limit)
    if hot is None:
        return local(df, keys)

    # Bounded by rows/limit, so the broadcast stays small however large the input is.
    cold_rows = df.alias("r").join(F.broadcast(hot.alias("h")), _same_keys("r", "h", keys), "left_anti")
    hot_rows = df.alias("r").join(F.broadcast(hot.alias("h")), _same_keys("r", "h", keys), "left_semi")
    return local(cold_rows, keys).unionByName(_two_level(hot_rows, keys, order_cols, specs, local))


def _two_level(df, keys, order_cols, specs, local) -> DataFrame:
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order_cols)
    # Materialised once: the range of a row must not change between the two passes.
    ranged = durable(ranged.withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy(*keys, "_range").agg(
        *[_fold(kind, col).alias(f"_t_{n}") for n, (kind, col) in specs.items()]
    )
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys, "_range", *[_fold(kind, F.col(f"_t_{n}")).over(before).alias(f"_c_{n}") for n, (kind, _) in specs.items()]
    )
    scanned = local(ranged, [*keys, "_range"])
    joined = scanned.alias("s").join(
        carried.alias("c"), _same_keys("s", "c", [*keys, "_range"]), "left"
    )
    keep = [F.col(f"s.{c}") for c in df.columns]
    merged = [
        _merge(kind, F.col(f"c._c_{n}"), F.col(f"s.{n}")).alias(n) for n, (kind, _) in specs.items()
    ]
    return joined.select(*keep, *merged)


def rank_in_group(df, keys, order, name="rn", limit: int | None = None, hot=True) -> DataFrame:
    """row_number() per key, exact for keys of any size."""
    return running(df, keys, order, {name: ("sum", F.lit(1).cast("long"))}, limit=limit, hot=hot)


def previous(df, keys, order, cols: dict[str, str | Column], limit: int | None = None) -> DataFrame:
    """lag(1) of several columns per key: the newest row strictly before."""
    vals = [F.col(c).alias(f"v{i}") if isinstance(c, str) else c.alias(f"v{i}") for i, c in enumerate(cols.values())]
    hot = hot_keys(df, keys, limit)
    ranked = rank_in_group(df, keys, order, "_rn", hot=hot)
    with_prev = running(ranked, keys, ["_rn"], {"_prev": ("max", F.struct(F.col("_rn"), *vals))}, inclusive=False, hot=hot)
    out = with_prev.select("*", *[F.col(f"_prev.v{i}").alias(n) for i, n in enumerate(cols)])
    return out.drop("_rn", "_prev")


def failure_streak(df, keys, order, failed: Column, limit: int | None = None) -> DataFrame:
    """Add ``rn`` and ``streak`` (consecutive failures ending at this row)."""
    hot = hot_keys(df, keys, limit)
    ranked = rank_in_group(df, keys, order, "rn", hot=hot).withColumn("_failed", failed)
    scanned = running(ranked, keys, ["rn"], {"_ok": ("max", F.when(~F.col("_failed"), F.col("rn")))}, hot=hot)
    return scanned.withColumn("streak", F.col("rn") - F.coalesce("_ok", F.lit(0))).drop("_failed", "_ok")


def top_k(df, keys, order, k: int, name: str | None = None) -> DataFrame:
    """First k rows per key. Catalyst limits each group before the shuffle
    (WindowGroupLimit), so a hot key sends at most k rows per map task."""
    w = Window.partitionBy(*keys).orderBy(*_order(order))
    ranked = df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k)
    return ranked.withColumnRenamed("_k", name) if name else ranked.drop("_k")


def dealt(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """Rows dealt by ``keys`` over all of ``spark.sql.shuffle.partitions``.

    Adaptive execution merges the partitions that an aggregation reads down to one per core, so with nearly as many groups
    as rows the hash table of a task grows with the input; partitions of a given number are kept. An aggregation by these
    keys needs no further shuffle."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def spread_join(rows: DataFrame, lookup: DataFrame, key: str, parts: int = 16) -> DataFrame:
    """Join rows to a table with one row per key, each hot key dealt over ``parts`` tasks.

    An aggregation by the key that follows has to shuffle again and combines before that, so a hot key's rows never
    meet in one task. The part is a hash of the row, so a task that runs again deals its rows alike. Hot is a key with
    more than ``HOT_KEY_ROWS`` rows or a large share of all, so there are few: only their rows of the lookup are repeated,
    and without any it is a plain join."""
    hot = hot_keys(rows, [key], min(HOT_KEY_ROWS, rows.count() // (4 * parts)))
    if hot is None:
        return rows.join(lookup, key)
    hot = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(parts))
    every = F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))
    dealt = rows.join(hot, key, "left").withColumn("_part", F.when(F.col("_hot"), part).otherwise(F.lit(0).cast("long"))).drop("_hot")
    repeated = lookup.join(hot, key, "left").withColumn("_part", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0).cast("long"))))).drop("_hot")
    return dealt.join(repeated, [key, "_part"]).drop("_part")
