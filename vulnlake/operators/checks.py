"""Check compiler: check rows become one aggregate per input and one comparison of key sets.

A check needs two numbers per project, ``good`` and ``total``. The ``share`` checks of an input are conditional counts
of a few aggregates, combined before the shuffle. Key checks mark each (project, check, key) with what either side holds;
keys meet by grouping, so no pair of rows is formed and a hot project is dealt out by its keys. A project that one
input lacks has zero rows there, which fails what asks for at least one. Null predicates count as not met, null keys
are left out, and an input without rows gives zeros.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.rules.checks import CHECKS, MOST_WARNINGS, Check

#: Share checks of one aggregate: all in one took longer than several of this size, each with its own read of the input.
TOGETHER = 12
RULE = "array<struct<check:int,phase:string,item:string,level:string,pct:int,least:int,most:int>>"


def counted(frame: DataFrame, checks: Sequence[tuple[int, Check]], by: str) -> DataFrame:
    """Good and total rows of all share checks of one input, in one aggregate."""
    n = []
    for i, c in checks:
        n += [F.expr(f"count_if(({c.scope}) AND ({c.good})) AS g{i}"), F.expr(f"count_if({c.scope}) AS t{i}")]
    rows = ", ".join(f"named_struct('check', {i}, 'good', g{i}, 'total', t{i})" for i, _ in checks)
    return frame.groupBy(by).agg(*n).selectExpr(by, f"inline(array({rows}))")


def sides(inputs: Mapping[str, DataFrame], source: str, marks: Sequence[tuple[int, str, str, bool]], by: str) -> DataFrame:
    """(project, check, key, n, other) of one input, read once for all its key checks.

    Rows are counted per distinct key expression, with one conditional count for each check that asks for it; only what is
    left of a key is repeated for its checks."""
    keys = list(dict.fromkeys(key for _, _, key, _ in marks))
    asked = {k: " OR ".join(f"s{j}" for j, m in enumerate(marks) if m[2] == k) for k in keys}
    scoped = inputs[source].select("*", *[F.expr(f"({scope}) AS s{j}") for j, (_, scope, _, _) in enumerate(marks)])
    held = ", ".join(f"named_struct('k', {n}, 'key', if({asked[key]}, CAST({key} AS STRING), NULL))" for n, key in enumerate(keys))
    rows = scoped.selectExpr(by, *[f"s{j}" for j in range(len(marks))], f"inline(filter(array({held}), e -> e.key IS NOT NULL))")
    counts = rows.groupBy(by, "k", "key").agg(*[F.count_if((F.col("k") == keys.index(key)) & F.col(f"s{j}")).alias(f"n{j}") for j, (_, _, key, _) in enumerate(marks)])
    own = ", ".join(f"named_struct('check', {i}, 'n', if({str(left).lower()}, n{j}, 0L), 'other', {str(not left).lower()}, 'rows', n{j})" for j, (i, _, _, left) in enumerate(marks))
    return counts.selectExpr(by, "key", f"inline(filter(array({own}), e -> e.rows > 0))").drop("rows")


def key_counts(inputs: Mapping[str, DataFrame], checks: Sequence[tuple[int, Check]], by: str) -> DataFrame:
    marks: dict[str, list] = {}
    for i, c in checks:
        marks.setdefault(c.source, []).append((i, c.scope, c.key, True))
        if c.other:
            marks.setdefault(c.other, []).append((i, c.other_scope, c.other_key or c.key, False))
    frames = [sides(inputs, s, m, by) for s, m in marks.items()]
    keys = reduce(DataFrame.unionByName, frames).groupBy(by, "check", "key").agg(F.sum("n").alias("n"), F.max("other").alias("other"))
    kind = F.element_at(F.from_json(F.lit(json.dumps({i: c.kind for i, c in checks})), "map<string,string>"), F.col("check").cast("string"))
    good = (F.when(kind == "inside", F.col("other")).when(kind == "outside", ~F.col("other"))
            .when(kind == "unique", F.col("n") == 1).otherwise(F.lit(True)))
    return keys.where("n > 0").groupBy(by, "check").agg(F.count_if(good).alias("good"), F.count(F.lit(1)).alias("total"))


def run_checks(inputs: Mapping[str, DataFrame], checks: Sequence[Check] = CHECKS, by: str = "project") -> DataFrame:
    """One row per (project, phase, item): its counts, level and whether it holds.

    ``inputs`` are named as in the check rows and share the column ``by``; rows without a project are left out."""
    inputs = {k: v.where(F.col(by).isNotNull()) for k, v in inputs.items()}
    numbered = list(enumerate(checks))
    frames = []
    for source in dict.fromkeys(c.source for c in checks):
        mine = [(i, c) for i, c in numbered if c.source == source and c.kind == "share"]
        frames += [counted(inputs[source], mine[n : n + TOGETHER], by) for n in range(0, len(mine), TOGETHER)]
    keyed = [(i, c) for i, c in numbered if c.kind != "share"]
    if keyed:
        frames.append(key_counts(inputs, keyed, by))
    # at most one entry per check: the list is as long as the rule table
    have = reduce(DataFrame.unionByName, frames).groupBy(by).agg(
        F.map_from_entries(F.collect_list(F.struct("check", F.struct("good", "total")))).alias("have"))
    rules = F.from_json(F.lit(json.dumps([{"check": i, **c._asdict()} for i, c in numbered])), RULE)
    none = F.struct(F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("total"))
    rows = have.select(by, "have", F.inline(rules)).withColumn("n", F.coalesce(F.try_element_at("have", F.col("check")), none))
    ok = ((F.col("n.good") * 100 >= F.col("pct") * F.col("n.total")) & (F.col("n.good") >= F.col("least"))
          & (F.col("most").isNull() | (F.col("n.good") <= F.col("most"))))
    return rows.groupBy(by, "phase", "item", "level").agg(
        F.sum("n.good").alias("good"), F.sum("n.total").alias("total"), F.min(ok).alias("ok"))


def verdicts(rows: DataFrame, by: str = "project") -> DataFrame:
    """Per project and phase: items passed, what failed, and the verdict.

    Every item outside the ``warn`` level has to pass; a phase in ``MOST_WARNINGS`` may fail that many ``warn`` items."""
    limit = F.try_element_at(F.create_map(*[F.lit(x) for kv in MOST_WARNINGS.items() for x in kv]), F.col("phase"))
    g = rows.groupBy(by, "phase").agg(
        F.count(F.lit(1)).alias("items"), F.count_if("ok").alias("passed"),
        F.count_if(~F.col("ok") & (F.col("level") != "warn")).alias("hard_fails"), F.count_if(~F.col("ok") & (F.col("level") == "warn")).alias("warnings"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("item")))), ",").alias("failed"))
    bad = (F.col("hard_fails") > 0) | F.coalesce(F.col("warnings") > limit, F.lit(False))
    return g.withColumn("verdict", F.when(bad, "fail").otherwise("pass"))
