"""The k best simple paths per project without listing every simple path.

Three passes over the edges, each of ``steps`` rounds:

1. Backwards: for every node, number of nodes still to come and weakest status among them, the best that any walk to a goal
   can add. Walks may repeat nodes, so this is a bound from above, and it is the same size for every fan-in.
2. Forwards: per (end, weakest status) of each length only the first simple paths in the order of the result are carried.
   What reaches a goal gives each project a score that its k-th best path has at least.
3. Forwards again, exactly: a partial path goes on only where, by the bound, it can still come before that path. Equal
   scores are told apart by the path's key, in the bound as well, so a hub with many equal paths is no list of them all.

The result equals the first k of a full listing. Points, length bonus and confidence are those of ``graph.path_score``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.operators.ordered import top_k
from vulnlake.rules import correlation as R
from vulnlake.session import durable

#: Weakest status of a path by rank; what is neither confirmed nor suspected nor potential counts as confirmed.
RANKS = ["confirmed", "suspected", "potential"]
#: Partial paths per (end, weakest status) that the second pass carries, times k.
SPARE = 4


def _pick(value: Column, table: dict, default) -> Column:
    out = F.lit(default)
    for key, x in table.items():
        out = F.when(value == key, F.lit(x)).otherwise(out)
    return out


def _score(points: Column, n: Column, rank: Column) -> Column:
    return F.round(points * _pick(n, R.LENGTH_BONUS, R.LONG_BONUS) * _pick(rank, {i: R.CONFIDENCE[s] for i, s in enumerate(RANKS)}, 1.0), 2)


def _weights(nodes: DataFrame) -> DataFrame:
    rank = _pick(F.col("status"), {s: i for i, s in enumerate(RANKS)}, 0)
    return nodes.select(F.col("node_id").alias("node"), "project", _pick(F.col("status"), R.NODE_POINTS, 0).cast("long").alias("points"), rank.cast("int").alias("rank"))


def bounds(edges: DataFrame, weights: DataFrame, goals: DataFrame, steps: int) -> DataFrame:
    """node, more (nodes to come), rank, points, tail: the best that walks to a goal add, per node, number and weakest status."""
    zero = F.lit(0).cast("long")
    level = goals.select("node", F.lit(0).alias("more"), F.lit(0).alias("rank"), zero.alias("points"), F.lit("").alias("tail"))
    found = [durable(level)]
    into = edges.join(weights.select(F.col("node").alias("dst"), F.col("points").alias("p"), F.col("rank").alias("r")), "dst")
    for more in range(1, steps):
        step = into.join(found[-1].select(F.col("node").alias("dst"), "rank", "points", "tail"), "dst")
        step = step.select(F.col("src").alias("node"), F.greatest("rank", "r").alias("rank"), (-(F.col("points") + F.col("p"))).alias("minus"), F.concat(F.lit(">"), "dst", "tail").alias("tail"))
        best = step.groupBy("node", "rank").agg(F.min(F.struct("minus", "tail")).alias("b"))
        found.append(durable(best.select("node", F.lit(more).alias("more"), "rank", (-F.col("b.minus")).alias("points"), F.col("b.tail").alias("tail"))))
        if found[-1].isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def _rounds(first: DataFrame, into: DataFrame, steps: int, kept) -> DataFrame:
    """All paths (project, path, end, points, rank, key) that ``kept`` leaves, from those of one node on."""
    frontier = durable(kept(first, 1))
    found = [frontier]
    for n in range(2, steps + 1):
        step = frontier.join(into.select(F.col("src").alias("end"), "dst", "p", "r"), "end").where(~F.array_contains("path", F.col("dst")))
        step = step.select("project", F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("end"), (F.col("points") + F.col("p")).alias("points"),
                           F.greatest("rank", "r").alias("rank"), F.concat("key", F.lit(">"), "dst").alias("key"))
        frontier = durable(kept(step, n))
        if frontier.isEmpty():
            break
        found.append(frontier)
    return reduce(DataFrame.unionByName, found)


def _complete(paths: DataFrame, goals: DataFrame) -> DataFrame:
    done = paths.join(goals.select(F.col("node").alias("end")), "end", "left_semi")
    return done.select("project", F.col("key").alias("path_key"), F.size("path").alias("len"), _score(F.col("points"), F.size("path"), F.col("rank")).alias("path_score"))


def k_best_paths(nodes: DataFrame, edges: DataFrame, starts: Column, goals: Column, k: int = 3, steps: int = 4) -> DataFrame:
    """project (of the start), path_key, len, path_score, place of the k best simple paths of up to ``steps`` nodes."""
    weights = durable(_weights(nodes))
    e = durable(edges.select(F.col("source_node").alias("src"), F.col("target_node").alias("dst")).where("src <> dst").distinct())
    goal = durable(nodes.where(goals).select(F.col("node_id").alias("node")).distinct())
    bound = bounds(e, weights, goal, steps)
    alive = durable(bound.groupBy("node").agg(F.min("more").alias("least")))
    into = durable(e.join(weights.select(F.col("node").alias("dst"), F.col("points").alias("p"), F.col("rank").alias("r")), "dst").join(alive.select(F.col("node").alias("dst"), "least"), "dst"))
    first = nodes.where(starts).select(F.col("node_id").alias("node")).join(weights, "node").join(alive, "node", "left_semi")
    first = durable(first.select("project", F.array("node").alias("path"), F.col("node").alias("end"), "points", "rank", F.col("node").alias("key")))
    order = [F.col("points").desc(), F.col("key")]
    some = _rounds(first, into, steps, lambda df, n: top_k(df, ["end", "rank"], order, k * SPARE))
    floor = top_k(_complete(some, goal), ["project"], [F.col("path_score").desc(), "path_key"], k, "place").where(F.col("place") == k)
    floor = durable(floor.select("project", F.col("path_score").alias("least_score"), F.col("path_key").alias("last_key")))
    adds = durable(bound.groupBy("node").agg(F.collect_list(F.struct("more", F.col("rank").alias("r"), F.col("points").alias("p"), "tail")).alias("adds")).withColumnRenamed("node", "end"))  # at most 3 * steps

    def can_win(df: DataFrame, n: int) -> DataFrame:
        score = lambda x: _score(F.col("points") + x["p"], x["more"] + n, F.greatest("rank", x["r"]))
        before = lambda x: (score(x) > F.col("least_score")) | ((score(x) == F.col("least_score")) & (F.concat("key", x["tail"]) <= F.col("last_key")))
        may = F.exists("adds", lambda x: (x["more"] + n <= steps) & (F.col("least_score").isNull() | before(x)))
        return df.join(adds, "end").join(floor, "project", "left").where(may).select(*df.columns)

    return top_k(_complete(_rounds(first, into, steps, can_win), goal), ["project"], [F.col("path_score").desc(), "path_key"], k, "place")
