"""Interval joins and k best paths against full listings."""

import random
import re

import pytest
from pyspark.sql import functions as F

from vulnlake.functions import versions as V
from vulnlake.operators import graph as G
from vulnlake.operators.intervals import blocks, interval_join
from vulnlake.operators.paths import k_best_paths
from vulnlake.operators.windows import top_paths


@pytest.mark.parametrize("top", [0, 1, 10])
def test_blocks_are_a_disjoint_union(spark, top):
    cases = [(a, b) for a in range(0, 23) for b in range(0, 23)]
    df = spark.createDataFrame(cases, "a long, b long").withColumn("got", blocks(F.col("a"), F.col("b"), top))
    for r in df.collect():
        points = [p for x in r["got"] for p in range(x["block"] << x["level"], (x["block"] + 1) << x["level"])]
        assert sorted(points) == list(range(r["a"], r["b"])), r


@pytest.mark.parametrize("top", [1, 10])
def test_interval_join_equals_condition(spark, top):
    rng = random.Random(top)
    value = lambda: rng.choice([None, *range(40)]) if rng.random() < 0.1 else rng.randrange(40)
    points = spark.createDataFrame([(rng.choice("abc"), value(), i) for i in range(200)], "k string, at int, pid int")
    ranges = spark.createDataFrame([(rng.choice("abcd"), value(), value(), rng.random() < 0.5, rng.random() < 0.5, i) for i in range(120)] * 2, "k string, lo int, hi int, li boolean, hi_in boolean, rid int")
    got = interval_join(points, ranges, ["k"], "at", "lo", "hi", F.col("li"), F.col("hi_in"), top=top).select("pid", "rid")
    low = F.col("lo").isNull() | F.when(F.col("li"), F.col("at") >= F.col("lo")).otherwise(F.col("at") > F.col("lo"))
    high = F.col("hi").isNull() | F.when(F.col("hi_in"), F.col("at") <= F.col("hi")).otherwise(F.col("at") < F.col("hi"))
    want = points.where("at IS NOT NULL").join(ranges, "k").where(low & high).select("pid", "rid")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 1000


def test_advisories_of_one_package_with_many_of_each(spark):
    """10,000 versions and 10,000 advisories of a package: equal rows, and no condition inside a join."""
    n = 10_000
    packages = spark.range(n).select(F.lit("p").alias("project"), F.lit("v/lib").alias("package"), F.concat_ws(".", F.floor(F.col("id") / 100), F.col("id") % 100).alias("version"))
    adv = spark.range(n).select(F.lit("v/lib").alias("package"), F.concat(F.lit("A"), "id").alias("vuln_id"), ((F.col("id") * 7919) % n).alias("from"), (F.col("id") % 9).alias("width"))
    key = lambda c: V.version_key(F.concat_ws(".", F.floor(c / 100).cast("string"), (c % 100).cast("string")))
    adv = adv.withColumn("lo", key(F.col("from"))).withColumn("hi", key(F.col("from") + F.col("width")))
    out = V.match_advisories(packages, adv)
    got = out.groupBy("vuln_id").agg(F.count("*").alias("n")).collect()
    want = {f"A{i}": min(i * 7919 % n + i % 9, n) - i * 7919 % n for i in range(n)}
    assert {r["vuln_id"]: r["n"] for r in got} == {a: c for a, c in want.items() if c}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join (Inner|Cross|LeftOuter), .*(<|>=|<=) ", plan) and "Cartesian" not in plan and "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_pre_releases_of_the_next_version_lie_beyond(spark):
    cases = [("2.0.0-rc1", "^1.2", False), ("2.0.0-rc1", "~1.2", False), ("2.0.0-beta", "1.*", False), ("1.9.9", "^1.2", True), ("1.3.0-beta", "^1.2", True), ("1.3.0-dev", "~1.2.3", False),
             ("1.2.9", "~1.2.3", True), ("0.3.0-alpha", "^0.2.1", False), ("0.2.9", "^0.2.1", True), ("2.0.0", "1.* || ^2.0", True), ("2.1.0-rc1", "2.0.*", False)]
    df = spark.createDataFrame(cases, "v string, rule string, want boolean")
    assert df.withColumn("got", V.satisfies(V.version_key("v"), "rule")).where("got <> want").collect() == []


def graph(spark, rng, n, degree, projects=2):
    status = ["confirmed", "suspected", "potential"]
    nodes = [(f"n{i}", f"p{i % projects}", rng.choice(status), rng.choice(["low", "high"]), rng.choice(["rce", "xss"])) for i in range(n)]
    edges = [(f"n{a}", f"n{(a + projects * rng.randrange(n // projects)) % n}") for a in range(n) for _ in range(degree)]
    return spark.createDataFrame(nodes, "node_id string, project string, status string, severity string, vuln_type string"), spark.createDataFrame(edges, "source_node string, target_node string")


@pytest.mark.parametrize("seed,n,degree,steps,k", [(1, 12, 2, 4, 3), (2, 16, 3, 6, 3), (3, 20, 2, 5, 1), (4, 8, 5, 5, 4)])
def test_k_best_equals_full_listing(spark, seed, n, degree, steps, k):
    nodes, edges = graph(spark, random.Random(seed), n, degree)
    nodes = nodes.withColumn("severity", F.col("severity"))
    got = k_best_paths(nodes, edges, F.expr("severity = 'low'"), F.expr("vuln_type = 'rce'"), k, steps)
    full = G.score_paths(G.find_paths(nodes, edges, F.expr("severity = 'low'"), F.expr("vuln_type = 'rce'"), steps), nodes)
    want = top_paths(full, k).select("project", "path_key", "path_score", "place")
    assert sorted(map(tuple, got.select("project", "path_key", "path_score", "place").collect())) == sorted(map(tuple, want.collect()))


def test_hub_with_many_equal_paths(spark):
    """20,000 edges into a hub and out of it: 10**8 paths of three nodes with one score."""
    m = 10_000
    ids = spark.range(m)
    nodes = ids.select(F.concat(F.lit("s"), "id").alias("node_id"), F.lit("low").alias("severity"), F.lit("x").alias("vuln_type")).unionByName(
        ids.select(F.concat(F.lit("g"), "id").alias("node_id"), F.lit("high").alias("severity"), F.lit("rce").alias("vuln_type"))).unionByName(
        spark.createDataFrame([("hub", "mid", "x")], "node_id string, severity string, vuln_type string"))
    nodes = nodes.withColumn("project", F.lit("p")).withColumn("status", F.lit("confirmed"))
    edges = ids.select(F.concat(F.lit("s"), "id").alias("source_node"), F.lit("hub").alias("target_node")).unionByName(ids.select(F.lit("hub").alias("source_node"), F.concat(F.lit("g"), "id").alias("target_node")))
    got = k_best_paths(nodes, edges, F.expr("severity = 'low'"), F.expr("vuln_type = 'rce'"), 3, 5)
    assert [tuple(r) for r in got.orderBy("place").select("path_key", "path_score").collect()] == [("s0>hub>g0", 60.0), ("s0>hub>g1", 60.0), ("s0>hub>g10", 60.0)]
