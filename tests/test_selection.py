"""Order statistics against sorted lists."""

import math
import random
import statistics
from collections import defaultdict

from pyspark.sql import functions as F

from vulnlake.operators import selection as S


def test_medians_of_awkward_values(spark):
    rng = random.Random(4)
    groups = {"one": [3.5], "two": [1.0, 2.0], "same": [7.0] * 30, "wide": [10.0 ** rng.randrange(-300, 300) * rng.choice([-1, 1]) for _ in range(201)],
              "ties": [float(rng.randrange(3)) for _ in range(100)], "ends": [-math.inf, -1.0, 0.0, 5.0, math.inf], "near": [1.0 + i * 2**-52 for i in range(40)], "plain": [rng.gauss(0, 1) for _ in range(500)]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("plain", None), ("plain", math.nan), ("none", None), (None, 4.0), (None, 6.0)]
    rng.shuffle(rows)
    got = {r["k"]: (r["samples"], r["median"]) for r in S.medians(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert {k: (len(vs), statistics.median(vs)) for k, vs in groups.items()} == {k: v for k, v in got.items() if k is not None} and "none" not in got


def test_wanted_ranks(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.randrange(1000) / 7) for _ in range(3000)]
    by = defaultdict(list)
    for k, v in rows:
        by[k].append(v)
    wanted = [(k, r) for k in by for r in (0, 1, 17, len(by[k]) // 3, len(by[k]) - 1)]
    got = S.order_statistics(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", spark.createDataFrame(wanted, "k string, rank long"))
    assert {(r["k"], r["rank"]): r["v"] for r in got.collect()} == {(k, r): sorted(by[k])[r] for k, r in wanted}


def test_one_key_with_millions_of_values(spark):
    """No stage above the count sees more than the buckets of a key; the result is that of a sort."""
    n = 3_000_001
    df = spark.range(0, n, 1, 8).select(F.lit("k").alias("k"), F.pow((F.col("id") * 7919 % n).cast("double") / n, 3).alias("v"))
    r = S.medians(df, ["k"], "v").first()
    assert r["samples"] == n and r["median"] == ((n // 2) / n) ** 3
