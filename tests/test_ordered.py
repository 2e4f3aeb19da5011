"""The two-level scan must equal the plain window on keys of any size."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vulnlake.operators import ordered as O


@pytest.fixture(scope="module")
def skewed(spark):
    # one key holds a third of the rows
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"),
        ((F.col("id") * 7919) % 3001).alias("t"), ((F.col("id") * 31) % 17 - 5).cast("int").alias("v"), "id")


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_matches_window(skewed, inclusive):
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    want = skewed.select("id", F.sum("v").over(w).alias("s"), F.min("v").over(w).alias("lo"), F.max("v").over(w).alias("hi"))
    got = O.running(skewed, ["k"], ["t", "id"], {"s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v")}, inclusive=inclusive, limit=100)
    assert rows(got, "id", "s", "lo", "hi") == rows(want, "id", "s", "lo", "hi")


def test_hot_keys_are_found_and_bounded(skewed):
    hot = O.hot_keys(skewed, ["k"], limit=100)
    assert [r.k for r in hot.collect()] == ["hot"]
    assert O.hot_keys(skewed, ["k"], limit=5000) is None


def test_rank_previous_streak(skewed):
    w = Window.partitionBy("k").orderBy("t", "id")
    want = skewed.select("id", F.row_number().over(w).cast("long").alias("rn"), F.lag("v").over(w).alias("p"))
    ranked = O.rank_in_group(skewed, ["k"], ["t", "id"], limit=100)
    prev = O.previous(skewed, ["k"], ["t", "id"], {"p": "v"}, limit=100)
    assert rows(ranked, "id", "rn") == rows(want, "id", "rn")
    assert rows(prev, "id", "p") == rows(want, "id", "p")
    plain = O.failure_streak(skewed, ["k"], ["t", "id"], F.col("v") > 0)
    split = O.failure_streak(skewed, ["k"], ["t", "id"], F.col("v") > 0, limit=100)
    assert rows(plain, "id", "rn", "streak") == rows(split, "id", "rn", "streak")


def test_null_keys_stay_together(spark):
    df = spark.createDataFrame([(None, i) for i in range(20)] + [("a", i) for i in range(5)], "k string, t int")
    got = O.rank_in_group(df, ["k"], ["t"], limit=10)
    assert rows(got.where("k IS NULL"), "t", "rn") == sorted([(i, i + 1) for i in range(20)], key=str)


def test_top_k_limits_before_the_shuffle(skewed):
    top = O.top_k(skewed, ["k"], ["t", "id"], 3)
    assert top.groupBy("k").count().agg(F.max("count")).first()[0] == 3
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
