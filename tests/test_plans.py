"""Plans that must hold: hot keys are dealt again before they are gathered."""

from pyspark.sql import functions as F

from vulnlake.functions import http as H
from vulnlake.operators import behaviour as B
from vulnlake.operators import scan as X
from vulnlake.operators.ordered import spread_join
from vulnlake.plans.q_source import function_calls
from vulnlake.sources.sinks import to_sarif


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_made(df, node):
    """Output rows of the nodes of a kind in a plan that has run."""
    def walk(p):
        kind = p.getClass().getSimpleName()
        inner = [p.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [p.plan()] if kind.endswith("QueryStageExec") else [p.children().apply(i) for i in range(p.children().size())]
        return ([p.metrics().apply("numOutputRows").value()] if kind == node else []) + [n for c in inner for n in walk(c)]
    return walk(df._jdf.queryExecution().executedPlan())


def test_sarif_shards_are_dealt_by_shard(spark, tables):
    _, shards = to_sarif(tables.fx_sinks.withColumn("sink_function", F.lit("call")), shard_rows=500)
    assert "hashpartitioning(project" in plan(shards) and "shard" in plan(shards).split("hashpartitioning(project")[1].split(")")[0]


def test_spread_join_leaves_an_exchange_for_the_aggregation(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 4000, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    lookup = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = spread_join(rows, lookup, "k").groupBy("k").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
        want = rows.join(lookup, "k").groupBy("k").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
        assert "_part" in plan(got) and plan(got).count("Exchange hashpartitioning") == plan(want).count("Exchange hashpartitioning") + 1
        assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_spread_join_repeats_only_hot_keys_of_the_lookup(spark):
    rows = spark.range(6000).select(F.when(F.col("id") < 3000, 1).when(F.col("id") < 3010, None).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    lookup = spark.range(6000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w")).unionByName(spark.createDataFrame([(None, 1)], "k long, w long"))
    got, want = spread_join(rows, lookup, "k"), rows.join(lookup, "k")
    assert got.columns == want.columns and got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    even = spread_join(rows.where("v >= 3010"), lookup, "k")
    assert "Generate" not in plan(even) and even.count() == 2990
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        held = got.groupBy("k").count()
        held._jdf.queryExecution().toRdd().count()
        assert rows_made(held, "GenerateExec") == [6000 + 15]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_function_calls_are_taken_out_once(spark, tables):
    rows = [("p", "a", 1, "f("), ("p", "a", 2, "1);"), ("p", "a", 3, "g(2);"), ("p", "a", 3, "h(3);"), ("p", "b", 1, "system('x"), ("p", "b", 2, "y');"), (None, "c", 1, "k(4);")]
    lines = spark.createDataFrame(rows, "project string, path string, line int, text string")
    found = X.calls(X.code_lines(lines), hot=None)
    assert {(r.path, r.line, r.token, tuple(r.args)) for r in found.collect()} == {
        ("a", 1, "f", ("1",)), ("a", 3, "g", ("2",)), ("a", 3, "h", ("3",)), ("b", 1, "system", ("'x y'",)), ("c", 1, "k", ("4",))}
    assert plan(function_calls(tables)).count("MapInArrow") == 1


def test_safe_calls_are_kept_where_asked_for(spark):
    rows = [("p", "a", 1, "libxml_disable_entity_loader(true);"), ("p", "a", 2, "libxml_disable_entity_loader(false);"), ("p", "a", 3, "libxml_disable_entity_loader();")]
    c = X.calls(X.code_lines(spark.createDataFrame(rows, "project string, path string, line int, text string")), X.known_names(), None)
    assert [sorted(r.line for r in X.table_hits(c, keep_safe=k).collect()) for k in (False, True)] == [[2, 3], [1, 2, 3]]


def test_escapes_need_no_python(spark):
    df = spark.createDataFrame([(r"a\x3cbé中z",), (r"😀",), ("none",), (None,)], "t string").select(H.decode_escapes(F.col("t")).alias("d"))
    assert "Python" not in plan(df) and [r.d for r in df.collect()] == ["a<bé中z", "😀", "none", None]


def test_coupons_and_approvals(spark):
    uses = spark.createDataFrame([("c", "u", 1, 1, 5), ("c", "u", 2, 6, 5), ("c", "v", 3, 2, 5)], "code string, usr string, ord int, at int, until int")
    assert {(r.usr, r.issue) for r in B.coupon_misuse(uses, "code", "usr", "ord", "at", "until").collect()} == {("u", "reused_by_user"), ("u", "used_after_expiry")}
    log = spark.createDataFrame([(1, "a", "submit"), (1, "a", "approve"), (2, "a", "submit"), (2, "b", "approve")], "item int, who string, step string")
    assert [r.item for r in B.self_approval(log, "item", "who", "step", "submit", "approve").collect()] == [1]


def test_normalised_findings_are_counted_in_partitions_of_a_given_number(spark):
    from vulnlake.plans.q_findings import normalised
    from vulnlake.plans.registry import Tables
    from tests.conftest import SF_DIR
    out = normalised(Tables(spark, SF_DIR))
    assert "REPARTITION_BY_NUM" in plan(out)


def test_uses_are_counted_in_partitions_of_a_given_number(spark):
    rows = [("c", "u", o, d, 5) for o in (1, 1, 2, None) for d in (4, 6)] + [("c", "v", 1, 4, 5), ("c", None, 1, 9, 5), ("d", "v", None, 9, 5)]
    uses = spark.createDataFrame(rows, "code string, user string, ord int, at int, last int").repartition(3)
    out = B.coupon_misuse(uses, "code", "user", "ord", "at", "last")
    got = {(r.code, r.user, r.orders, r.late, r.issue) for r in out.collect()}
    assert got == {("c", "u", 2, 4, "reused_by_user"), ("c", "u", 2, 4, "used_after_expiry"), ("c", None, 1, 1, "used_after_expiry"), ("d", "v", 0, 1, "used_after_expiry")}
    # merged down to one by adaptive execution before, whatever the number of groups
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_conditions_on_code_do_not_read_the_line_again(spark):
    lines = spark.createDataFrame([("p", "a", 1, "x('a'); // b"), ("p", "a", 2, "/* c"), ("p", "a", 3, "d */ y();")], "project string, path string, line int, text string")
    rows = X.code_lines(lines)
    reads = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("lambdafunction")
    few, many = rows.select("code"), rows.where("code rlike 'x' or code rlike 'y' or code rlike 'z'").select("code")
    assert reads(many) == reads(few)
    assert sorted(r.code.strip() for r in many.collect()) == ["x('a');", "y();"]


def test_result_documents_are_read_once(spark, tables):
    from vulnlake.plans.q_links import sarif_result_documents
    assert "from_json" not in sarif_result_documents(tables)._jdf.queryExecution().optimizedPlan().toString()
