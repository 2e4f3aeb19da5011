"""Golden rows and monotonicity of the scoring rules."""

from hypothesis import given
from hypothesis import strategies as st
import pytest
from pyspark.sql import functions as F

from vulnlake.functions import score as S
from vulnlake.functions import versions as V

# (R, I, C, score, level): the published severity examples
GOLDEN = [(3, 3, 3, 3.00, "C"), (3, 3, 2, 2.75, "C"), (2, 3, 3, 2.60, "H"), (3, 2, 2, 2.40, "H"), (2, 2, 3, 2.25, "H"), (2, 3, 1, 2.10, "H"),
          (2, 2, 2, 2.00, "M"), (2, 2, 1, 1.75, "M"), (2, 1, 2, 1.65, "M"), (2, 1, 1, 1.40, "M"), (3, 1, 3, 2.30, "H"), (3, 2, 3, 2.65, "H"), (1, 2, 2, 1.60, "M")]


def test_severity_golden(spark):
    df = spark.createDataFrame(GOLDEN, "r int, i int, c int, score double, level string")
    h = S.severity_hundredths("r", "i", "c")
    bad = df.where((h / 100 != F.col("score")) | (S.severity_level(h) != F.col("level")))
    assert bad.count() == 0


def test_cvss_known_vectors(spark):
    # public CVSS 3.1 scores: AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H = 9.8, reflected XSS S:U = 5.4, SSRF S:C without impact = 0
    df = spark.createDataFrame([("anonymous", False, "RCE", 9.8), ("anonymous", False, "XSS", 5.4), ("anonymous", False, "SSRF", 0.0), ("authenticated", False, "SQLi", 8.1)],
                               "a string, f boolean, t string, want double")
    got = df.select(S.cvss_base(S.cvss_metrics("a", F.col("f"), "t")).alias("s"), "want").collect()
    assert [r.s for r in got] == [r.want for r in got]


VERSIONS = [("6.18.30", "<6.18.35", True), ("7.4.2", "<7.4.5", True), ("1.2.1", "<2.0.0", True), ("2.5.0", "<2.7.0", True), ("6.18.35", "<6.18.35", False),
            ("v7.4.10", "<7.4.5", False), ("10.0.0", "<9.9.9", False), ("5.0.23", "5.0.0 ~ 5.0.23", True), ("5.1.0", "5.0.x", False), ("5.0.9", "5.0.x", True),
            ("2.0.0-beta1", "<2.0.0", True), ("1.9.9", "~1.2", True), ("2.0.0", "~1.2", False), ("3.0", ">=3.0.0", True)]


def test_version_ranges(spark):
    df = spark.createDataFrame(VERSIONS, "v string, rule string, want boolean")
    bad = df.withColumn("got", V.in_bounds(V.version_key("v"), V.constraint_bounds("rule"))).where("got <> want")
    assert bad.collect() == []


WHOLE = [("7.1", ">7.1", False), ("7.1.1", ">7.1", True), ("8.2", "^7.4 || ^8.0", True), ("7.3", "^7.4 || ^8.0", False), ("9.0", "^7.4||^8.0", False), ("1.5", ">=1.0 <2.0", True),
         ("2.0", ">=1.0,<2.0", False), ("0.3.5", "^0.3.1", True), ("0.4", "^0.3.1", False), ("0.0.4", "^0.0.3", False), ("1.5", "1.0 - 2.0", True), ("4", "*", True)]
ORDER = ["0.9", "1.0-dev", "1.0-alpha1", "1.0.0-beta.2", "1.0-rc1", "1.0-rc2", "v1.0.0", "1.0.0.1", "1.2.3.4.5", "1.2.3.4.6", "1.10", "2.0.0-a1", "2", "3000000000.1", "99999999999999999999"]


def test_whole_constraints(spark):
    df = spark.createDataFrame(WHOLE, "v string, rule string, want boolean")
    assert df.withColumn("got", V.satisfies(V.version_key("v"), "rule")).where("got <> want").collect() == []


def test_versions_of_any_length_in_order(spark):
    from vulnlake import register

    register(spark)
    df = spark.createDataFrame(list(enumerate(ORDER)), "i int, v string").withColumn("key", V.version_key("v")).withColumn("sql", F.expr("vl_version_key(v)"))
    rows = df.orderBy("key").collect()
    assert [r.i for r in rows] == list(range(len(ORDER))) and all(r.key == r.sql for r in rows)


def test_more_sources_never_lower_priority(spark):
    df = spark.createDataFrame([(a, t, n) for a in ("anonymous", "authenticated", "admin", "api_key", "system") for t in ("RCE", "SQLi", "XSS", "New") for n in (1, 2, 3, 4)],
                               "a string, t string, n int")
    tags = F.array().cast("array<string>")
    got = df.withColumn("p", S.final_priority(S.base_priority("a", S.danger_class("t")), F.col("n"), tags)).toPandas()
    for _, g in got.groupby(["a", "t"]):
        assert list(g.sort_values("n").p) == sorted(g.p, reverse=True)


def test_gate_never_raises_a_verdict(spark):
    rows = [(v, t, e, j) for v in S.VERDICTS for t in ("RESOLVED", "UNRESOLVED", None) for e in (True, False) for j in ("directly_exploitable", "not_exploitable")]
    df = spark.createDataFrame(rows, "v string, t string, e boolean, j string")
    g = S.gated_verdict("v", "t", F.col("e"), "j")
    assert df.where(S.rank_of(g, S.VERDICTS) < S.rank_of("v", S.VERDICTS)).count() == 0
    ok = df.where("v = 'confirmed' AND t = 'RESOLVED' AND e AND j = 'directly_exploitable'").select(g).first()[0]
    assert ok == "confirmed"


@pytest.fixture(scope="module")
def known_names(spark):
    return spark.createDataFrame([("v", "http-kernel"), ("v", "monolog"), ("v", "ab")], "vendor string, name string")


def test_near_names_equal_brute_force(spark, known_names):
    import itertools
    names = ["http-kernal", "http-kernel", "htp-kernel", "http-kernels", "xhttp-kernelx", "monologg", "mnolog", "abc", "b", "zz", "monolith", "ttp-kernell"]
    df = spark.createDataFrame([("v", n) for n in names], "vendor string, name string")

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    want = {(n, k, lev(n, k)) for n, k in itertools.product(names, ["http-kernel", "monolog", "ab"]) if 1 <= lev(n, k) <= 2}
    got = {(r.name, r.known_name, r.distance) for r in V.near_names(df, known_names).collect()}
    assert got == want


def test_near_names_with_a_common_piece(spark):
    """Thousands of names share all but five letters; only near ones meet."""
    import random
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [("v", word() + "-bundle-component") for _ in range(3000)] + [("v", ""), ("v", "a"), ("v", "ab"), ("w", "ab"), ("v", None), (None, "ab"), ("v", "é😀-bundle")]
    known = rows[::60] + [("v", "b"), ("v", "é-bundle")]
    n, k = spark.createDataFrame(rows, "vendor string, name string"), spark.createDataFrame(known, "vendor string, name string")
    pairs = n.distinct().join(k.distinct().withColumnRenamed("name", "known_name"), "vendor")
    want = pairs.withColumn("distance", F.levenshtein("name", "known_name")).where("distance BETWEEN 1 AND 2")
    got = V.near_names(n, k)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
    signatures = spark.createDataFrame([("abcd",), ("",), ("a",)], "t string").select(F.array_sort(F.array_distinct(V.left_out(F.col("t"), 2))).alias("s")).collect()
    assert [len(r.s) for r in signatures] == [11, 1, 2] and signatures[2].s == ["", "a"]


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=5))
def test_hundredths_have_no_edges(axes):
    for r, i, c in axes:
        assert abs((40 * r + 35 * i + 25 * c) / 100 - (0.40 * r + 0.35 * i + 0.25 * c)) < 1e-9


def test_cvss_base_as_sql_function(spark):
    from vulnlake import register

    register(spark)
    cases = [("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", 9.8), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N", 6.1), ("CVSS:3.1/AV:P/AC:H/PR:H/UI:R/S:U/C:N/I:N/A:N", 0.0),
             ("CVSS:3.1/AV:L/AC:L/PR:L/UI:N/S:U/C:H/I:H/A:H", 7.8), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H", 10.0), ("CVSS:3.1/AV:N/AC:L", None), ("", None), (None, None)]
    got = spark.createDataFrame(cases, "v string, want double").selectExpr("v", "want", "vl_cvss_base(v) AS got").collect()
    assert [(r.v, r.got) for r in got] == cases
