"""Report tables: groups, pool numbers, producers without records, edge cases."""

from vulnlake.operators import report
from vulnlake.rules.evidence import FAMILY_EVIDENCE, required

SCHEMA = "project string, file string, line int, sink_type string, verdict string, evidence map<string,string>, rounds int, max_rounds int, reachable boolean"
KIND = next(iter(FAMILY_EVIDENCE))
FULL = {p: "seen" for p in required(FAMILY_EVIDENCE[KIND])}


def rows(spark, entries):
    return spark.createDataFrame([("p", "a.php", n, KIND, v, e, r, 8, True) for n, v, e, r in entries], SCHEMA)


def test_groups(spark):
    first = next(iter(FULL))
    got = report.graded(rows(spark, [
        (1, "confirmed", FULL, 1), (2, "confirmed", {}, 1), (3, "suspected", FULL, 1), (4, "suspected", {}, 1), (5, "potential", None, 1), (6, "failed", FULL, 8),
        (7, "failed", FULL, 7), (8, None, FULL, 1), (9, "confirmed", {**FULL, first: "[未获取: timeout]"}, 1)]))
    assert {r.line: r.grp for r in got.collect()} == {1: "confirmed", 2: "suspected", 3: "suspected", 4: "pool", 5: "pool", 6: "pool", 7: "failed", 8: "none", 9: "pool"}


def test_pool_keeps_every_entry_and_counts_equal_ones(spark):
    entries = [(n % 1005, "suspected", {}, 1) for n in range(1010)]
    got = report.risk_pool(rows(spark, entries)).collect()
    assert sum(r.times for r in got) == 1010 and len({r.id for r in got}) == len(got) == 1005
    by_id = {r.id: r for r in got}
    assert by_id["RP-001"].line == 0 and by_id["RP-001"].times == 2 and by_id["RP-1005"].line == 1004 and by_id["RP-001"].next_step == "replay by hand"
    assert report.risk_pool(rows(spark, [])).collect() == []


def test_producers_without_records(spark):
    a = spark.createDataFrame([("p", "x", "failed"), ("p", "x", "executed"), ("p", "y", "odd"), ("q", None, None)], "project string, agent string, state string")
    got = {(r.project, r.agent): (r.state, r.records) for r in report.agent_matrix(a, ["x", "y"]).collect()}
    assert got == {("p", "x"): ("executed", 2), ("p", "y"): ("missing", 1), ("q", "x"): ("missing", 0), ("q", "y"): ("missing", 0)}


def test_coverage_gap(spark):
    r = spark.createDataFrame([("p", "audited"), ("p", "skipped"), ("p", "open"), ("p", None)], "project string, state string")
    assert tuple(report.route_coverage(r).first()) == ("p", 4, 1, 1, 2, 25.0)
