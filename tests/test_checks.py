"""Check compiler against plain Python, and the shape of its plan."""

import random

from vulnlake.operators.checks import run_checks, verdicts
from vulnlake.rules.checks import CHECKS, Check
from tests.test_plans import plan

RULES = [
    Check("1", "a", "must", "left", good="v > 3", pct=50, least=1),
    Check("1", "b", "warn", "left", scope="v > 1", good="k <> 'x'", pct=100),
    Check("1", "c", "item", "left", least=1, most=6),
    Check("2", "in", "must", "left", "inside", key="k", other="right", pct=100),
    Check("2", "self", "warn", "left", "outside", key="k", other="left", other_scope="v = 0", pct=60),
    Check("2", "named", "warn", "left", "inside", scope="v > 2", key="k", other="right", other_key="name", other_scope="name <> 'q'", pct=40),
    Check("2", "one", "item", "left", "unique", key="k", pct=100),
    Check("2", "kinds", "item", "right", "distinct", key="k", least=2),
    Check("cross", "w1", "warn", "left", good="v = 0", pct=100), Check("cross", "w2", "warn", "left", good="v = 1", pct=100),
    Check("cross", "w3", "warn", "left", good="v = 2", pct=100),
]


def tables(spark, left, right):
    return {"left": spark.createDataFrame(left, "project string, k string, v int"), "right": spark.createDataFrame(right, "project string, k string, name string")}


def plain(left, right):
    """(good, total, ok) of every item, row by row."""
    out = {}
    for p in {r[0] for r in left + right if r[0] is not None}:
        ls, rs = [r for r in left if r[0] == p], [r for r in right if r[0] == p]
        put = lambda item, good, total, ok: out.__setitem__((p, *item), (good, total, bool(ok)))
        g = sum(r[2] is not None and r[2] > 3 for r in ls)
        put(("1", "a"), g, len(ls), 2 * g >= len(ls) and g >= 1)
        s = [r for r in ls if r[2] is not None and r[2] > 1]
        g = sum(r[1] is not None and r[1] != "x" for r in s)
        put(("1", "b"), g, len(s), g == len(s))
        put(("1", "c"), len(ls), len(ls), 1 <= len(ls) <= 6)
        keys = {r[1] for r in ls} - {None}
        g = len(keys & {r[1] for r in rs})
        put(("2", "in"), g, len(keys), g == len(keys))
        g = len(keys - {r[1] for r in ls if r[2] == 0})
        put(("2", "self"), g, len(keys), 100 * g >= 60 * len(keys))
        wanted = {r[1] for r in ls if r[2] is not None and r[2] > 2} - {None}
        g = len(wanted & {r[2] for r in rs if r[2] not in (None, "q")})
        put(("2", "named"), g, len(wanted), 100 * g >= 40 * len(wanted))
        g = sum(1 for k in keys if sum(r[1] == k for r in ls) == 1)
        put(("2", "one"), g, len(keys), g == len(keys))
        kinds = {r[1] for r in rs} - {None}
        put(("2", "kinds"), len(kinds), len(kinds), len(kinds) >= 2)
        for n, item in enumerate(("w1", "w2", "w3")):
            g = sum(r[2] == n for r in ls)
            put(("cross", item), g, len(ls), g == len(ls))
    return out


def got(spark, left, right):
    return {(r.project, r.phase, r.item): (r.good, r.total, r.ok) for r in run_checks(tables(spark, left, right), RULES).collect()}


def test_equal_to_plain_python(spark):
    rng = random.Random(5)
    pick = lambda xs: rng.choice(xs)
    left = [(pick(["a", "b", "c", "d", None]), pick(["x", "y", "z", "q", "", None]), pick([0, 1, 2, 3, 4, 5, None])) for _ in range(60)]
    left += left[:5] + [("hot", f"k{n % 40}", n % 6) for n in range(400)]
    right = [(pick(["a", "b", "hot", "only-right"]), pick(["x", "y", "k1", None]), pick(["x", "q", "k2", None])) for _ in range(30)]
    assert got(spark, left, right) == plain(left, right)


def test_empty_inputs(spark):
    assert got(spark, [], []) == {}
    rows = got(spark, [], [("p", "x", "y")])
    assert rows[("p", "1", "a")] == (0, 0, False) and rows[("p", "2", "in")] == (0, 0, True) and rows[("p", "2", "kinds")] == (1, 1, False)


def test_parts_of_one_item_and_verdicts(spark):
    rules = [Check("2", "8", "must", "left", good="v = 1", least=1, most=2), Check("2", "8", "must", "left", "unique", key="k", pct=100)]
    t = tables(spark, [("p", "x", 1), ("p", "y", 0), ("r", "x", 1), ("r", "x", 1)], [])
    rows = {r.project: (r.good, r.total, r.ok) for r in run_checks(t, rules).collect()}
    assert rows == {"p": (3, 4, True), "r": (2, 3, False)}
    left = [("p", "x", 5), ("r", "x", 0), ("r", "x", 0)]
    v = {(r.project, r.phase): (r.hard_fails, r.warnings, r.failed, r.verdict) for r in verdicts(run_checks(tables(spark, left, []), RULES)).collect()}
    assert v[("p", "cross")] == (0, 3, "w1,w2,w3", "fail")  # three warnings are one too many
    assert v[("r", "cross")] == (0, 2, "w2,w3", "pass")
    assert v[("p", "1")] == (0, 1, "b", "pass") and v[("r", "1")] == (1, 0, "a", "fail")


def test_published_rows_are_whole():
    per_phase = {p: len({c.item for c in CHECKS if c.phase == p}) for p in {c.phase for c in CHECKS}}
    assert per_phase == {"1": 9, "2": 12, "3": 13, "4": 13, "cross": 17, "4-graph": 2, "4-all": 6, "4.5": 4, "5": 16}


def test_no_pairs_in_the_plan(spark):
    text = plan(run_checks(tables(spark, [("p", "x", 1)], [("p", "x", "y")]), RULES))
    assert "Join" not in text and "Window" not in text


def test_checks_of_one_key_share_its_rows(spark):
    from vulnlake.operators.checks import sides
    left = spark.createDataFrame([("p", "a", 1), ("p", "a", 2), ("p", None, 3), ("p", "b", None)], "project string, k string, v int")
    marks = [(0, "v > 0", "k", True), (1, "v > 1", "k", True), (2, "true", "k", False)]
    out = sides({"left": left}, "left", marks, "project")
    assert {(r.check, r.key, r.n, r.other) for r in out.collect()} == {(0, "a", 2, False), (1, "a", 1, False), (2, "a", 0, True), (2, "b", 0, True)}
    # one entry per distinct key before the shuffle, not one per check
    assert plan(out).split("Exchange")[-1].count("named_struct(") == 1
