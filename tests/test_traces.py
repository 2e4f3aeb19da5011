"""Call stacks against a direct simulation."""

import random

from vulnlake.functions import traces as T
from vulnlake.operators import ordered


def simulate(frames):
    stack, out = [], []
    for i, (level, fn) in enumerate(frames, 1):
        while len(stack) >= level:
            stack.pop()
        stack.append(fn)
        if fn == "system":
            out.append((i, tuple(stack)))
    return out


def check(spark, traces):
    rows = [(t, n, lvl, fn) for t, frames in traces.items() for n, (lvl, fn) in enumerate(frames)]
    df = spark.createDataFrame(rows, "trace_id int, func_nr int, level int, function string")
    got = {}
    for r in T.sink_chains(df, ["func_nr"]).collect():
        got.setdefault(r.trace_id, []).append((r.rn, tuple(r.call_path)))
    for t, frames in traces.items():
        assert sorted(got.get(t, [])) == simulate(frames)


def test_stacks_equal_simulation(spark, monkeypatch):
    rnd = random.Random(1)
    traces = {t: [(rnd.randint(1, 6), rnd.choice(["a", "b", "c", "system"])) for _ in range(rnd.randint(1, 60))] for t in range(12)}
    traces[99] = [(rnd.randint(1, 9), rnd.choice(["a", "b", "system"])) for _ in range(300)]
    check(spark, traces)
    monkeypatch.setattr(ordered, "HOT_KEY_ROWS", 40)  # long traces take the split plan
    check(spark, traces)


def test_reader_rules(spark):
    lines = ["Version: 3", "File format: 1", "", "1\t1\t0\t0.1\t10\tmain\t1\t\ta.php\t3", "1\t1\t1\t0.2\t10", "2\t2\t0\t0.1\t10\tshort\t1\t", "2\t3\t0\t0.1\t10\tB->c\t0\t\tb.php"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert [(r.level, r.function, r.user_defined, r.line) for r in T.trace_frames(df).collect()] == [(1, "main", True, 3), (2, "B->c", False, 0)]
