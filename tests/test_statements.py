"""States of lines against a plain reader of characters, calls over lines, and needles against their patterns."""

import random
import re

import pytest
from pyspark.sql import functions as F

from vulnlake.operators import lexing as L
from vulnlake.operators import needles as N
from vulnlake.operators import scan as X
from vulnlake.plans.corpus import POOL
from vulnlake.rules import patterns as P
from vulnlake.rules import sinks as K

LINES = "project string, path string, line int, text string"


def plain_states(lines):
    """State that each line starts in, read character by character."""
    out, state = [], 0
    for text in lines:
        out.append(state)
        i = 0
        while i < len(text):
            two = text[i : i + 2]
            if state == 0:
                if two == "//" or (text[i] == "#" and two != "#["):
                    break
                if two == "/*":
                    state, i = 3, i + 1
                elif text[i] in "'\"":
                    state = 1 if text[i] == "'" else 2
            elif state == 3:
                if two == "*/":
                    state, i = 0, i + 1
            elif text[i] == "\\":
                i += 1
            elif text[i] == ("'" if state == 1 else '"'):
                state = 0
            i += 1
    return out


@pytest.mark.parametrize("chunk,blocks", [(7, 10), (2, 1), (1, 3)])
def test_states_equal_plain_reader(spark, monkeypatch, chunk, blocks):
    monkeypatch.setattr(L, "CHUNK", chunk)
    monkeypatch.setattr(L, "BLOCKS", blocks)
    rng, bits = random.Random(chunk), ["'", '"', "/*", "*/", "//", "#", "#[", "\\", "a", " ", "(", ")", "it's", "\\'", '\\"', "*", "/"]
    files = {f"f{k}": ["".join(rng.choice(bits) for _ in range(rng.randrange(9))) for _ in range(rng.choice([1, 3, 40, 300]))] for k in range(12)}
    rows = [("p", path, i, text) for path, lines in files.items() for i, text in enumerate(lines, 1)]
    got = {(r.path, r.line): (r.lex_in, r.lex_out) for r in L.code_lines(spark.createDataFrame(rows, LINES)).collect()}
    for path, lines in files.items():
        want = plain_states([*lines, ""])
        assert [got[path, i + 1] for i in range(len(lines))] == list(zip(want, want[1:])), path


def scan(spark, *files):
    src = spark.createDataFrame([("p", f"{i}.php", f) for i, f in enumerate(files)], "project string, path string, content string")
    return X.scan_calls(X.explode_lines(src))


MULTI = """<?php
function run($d, $p) {
    $out = system(
        $_GET['c'] // exec($no)
    );
    file_put_contents($p,
        serialize([$d, f(g(h(i(j($a)))))]),
        LOCK_EX);
    file_put_contents($p,
        $d
    );
    $c = openssl_encrypt($d,
        'aes-128-ecb', /* a, b
        md5($hidden) */ $key);
    $h = sha1(
        $user_password
    );
    $model
        ->fill(
            $request->all()
        );
    $wpdb
        ->query("select 'system(1)'
            from exec(2) where a = " . $x);
    passthru(
        'ls'
    );
    libxml_disable_entity_loader(
        true
    );
}
"""


def test_calls_over_lines(spark):
    hits = scan(spark, MULTI).collect()
    got = {(r.line, r.function) for r in hits}
    by = {(r.line, r.function): r for r in hits}
    assert {(3, "system"), (6, "file_put_contents"), (9, "file_put_contents() without LOCK_EX"), (12, "openssl_encrypt() with ECB mode"), (15, "sha1() on password variable"),
            (19, "->fill($request->all())"), (23, "$wpdb->query()"), (25, "passthru")} <= got
    assert not {f for _, f in got} & {"exec", "md5", "libxml_disable_entity_loader"} and (6, "file_put_contents() without LOCK_EX") not in got
    assert by[3, "system"].args == ["$_GET['c']"] and by[3, "system"].in_function == "run"
    assert by[6, "file_put_contents"].args == ["$p", "serialize([$d, f(g(h(i(j($a)))))])", "LOCK_EX"]
    assert by[23, "$wpdb->query()"].arg_safety == ["suspicious"]
    traceable = {(r.line, r.function) for r in X.traceable(scan(spark, MULTI)).collect()}
    assert (3, "system") in traceable and (25, "passthru") not in traceable


def test_unclosed_parenthesis_ends_at_the_next_definition(spark):
    text = "<?php\nfunction a() {\n$x = foo(\n$y;\n}\npublic static function b() {\nsystem($z);\n}\n"
    hits = {(r.line, r.function): r for r in scan(spark, text).collect()}
    assert hits[7, "system"].args == ["$z"] and hits[7, "system"].in_function == "b"


def test_files_that_cannot_be_parsed(spark):
    files = ["<?php\nf(1);", "<?php\nf(\n1\n);", "<?php\n$x = 'a", "<?php /* a", "<?php\nf(1;", "<?php\n1);"]
    src = spark.createDataFrame([("p", str(i), f) for i, f in enumerate(files)], "project string, path string, content string")
    lines = X.explode_lines(src)
    assert sorted(r.path for r in X.unparsed(lines).collect()) == ["2", "3", "4", "5"]
    s = X.scan_summary(lines, X.scan_calls(lines)).first()
    assert (s.files, s.sinks, s.parse_errors) == (6, 0, 4)


def test_arguments_nest_to_any_depth():
    deep = "f(" * 300 + "$x" + ")" * 300
    calls = L.calls_in(f"system({deep}, [1, (2), 'a,)'], function ($a, $b) {{ return g($a, 1); }})")
    assert calls[0][1] == "system" and calls[0][3] == [deep, "[1, (2), 'a,)']", "function ($a, $b) { return g($a, 1); }"]
    assert len(calls) == 303


PATTERNS = sorted({p for rules in P.PATTERNS.values() for r in rules for p in r[1:] if p} | {rx for _, rx in K.catalogue_rows()} | {rx for _, rx in P.FRAMEWORK_USAGE})


def test_needles_lose_no_match(spark):
    rows = [("p", "a", i, t) for i, t in enumerate([*POOL, *(t.upper() for t in POOL), *MULTI.split("\n")])]
    df = spark.createDataFrame(rows, LINES)
    got = {r.line: set(r.ids) for r in df.select("line", N.matched("text", PATTERNS).alias("ids")).collect()}
    plain = df.select("line", F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(i)) for i, p in enumerate(PATTERNS)])).alias("ids"))
    assert got == {r.line: set(r.ids) for r in plain.collect()}
    assert sum(map(len, got.values())) > 100


def test_needles_spare_most_tests(spark):
    df = spark.createDataFrame([("p", "a", i, t) for i, t in enumerate(POOL)], LINES)
    n = N.tests_left(df, PATTERNS, "text").first()
    assert n["all"] == len(POOL) * len(PATTERNS) and n["tests"] * 5 < n["all"]


def test_needles_of_patterns():
    assert N.needles(r"\b(?:eval|assert)\s*\([^;]*\$") == ("assert", "eval")
    assert N.needles(r"a|bcd") == () and N.needles(r"x*") == () and N.needles(r"(?i)SameSite") == ("samesite",)
    assert N.needles(r"foo(?:bar)?baz[rR]aw") in {("foo",), ("baz",)} and N.needles(r"\p{L}+abc") == ()


def test_one_projection_tries_all_patterns(spark):
    """All rules of all scopes read the lines once: one matched array, one combined aggregation below it."""
    df = X.scopes(X.code_lines(spark.createDataFrame([("p", "a", 1, "f(1);")], LINES)))
    plan = X.family_hits(df)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Generate explode\(transform", plan)) == 1
