"""Source lines and the hits they must give."""

import pytest
from pyspark.sql import functions as F

from vulnlake.operators import scan as X

CASES = [
    ("$h = md5($password);", [("Crypto", "md5", "func_call"), ("Crypto", "md5() on password variable", "crypto_weak_hash")]),
    ("$h = md5($url);", [("Crypto", "md5", "func_call")]),
    ("$rows = $wpdb->query($sql);", [("SQLi", "->query()", "method_call"), ("WordPress", "$wpdb->query()", "method_call")]),
    ("$collection->find($f);", [("NoSQL", "->find()", "method_call"), ("NoSQL", "MongoDB->find()", "method_call")]),
    ("include $page;", [("LFI", "include", "dynamic_include")]),
    ("include 'a.php';", []),
    ("file_put_contents($p, $d);", [("FileWrite", "file_put_contents", "func_call"), ("RaceCondition", "file_put_contents() without LOCK_EX", "race_condition")]),
    ("file_put_contents($p, $d, LOCK_EX);", [("FileWrite", "file_put_contents", "func_call")]),
    ("if ($token == $stored)", [("WeakComparison", "== on sensitive var", "weak_comparison")]),
    ("if ($token === $stored)", []),
    ("if ($a !== $secret)", []),
    ("if ($this->token != $x)", [("WeakComparison", "!= on sensitive var", "weak_comparison")]),
    ("$x = 'call system($y) or exec(1) now';", []),
    ("$x = \"eval($y)\" . system('a(b)c');", [("RCE", "system", "func_call")]),
    ("protected $guarded = [];", [("MassAssignment", "$guarded = []", "property")]),
    ("public function __wakeup()", [("Deserialization", "__wakeup() definition", "magic_method")]),
    ("libxml_disable_entity_loader(true);", []),
    ("libxml_disable_entity_loader(false);", [("XXE", "libxml_disable_entity_loader", "func_call")]),
    ("$obj->$m($x);", [("RCE", "->$m()", "dynamic_method")]),
    ("$f($x);", [("RCE", "$f()", "dynamic_call")]),
    ("$user->fill($request->all());", [("MassAssignment", "->fill($request->all())", "method_call")]),
    ("$x = DB::raw('a' . md5(sha1($b)));", [("SQLi", "DB::raw", "static_call"), ("Crypto", "md5", "func_call"), ("Crypto", "sha1", "func_call")]),
    ("$c = mcrypt_encrypt($a);", [("Crypto", "mcrypt_encrypt", "func_call"), ("Crypto", "mcrypt_encrypt() (deprecated)", "crypto_deprecated")]),
    ("$c = openssl_encrypt($d, 'aes-128-ECB', $k);", [("Crypto", "openssl_encrypt", "func_call"), ("Crypto", "openssl_encrypt() with ECB mode", "crypto_ecb")]),
    ("if (file_exists($f)) { include $f; }", [("LFI", "include", "dynamic_include"), ("RaceCondition", "file_exists() + include/require (TOCTOU)", "race_condition")]),
    ("'resolve' => function ($r) {", [("GraphQL", "'resolve' => closure (GraphQL field resolver)", "graphql_resolve")]),
    ("$redis->eval($s);", [("NoSQL", "->eval()", "method_call"), ("NoSQL", "Redis->eval()", "method_call")]),
    ("// system($x);", []),
    ("function system($x) {", []),
]


@pytest.fixture(scope="module")
def hits(spark):
    df = spark.createDataFrame([("p", f"f{i}.php", 1, text) for i, (text, _) in enumerate(CASES)], "project string, path string, line int, text string")
    out = {}
    for r in X.scan_calls(df).collect():
        out.setdefault(r.path, []).append((r.sink_type, r.function, r.call_type))
    return out


@pytest.mark.parametrize("i", range(len(CASES)), ids=[c[0][:30] for c in CASES])
def test_line(hits, i):
    assert sorted(hits.get(f"f{i}.php", [])) == sorted(CASES[i][1])


SOURCE = """<?php
namespace App;
/* system($hidden);
   exec($hidden); */
class TokenType
{
    public function makeToken()
    {
        $n = mt_rand(1, 2);
        if (file_exists($f)) {
            $a = 1;
            require $f;
        }
        if (file_exists($g)) { $b = 2; }
        require $g;
    }
    public function resolve($root) { return system('ls'); }
}
function plain($x) {
    return rand(); # exec($x)
}
"""


def test_scopes_comments_and_blocks(spark):
    src = spark.createDataFrame([("p", "a.php", SOURCE)], "project string, path string, content string")
    got = {(r.line, r.function): r for r in X.scan_calls(X.explode_lines(src)).collect()}
    assert (3, "system") not in got and (4, "exec") not in got and (20, "exec") not in got
    weak = got[(9, "mt_rand() for security purpose ($makeToken)")]
    assert (weak.in_class, weak.in_function, weak.namespace) == ("TokenType", "makeToken", "App")
    assert (10, "file_exists() + include/require (TOCTOU)") in got
    assert (14, "file_exists() + include/require (TOCTOU)") not in got
    assert got[(17, "resolve() in TokenType")].call_type == "graphql_resolve"
    assert got[(17, "system")].arg_safety == ["safe"]
    assert got[(20, "rand")].in_function == "plain" and got[(20, "rand")].in_class is None


def test_argument_safety(spark):
    df = spark.createDataFrame([("p", "a", 1, "f('x', $v, 'a' . $b, g($c), $d[1], 3.14, -1, \"in $v\")")], "project string, path string, line int, text string")
    c = X.calls(X.code_lines(df)).where("token = 'f'").select(F.zip_with("args", "outers", X.arg_safety).alias("s"))
    assert c.first().s == ["safe", "needs_trace", "suspicious", "needs_trace", "needs_trace", "safe", "needs_trace", "needs_trace"]
    hits = X.with_safety(X.table_hits(X.calls(X.code_lines(spark.createDataFrame([("p", "a", 1, "system('ls');"), ("p", "a", 2, "system($x);")],
                                                                                 "project string, path string, line int, text string")))))
    assert [r.line for r in X.traceable(hits).collect()] == [2]


def test_parentheses_in_strings_come_back_in_arguments(spark):
    src = spark.createDataFrame([("p", "a.php", "<?php\nsystem('a(b)c', $x);")], "project string, path string, content string")
    assert [r.args for r in X.scan_calls(X.explode_lines(src)).collect()] == [["'a(b)c'", "$x"]]


def test_read_sources_skips_vendor_and_big_files(spark, tmp_path):
    root = tmp_path / "tree"
    for rel, text in {"shop/app/a.php": "<?php\nsystem($x);\n", "shop/vendor/b.php": "<?php exec($y);", "shop/app/c.txt": "no", "shop/app/big.php": "x" * 5000}.items():
        f = root / rel
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    src, skipped = X.read_sources(spark, str(root), max_bytes=1000)
    assert [tuple(r)[:2] for r in src.collect()] == [("shop", "shop/app/a.php")]
    assert [r.path.endswith("big.php") for r in skipped.collect()] == [True]
    whole, none = X.read_sources(spark, str(root))
    assert whole.count() == 2 and none.count() == 0
    assert X.scan_calls(X.explode_lines(src)).select("line", "function").collect()[0] == (2, "system")


def test_root_name_inside_the_tree(spark, tmp_path):
    f = tmp_path / "src" / "shop" / str(tmp_path).strip("/") / "src" / "a.php"
    f.parent.mkdir(parents=True)
    f.write_text("<?php")
    for root in (str(tmp_path / "src"), f"{tmp_path}/src/", f"file://{tmp_path}/src", f"file:{tmp_path}/src"):
        assert [r.path for r in X.read_sources(spark, root)[0].collect()] == [f"shop{tmp_path}/src/a.php"]


def test_scope_rules(spark):
    lines = [("p", "a", i + 1, t) for i, t in enumerate([
        "function login($r) {", "$_SESSION['user_id'] = $id;", "}", "function safe($r) {", "$_SESSION['user_id'] = $id;", "session_regenerate_id(true);", "}"])]
    df = spark.createDataFrame(lines, "project string, path string, line int, text string")
    s = X.scopes(X.code_lines(df))
    h = X.scope_hits(s, "function", X.scope_rules("function", ["session"]))
    assert {(r.in_function, r.rule) for r in h.collect()} == {("login", "session-1"), ("login", "session-8")}
