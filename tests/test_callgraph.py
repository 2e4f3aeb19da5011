"""Hidden call edges: what they are, how many, and the walk through them."""

from vulnlake.operators import callgraph as C
from vulnlake.operators import scan as X

SOURCE = """<?php
class Provider {
    public function register() {
        $this->app->bind(Wire::class, Gateway::class);
        $this->app->singleton(
            'pay', Wire::class
        );
        add_action('saved', 'on_saved', 5);
        add_action('saved', 'late');
    }
}
interface Gateway extends Root { }
class PayGateway implements Gateway {
    public function pay($x) {
        system($x);
    }
}
class Job {
    public function handle($d) {
        exec($d);
    }
}
class Trim {
    public function handle($d) {
        passthru($d);
    }
}
function on_saved($x) {
    eval($x);
}
function nobody($x) {
    system($x);
}
class Page {
    public function show() {
        $in = $_GET['q'];
        resolve(
            'pay'
        )->pay($in);
        do_action('saved', $in);
        Bus::chain([new First($in), new Job($in)]);
        $pipe->through([Trim::class, Last::class]);
    }
}
"""


def scanned(spark, text):
    src = spark.createDataFrame([("p", "a.php", text)], "project string, path string, content string")
    return C.facts(X.scopes(X.code_lines(X.explode_lines(src))))


def test_edges_and_walk(spark):
    calls, lines = scanned(spark, SOURCE)
    edges = C.hidden_edges(calls, lines)
    got = {(r.src, r.dst, r.kind, r.cost, r.seq) for r in edges.collect()}
    assert {("service:Wire", "service:Gateway", "container", 0, 0), ("service:pay", "service:Wire", "container", 0, 0), ("service:Gateway", "service:PayGateway", "implements", 0, 0),
            ("service:PayGateway", "PayGateway::pay", "method", 0, 0), ("Page::show", "service:pay", "container", 1, 0), ("hook:saved", "on_saved", "hook", 0, 5), ("hook:saved", "late", "hook", 0, 10),
            ("Page::show", "hook:saved", "hook", 1, 0), ("Page::show", "message:Job", "message", 1, 1), ("message:Job", "Job::handle", "message", 0, 0), ("Page::show", "Trim::handle", "pipeline", 1, 0)} <= got
    sinks = calls.where("token IN ('system', 'exec', 'passthru', 'eval')").select("project", C.caller().alias("node"))
    sources = lines.where(lines.code.contains("$_GET")).select("project", C.caller().alias("node"))
    walk = {r.node: (r.depth, r.stop) for r in C.hidden_walk(sinks, edges, sources).collect()}
    assert walk == {"PayGateway::pay": (1, "source_found"), "Job::handle": (1, "source_found"), "Trim::handle": (1, "source_found"), "on_saved": (1, "source_found"), "nobody": (None, "no_caller")}


def test_sites_and_registrations_are_never_paired(spark):
    n = 400
    text = "<?php\n" + "".join(f"function f{i}($x) {{ do_action('h', $x); }}\nadd_action('h', 'g{i}');\n" for i in range(n))
    calls, lines = scanned(spark, text)
    assert C.hidden_edges(calls, lines).count() == 2 * n


def test_cycles_of_bindings_end(spark):
    edges = spark.createDataFrame([("p", "a", "service:x", 1), ("p", "service:x", "service:y", 0), ("p", "service:y", "service:x", 0), ("p", "service:y", "t", 0), ("p", "t", "a", 1)], "project string, src string, dst string, cost int")
    got = {r.node: r.depth for r in C.reach(edges, spark.createDataFrame([("p", "a")], "project string, node string")).collect()}
    assert got == {"a": 0, "service:x": 1, "service:y": 1, "t": 1}
