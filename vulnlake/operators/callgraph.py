"""Call edges that the text of a call does not show: containers, interfaces, hooks, queued jobs, events, pipelines.

What binds callers and targets (a service, a hook, a message) is a node of its own: a caller has one edge to it (cost 1) and
each registration one edge from it (cost 0). Sites and registrations are never paired, however many share a name. The
closure of bindings, sub-interfaces and implementers is the walk along edges of cost 0, taken semi-naively: each round
follows only what the round before has reached.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.operators import scan as X
from vulnlake.session import durable

EDGE = ["project", "src", "dst", "kind", "cost", "seq"]
CLASS = r"^\\?(\w+)::class$"
MADE = r"(?:new\s+\\?(\w+)|\\?(\w+)::class)"
#: Call tokens by role (fixed values).
BIND = ["->bind", "->singleton", "->scoped", "bind"]
RESOLVE = ["resolve", "app", "->make", "->get", "::make"]
FIRE = ["do_action", "apply_filters"]
HOOK = ["add_action", "add_filter"]
SEND = ["dispatch", "event", "::dispatch", "->dispatch", "::chain", "::later", "::push", "::dispatchNow"]
THROUGH = ["->through", "->middleware"]
DEFAULT_PRIORITY = 10


def facts(scoped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, lines) that the edges are read from, each written once: every kind of edge reads them again."""
    lines = durable(scoped.drop("text", "check_line", "namespace"))
    return durable(X.calls(lines).select("project", "path", "line", "in_class", "in_function", "token", "before", "args")), lines


def caller() -> Column:
    return F.coalesce(F.concat("in_class", F.lit("::"), "in_function"), F.col("in_function"), F.concat(F.lit("file:"), "path"))


def _name(arg: Column, rx: str = CLASS) -> Column:
    return F.nullif(F.regexp_extract(arg, rx, 1), F.lit(""))


def _quoted(arg: Column) -> Column:
    return _name(arg, r"^['\x22]([\w./:-]+)['\x22]$")


def _made(arg: Column) -> Column:
    """Classes named in an argument, in order."""
    text = F.coalesce(arg, F.lit(""))
    return F.zip_with(F.regexp_extract_all(text, F.lit(MADE), F.lit(1)), F.regexp_extract_all(text, F.lit(MADE), F.lit(2)), lambda a, b: F.when(a != "", a).otherwise(b))


def _edges(rows: DataFrame, src: Column, dst: Column, kind: str, cost: int, seq: Column | int = 0) -> DataFrame:
    out = rows.select("project", src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), F.lit(cost).alias("cost"), (seq if isinstance(seq, Column) else F.lit(seq)).cast("int").alias("seq"))
    return out.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct()


def _hub(kind: str, name: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), name)


def heritage(lines: DataFrame) -> DataFrame:
    """project, name, parent: what a class or interface extends and implements."""
    head = r"^\s*(?:abstract\s+|final\s+|readonly\s+)*(?:class|interface)\s+(\w+)"
    rows = lines.where(F.col("code").rlike(head)).select("project", F.regexp_extract("code", head, 1).alias("name"), "code")
    parents = F.concat(F.split(F.regexp_extract("code", r"\bextends\s+([\w\\, ]+)", 1), r"\s*,\s*|\s+implements.*"), F.split(F.regexp_extract("code", r"\bimplements\s+([\w\\, ]+)", 1), r"\s*,\s*"))
    return rows.select("project", "name", F.explode(F.transform(parents, lambda p: F.regexp_extract(F.trim(p), r"(\w+)$", 1))).alias("parent")).where("parent <> ''").distinct()


def methods(lines: DataFrame) -> DataFrame:
    """project, in_class, name of all functions; those outside classes have no in_class."""
    rx = r"\bfunction\s+&?(\w+)\s*\("
    return lines.where(F.col("code").rlike(rx)).select("project", "in_class", F.regexp_extract("code", rx, 1).alias("name")).distinct()


def hidden_edges(calls: DataFrame, lines: DataFrame) -> DataFrame:
    """Edges of all kinds (columns EDGE) from calls and scoped lines."""
    arg = lambda i: F.when(F.size("args") >= i, F.element_at("args", i))
    of = lambda tokens: calls.where(F.col("token").isin(tokens))
    site = caller()
    parts = [
        _edges(of(BIND), _hub("service", F.coalesce(_name(arg(1)), _quoted(arg(1)))), _hub("service", F.coalesce(_name(arg(2)), _quoted(arg(2)))), "container", 0),
        _edges(of(RESOLVE), site, _hub("service", F.coalesce(_name(arg(1)), _quoted(arg(1)))), "container", 1),
        _edges(heritage(lines), _hub("service", F.col("parent")), _hub("service", F.col("name")), "implements", 0),
        _edges(methods(lines).where("in_class IS NOT NULL"), _hub("service", F.col("in_class")), F.concat("in_class", F.lit("::"), "name"), "method", 0),
        _edges(of(FIRE), site, _hub("hook", _quoted(arg(1))), "hook", 1),
        _edges(of(HOOK), _hub("hook", _quoted(arg(1))), _quoted(arg(2)), "hook", 0, F.coalesce(arg(3).try_cast("int"), F.lit(DEFAULT_PRIORITY))),
        _edges(of(["::listen"]), _hub("message", _name(arg(1))), F.concat(_name(arg(2)), F.lit("::handle")), "message", 0),
    ]
    sent = of(SEND).withColumn("_own", F.when(F.col("token").isin("::dispatch", "::dispatchNow") & ~F.col("before").isin("Event", "Bus", "Queue", ""), F.col("before")))
    sent = sent.withColumn("_names", F.when(F.col("_own").isNotNull(), F.array("_own")).otherwise(_made(F.when(F.col("token") == "::later", arg(2)).otherwise(arg(1)))))
    sent = sent.select("project", site.alias("site"), "token", F.posexplode("_names").alias("pos", "name"))
    parts.append(_edges(sent, F.col("site"), _hub("message", F.col("name")), "message", 1, F.col("pos")))
    works = F.when(F.col("token") == "::push", "::fire").otherwise("::handle")
    parts.append(_edges(sent, _hub("message", F.col("name")), F.concat("name", works), "message", 0))
    listens = lines.where(F.col("code").rlike(r"\w+::class\s*=>")).select("project", F.regexp_extract("code", r"(\w+)::class\s*=>", 1).alias("event"), F.posexplode(
        F.regexp_extract_all(F.regexp_extract("code", r"=>(.*)$", 1), F.lit(r"(\w+)::class"), F.lit(1))).alias("pos", "listener"))
    parts.append(_edges(listens, _hub("message", F.col("event")), F.concat("listener", F.lit("::handle")), "message", 0, F.col("pos")))
    stages = of(THROUGH).select("project", site.alias("site"), F.posexplode(_made(arg(1))).alias("pos", "name"))
    parts.append(_edges(stages, F.col("site"), F.concat("name", F.lit("::handle")), "pipeline", 1, F.col("pos")))
    return reduce(DataFrame.unionByName, parts)


def direct_edges(calls: DataFrame, lines: DataFrame) -> DataFrame:
    """Edges that calls show: functions of the project, static methods and methods of ``$this``."""
    token, site = F.col("token"), caller()
    own = calls.where(token.startswith("->") & (F.col("before") == "$this") & F.col("in_class").isNotNull())
    static = calls.where(token.startswith("::") & F.col("before").rlike(r"^\w+$"))
    known = methods(lines).where("in_class IS NULL").select("project", F.col("name").alias("token"))
    plain = calls.where(token.rlike(r"^[A-Za-z_]\w*$")).join(known, ["project", "token"])
    klass = F.when(F.col("before").isin("self", "static"), F.col("in_class")).otherwise(F.col("before"))
    return reduce(DataFrame.unionByName, [
        _edges(plain, site, token, "call", 1), _edges(static, site, F.concat(klass, token), "call", 1),
        _edges(own, site, F.concat("in_class", F.lit("::"), F.expr("substr(token, 3)")), "call", 1)])


def reach(edges: DataFrame, sources: DataFrame, limit: int | None = None) -> DataFrame:
    """(project, node, depth): least cost from any source (project, node), hubs included.

    Each round takes one step of cost 1 and then all of cost 0 that follow, reading only the newest nodes."""
    key = ["project", "node"]
    step = lambda rows, cost: edges.where(F.col("cost") == cost).select("project", F.col("src").alias("node"), F.col("dst")).join(rows, key).select("project", F.col("dst").alias("node")).distinct()

    def closed(rows: DataFrame, seen: DataFrame | None, depth: int) -> DataFrame:
        new = durable(rows if seen is None else rows.join(seen, key, "left_anti"))
        parts, known = [new], new.select(*key) if seen is None else seen.select(*key).unionByName(new.select(*key))
        while not parts[-1].isEmpty():
            more = durable(step(parts[-1], 0).join(known, key, "left_anti"))
            known = known.unionByName(more)
            parts.append(more)
        return durable(reduce(DataFrame.unionByName, parts).withColumn("depth", F.lit(depth)))

    found = front = closed(sources.select(*key).distinct(), None, 0)
    depth = 0
    while not front.isEmpty() and (limit is None or depth < limit):
        depth += 1
        front = closed(step(front.select(*key), 1), found.select(*key), depth)
        found = found.unionByName(front)
    return found


def hidden_walk(sinks: DataFrame, edges: DataFrame, sources: DataFrame, limit: int = 10) -> DataFrame:
    """Sinks (project, node) with the least number of calls from an input source, hidden edges included, and the stop reason."""
    edges = durable(edges)
    down = reach(edges, sources, limit).withColumn("_found", F.lit(True))
    entered = edges.where("cost = 1").select("project", F.col("dst").alias("node")).distinct()
    called = reach(edges.where("cost = 0"), entered, 0).select("project", "node").withColumn("_called", F.lit(True))
    j = sinks.distinct().join(down, ["project", "node"], "left").join(called, ["project", "node"], "left")
    return j.select("project", "node", "depth", F.when(F.col("_found"), "source_found").when(F.col("_called"), "not_reached").otherwise("no_caller").alias("stop"))
