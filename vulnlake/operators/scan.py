"""Source scan: files -> lines -> calls and rule hits.

The scan is narrow up to the hits: lines are split, strings and comments are
followed over lines (``lexing``), calls are taken out of statements of one or
more lines and matched to small broadcast tables, pure patterns are one
projection in which a line meets only the patterns whose needle it holds
(``needles``). Scope (open class and function of a line) and statements need an
ordered pass per file. Names inside strings are no calls; arguments nest to any
depth.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.operators.lexing import BEGINS, BLOCK_COMMENT, DEFINITION, FILE, LINE_COMMENT, STRING, calls_of, code_lines, ending, opened, receiver, statement_lines, statements
from vulnlake.operators.needles import matched
from vulnlake.operators.ordered import hot_keys, running
from vulnlake.rules import patterns as P
from vulnlake.rules import sinks as K

EXCLUDED = r"(^|/)(vendor|node_modules|\.git)/"
CALL_NAME = r"((?:->|::|\$)?[A-Za-z_]\w*)\s*\("
INCLUDE = r"(?:^|[^\w$>])(include_once|include|require_once|require)\b[\s(]*([^;]*)"
COMPARISON = r"(?:\$\w+(?:->\w+)*|[^=!<>\s])\s*[!=]=\s*(?:\$\w+(?:->\w+)*|[^=\s])"
HIT = ["project", "path", "line", "sink_type", "function", "call_type"]


def read_sources(spark, root: str, extension: str = "php", exclude: str = EXCLUDED, max_bytes: int | None = None):
    """(sources, skipped): whole files with project = first folder.

    All files are read. With ``max_bytes``, larger ones are listed in ``skipped`` instead; that filter runs on file
    metadata, so their contents never leave disk."""
    meta = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{extension}").load(root)
    most = F.lit((1 << 63) - 1 if max_bytes is None else max_bytes)
    skipped = meta.select("path", "length").where((F.col("length") > most) & ~F.col("path").rlike(exclude))
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{extension}").text(root, wholetext=True)
    full = F.col("_metadata.file_path")
    place = re.match(r"^(?:[A-Za-z][\w+.-]*:(?://[^/]*)?)?(.*?)/*$", root).group(1)  # without scheme and authority
    before = r"^(?:[A-Za-z][\w+.-]*:(?://[^/]*)?)?/*" if place.startswith("/") else "^.*?/"  # a relative folder is resolved by the reader
    rel = F.regexp_replace(full, before + re.escape(place.strip("/")) + "/", "")
    src = text.where(~full.rlike(exclude) & (F.col("_metadata.file_size") <= most)).select(
        F.split(rel, "/")[0].alias("project"), rel.alias("path"), F.col("value").alias("content"))
    return src, skipped


def explode_lines(src: DataFrame, content: str = "content") -> DataFrame:
    """Numbered lines; no other wide column survives."""
    return src.select("project", "path", F.posexplode(F.split(content, "\r?\n")).alias("_p", "text")).select(
        "project", "path", (F.col("_p") + 1).alias("line"), "text")


def _count(text: str, ch: str) -> Column:
    return F.length(text) - F.length(F.replace(F.col(text), F.lit(ch), F.lit("")))


def scopes(lines: DataFrame, hot=True) -> DataFrame:
    """Add namespace, in_class, in_function and check_line of each line from open braces, and its statement.

    All come from three ordered scans over the same partitioning."""
    hot = hot_keys(lines, FILE) if hot is True else hot
    lines = lines.withColumn("_o", opened(F.col("code")))
    braces = _count("code", "{") - _count("code", "}")
    use = F.col("code").rlike(r"\b(?:include|require)(?:_once)?\b")
    deep = running(lines, FILE, ["line"], {"_d": ("sum", braces), "_p": ("sum", F.col("_o")), "_t": ("max", ending()), "_u": ("max", F.when(use, F.col("line")))}, inclusive=False, hot=hot)
    deep = deep.withColumn("_d", F.coalesce("_d", F.lit(0))).withColumn("_p", F.coalesce("_p", F.lit(0))).withColumn("prev", receiver("_t"))

    def named(pattern: str) -> Column:
        name = F.regexp_extract("code", pattern, 1)
        return F.when(name != "", F.struct("line", F.col("_d").alias("d"), name.alias("name")))

    check = F.col("code").rlike(r"\bif\s*\(.*\bfile_exists\s*\(")
    carried = running(deep, FILE, ["line"], {
        "_n": ("max", named(r"^\s*namespace\s+([\w\\]+)")),
        "_c": ("max", named(r"^\s*(?:abstract\s+|final\s+)*class\s+(\w+)")),
        "_f": ("max", named(r"\bfunction\s+&?(\w+)\s*\(")),
        "_b": ("max", F.when(F.col("code").rlike(BEGINS), F.struct("line", "_p"))),
        "_i": ("max", F.when(check, F.struct("line", F.col("_d").alias("d"))))}, hot=hot)
    carried = carried.withColumn("_p", F.col("_p") - F.coalesce("_b._p", F.lit(0)))
    end = F.col("_d") + braces

    def closing(c: str) -> Column:
        """Line on which the block that belongs to marker ``c`` ends."""
        own = (F.col("line") == F.col(f"{c}.line")) & F.col("code").contains("{")
        return F.when(((F.col("_d") > F.col(f"{c}.d")) | own) & (end <= F.col(f"{c}.d")), F.col("line"))

    starts = F.when(F.col("_p") <= 0, F.col("line"))
    carried = running(carried, FILE, ["line"], {f"_q{c}": ("max", closing(f"_{c}")) for c in "cfi"} | {"_s": ("max", starts)}, inclusive=False, hot=hot)

    def inside(c: str) -> Column:
        closed = F.coalesce(F.col(f"_q{c}") >= F.col(f"_{c}.line"), F.lit(False))
        return (F.col("line") == F.col(f"_{c}.line")) | ((F.col("_d") > F.col(f"_{c}.d")) & ~closed)

    in_class = F.when(inside("c"), F.col("_c.name"))
    # a method closed before the class opened does not belong to it
    in_function = F.when(inside("f") & (in_class.isNull() | (F.col("_f.line") > F.col("_c.line"))), F.col("_f.name"))
    # the first include inside the block of a file check
    checked = F.when(use & inside("i") & (F.col("_u").isNull() | (F.col("_u") < F.col("_i.line"))), F.col("_i.line"))
    carried = carried.withColumn("stmt", F.coalesce(starts, F.col("_s"), F.col("line")))
    carried = carried.withColumn("lone", (F.col("stmt") == F.col("line")) & (F.col("_p") + F.col("_o") <= 0))
    return carried.withColumn("namespace", F.col("_n.name")).withColumn("in_class", in_class).withColumn(
        "in_function", in_function).withColumn("check_line", checked).drop("_d", "_o", "_p", "_u", "_n", "_c", "_f", "_b", "_i", "_s", "_t", "_qc", "_qf", "_qi")


#: Columns of lines that a call does not keep.
OF_LINES = {"text", "code", "lex_in", "lex_out", "stmt", "lone", "prev"}


def calls(lines: DataFrame, wanted: Column | None = None, hot=True) -> DataFrame:
    """One row per call: line of its name, token, text right before it, arguments and these without nested groups.

    A call may go on over any number of lines. ``wanted`` (on the statement's ``text``) leaves out statements unread.
    ``hot`` passes on ``hot_keys`` of the source lines, which need no lexing."""
    facts = [c for c in lines.columns if c not in OF_LINES and c not in (*FILE, "line")]
    lines = lines if "stmt" in lines.columns else statement_lines(lines, hot)
    units = statements(lines, [*facts, "prev"]).where(F.col("text").contains("("))
    found = calls_of(units if wanted is None else units.where(wanted))
    at = F.element_at("lines", F.col("row") + 1)
    opens = (F.col("seq") == 0) & (F.col("row") == 0) & (F.col("before") == "") & F.col("token").rlike("^(?:->|::)")
    before = F.when(opens, F.coalesce(at["prev"], F.lit(""))).otherwise(F.col("before"))
    return found.select(*FILE, at["line"].alias("line"), *[at[c].alias(c) for c in facts], "seq", "token", before.alias("before"), "args", "outers")


def arg_safety(arg: Column, outer: Column | None = None) -> Column:
    """``outer`` is the argument without strings and nested groups; without it, groups nested twice are left out here."""
    bare = F.regexp_replace(arg, r"'[^']*'|\x22[^\x22]*\x22|\((?:[^()]|\([^()]*\))*\)", "") if outer is None else F.regexp_replace(outer, r"^\s*\.\.\.", "")
    literal = arg.rlike(r"^('[^']*'|\x22[^\x22$]*\x22|\d+(\.\d+)?)$")
    return F.when(literal, "safe").when(~arg.rlike(r"^\$\w+$") & F.regexp_replace(bare, r"\d+\.\d+", "").contains("."), "suspicious").otherwise("needs_trace")


def with_safety(hits: DataFrame) -> DataFrame:
    return hits.withColumn("arg_safety", F.zip_with("args", "outers", arg_safety))


def traceable(hits: DataFrame) -> DataFrame:
    """Hits with at least one argument that is not a literal."""
    return hits.where(F.exists("arg_safety", lambda s: s != "safe"))


def _last_name(expr: Column) -> Column:
    """Variable or property name a text ends with."""
    return F.nullif(F.regexp_extract(expr, r"(?:\$|->)(\w+)$", 1), F.lit(""))


def _any_in(text: Column, words: list[str]) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(words)), F.lit(False))


def _table_key() -> Column:
    name = F.col("token")
    return (F.when(name.startswith("->"), F.concat(F.lit("m:"), F.expr("substr(token, 3)")))
            .when(name.startswith("::"), F.concat(F.lit("s:"), F.regexp_extract("before", r"(\w+)$", 1), name))
            .when(~name.startswith("$"), F.concat(F.lit("f:"), name)))


def _table(spark, function_sinks=None, method_sinks=None, static_sinks=None) -> DataFrame:
    rows = []
    for kind, table in (("f", function_sinks or K.pairs(K.FUNCTION_SINKS)), ("m", method_sinks or K.pairs(K.METHOD_SINKS)),
                        ("s", static_sinks or K.pairs(K.STATIC_SINKS))):
        rows += [(f"{kind}:{n}", fam) for n, fam in table]
    return spark.createDataFrame(rows, "_key string, _family string")


def _table_hit(keep_safe: bool = False) -> Column:
    """The name-table hit of a call whose ``_family`` was looked up; null for none or for a safe call (unless ``keep_safe``)."""
    name = F.col("token")
    klass = F.regexp_extract("before", r"(\w+)$", 1)
    safe = (name == "libxml_disable_entity_loader") & (F.lower(F.when(F.size("args") > 0, F.col("args")[0])) == "true")
    shown = F.when(name.startswith("->"), F.concat(name, F.lit("()"))).when(name.startswith("::"), F.concat(klass, name)).otherwise(name)
    kind = F.when(name.startswith("->"), "method_call").when(name.startswith("::"), "static_call").otherwise("func_call")
    return F.when(F.col("_family").isNotNull() & (F.lit(keep_safe) | ~F.coalesce(safe, F.lit(False))),
                  F.struct(F.col("_family").alias("sink_type"), shown.alias("function"), kind.alias("call_type")))


def table_hits(call_rows: DataFrame, function_sinks=None, method_sinks=None, static_sinks=None, keep_safe: bool = False) -> DataFrame:
    """Calls found in the name tables (functions, methods, static methods); ``keep_safe`` counts calls that their arguments make safe."""
    table = _table(call_rows.sparkSession, function_sinks, method_sinks, static_sinks)
    hit = call_rows.withColumn("_key", _table_key()).join(F.broadcast(table), "_key")
    return hit.withColumn("_h", F.explode(F.array_compact(F.array(_table_hit(keep_safe))))).select(*call_rows.columns, "_h.*")


def _context_array() -> Column:
    """Further hits of a call that depend on its receiver, arguments or function."""
    t, args = F.col("token"), F.col("args")
    method = F.when(t.startswith("->"), F.expr("substr(token, 3)"))
    receiver = _last_name(F.col("before"))
    arg = lambda i: F.when(F.size(args) >= i, F.element_at(args, i))
    bulk = F.exists(args, lambda a: a.rlike(r"->all\s*\(\s*\)$"))
    mongo, redis = method.isin(K.MONGO_METHODS), method.isin(K.REDIS_METHODS)
    hit = lambda cond, fam, fn, kind: F.when(F.coalesce(cond, F.lit(False)), F.struct(
        F.lit(fam).alias("sink_type"), fn.alias("function"), F.lit(kind).alias("call_type")))
    return F.array_compact(F.array(
        hit(t.startswith("$") & ~F.col("before").rlike(r"(?:->|::)$"), "RCE", F.concat(t, F.lit("()")), "dynamic_call"),
        hit(method.isin(K.BULK_METHODS) & bulk, "MassAssignment", F.concat(t, F.lit("($request->all())")), "method_call"),
        hit(method.isin(K.WPDB_METHODS) & F.col("before").rlike(r"\$wpdb$"), "WordPress", F.concat(F.lit("$wpdb"), t, F.lit("()")), "method_call"),
        hit((mongo | redis) & _any_in(receiver, K.NOSQL_RECEIVERS), "NoSQL",
            F.concat(F.when(redis, "Redis").otherwise("MongoDB"), t, F.lit("()")), "method_call"),
        hit(t.isin("md5", "sha1") & arg(1).rlike(r"^\$[\w>-]+$") & _any_in(_last_name(arg(1)), K.PASSWORD_NAMES), "Crypto",
            F.concat(t, F.lit("() on password variable")), "crypto_weak_hash"),
        hit(t.isin("rand", "mt_rand") & _any_in(F.col("in_function"), K.SECURITY_SCOPES), "Crypto",
            F.concat(t, F.lit("() for security purpose ($"), F.coalesce("in_function", F.lit("")), F.lit(")")), "crypto_weak_random"),
        hit((t == "openssl_encrypt") & arg(2).rlike(r"(?i)^['\x22].*ecb"), "Crypto", F.lit("openssl_encrypt() with ECB mode"), "crypto_ecb"),
        hit(t.startswith("mcrypt_"), "Crypto", F.concat(t, F.lit("() (deprecated)")), "crypto_deprecated"),
        hit((t == "file_put_contents") & ~F.coalesce(arg(3).contains("LOCK_EX"), F.lit(False)), "RaceCondition",
            F.lit("file_put_contents() without LOCK_EX"), "race_condition"),
    ))


def context_hits(call_rows: DataFrame) -> DataFrame:
    return call_rows.withColumn("_h", F.explode(_context_array())).select("*", "_h.*").drop("_h")


def _line_array() -> Column:
    """Hits that are read off a line: includes, comparisons, definitions, properties."""
    c = F.col("code")
    one = lambda cond, fam, fn, kind: F.when(F.coalesce(cond, F.lit(False)), F.array(F.struct(
        F.lit(fam).alias("sink_type"), fn.alias("function"), F.lit(kind).alias("call_type"))))
    magic = F.regexp_extract(c, r"function\s+(__(?:destruct|wakeup|toString|call|get))\s*\(", 1)
    resolve = F.regexp_extract(c, r"function\s+(resolve(?:Field)?)\s*\(", 1)
    # quoted text and inner calls say nothing about how the operand is built
    bare = F.regexp_replace(c, STRING, "''")
    operand = F.regexp_extract(bare, INCLUDE, 2)
    dynamic = bare.rlike(INCLUDE) & (operand.rlike(r"^\$\w+[\s)]*$") | F.regexp_replace(operand, r"\w+\s*\([^()]*\)", "x").contains("."))
    comparisons = F.regexp_extract_all(c, F.lit(f"({COMPARISON})"), F.lit(1))
    left = r"^(\$\w+(?:->\w+)*)?"
    weak = F.filter(comparisons, lambda x: _any_in(_last_name(F.regexp_extract(x, left, 1)), K.SENSITIVE_NAMES)
                    | _any_in(_last_name(F.regexp_extract(x, r"[!=]=\s*(\$\w+(?:->\w+)*)$", 1)), K.SENSITIVE_NAMES))
    weak = F.transform(weak, lambda x: F.struct(
        F.lit("WeakComparison").alias("sink_type"),
        F.concat(F.regexp_extract(x, r"[^=!<>]\s*([!=]=)", 1), F.lit(" on sensitive var")).alias("function"), F.lit("weak_comparison").alias("call_type")))
    none = F.array().cast("array<struct<sink_type:string,function:string,call_type:string>>")
    return F.flatten(F.array(*[F.coalesce(x, none) for x in (
        one(c.rlike(r"->\$\w+\s*\("), "RCE", F.concat(F.lit("->$"), F.regexp_extract(c, r"->\$(\w+)\s*\(", 1), F.lit("()")), "dynamic_method"),
        one(dynamic, "LFI", F.regexp_extract(bare, INCLUDE, 1), "dynamic_include"),
        weak,
        one(magic != "", "Deserialization", F.concat(magic, F.lit("() definition")), "magic_method"),
        one(c.rlike(r"\$guarded\s*=\s*(?:\[\s*\]|array\s*\(\s*\))"), "MassAssignment", F.lit("$guarded = []"), "property"),
        one((resolve != "") & _any_in(F.col("in_class"), K.GRAPHQL_CLASSES), "GraphQL", F.concat(resolve, F.lit("() in "), F.col("in_class")), "graphql_resolve"),
        one(c.rlike(r"['\x22]resolve['\x22]\s*=>\s*(?:static\s+)?(?:function|fn)\b"), "GraphQL", F.lit("'resolve' => closure (GraphQL field resolver)"), "graphql_resolve"),
        one(F.col("check_line").isNotNull(), "RaceCondition", F.lit("file_exists() + include/require (TOCTOU)"), "race_condition"),
    )]))


def line_hits(lines: DataFrame) -> DataFrame:
    h = lines.withColumn("_h", F.explode(_line_array())).select("*", "_h.*").drop("_h")
    return h.withColumn("line", F.when(F.col("call_type") == "race_condition", F.col("check_line")).otherwise(F.col("line")))


def check_then_include(scoped: DataFrame) -> DataFrame:
    """``if (file_exists(..)) { .. include .. }``: the include lies inside the block of the check."""
    return line_hits(scoped).where(F.col("call_type") == "race_condition")


def known_names() -> Column:
    """Whether a statement calls anything that a table or a context rule asks for."""
    known = sorted({n for t in (K.FUNCTION_SINKS, K.METHOD_SINKS) for n, _ in K.pairs(t)} | {n.split("::")[1] for n, _ in K.pairs(K.STATIC_SINKS)}
                   | set(K.BULK_METHODS + K.WPDB_METHODS + K.MONGO_METHODS + K.REDIS_METHODS))
    tokens = F.regexp_extract_all("text", F.lit(r"(\$?[A-Za-z_]\w*)\s*\("), F.lit(1))
    return F.exists(tokens, lambda n: n.isin(known) | n.startswith("$") | n.startswith("mcrypt_"))


def scan_calls(lines: DataFrame) -> DataFrame:
    """All hits of the base scan with scope, arguments and argument safety.

    Lines give their own hits; statements give calls, which are looked up in the broadcast name table and in the rules
    that depend on receiver, arguments or function. Both read the same ordered lines."""
    keep = ["project", "path", "line", "in_function", "in_class", "namespace"]
    scoped = scopes(code_lines(lines), hot_keys(lines, FILE)).where(F.col("code") != "").drop("text")
    none = F.array().cast("array<string>")
    own = line_hits(scoped).select(*keep, none.alias("args"), none.alias("outers"), "sink_type", "function", "call_type")
    rows = calls(scoped.drop("check_line"), known_names()).withColumn("_key", _table_key())
    looked = rows.join(F.broadcast(_table(lines.sparkSession)), "_key", "left")
    hits = F.concat(F.array_compact(F.array(_table_hit())), _context_array())
    called = looked.withColumn("_h", F.explode(hits)).select(*keep, "args", "outers", "_h.*")
    return with_safety(own.unionByName(called)).select(*HIT, "args", "arg_safety", "in_function", "in_class", "namespace")


def unparsed(lines: DataFrame) -> DataFrame:
    """project, path of the files that end inside a string, a comment or a parenthesis, or close more than they open."""
    rows = code_lines(lines).withColumn("_o", opened(F.col("code")))
    ends = rows.groupBy(*FILE).agg(F.max(F.struct("line", "lex_out")).alias("end"), F.sum("_o").alias("open"))
    return ends.where((F.col("end.lex_out") != 0) | (F.col("open") != 0)).select(*FILE)


def scan_summary(lines: DataFrame, hits: DataFrame) -> DataFrame:
    files = lines.groupBy("project").agg(F.countDistinct("path").alias("files"))
    errors = unparsed(lines).groupBy("project").agg(F.count(F.lit(1)).alias("parse_errors"))
    sinks = hits.groupBy("project").agg(F.count(F.lit(1)).alias("sinks"))
    return files.join(sinks, "project", "left").join(errors, "project", "left").fillna(0, ["sinks", "parse_errors"])


# --- pattern rules -------------------------------------------------------------------------

def pattern_hits(lines: DataFrame, rules: list[tuple[str, str]], text: str = "code") -> DataFrame:
    """(rule id, pattern) pairs evaluated in one projection; one row per line and rule that matches."""
    names = F.array(*[F.lit(rid) for rid, _ in rules])
    ids = F.transform(matched(text, [rx for _, rx in rules]), lambda i: F.get(names, i))
    return lines.select(*[c for c in lines.columns if c not in OF_LINES], F.explode(ids).alias("rule"))


def line_rules(families=None) -> list[tuple[str, str]]:
    return [(f"{fam}-{n}", r[1]) for fam, rs in P.PATTERNS.items() if families is None or fam in families
            for n, r in enumerate(rs, 1) if r[0] == "line"]


def scope_rules(scope: str, families=None) -> list[tuple[str, str, str | None, str | None]]:
    return [(f"{fam}-{n}", *r[1:]) for fam, rs in P.PATTERNS.items() if families is None or fam in families
            for n, r in enumerate(rs, 1) if r[0] == scope]


#: What a rule holds of: its columns; the others are null.
SCOPES = {"line": ["project", "path", "line"], "function": ["project", "path", "in_function"], "file": ["project", "path"], "project": ["project"]}


def rule_hits(lines: DataFrame, rules: list[tuple[str, str, str, str | None, str | None]]) -> DataFrame:
    """scope, project, path, in_function, line, rule of rules (scope, id, first, then, never).

    Every distinct pattern is tried once per line. A hit counts for each scope that asks for its pattern; per scope and
    pattern only the first and last line are kept, combined before the shuffle, and rules are decided on these."""
    patterns = sorted({p for r in rules for p in r[2:] if p})
    number = {p: i for i, p in enumerate(patterns)}
    asked = [[s for s in SCOPES if any(r[0] == s and p in r[2:] for r in rules)] for p in patterns]
    wanted = F.array(*[F.array(*[F.lit(s) for s in scopes]) for scopes in asked])
    keys = [c for c in ("project", "path", "line", "in_function") if c in lines.columns]
    hits = lines.where(F.col("code") != "").select(*keys, F.explode(matched("code", patterns)).alias("id"))
    hits = hits.select(*keys, "id", F.explode(F.get(wanted, F.col("id"))).alias("scope"))
    if "in_function" in keys:
        hits = hits.where((F.col("scope") != "function") | F.col("in_function").isNotNull())
    of = lambda c, kind: F.when(F.col("scope").isin([s for s, own in SCOPES.items() if c in own]), F.col(c) if c in keys else F.lit(None)).cast(kind).alias(c if c != "line" else "at")
    place = F.when(F.col("scope") == "project", F.lit(1)).otherwise(F.col("line"))
    group = ["scope", "project", "path", "in_function", "at"]
    each = hits.select("scope", "project", of("path", "string"), of("in_function", "string"), of("line", "int"), "id", place.alias("place"))
    each = each.groupBy(*group, "id").agg(F.min("place").alias("a"), F.max("place").alias("b"))
    held = each.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("id", F.struct("a", "b")))).alias("m"))

    def rows(scope: str) -> Column:
        own = [F.struct(F.lit(rid).alias("rule"), *[F.lit(number.get(p)).cast("int").alias(n) for n, p in zip(("first", "then", "never"), ps)]) for s, rid, *ps in rules if s == scope]
        return F.array(*own) if own else F.array().cast("array<struct<rule:string,first:int,then:int,never:int>>")

    def holds(r: Column) -> Column:
        first, then, never = (F.try_element_at("m", r[n]) for n in ("first", "then", "never"))
        return first.isNotNull() & (r["then"].isNull() | F.coalesce(then["b"] >= first["a"], F.lit(False))) & (r["never"].isNull() | never.isNull())

    found = F.lit(None)
    for scope in SCOPES:
        found = F.when(F.col("scope") == scope, F.transform(F.filter(rows(scope), holds), lambda r: F.struct(r["rule"].alias("rule"), F.try_element_at("m", r["first"])["a"].alias("line")))).otherwise(found)
    out = held.select("scope", "project", "path", "in_function", F.explode(found).alias("_h")).select("scope", "project", "path", "in_function", "_h.*")
    return out.withColumn("line", F.when(F.col("scope") != "project", F.col("line")))


def scope_hits(lines: DataFrame, scope: str, rules=None) -> DataFrame:
    """Rules over a whole function, file or project."""
    own = [(scope, *r) for r in (rules or scope_rules(scope))]
    return rule_hits(lines, own).select(*[c for c in SCOPES[scope] if c != "line"], "rule", "line")


def family_hits(lines: DataFrame, families=None) -> DataFrame:
    """Hits of the specialist families at every scope, from one pass over scoped lines: project, path, line, rule."""
    rules = [("line", rid, rx, None, None) for rid, rx in line_rules(families)]
    rules += [(scope, *r) for scope in ("function", "file", "project") for r in scope_rules(scope, families)]
    return rule_hits(lines, rules).select("project", "path", "line", "rule")


def catalogue_hits(lines: DataFrame, catalogue: list[tuple[str, str]] | None = None) -> DataFrame:
    """Hits of the extended catalogue: family, level and number of the row."""
    h = pattern_hits(lines, catalogue or K.catalogue_rows()).withColumn("_r", F.split("rule", ":"))
    return h.withColumn("family", F.get("_r", F.lit(0))).withColumn("level", F.get("_r", F.lit(1))).withColumn("row", F.get("_r", F.lit(2)).cast("int")).drop("rule", "_r")


def framework_hits(lines: DataFrame, usage=None) -> DataFrame:
    rules = [(f"{fw}:{i}", rx) for i, (fw, rx) in enumerate(usage or P.FRAMEWORK_USAGE)]
    return pattern_hits(lines, rules).withColumn("framework", F.split("rule", ":")[0])
