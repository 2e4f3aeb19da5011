"""Source scan queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vulnlake.operators import scan as X
from vulnlake.plans.q_graph import values
from vulnlake.plans.registry import BODIES, query
from vulnlake.rules import patterns as P
from vulnlake.rules import sinks as K


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Tokens of a whole file: strings, comments, definitions, calls, names, line ends, single characters.
TOKEN = (r"(?s)'[^'\\]*(?:\\.[^'\\]*)*'?|\x22[^\x22\\]*(?:\\.[^\x22\\]*)*\x22?|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/|/\*.*|//[^\n]*|#[^\[\n][^\n]*|"
         r"function[ \t]+&?\w+[ \t]*\(|(?:->|::|\$)?[A-Za-z_]\w*[ \t]*\(|(?:->|::|\$)?[A-Za-z_]\w*|\n|.")
#: Reads files whole, unlike the operator: tokens of the joined text, then the code of each line from the tokens on it.
CODE_SQL = rf"""tx AS (SELECT project, path, string_agg(text, chr(10) ORDER BY line) AS t, list(line ORDER BY line) AS ls FROM fx_lines GROUP BY 1, 2),
t0 AS (SELECT project, path, ls, regexp_extract_all(t, {lit(TOKEN)}) AS ts FROM tx),
t1 AS (SELECT project, path, ls, unnest(ts) AS tok, generate_subscripts(ts, 1) AS pos FROM t0),
t2 AS (SELECT *, string_split(tok, chr(10)) AS parts, left(tok, 1) IN (chr(39), chr(34)) AS quoted, regexp_matches(tok, '^(//|/[*]|#[^\[])') AS comment,
 length(tok) > 1 AND right(tok, 1) = left(tok, 1) AS ended,
 CAST(COALESCE(sum(length(tok) - length(replace(tok, chr(10), ''))) OVER (PARTITION BY project, path ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS nl FROM t1),
tp AS (SELECT project, path, ls, pos, nl, parts, quoted, ended, left(tok, 1) AS q, unnest(range(1, len(parts) + 1)) AS i FROM t2 WHERE NOT comment AND tok <> chr(10)),
tl AS (SELECT project, path, ls[nl + i] AS line, pos, i, CASE WHEN quoted THEN (CASE WHEN i > 1 THEN q ELSE '' END) || parts[i] || (CASE WHEN i < len(parts) OR NOT ended THEN q ELSE '' END) ELSE parts[i] END AS piece FROM tp),
src AS (SELECT project, path, line, COALESCE(string_agg(piece, '' ORDER BY pos, i), '') AS code FROM fx_lines LEFT JOIN tl USING (project, path, line) GROUP BY 1, 2, 3)"""
DEPTH_SQL = r"""dp AS (SELECT *, length(code) - length(replace(code, '{', '')) - (length(code) - length(replace(code, '}', ''))) AS delta,
 COALESCE(SUM(length(code) - length(replace(code, '{', '')) - (length(code) - length(replace(code, '}', '')))) OVER (PARTITION BY project, path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS d,
 regexp_extract(code, '^\s*(?:abstract\s+|final\s+)*class\s+(\w+)', 1) AS cn, regexp_extract(code, '\bfunction\s+&?(\w+)\s*\(', 1) AS fn,
 regexp_matches(code, '\bif\s*\(.*\bfile_exists\s*\(') AS chk FROM src),
sp AS (SELECT *, max(CASE WHEN cn <> '' THEN line END) OVER q AS cl, max(CASE WHEN fn <> '' THEN line END) OVER q AS fl, max(CASE WHEN chk THEN line END) OVER q AS il FROM dp
 WINDOW q AS (PARTITION BY project, path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
sc AS (SELECT s.*, c.d AS cd, c.cn AS cname, f.d AS fd, f.fn AS fname, i.d AS idp FROM sp s LEFT JOIN dp c ON c.project = s.project AND c.path = s.path AND c.line = s.cl
 LEFT JOIN dp f ON f.project = s.project AND f.path = s.path AND f.line = s.fl LEFT JOIN dp i ON i.project = s.project AND i.path = s.path AND i.line = s.il),
qs AS (SELECT *, max(CASE WHEN (d > cd OR (line = cl AND contains(code, '{'))) AND d + delta <= cd THEN line END) OVER e AS qc,
 max(CASE WHEN (d > fd OR (line = fl AND contains(code, '{'))) AND d + delta <= fd THEN line END) OVER e AS qf,
 max(CASE WHEN (d > idp OR (line = il AND contains(code, '{'))) AND d + delta <= idp THEN line END) OVER e AS qi FROM sc
 WINDOW e AS (PARTITION BY project, path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
kl AS (SELECT *, CASE WHEN cl IS NOT NULL AND (line = cl OR (d > cd AND (qc IS NULL OR qc < cl))) THEN cname END AS in_class FROM qs),
scoped AS (SELECT project, path, line, code, d, in_class, CASE WHEN fl IS NOT NULL AND (line = fl OR (d > fd AND (qf IS NULL OR qf < fl))) AND (in_class IS NULL OR fl > cl) THEN fname END AS in_function,
 CASE WHEN il IS NOT NULL AND (line = il OR (d > idp AND (qi IS NULL OR qi < il))) THEN il END AS in_check FROM kl)"""
CALLS_SQL = rf"""t3 AS (SELECT project, path, ls[nl + 1] AS line, pos, tok, quoted, NOT quoted AND right(tok, 1) IN ('(', '[', '{{') AS opens, tok IN (')', ']', '}}') AS closes FROM t2 WHERE NOT comment),
t4 AS (SELECT *, sum(opens::INT - closes::INT) OVER (PARTITION BY project, path ORDER BY pos) AS d FROM t3),
tk AS (SELECT project, path, line, pos, d, regexp_extract(tok, {lit(X.CALL_NAME)}, 1) AS token FROM t4 WHERE opens AND right(tok, 1) = '(' AND tok <> '(' AND NOT regexp_matches(tok, '^function[ \t]+&?\w'))"""
ARG_SQL = r"""ce AS (SELECT k.*, COALESCE(c.pos, 1000000000) AS stop FROM tk k ASOF LEFT JOIN (SELECT * FROM t4 WHERE closes) c ON c.project = k.project AND c.path = k.path AND c.d = k.d - 1 AND k.pos < c.pos),
an AS (SELECT ce.project, ce.path, ce.line, ce.pos AS cpos, ce.token, t.pos, t.tok, t.quoted, t.opens, t.closes, t.d - ce.d AS r, t.tok = ',' AND t.d = ce.d AS cut,
 sum(CASE WHEN t.tok = ',' AND t.d = ce.d THEN 1 ELSE 0 END) OVER (PARTITION BY ce.project, ce.path, ce.pos ORDER BY t.pos) AS i FROM ce JOIN t4 t ON t.project = ce.project AND t.path = ce.path AND t.pos > ce.pos AND t.pos < ce.stop),
ag AS (SELECT project, path, line, cpos, token, i, trim(regexp_replace(string_agg(CASE WHEN cut THEN '' ELSE tok END, '' ORDER BY pos), '\s*\n\s*', ' ', 'g')) AS arg,
 string_agg(CASE WHEN cut THEN '' WHEN r = 0 AND quoted THEN '''''' WHEN r = 0 AND NOT closes THEN tok WHEN r = 1 AND opens THEN tok ELSE '' END, '' ORDER BY pos) AS bare FROM an GROUP BY 1, 2, 3, 4, 5, 6),
ar AS (SELECT *, row_number() OVER (PARTITION BY project, path, cpos ORDER BY i) AS n FROM ag WHERE arg <> ''),
sf AS (SELECT *, CASE WHEN regexp_matches(arg, '^(''[^'']*''|\x22[^\x22$]*\x22|\d+(\.\d+)?)$') THEN 'safe' WHEN NOT regexp_matches(arg, '^\$\w+$')
 AND contains(regexp_replace(regexp_replace(bare, '^\s*\.\.\.', ''), '\d+\.\d+', '', 'g'), '.') THEN 'suspicious' ELSE 'needs_trace' END AS safety FROM ar)"""
#: Calls with single arguments beside them.
WITH_ARGS = f"""{CALLS_SQL}, {ARG_SQL}, ca AS (SELECT k.*, a1.arg AS arg1, a2.arg AS arg2, a3.arg AS arg3 FROM tk k LEFT JOIN ar a1 ON a1.project = k.project AND a1.path = k.path AND a1.cpos = k.pos AND a1.n = 1
 LEFT JOIN ar a2 ON a2.project = k.project AND a2.path = k.path AND a2.cpos = k.pos AND a2.n = 2 LEFT JOIN ar a3 ON a3.project = k.project AND a3.path = k.path AND a3.cpos = k.pos AND a3.n = 3)"""


def code(t):
    return X.code_lines(t.fx_lines)


def sink_calls(t):
    """Calls of the statements that name something a table asks for."""
    return X.calls(code(t), X.known_names(), X.hot_keys(t.fx_lines, X.FILE))


def scoped(t):
    return X.scopes(X.code_lines(t.fx_lines), X.hot_keys(t.fx_lines, X.FILE))


@query("R02_numbered_lines", """
SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines, CAST(length(string_split(text, chr(10))[1]) AS INT) AS first_len FROM documents""")
def numbered(t):
    src = t.documents.select(F.lit("docs").alias("project"), F.col("doc_id").alias("path"), F.col("text").alias("content"))
    return X.explode_lines(src).groupBy(F.col("path").alias("doc_id")).agg(
        F.count("*").alias("lines"), F.max(F.when(F.col("line") == 1, F.length("text"))).alias("first_len"))


@query("F01_function_calls", f"""WITH {CODE_SQL}, {CALLS_SQL}, k(name, sink_type) AS (VALUES {values(K.pairs(K.FUNCTION_SINKS))})
SELECT sink_type, token AS function, COUNT(*) AS hits FROM tk JOIN k ON name = token GROUP BY 1, 2""")
def function_calls(t):
    # F02 drops the entity-loader call with a true argument; kept here so that F01 alone is compared
    return X.table_hits(sink_calls(t), keep_safe=True).where("call_type = 'func_call'").groupBy("sink_type", "function").agg(F.count("*").alias("hits"))


@query("F02_entity_loader", f"""WITH {CODE_SQL}, {WITH_ARGS} SELECT project, path, line FROM ca WHERE token = 'libxml_disable_entity_loader' AND lower(COALESCE(arg1, '')) <> 'true'""")
def entity_loader(t):
    return X.table_hits(sink_calls(t)).where("function = 'libxml_disable_entity_loader'").select("project", "path", "line")


@query("F03_static_calls", f"""WITH {CODE_SQL}, x AS (SELECT unnest(regexp_extract_all(code, '(\\w+::\\w+)\\s*\\(', 1)) AS function FROM src),
k(name, sink_type) AS (VALUES {values(K.pairs(K.STATIC_SINKS))}) SELECT sink_type, function, COUNT(*) AS hits FROM x JOIN k ON name = function GROUP BY 1, 2""")
def static_calls(t):
    return X.table_hits(sink_calls(t)).where("call_type = 'static_call'").groupBy("sink_type", "function").agg(F.count("*").alias("hits"))


@query("F04_method_calls", f"""WITH {CODE_SQL}, {CALLS_SQL}, k(name, sink_type) AS (VALUES {values(K.pairs(K.METHOD_SINKS))})
SELECT sink_type, token || '()' AS function, COUNT(*) AS hits FROM tk JOIN k ON token = '->' || name GROUP BY 1, 2""")
def method_calls(t):
    return X.table_hits(sink_calls(t)).where("call_type = 'method_call'").groupBy("sink_type", "function").agg(F.count("*").alias("hits"))


def _line_query(key, kind, where, fn):
    @query(key, f"WITH {CODE_SQL} SELECT project, path, line, {fn} AS function FROM src WHERE {where}")
    def run(t):
        return X.line_hits(scoped(t)).where(F.col("call_type") == kind).select("project", "path", "line", "function")
    return run


_line_query("F05_dynamic_method", "dynamic_method", r"regexp_matches(code, '->\$\w+\s*\(')", r"'->$' || regexp_extract(code, '->\$(\w+)\s*\(', 1) || '()'")
BARE = f"regexp_replace(code, {lit(X.STRING)}, {lit(chr(39) * 2)}, 'g')"
OPERAND = f"regexp_extract({BARE}, {lit(X.INCLUDE)}, 2)"
_line_query("F07_dynamic_include", "dynamic_include",
            rf"regexp_matches({BARE}, {lit(X.INCLUDE)}) AND (regexp_matches({OPERAND}, '^\$\w+[\s)]*$') OR contains(regexp_replace({OPERAND}, '\w+\s*\([^()]*\)', 'x', 'g'), '.'))",
            rf"regexp_extract({BARE}, {lit(X.INCLUDE)}, 1)")
_line_query("F09_magic_methods", "magic_method", r"regexp_matches(code, 'function\s+(__(?:destruct|wakeup|toString|call|get))\s*\(')",
            r"regexp_extract(code, 'function\s+(__(?:destruct|wakeup|toString|call|get))\s*\(', 1) || '() definition'")
_line_query("F10_guarded", "property", r"regexp_matches(code, '\$guarded\s*=\s*\[\s*\]')", "'$guarded = []'")


def _context_query(key, where_spark, sql, cols=("project", "path", "line", "function")):
    @query(key, sql)
    def run(t):
        return X.context_hits(X.calls(scoped(t), X.known_names())).where(where_spark).select(*cols)
    return run


_context_query("F06_dynamic_function", "call_type = 'dynamic_call'",
               rf"WITH {CODE_SQL}, x AS (SELECT project, path, line, unnest(regexp_extract_all(code, '(?:^|[^\w>:$])(\$[A-Za-z_]\w*)\s*\(', 1)) AS token FROM src) SELECT project, path, line, token || '()' AS function FROM x")
_context_query("F11_bulk_assignment", "sink_type = 'MassAssignment'",
               rf"""WITH {CODE_SQL}, {WITH_ARGS} SELECT project, path, line, token || '($request->all())' AS function FROM tk WHERE token IN ('->fill', '->update', '->create')
 AND EXISTS (SELECT 1 FROM ar WHERE ar.project = tk.project AND ar.path = tk.path AND ar.cpos = tk.pos AND regexp_matches(arg, '->all\s*\(\s*\)$'))""")
_context_query("F12_wpdb_calls", "sink_type = 'WordPress'",
               rf"WITH {CODE_SQL} SELECT project, path, line, '$wpdb->' || regexp_extract(code, '\$wpdb->(query|get_results|get_row|get_var)\s*\(', 1) || '()' AS function FROM src WHERE regexp_matches(code, '\$wpdb->(query|get_results|get_row|get_var)\s*\(')")
_context_query("F13_nosql_receivers", "sink_type = 'NoSQL'",
               rf"""WITH {CODE_SQL}, x AS (SELECT project, path, line, lower(regexp_extract(code, '(?:\$|->)(\w+)->(?:find|findOne|aggregate|updateOne|deleteMany|insertOne|eval|rawCommand)\s*\(', 1)) AS r,
 regexp_extract(code, '->(find|findOne|aggregate|updateOne|deleteMany|insertOne|eval|rawCommand)\s*\(', 1) AS m FROM src)
 SELECT project, path, line, CASE WHEN m IN ('eval', 'rawCommand') THEN 'Redis' ELSE 'MongoDB' END || '->' || m || '()' AS function FROM x WHERE r <> '' AND regexp_matches(r, '{"|".join(K.NOSQL_RECEIVERS)}')""")
_context_query("F14_weak_hash", "call_type = 'crypto_weak_hash'",
               rf"""WITH {CODE_SQL}, {WITH_ARGS} SELECT project, path, line, token || '() on password variable' AS function FROM ca WHERE token IN ('md5', 'sha1') AND regexp_matches(arg1, '^\$[\w>-]+$')
 AND regexp_matches(lower(regexp_extract(arg1, '(?:\$|->)(\w+)$', 1)), '{"|".join(K.PASSWORD_NAMES)}')""")
_context_query("F15_weak_random", "call_type = 'crypto_weak_random'",
               rf"WITH {CODE_SQL}, {DEPTH_SQL} SELECT project, path, line, regexp_extract(code, '\b(rand|mt_rand)\s*\(', 1) || '() for security purpose ($' || in_function || ')' AS function FROM scoped WHERE regexp_matches(code, '\b(?:rand|mt_rand)\s*\(') AND regexp_matches(lower(in_function), '{'|'.join(K.SECURITY_SCOPES)}')")
_context_query("F16_ecb_mode", "call_type = 'crypto_ecb'",
               rf"""WITH {CODE_SQL}, {WITH_ARGS} SELECT project, path, line, 'openssl_encrypt() with ECB mode' AS function FROM ca WHERE token = 'openssl_encrypt' AND regexp_matches(arg2, '(?i)^[''\x22].*ecb')""")
_context_query("F17_deprecated_crypto", "call_type = 'crypto_deprecated'",
               rf"WITH {CODE_SQL}, {CALLS_SQL} SELECT project, path, line, token || '() (deprecated)' AS function FROM tk WHERE starts_with(token, 'mcrypt_')")
_context_query("F19_write_without_lock", "sink_type = 'RaceCondition'",
               rf"""WITH {CODE_SQL}, {WITH_ARGS} SELECT project, path, line, 'file_put_contents() without LOCK_EX' AS function FROM ca WHERE token = 'file_put_contents' AND NOT contains(COALESCE(arg3, ''), 'LOCK_EX')""")


@query("F08_weak_comparison", rf"""WITH {CODE_SQL}, x AS (SELECT project, path, line, unnest(regexp_extract_all(code, {lit('(' + X.COMPARISON + ')')}, 1)) AS c FROM src),
y AS (SELECT *, lower(regexp_extract(c, '^(?:\$\w+(?:->\w+)*->|\$)(\w+)', 1)) AS l, lower(regexp_extract(c, '[!=]=\s*(?:\$\w+(?:->\w+)*->|\$)(\w+)$', 1)) AS r FROM x)
SELECT project, path, line, regexp_extract(c, '[^=!<>]\s*([!=]=)', 1) || ' on sensitive var' AS function FROM y WHERE regexp_matches(l, '{"|".join(K.SENSITIVE_NAMES)}') OR regexp_matches(r, '{"|".join(K.SENSITIVE_NAMES)}')""")
def weak_comparison(t):
    return X.line_hits(scoped(t)).where("call_type = 'weak_comparison'").select("project", "path", "line", "function")


@query("F18_check_then_include", rf"""WITH {CODE_SQL}, {DEPTH_SQL}
SELECT DISTINCT project, path, in_check AS line FROM scoped WHERE in_check IS NOT NULL AND regexp_matches(code, '\b(?:include|require)(?:_once)?\b')""")
def check_include(t):
    return X.check_then_include(scoped(t)).select("project", "path", "line")


@query("F20_graphql_resolvers", rf"""WITH {CODE_SQL}, {DEPTH_SQL}
SELECT project, path, line, regexp_extract(code, 'function\s+(resolve(?:Field)?)\s*\(', 1) || '() in ' || in_class AS function FROM scoped WHERE regexp_matches(code, 'function\s+resolve(?:Field)?\s*\(') AND regexp_matches(lower(in_class), '{"|".join(K.GRAPHQL_CLASSES)}')
UNION ALL SELECT project, path, line, '''resolve'' => closure (GraphQL field resolver)' FROM scoped WHERE regexp_matches(code, '[''\x22]resolve[''\x22]\s*=>\s*(?:static\s+)?(?:function|fn)\b')""")
def resolvers(t):
    return X.line_hits(scoped(t)).where("sink_type = 'GraphQL'").select("project", "path", "line", "function")


@query("F21_scopes", f"WITH {CODE_SQL}, {DEPTH_SQL} SELECT project, path, line, in_class, in_function FROM scoped")
def scope_rows(t):
    return scoped(t).select("project", "path", "line", "in_class", "in_function")


@query("F22_argument_safety", f"WITH {CODE_SQL}, {CALLS_SQL}, {ARG_SQL} SELECT token, arg, safety, COUNT(*) AS uses FROM sf GROUP BY 1, 2, 3")
def safety(t):
    c = X.with_safety(X.calls(code(t), hot=X.hot_keys(t.fx_lines, X.FILE))).select("token", F.explode(F.arrays_zip("args", "arg_safety")).alias("a"))
    return c.select("token", F.col("a.args").alias("arg"), F.col("a.arg_safety").alias("safety")).groupBy("token", "arg", "safety").agg(F.count("*").alias("uses"))


@query("F23_traceable_calls", f"""WITH {CODE_SQL}, {CALLS_SQL}, {ARG_SQL}, k(name, sink_type) AS (VALUES {values(K.pairs(K.FUNCTION_SINKS))}),
g AS (SELECT project, path, line, cpos, token, bool_or(safety <> 'safe') AS tr FROM sf JOIN k ON token = name WHERE NOT (token = 'libxml_disable_entity_loader' AND lower(arg) = 'true') GROUP BY 1, 2, 3, 4, 5)
SELECT token, COUNT(*) AS hits FROM g WHERE tr GROUP BY 1""")
def traceable(t):
    h = X.with_safety(X.table_hits(sink_calls(t)).where("call_type = 'func_call'"))
    return X.traceable(h).groupBy("token").agg(F.count("*").alias("hits"))


TABLES = [("f", n) for n, _ in K.pairs(K.FUNCTION_SINKS)] + [("m", n) for n, _ in K.pairs(K.METHOD_SINKS)] + [("s", n) for n, _ in K.pairs(K.STATIC_SINKS)]


@query("F24_scan_summary", f"""WITH {CODE_SQL}, {WITH_ARGS}, k(kind, name) AS (VALUES {values(TABLES)}),
x AS (SELECT ca.*, CASE WHEN starts_with(ca.token, '::') THEN b.tok END AS klass FROM ca LEFT JOIN t4 b ON b.project = ca.project AND b.path = ca.path AND b.pos = ca.pos - 1),
h AS (SELECT project, COUNT(*) AS sinks FROM x JOIN k ON name = CASE kind WHEN 'f' THEN token WHEN 'm' THEN substr(token, 3) ELSE klass || token END AND (kind <> 'm' OR starts_with(token, '->'))
 WHERE NOT (token = 'libxml_disable_entity_loader' AND lower(COALESCE(arg1, '')) = 'true') GROUP BY 1),
e AS (SELECT project, path, bool_or((quoted AND NOT ended) OR (starts_with(tok, '/*') AND NOT ends_with(tok, '*/')))
 OR sum(CASE WHEN quoted OR comment THEN 0 WHEN right(tok, 1) = '(' THEN 1 WHEN tok = ')' THEN -1 ELSE 0 END) <> 0 AS bad FROM t2 GROUP BY 1, 2),
f AS (SELECT project, COUNT(*) AS files, CAST(sum(bad::INT) AS BIGINT) AS parse_errors FROM e GROUP BY 1)
SELECT f.project, files, COALESCE(sinks, 0) AS sinks, parse_errors FROM f LEFT JOIN h USING (project)""")
def summary(t):
    return X.scan_summary(t.fx_lines, X.table_hits(sink_calls(t)))


def union_rules(rules, source="src") -> str:
    return " UNION ALL ".join(f"SELECT {lit(rid)} AS rule, project, path, line FROM {source} WHERE regexp_matches(code, {lit(rx)})" for rid, rx in rules)


CAT = K.catalogue_rows()


@query("F25_catalogue", f"WITH {CODE_SQL}, h AS ({union_rules(CAT)}) SELECT split_part(rule, ':', 1) AS family, split_part(rule, ':', 2) AS level, CAST(split_part(rule, ':', 3) AS INT) AS row, COUNT(*) AS hits FROM h GROUP BY 1, 2, 3")
def catalogue(t):
    return X.catalogue_hits(code(t)).groupBy("family", "level", "row").agg(F.count("*").alias("hits"))


FW = [(f"{fw}:{i}", rx) for i, (fw, rx) in enumerate(P.FRAMEWORK_USAGE)]


@query("B22_framework_usage", f"WITH {CODE_SQL}, h AS ({union_rules(FW)}) SELECT split_part(rule, ':', 1) AS framework, COUNT(*) AS hits FROM h GROUP BY 1")
def framework_usage(t):
    return X.framework_hits(code(t)).groupBy("framework").agg(F.count("*").alias("hits"))


def scope_sql(scope: str, rules) -> str:
    keys = {"function": "project, path, in_function", "file": "project, path", "project": "project"}[scope]
    place = "line" if scope != "project" else "1"
    parts = []
    for rid, first, then, never in rules:
        cond = f"min(CASE WHEN regexp_matches(code, {lit(first)}) THEN {place} END) IS NOT NULL"
        if then:
            cond += f" AND max(CASE WHEN regexp_matches(code, {lit(then)}) THEN {place} END) >= min(CASE WHEN regexp_matches(code, {lit(first)}) THEN {place} END)"
        if never:
            cond += f" AND NOT bool_or(regexp_matches(code, {lit(never)}))"
        where = "WHERE in_function IS NOT NULL" if scope == "function" else ""
        parts.append(f"SELECT {lit(rid)} AS rule, project FROM scoped {where} GROUP BY {keys} HAVING {cond}")
    return " UNION ALL ".join(parts)


def _family_query(number: int, family: str):
    rules = X.line_rules([family])
    parts = [f"SELECT rule, project FROM ({union_rules(rules, 'scoped')})"] if rules else []
    for scope in ("function", "file", "project"):
        r = X.scope_rules(scope, [family])
        if r:
            parts.append(scope_sql(scope, r))

    @query(f"P{number:02d}_{family}", f"WITH {CODE_SQL}, {DEPTH_SQL}, h AS ({' UNION ALL '.join(parts)}) SELECT rule, COUNT(*) AS hits, COUNT(DISTINCT project) AS projects FROM h GROUP BY 1")
    def run(t):
        return X.family_hits(scoped(t), [family]).groupBy("rule").agg(F.count("*").alias("hits"), F.countDistinct("project").alias("projects"))
    return run


for _n, _family in enumerate(P.PATTERNS, 1):
    _family_query(_n, _family)


ALL_RULES = [f"SELECT rule FROM ({union_rules(X.line_rules(), 'scoped')})"] + [f"SELECT rule FROM ({scope_sql(s, X.scope_rules(s))})" for s in ("function", "file", "project")]


@query("F26_all_families", f"""WITH {CODE_SQL}, {DEPTH_SQL}, h AS ({' UNION ALL '.join(ALL_RULES)}) SELECT rule, COUNT(*) AS hits FROM h GROUP BY 1""")
def all_families(t):
    return X.family_hits(scoped(t)).groupBy("rule").agg(F.count("*").alias("hits"))


# The whole scan is the sum of its rules: (query, sink type, call type); None keeps the column of the part.
SCAN_PARTS = [
    ("F03_static_calls", None, "'static_call'"), ("F04_method_calls", None, "'method_call'"), ("F05_dynamic_method", "'RCE'", "'dynamic_method'"),
    ("F06_dynamic_function", "'RCE'", "'dynamic_call'"), ("F07_dynamic_include", "'LFI'", "'dynamic_include'"), ("F08_weak_comparison", "'WeakComparison'", "'weak_comparison'"),
    ("F09_magic_methods", "'Deserialization'", "'magic_method'"), ("F10_guarded", "'MassAssignment'", "'property'"), ("F11_bulk_assignment", "'MassAssignment'", "'method_call'"),
    ("F12_wpdb_calls", "'WordPress'", "'method_call'"), ("F13_nosql_receivers", "'NoSQL'", "'method_call'"), ("F14_weak_hash", "'Crypto'", "'crypto_weak_hash'"),
    ("F15_weak_random", "'Crypto'", "'crypto_weak_random'"), ("F16_ecb_mode", "'Crypto'", "'crypto_ecb'"), ("F17_deprecated_crypto", "'Crypto'", "'crypto_deprecated'"),
    ("F19_write_without_lock", "'RaceCondition'", "'race_condition'"), ("F20_graphql_resolvers", "'GraphQL'", "'graphql_resolve'"),
]


def full_scan_sql() -> str:
    parts = []
    for name, fam, kind in SCAN_PARTS:
        n = "hits" if fam is None else "1"
        parts.append(f"SELECT {fam or 'sink_type'} AS sink_type, function, {kind} AS call_type, {n} AS n FROM ({BODIES[name]})")
    parts.append(f"SELECT 'RaceCondition', 'file_exists() + include/require (TOCTOU)', 'race_condition', 1 FROM ({BODIES['F18_check_then_include']})")
    parts.append(f"SELECT sink_type, function, 'func_call', hits FROM ({BODIES['F01_function_calls']}) WHERE function <> 'libxml_disable_entity_loader'")
    parts.append(f"SELECT 'XXE', 'libxml_disable_entity_loader', 'func_call', 1 FROM ({BODIES['F02_entity_loader']})")
    return f"SELECT sink_type, function, call_type, SUM(n)::BIGINT AS hits FROM ({' UNION ALL '.join(parts)}) GROUP BY 1, 2, 3"


@query("F01_F24_full_scan", full_scan_sql())
def full_scan(t):
    return X.scan_calls(t.fx_lines).groupBy("sink_type", "function", "call_type").agg(F.count("*").alias("hits"))
