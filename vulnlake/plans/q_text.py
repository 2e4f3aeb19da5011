"""Leaks, routes, traces and recorded HTTP."""

from __future__ import annotations

from pyspark.sql import functions as F

from vulnlake.functions import http as H
from vulnlake.functions import score as S
from vulnlake.functions import traces as T
from vulnlake.operators import callgraph as C
from vulnlake.operators import inventory as I
from vulnlake.operators import leaks as L
from vulnlake.operators import platform as P
from vulnlake.plans.q_graph import values
from vulnlake.plans.q_source import CODE_SQL, DEPTH_SQL, WITH_ARGS, code, lit, scoped
from vulnlake.plans.registry import query
from vulnlake.sources import reports as R


def extract_union(rules, source, key, text="text") -> str:
    return " UNION ALL ".join(f"SELECT {key}, {lit(r)} AS rule, unnest(regexp_extract_all({text}, {lit(rx)}, 1)) AS value FROM {source}" for r, rx in rules)


SECRET_SQL = f"h AS ({extract_union(L.SECRET_RULES, 'documents', 'doc_id')}), s AS (SELECT * FROM h WHERE lower(value) NOT IN ({', '.join(lit(p) for p in L.PLACEHOLDERS)}))"


@query("F27_secrets", f"WITH {SECRET_SQL} SELECT doc_id, rule, sha256(value) AS value_sha, concat(substr(value, 1, 4), '****') AS preview FROM s")
def secrets(t):
    return L.secrets(t.texts("documents", "doc_id", "text"))


@query("F28_placeholders", f"WITH {SECRET_SQL}, g AS (SELECT rule, COUNT(*) AS matches FROM h GROUP BY 1), k AS (SELECT rule, COUNT(*) AS leaks FROM s GROUP BY 1) SELECT rule, matches, COALESCE(leaks, 0) AS leaks FROM g LEFT JOIN k USING (rule)")
def placeholders(t):
    every = L.found_values(t.texts("documents", "doc_id", "text"), L.SECRET_RULES, "text")
    ok = ~F.lower("value").isin(L.PLACEHOLDERS)
    return every.groupBy("rule").agg(F.count("*").alias("matches"), F.count_if(ok).alias("leaks"))


DIFF_SQL = """d AS (SELECT source AS commit, concat('conf/k', CAST(doc_id AS VARCHAR), CASE doc_id % 5 WHEN 0 THEN '.pem' WHEN 1 THEN '.env' ELSE '.txt' END) AS path,
 CASE lang WHEN 'en' THEN 'D' ELSE 'M' END AS change_type, text AS patch FROM documents)"""


def diffs(t):
    m = F.col("doc_id") % 5
    return t.documents.select(
        F.col("source").alias("commit"), F.concat(F.lit("conf/k"), F.col("doc_id").cast("string"), S.pick(m, {0: ".pem", 1: ".env"}, ".txt")).alias("path"),
        F.when(F.col("lang") == "en", "D").otherwise("M").alias("change_type"), F.col("text").alias("patch"))


@query("F29_history_secrets", f"""WITH {DIFF_SQL}, h AS ({extract_union(L.SECRET_RULES, 'd', 'commit', 'patch')}), s AS (SELECT * FROM h WHERE lower(value) NOT IN ({', '.join(lit(p) for p in L.PLACEHOLDERS)})),
a AS (SELECT commit, rule FROM s UNION ALL SELECT commit, 'deleted_key_file' FROM d WHERE change_type = 'D' AND regexp_matches(path, '\\.(env|pem|key|p12)$'))
SELECT commit, rule, COUNT(*) AS hits FROM a GROUP BY 1, 2""")
def history(t):
    return L.history_secrets(diffs(t)).groupBy("commit", "rule").agg(F.count("*").alias("hits"))


@query("R13_change_rows", f"WITH {DIFF_SQL} SELECT commit, change_type, COUNT(*) AS files, SUM(length(patch))::BIGINT AS chars FROM d GROUP BY 1, 2")
def change_rows(t):
    return diffs(t).groupBy("commit", "change_type").agg(F.count("*").alias("files"), F.sum(F.length("patch")).alias("chars"))


LUHN_SQL = "list_sum(list_transform(range(1, length(value) + 1), lambda i: CASE WHEN i % 2 = 0 THEN CASE WHEN CAST(substr(reverse(value), i, 1) AS INT) > 4 THEN CAST(substr(reverse(value), i, 1) AS INT) * 2 - 9 ELSE CAST(substr(reverse(value), i, 1) AS INT) * 2 END ELSE CAST(substr(reverse(value), i, 1) AS INT) END)) % 10 = 0"


@query("F30_unmasked_pii", f"WITH h AS ({extract_union(L.PII_RULES, 'documents', 'doc_id')}) SELECT doc_id, rule, sha256(value) AS value_sha FROM h WHERE CASE WHEN rule = 'card' THEN {LUHN_SQL} ELSE true END")
def pii(t):
    return L.unmasked_pii(t.texts("documents", "doc_id", "text"))


BODY = "CASE event_type WHEN 'view' THEN concat('{\"id\":', CAST(event_id AS VARCHAR), ',\"password_hash\":\"x\"}') WHEN 'click' THEN '{\"token\":1,\"ssn\":2}' ELSE '{\"id\":1}' END"


@query("F31_exposed_fields", f"""WITH b AS (SELECT event_id, {BODY} AS body FROM events), k AS (SELECT event_id, unnest(json_keys(body)) AS field FROM b)
SELECT event_id, field FROM k WHERE field IN ('password_hash','secret','secret_key','token','ssn','internal_ip')""")
def exposed(t):
    body = (F.when(F.col("event_type") == "view", F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(',"password_hash":"x"}')))
            .when(F.col("event_type") == "click", '{"token":1,"ssn":2}').otherwise('{"id":1}'))
    return L.exposed_fields(t.events.select("event_id", body.alias("body")))


@query("F32_page_leaks", f"""WITH f AS ({' UNION ALL '.join(f"SELECT page_id, {lit(r)} AS rule FROM fx_html WHERE regexp_matches(html, {lit(rx)})" for r, rx in L.PAGE_RULES)}) SELECT rule, COUNT(*) AS pages FROM f GROUP BY 1""")
def page_leaks(t):
    return L.text_flags(t.fx_html, L.PAGE_RULES, "html").groupBy("rule").agg(F.count("*").alias("pages"))


@query("F32_page_comments", f"""WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<!--(.*?)-->', 1)) AS note FROM fx_html) SELECT page_id, trim(note) AS note FROM c WHERE regexp_matches(note, {lit(L.COMMENT_HINT)})""")
def comments(t):
    return L.page_comments(t.fx_html)


@query("F33_sensitive_logs", f"""WITH f AS ({' UNION ALL '.join(f"SELECT doc_id, {lit(r)} AS rule FROM documents WHERE regexp_matches(text, {lit(rx)})" for r, rx in L.LOG_RULES)}) SELECT doc_id, rule FROM f""")
def logs(t):
    return L.text_flags(t.texts("documents", "doc_id", "text"), L.LOG_RULES, "text")


@query("F34_log_injection", """
WITH x AS (SELECT CASE WHEN regexp_matches(text, '(?i)%0d%0a') THEN 'encoded_crlf' WHEN contains(text, chr(27) || '[') THEN 'ansi_escape' WHEN contains(text, chr(10)) OR contains(text, chr(13)) THEN 'line_break' END AS marker FROM conversations)
SELECT marker, COUNT(*) AS records FROM x GROUP BY 1 UNION ALL SELECT 'broken_json', COUNT(*) FILTER (NOT json_valid(props)) FROM events""")
def injection(t):
    a = t.conversations.groupBy(L.injection_marker("text").alias("marker")).agg(F.count("*").alias("records"))
    broken = F.count_if(F.expr("try_parse_json(props)").isNull())
    return a.unionByName(t.events.agg(broken.alias("records")).select(F.lit("broken_json").alias("marker"), "records"))


@query("F35_exposed_log_paths", """
WITH p AS (SELECT l_orderkey, concat(CASE l_suppkey % 4 WHEN 0 THEN 'public/' WHEN 1 THEN 'storage/logs/' WHEN 2 THEN 'www/app/' ELSE 'var/' END, 'app', CAST(l_linenumber AS VARCHAR), CASE l_partkey % 3 WHEN 0 THEN '.log' WHEN 1 THEN '.log.1' ELSE '.txt' END) AS path FROM lineitem)
SELECT path, regexp_matches(path, '(?i)(^|/)(public|www|htdocs|webroot)/(.*/)?[^/]*\\.log(\\.[0-9]+|\\.gz|\\.bak)?$') AS web_reachable, regexp_matches(path, '(?i)\\.log\\.([0-9]+|gz|bak|old)$') AS rotated, COUNT(*) AS n FROM p GROUP BY 1""")
def log_paths(t):
    path = F.concat(S.pick(F.col("l_suppkey") % 4, {0: "public/", 1: "storage/logs/", 2: "www/app/"}, "var/"), F.lit("app"), F.col("l_linenumber").cast("string"),
                    S.pick(F.col("l_partkey") % 3, {0: ".log", 1: ".log.1"}, ".txt"))
    g = t.lineitem.groupBy(path.alias("path")).agg(F.count("*").alias("n"))
    return g.withColumn("web_reachable", F.col("path").rlike(L.LOG_PATH)).withColumn("rotated", F.col("path").rlike(L.ROTATED))


@query("F36_obfuscated_source", f"WITH h AS ({' UNION ALL '.join(f'SELECT {lit(r)} AS rule, project FROM fx_lines WHERE regexp_matches(text, {lit(rx)})' for r, rx in L.OBFUSCATED)}) SELECT rule, project, COUNT(*) AS files FROM h GROUP BY 1, 2")
def obfuscated(t):
    return L.text_flags(t.fx_lines.select("project", "text"), L.OBFUSCATED, "text").groupBy("rule", "project").agg(F.count("*").alias("files"))


@query("F37_entry_points", f"""WITH {CODE_SQL}, h AS ({' UNION ALL '.join(f'SELECT {lit(k)} AS entry_type, path FROM src WHERE regexp_matches(code, {lit(rx)})' for k, rx in I.ENTRY_RULES)})
SELECT entry_type, concat(entry_type, ':', regexp_extract(path, '([^/]+)\\.\\w+$', 1)) AS synthetic_id, COUNT(*) AS n FROM h GROUP BY 1, 2""")
def entry_points(t):
    return I.entry_points(code(t)).groupBy("entry_type", "synthetic_id").agg(F.count("*").alias("n"))


OTHER_ROUTES = " UNION ALL ".join(f"SELECT project, path, line, {lit(k)} AS method, regexp_extract(code, {lit(rx)}, 1) AS url FROM src WHERE regexp_matches(code, {lit(rx)})" for k, rx in I.ROUTE_OTHER)
ROUTE_SQL = f"rt AS (SELECT project, path, line, upper(regexp_extract(code, {lit(I.ROUTE_CALL)}, 1)) AS method, regexp_extract(code, {lit(I.ROUTE_CALL)}, 2) AS url FROM src WHERE regexp_matches(code, {lit(I.ROUTE_CALL)}) UNION ALL {OTHER_ROUTES})"


@query("F38_routes", f"WITH {CODE_SQL}, {ROUTE_SQL} SELECT method, url, COUNT(*) AS n FROM rt GROUP BY 1, 2")
def routes(t):
    return I.routes(code(t)).groupBy("method", "url").agg(F.count("*").alias("n"))


@query("F39_resource_routes", f"""WITH {CODE_SQL}, v(method, suffix, action) AS (VALUES {values(I.RESOURCE_ROUTES)})
SELECT controller, method, url, action, COUNT(*) AS n FROM (SELECT regexp_extract(code, {lit(I.RESOURCE_CALL)}, 2) AS controller, method, concat('/', regexp_extract(code, {lit(I.RESOURCE_CALL)}, 1), suffix) AS url, action FROM src, v WHERE regexp_matches(code, {lit(I.RESOURCE_CALL)})) GROUP BY 1, 2, 3, 4""")
def resources(t):
    return I.resource_routes(code(t)).groupBy("controller", "method", "url", "action").agg(F.count("*").alias("n"))


@query("F40_parameter_sources", f"WITH {CODE_SQL}, h AS ({' UNION ALL '.join(f'SELECT {lit(k)} AS source, project FROM src WHERE regexp_matches(code, {lit(rx)})' for k, rx in I.INPUT_RULES)}) SELECT source, project, COUNT(*) AS n FROM h GROUP BY 1, 2")
def parameters(t):
    return I.parameter_sources(code(t)).groupBy("source", "project").agg(F.count("*").alias("n"))


@query("F41_hidden_endpoints", f"WITH {CODE_SQL}, {ROUTE_SQL}, f AS (SELECT DISTINCT project, unnest(regexp_extract_all(code, {lit(I.BUNDLE_PATH)}, 1)) AS url FROM src) SELECT project, url, true AS hidden FROM f WHERE NOT EXISTS (SELECT 1 FROM rt WHERE rt.project = f.project AND rt.url = f.url)")
def hidden(t):
    c = code(t)
    return I.hidden_endpoints(c, I.routes(c))


@query("F42_sql_tables", f"WITH {CODE_SQL}, x AS (SELECT project, lower(unnest(regexp_extract_all(code, {lit(I.SQL_TABLE)}, 1))) AS tbl FROM src) SELECT project, tbl, COUNT(*) AS n FROM x GROUP BY 1, 2")
def tables(t):
    return I.sql_tables(code(t)).groupBy("project", "tbl").agg(F.count("*").alias("n"))


@query("F43_migration_types", f"""WITH {CODE_SQL}, mg AS (SELECT regexp_extract(code, {lit(I.MIGRATION)}, 1) AS f, regexp_extract(code, {lit(I.MIGRATION)}, 2) AS col, regexp_extract(code, {lit(I.MIGRATION)}, 3) AS n FROM src WHERE regexp_matches(code, {lit(I.MIGRATION)})),
k(f, type) AS (VALUES {values(I.COLUMN_TYPES.items())}) SELECT col, CASE f WHEN 'string' THEN concat('VARCHAR(', CASE n WHEN '' THEN '255' ELSE n END, ')') ELSE type END AS type, COUNT(*) AS uses FROM mg JOIN k USING (f) GROUP BY 1, 2""")
def migrations(t):
    return I.migration_columns(code(t)).groupBy("col", "type").agg(F.count("*").alias("uses"))


@query("F44_validation_types", """
WITH r AS (SELECT CASE p_size % 7 WHEN 0 THEN 'email|max:255' WHEN 1 THEN 'integer|min:0' WHEN 2 THEN 'string|max:1000' WHEN 3 THEN 'boolean' WHEN 4 THEN 'date' WHEN 5 THEN 'numeric' ELSE 'required|string' END AS rule FROM part)
SELECT rule, CASE rule WHEN 'email|max:255' THEN 'VARCHAR(255)' WHEN 'integer|min:0' THEN 'INT UNSIGNED' WHEN 'string|max:1000' THEN 'VARCHAR(1000)' WHEN 'boolean' THEN 'TINYINT(1)' WHEN 'date' THEN 'DATE'
 WHEN 'numeric' THEN 'DECIMAL' ELSE 'VARCHAR(255)' END AS type, COUNT(*) AS fields FROM r GROUP BY 1, 2""")
def validation(t):
    rule = S.pick(F.col("p_size") % 7, {0: "email|max:255", 1: "integer|min:0", 2: "string|max:1000", 3: "boolean", 4: "date", 5: "numeric"}, "required|string")
    return t.part.select(rule.alias("rule")).groupBy("rule").agg(F.count("*").alias("fields")).withColumn("type", I.validation_type("rule"))


@query("F45_foreign_keys", rf"""WITH {CODE_SQL}, {DEPTH_SQL}, x AS (SELECT regexp_extract(code, '->(hasMany|hasOne|belongsTo|belongsToMany)\s*\(\s*(\w+)::class', 1) AS relation,
 lower(regexp_extract(code, '->(hasMany|hasOne|belongsTo|belongsToMany)\s*\(\s*(\w+)::class', 2)) AS target, lower(COALESCE(in_class, '')) AS owner FROM scoped WHERE regexp_matches(code, '->(hasMany|hasOne|belongsTo|belongsToMany)\s*\(\s*(\w+)::class'))
SELECT relation, CASE relation WHEN 'belongsToMany' THEN owner || '_' || target WHEN 'belongsTo' THEN owner ELSE target END AS tbl,
 CASE relation WHEN 'belongsTo' THEN target || '_id' WHEN 'belongsToMany' THEN owner || '_id,' || target || '_id' ELSE owner || '_id' END AS columns, COUNT(*) AS n FROM x GROUP BY 1, 2, 3""")
def foreign_keys(t):
    return I.foreign_keys(scoped(t)).groupBy("relation", "tbl", "columns").agg(F.count("*").alias("n"))


CANON = "lower(regexp_replace(replace(replace(replace(replace(replace(url_decode(url_decode(uri)), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '/\\*(?:[^*]|\\*[^/])*\\*/', '', 'g'))"


@query("S31_canonical_uri", f"SELECT uri, {CANON} AS canonical, COUNT(*) AS n FROM fx_access GROUP BY 1, 2")
def canonical(t):
    return t.fx_access.groupBy("uri").agg(F.count("*").alias("n")).withColumn("canonical", H.canonical("uri", escapes=True))


@query("U03_decoded_escapes", """
SELECT event_id, concat('q=', chr(CAST(33 + event_id % 90 AS INT)), chr(CAST(960 + user_id % 20 AS INT)), '&r=', event_type, chr(CAST(65 + user_id % 26 AS INT))) AS text FROM events""")
def escapes(t):
    hexadecimal = lambda n, width: F.lpad(F.lower(F.hex(n)), width, "0")
    written = F.concat(F.lit("q=\\x"), hexadecimal(33 + F.col("event_id") % 90, 2), F.lit("\\u"), hexadecimal(960 + F.col("user_id") % 20, 4),
                       F.lit("&r="), F.col("event_type"), F.lit("\\x"), hexadecimal(65 + F.col("user_id") % 26, 2))
    return t.events.select("event_id", H.decode_escapes(written).alias("text"))


@query("F46_request_signatures", f"WITH c AS (SELECT client, {CANON} AS u FROM fx_access) SELECT client, CASE {' '.join(f'WHEN contains(u, {lit(fp.lower())}) THEN {lit(fp)}' for fp in L.REQUEST_FINGERPRINTS)} END AS signature, COUNT(*) AS requests FROM c GROUP BY 1, 2")
def signatures(t):
    a = t.fx_access.select("client", H.canonical("uri").alias("u"))
    return a.groupBy("client", L.request_signature("u").alias("signature")).agg(F.count("*").alias("requests"))


@query("B19_sensitive_paths", f"WITH c AS (SELECT client, status, {CANON} AS u FROM fx_access) SELECT client, CASE {' '.join(f'WHEN contains(u, {lit(p)}) THEN {lit(p)}' for p in H.SENSITIVE_PATHS)} WHEN regexp_matches(regexp_replace(u, '[?#].*$', ''), {lit(H.BACKUP_SUFFIX)}) THEN 'backup' END AS what, COUNT(*) AS answered FROM c WHERE status = 200 GROUP BY 1, 2 HAVING what IS NOT NULL")
def sensitive(t):
    a = t.fx_access.where("status = 200").select("client", H.canonical("uri").alias("u"))
    # exploding the found paths drops the rest without copying the rule into a pushed-down filter
    a = a.select("client", F.explode(F.array_compact(F.array(H.sensitive_path("u")))).alias("what"))
    return a.groupBy("client", "what").agg(F.count("*").alias("answered"))


@query("S30_redirect_targets", f"""
WITH p AS (SELECT uri, regexp_extract(uri, '[?&](?:{'|'.join(H.REDIRECT_PARAMS)})=([^&#]*)', 1) AS target FROM fx_access), d AS (SELECT uri, target, url_decode(target) AS d FROM p WHERE target <> ''),
h AS (SELECT *, regexp_extract(d, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]+)', 1) AS host FROM d)
SELECT target, CASE WHEN regexp_matches(d, '(?i)^\\s*(?:javascript|data|vbscript):') THEN 'script_scheme' WHEN regexp_matches(d, '^[/\\\\]*\\\\') THEN 'backslash' WHEN starts_with(d, '//') THEN 'protocol_relative'
 WHEN regexp_matches(d, '^[a-zA-Z]+://[^/]*@') THEN 'userinfo' WHEN host <> '' AND host <> 'app.example' THEN CASE WHEN d <> target THEN 'encoded_external' ELSE 'external' END
 WHEN regexp_matches(d, '^/($|[^/\\\\])') THEN 'internal_path' ELSE 'internal' END AS class, COUNT(*) AS requests FROM h GROUP BY 1, 2""")
def redirect_targets(t):
    r = t.fx_access.select(H.redirect_param("uri").alias("target")).where(F.col("target").isNotNull()).groupBy("target").agg(F.count("*").alias("requests"))
    r = r.withColumn("d", H.decoded_target("target"))
    return r.withColumn("class", H.redirect_class("target", "d", F.lit("app.example"))).drop("d")


@query("F47_artifact_checks", """
SELECT source, COUNT(*) AS files, COUNT(*) FILTER (regexp_matches(text, '【填写】|TODO|TBD|PLACEHOLDER|xxx')) AS residue, 0::BIGINT AS bad_encoding,
 COUNT(*) FILTER (NOT regexp_matches(concat(lang, '_', source, '.json'), '^[a-z][a-z0-9_-]*\\.json$')) AS bad_names FROM documents GROUP BY 1""")
def artifact_checks(t):
    from vulnlake.operators.quality import artifact_problems
    d = t.documents.select("source", F.concat_ws("", F.concat_ws("_", "lang", "source"), F.lit(".json")).alias("name"), "text")
    p = artifact_problems(d, "name", "text", json_expected=F.lit(False))
    has = lambda r: F.count_if(F.array_contains("problems", r))
    return p.groupBy("source").agg(F.count("*").alias("files"), has("placeholder").alias("residue"), has("encoding").alias("bad_encoding"), has("file_name").alias("bad_names"))


@query("F48_schema_conformance", """
WITH x AS (SELECT unnest(list_filter([CASE WHEN verdict NOT IN ('confirmed','suspected','potential') THEN 'verdict:enum' END, CASE WHEN trace_status IS NULL THEN 'trace_status:required' END,
 CASE WHEN NOT (evidence_score BETWEEN 0 AND 9) THEN 'evidence_score:range' END, CASE WHEN NOT regexp_matches(file, '^app/Mod[0-9]*[02468]\\.php$') THEN 'file:pattern' END], lambda e: e IS NOT NULL)) AS problem FROM fx_sinks)
SELECT problem, COUNT(*) AS n FROM x GROUP BY 1""")
def conformance(t):
    from vulnlake.operators.quality import conformance_problems
    rules = [("verdict", "enum", ["confirmed", "suspected", "potential"]), ("trace_status", "required", None), ("evidence_score", "range", (0, 9)),
             ("file", "pattern", r"^app/Mod[0-9]*[02468]\.php$")]
    p = conformance_problems(t.fx_sinks, rules)
    return p.select(F.explode("problems").alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


@query("F49_doc_blocks", """
WITH m AS (SELECT event_id, concat('# t', chr(10), '```json', chr(10), CASE event_type WHEN 'error' THEN '{bad' ELSE props END, chr(10), '```', chr(10), CASE WHEN event_id % 3 = 0 THEN '%zz' ELSE '%2f' END) AS txt FROM events),
b AS (SELECT *, regexp_extract_all(txt, '(?s)```json\\s*\\n(.*?)```', 1) AS bl FROM m)
SELECT event_id, CAST(len(bl) AS INT) AS json_blocks, CAST(len(list_filter(bl, lambda x: NOT json_valid(x))) AS INT) AS bad_json, CAST(len(regexp_extract_all(txt, '(%[0-9A-Fa-f]?[G-Zg-z])', 1)) AS INT) AS bad_percent FROM b""")
def doc_blocks(t):
    text = F.concat(F.lit("# t\n```json\n"), F.when(F.col("event_type") == "error", "{bad").otherwise(F.col("props")), F.lit("\n```\n"),
                    F.when(F.col("event_id") % 3 == 0, "%zz").otherwise("%2f"))
    return L.doc_blocks(t.events.select("event_id", text.alias("text")))


@query("J26_false_positive_notes", f"""WITH {CODE_SQL}, x AS ({' UNION ALL '.join(f'SELECT {lit(i)} AS fp_id, project FROM src WHERE regexp_matches(code, {lit(rx)})' for i, rx in L.FALSE_POSITIVES)}) SELECT fp_id, COUNT(*) AS lines FROM x GROUP BY 1""")
def fp_notes(t):
    n = L.false_positive_notes(code(t).select("code"))
    return n.select(F.explode("fp_ids").alias("fp_id")).groupBy("fp_id").agg(F.count("*").alias("lines"))


@query("J35_event_edges", rf"""WITH {CODE_SQL}, {DEPTH_SQL}, f AS (SELECT project, path, line, in_function, regexp_extract(code, 'dispatch\s*\(\s*(?:new\s+)?(\w+)', 1) AS event FROM scoped WHERE regexp_matches(code, 'dispatch\s*\(\s*(?:new\s+)?\w+')),
l AS (SELECT DISTINCT project, regexp_extract(code, '(\w+)::class\s*=>\s*\[?\s*(\w+)::class', 1) AS event, regexp_extract(code, '(\w+)::class\s*=>\s*\[?\s*(\w+)::class', 2) AS listener FROM scoped WHERE regexp_matches(code, '(\w+)::class\s*=>\s*\[?\s*(\w+)::class'))
SELECT project, event, path, line, in_function, listener FROM f JOIN l USING (project, event)""")
def event_edges(t):
    return I.event_edges(scoped(t))


HUB_SQL = rf"""cs AS (SELECT ca.*, s.in_class, s.in_function, COALESCE(s.in_class || '::' || s.in_function, s.in_function, 'file:' || ca.path) AS site, COALESCE(regexp_extract(b.tok, '(\w+)$', 1), '') AS klass,
 COALESCE(b.tok, '') AS prior FROM ca JOIN scoped s USING (project, path, line) LEFT JOIN t4 b ON b.project = ca.project AND b.path = ca.path AND b.pos = ca.pos - 1),
nm AS (SELECT *, COALESCE(NULLIF(regexp_extract(arg1, '^\\?(\w+)::class$', 1), ''), NULLIF(regexp_extract(arg1, '^[\x27\x22]([\w./:-]+)[\x27\x22]$', 1), '')) AS n1,
 COALESCE(NULLIF(regexp_extract(arg2, '^\\?(\w+)::class$', 1), ''), NULLIF(regexp_extract(arg2, '^[\x27\x22]([\w./:-]+)[\x27\x22]$', 1), '')) AS n2 FROM cs),
hd AS (SELECT project, regexp_extract(code, '^\s*(?:abstract\s+|final\s+|readonly\s+)*(?:class|interface)\s+(\w+)', 1) AS name, code FROM scoped WHERE regexp_matches(code, '^\s*(?:abstract\s+|final\s+|readonly\s+)*(?:class|interface)\s+\w')),
hr AS (SELECT DISTINCT project, name, regexp_extract(trim(unnest(list_concat(string_split_regex(regexp_extract(code, '\bextends\s+([\w\\, ]+)', 1), '\s*,\s*|\s+implements.*'), string_split_regex(regexp_extract(code, '\bimplements\s+([\w\\, ]+)', 1), '\s*,\s*')))), '(\w+)$', 1) AS parent FROM hd),
md AS (SELECT DISTINCT project, in_class, regexp_extract(code, '\bfunction\s+&?(\w+)\s*\(', 1) AS name FROM scoped WHERE regexp_matches(code, '\bfunction\s+&?\w+\s*\(')),
sn AS (SELECT project, site, token, CASE WHEN token IN ('::dispatch', '::dispatchNow') AND klass NOT IN ('Event', 'Bus', 'Queue', '') THEN [klass]
 ELSE list_transform(regexp_extract_all(COALESCE(CASE token WHEN '::later' THEN arg2 ELSE arg1 END, ''), '(?:new\s+\\?\w+|\\?\w+::class)'), lambda x: regexp_extract(replace(x, '::class', ''), '(\w+)$', 1)) END AS names
 FROM cs WHERE token IN ({', '.join(lit(x) for x in C.SEND)})),
sx AS (SELECT project, site, token, unnest(names) AS name, generate_subscripts(names, 1) - 1 AS pos FROM sn),
ls AS (SELECT project, regexp_extract(code, '(\w+)::class\s*=>', 1) AS event, regexp_extract_all(regexp_extract(code, '=>(.*)$', 1), '(\w+)::class', 1) AS names FROM scoped WHERE regexp_matches(code, '\w+::class\s*=>')),
tw AS (SELECT project, site, list_transform(regexp_extract_all(COALESCE(arg1, ''), '(?:new\s+\\?\w+|\\?\w+::class)'), lambda x: regexp_extract(replace(x, '::class', ''), '(\w+)$', 1)) AS names FROM cs WHERE token IN ({', '.join(lit(x) for x in C.THROUGH)})),
eg AS (SELECT DISTINCT * FROM (
 SELECT project, 'service:' || n1 AS src, 'service:' || n2 AS dst, 'container' AS kind, 0 AS cost, 0 AS seq FROM nm WHERE token IN ({', '.join(lit(x) for x in C.BIND)})
 UNION ALL SELECT project, site, 'service:' || n1, 'container', 1, 0 FROM nm WHERE token IN ({', '.join(lit(x) for x in C.RESOLVE)})
 UNION ALL SELECT project, 'service:' || parent, 'service:' || name, 'implements', 0, 0 FROM hr WHERE parent <> ''
 UNION ALL SELECT project, 'service:' || in_class, in_class || '::' || name, 'method', 0, 0 FROM md WHERE in_class IS NOT NULL
 UNION ALL SELECT project, site, 'hook:' || n1, 'hook', 1, 0 FROM nm WHERE token IN ({', '.join(lit(x) for x in C.FIRE)}) AND left(arg1, 1) IN (chr(39), chr(34))
 UNION ALL SELECT project, 'hook:' || n1, n2, 'hook', 0, COALESCE(TRY_CAST(arg3 AS INT), {C.DEFAULT_PRIORITY}) FROM nm WHERE token IN ({', '.join(lit(x) for x in C.HOOK)}) AND left(arg1, 1) IN (chr(39), chr(34)) AND left(arg2, 1) IN (chr(39), chr(34))
 UNION ALL SELECT project, 'message:' || n1, n2 || '::handle', 'message', 0, 0 FROM nm WHERE token = '::listen' AND arg1 LIKE '%::class' AND arg2 LIKE '%::class'
 UNION ALL SELECT project, site, 'message:' || name, 'message', 1, pos FROM sx
 UNION ALL SELECT project, 'message:' || name, name || CASE token WHEN '::push' THEN '::fire' ELSE '::handle' END, 'message', 0, 0 FROM sx
 UNION ALL SELECT project, 'message:' || event, unnest(names) || '::handle', 'message', 0, generate_subscripts(names, 1) - 1 FROM ls
 UNION ALL SELECT project, site, unnest(names) || '::handle', 'pipeline', 1, generate_subscripts(names, 1) - 1 FROM tw)
 WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst)"""


def hidden(t):
    calls, lines = C.facts(scoped(t))
    return C.hidden_edges(calls, lines), calls, lines


@query("J35_hidden_edges", f"WITH {CODE_SQL}, {DEPTH_SQL}, {WITH_ARGS}, {HUB_SQL} SELECT project, src, dst, kind, CAST(cost AS INT) AS cost, CAST(seq AS INT) AS seq FROM eg")
def hidden_edges(t):
    return hidden(t)[0]


SINK_CALLS = ["system", "exec", "passthru", "eval", "shell_exec"]
READS = r"\$_(?:GET|POST|COOKIE|FILES)\b"


@query("J34_hidden_walk", rf"""WITH RECURSIVE {CODE_SQL}, {DEPTH_SQL}, {WITH_ARGS}, {HUB_SQL},
ed AS (SELECT DISTINCT project, src, dst, cost FROM eg WHERE src <> dst UNION
 SELECT cs.project, site, token, 1 FROM cs JOIN md ON md.project = cs.project AND md.in_class IS NULL AND md.name = token WHERE site <> token UNION
 SELECT project, site, CASE WHEN klass IN ('self', 'static') THEN in_class ELSE klass END || token, 1 FROM cs WHERE starts_with(token, '::') AND regexp_matches(prior, '^\w+$') AND site <> COALESCE(CASE WHEN klass IN ('self', 'static') THEN in_class ELSE klass END || token, site) UNION
 SELECT project, site, in_class || '::' || substr(token, 3), 1 FROM cs WHERE starts_with(token, '->') AND prior = '$this' AND in_class IS NOT NULL AND site <> in_class || '::' || substr(token, 3)),
so AS (SELECT DISTINCT project, COALESCE(in_class || '::' || in_function, in_function, 'file:' || path) AS node FROM scoped WHERE regexp_matches(code, '{READS}')),
sk AS (SELECT DISTINCT project, site AS node FROM cs WHERE token IN ({', '.join(lit(x) for x in SINK_CALLS)})),
w(project, node, depth) AS (SELECT project, node, 0 FROM so UNION SELECT e.project, e.dst, w.depth + e.cost FROM w JOIN ed e ON e.project = w.project AND e.src = w.node WHERE w.depth + e.cost <= 10),
m AS (SELECT project, node, min(depth) AS depth FROM w GROUP BY 1, 2),
c(project, node) AS (SELECT DISTINCT project, dst FROM ed WHERE cost = 1 UNION SELECT e.project, e.dst FROM c JOIN ed e ON e.project = c.project AND e.src = c.node WHERE e.cost = 0)
SELECT sk.project, sk.node, CAST(m.depth AS INT) AS depth, CASE WHEN m.node IS NOT NULL THEN 'source_found' WHEN c.node IS NOT NULL THEN 'not_reached' ELSE 'no_caller' END AS stop
FROM sk LEFT JOIN m USING (project, node) LEFT JOIN (SELECT DISTINCT * FROM c) c USING (project, node)""")
def hidden_walk(t):
    edges, calls, lines = hidden(t)
    every = edges.drop("seq", "kind").unionByName(C.direct_edges(calls, lines).drop("seq", "kind")).distinct()
    sources = lines.where(F.col("code").rlike(READS)).select("project", C.caller().alias("node"))
    sinks = calls.where(F.col("token").isin(SINK_CALLS)).select("project", C.caller().alias("node"))
    return C.hidden_walk(sinks, every, sources)


# --- platform and dependency facts ---------------------------------------------------------

@query("S20_framework", f"""WITH r(package, name, k) AS (VALUES {values([(p, n, i) for i, (p, n) in enumerate(I.FRAMEWORKS)])}),
j AS (SELECT q.project, r.name, r.k FROM fx_require q LEFT JOIN r ON q.package = r.package) SELECT project, COALESCE(arg_min(name, k), 'Native') AS framework FROM j GROUP BY 1""")
def framework(t):
    return I.framework_of(t.fx_require)


@query("S21_php_floor", f"""WITH {CODE_SQL} SELECT project, CAST(max(CASE WHEN regexp_matches(code, {lit(I.SYNTAX[0][1])}) THEN 801 WHEN regexp_matches(code, {lit(I.SYNTAX[1][1])}) THEN 800 WHEN regexp_matches(code, {lit(I.SYNTAX[2][1])}) THEN 704 ELSE 702 END) AS INT) AS php_floor FROM src GROUP BY 1""")
def floor(t):
    return I.syntax_floor(code(t))


@query("S22_database_type", """SELECT project, COALESCE(max(CASE package WHEN 'ext-pdo_mysql' THEN 'mysql' END), max(CASE package WHEN 'ext-pdo_pgsql' THEN 'pgsql' END), 'mysql') AS db_type FROM fx_require GROUP BY 1""")
def database(t):
    return I.database_type(t.fx_require)


CMS_CASE = " ".join(f"WHEN regexp_matches(path, {lit(rx)}) THEN {i}" for i, (_, rx) in enumerate(P.CMS_FILES))


@query("S20_content_system", f"""WITH k AS (SELECT project, min(CASE {CMS_CASE} END) AS k FROM fx_tree GROUP BY 1) SELECT project, {[n for n, _ in P.CMS_FILES]}[k + 1] AS cms FROM k WHERE k IS NOT NULL""")
def content_system(t):
    return P.cms_of(t.fx_tree)


@query("S20_components", " UNION ".join(f"SELECT project, '{k}' AS kind, regexp_extract(path, {lit(rx)}, 1) AS name FROM fx_tree WHERE regexp_matches(path, {lit(rx)})" for k, rx in P.COMPONENTS))
def components(t):
    return P.cms_parts(t.fx_tree)


@query("S20_content_version", rf"""WITH {CODE_SQL}, v AS (SELECT project, regexp_extract(code, '\$wp_version\s*=\s*[\x27\x22]([\w.-]+)[\x27\x22]', 1) AS v FROM src)
SELECT project, max_by(v, CASE v WHEN '6.4.2' THEN 1 ELSE 2 END) AS version FROM v WHERE v <> '' GROUP BY 1""")
def content_version(t):
    return P.cms_version(code(t))


SIGNAL_SQL = " UNION ALL ".join(f"SELECT project, {r} AS signal, {f'regexp_extract(code, {lit(rx)}, 1)' if k is None else lit(k)} AS db_type FROM src WHERE regexp_matches(code, {lit(rx)})" for r, rx, k in P.DATABASE_SIGNALS)


@query("S22_database_signals", f"""WITH {CODE_SQL}, s AS ({SIGNAL_SQL} UNION ALL SELECT project, 3, substr(package, 9) FROM fx_require WHERE package IN ('ext-pdo_mysql', 'ext-pdo_pgsql')
 UNION ALL SELECT project, 7, 'mysql' FROM (SELECT project FROM src UNION SELECT project FROM fx_require)),
m AS (SELECT project, min({{'a': signal, 'b': db_type}}) AS s FROM s GROUP BY 1) SELECT project, s.b AS db_type, CAST(s.a AS INT) AS signal FROM m""")
def database_signals(t):
    return P.database_of(code(t), t.fx_require)


MINIMA_SQL = " ".join(f"WHEN framework = '{f}' AND fw_major >= {m} THEN {v}" for f, m, v in sorted(P.PHP_MINIMA, key=lambda r: (r[0], -r[1])))


@query("X05_php_minimum", f"""WITH {CODE_SQL}, e AS (SELECT project, 700 + (v_minor % 5) + CASE WHEN is_dev THEN 100 ELSE 0 END AS floor, 0 AS p, 'constraint' AS kind FROM fx_packages
 UNION ALL SELECT project, CASE WHEN regexp_matches(code, {lit(I.SYNTAX[0][1])}) THEN 801 WHEN regexp_matches(code, {lit(I.SYNTAX[1][1])}) THEN 800 WHEN regexp_matches(code, {lit(I.SYNTAX[2][1])}) THEN 704 ELSE 702 END, -1, 'syntax' FROM src
 UNION ALL SELECT project, CASE {MINIMA_SQL} END, -2, 'framework' FROM fx_targets),
m AS (SELECT project, max({{'f': floor, 'p': p, 'k': kind}}) AS b FROM e WHERE floor IS NOT NULL GROUP BY 1) SELECT project, CAST(b.f AS INT) AS php_min, b.k AS decided_by FROM m""")
def php_minimum(t):
    rule = F.concat(F.when(F.col("is_dev"), ">=8.").otherwise("^7."), (F.col("v_minor") % 5).cast("string"), F.lit(" || ^9"))
    composer = t.fx_packages.select("project", P.constraint_minimum(rule).alias("floor"))
    syntax = I.syntax_floor(code(t)).select("project", F.col("php_floor").alias("floor"))
    frameworks = t.fx_targets.select("project", P.framework_minimum(F.col("framework"), F.col("fw_major")).alias("floor"))
    return P.php_minimum([("constraint", composer), ("syntax", syntax), ("framework", frameworks)])


@query("S43_maintenance_flags", """
WITH x AS (SELECT package, unnest(list_filter([CASE WHEN age_months > 24 THEN 'stale:high' END, CASE WHEN stars < 50 THEN 'few_stars:medium' END, CASE WHEN open_issues > 5 THEN 'open_security_issues:high' END,
 CASE WHEN license IS NULL THEN 'no_license:low' END, CASE WHEN maintainers = 1 THEN 'single_maintainer:medium' END, CASE WHEN abandoned THEN 'abandoned:high' END], lambda e: e IS NOT NULL)) AS flag FROM fx_require)
SELECT package, flag, COUNT(*) AS n FROM x GROUP BY 1, 2""")
def maintenance(t):
    f = I.maintenance_flags(F.col("age_months"), F.col("stars"), F.col("open_issues"), F.col("license"), F.col("maintainers"), F.col("abandoned"))
    return t.fx_require.select("package", F.explode(f).alias("flag")).groupBy("package", "flag").agg(F.count("*").alias("n"))


@query("S44_install_scripts", """
WITH u AS (SELECT project, package, p_partkey, script, concat('https://host', CAST(stars % 2 AS VARCHAR)) AS url FROM fx_require),
w AS (SELECT *, lag(url) OVER (PARTITION BY package ORDER BY p_partkey) AS prev FROM u)
SELECT package, COUNT(*) FILTER (regexp_matches(script, '(?i)\\beval\\b|base64_decode|\\bcurl\\b')) AS suspicious, COUNT(*) FILTER (prev IS NOT NULL AND prev <> url) AS changed_source FROM w GROUP BY 1""")
def scripts(t):
    u = t.fx_require.withColumn("url", F.concat(F.lit("https://host"), (F.col("stars") % 2).cast("string")))
    changed = I.changed_sources(u, ["p_partkey"]).groupBy("package").agg(F.count("*").alias("changed_source"))
    s = u.groupBy("package").agg(F.count_if(I.suspicious_script(F.col("script"))).alias("suspicious"))
    return s.join(changed, "package", "left").fillna(0, ["changed_source"])


@query("S45_risky_extensions", f"WITH r(extension, risk) AS (VALUES {values(I.RISKY_EXTENSIONS.items())}) SELECT e.extension, risk, COUNT(*) AS n FROM fx_require e JOIN r ON lower(e.extension) = r.extension GROUP BY 1, 2")
def extensions(t):
    return t.fx_require.groupBy("extension").agg(F.count("*").alias("n")).withColumn("risk", S.pick(F.lower("extension"), I.RISKY_EXTENSIONS)).where("risk IS NOT NULL")


@query("B12_session_settings", """
SELECT project, key, value, CASE WHEN key = 'session.sid_length' THEN 'short_id' WHEN key = 'session.sid_bits_per_character' THEN 'few_bits' ELSE 'long_lifetime' END AS issue, COUNT(*) AS n FROM fx_ini
WHERE (key = 'session.sid_length' AND CAST(value AS BIGINT) < 48) OR (key = 'session.sid_bits_per_character' AND CAST(value AS BIGINT) < 6) OR (key = 'session.gc_maxlifetime' AND CAST(value AS BIGINT) > 86400) GROUP BY 1, 2, 3, 4""")
def session_settings(t):
    return I.session_setting_issues(t.fx_ini).groupBy("project", "key", "value", "issue").agg(F.count("*").alias("n"))


@query("B12_setting_conflicts", """
WITH a AS (SELECT project, key, min(value) AS ini_value FROM fx_ini WHERE o_orderkey % 2 = 0 GROUP BY 1, 2), b AS (SELECT project, key, min(value) AS runtime_value FROM fx_ini WHERE o_orderkey % 2 = 1 GROUP BY 1, 2)
SELECT * FROM a JOIN b USING (project, key) WHERE ini_value <> runtime_value""")
def conflicts(t):
    even = F.col("o_orderkey") % 2 == 0
    return I.setting_conflicts(t.fx_ini.where(even), t.fx_ini.where(~even))


@query("S26_runtime_settings", """
WITH n AS (SELECT project, key, value, CASE WHEN lower(value) IN ('on') THEN 'on' WHEN lower(value) IN ('off', '') THEN 'off' ELSE lower(value) END AS v FROM fx_ini),
d AS (SELECT DISTINCT project, key, 'dangerous_value' AS issue FROM n WHERE (key IN ('allow_url_include','allow_url_fopen','display_errors','expose_php','register_argc_argv') AND v = 'on')
 OR (key IN ('session.cookie_httponly','session.cookie_secure','session.use_strict_mode') AND v = 'off')),
p AS (SELECT DISTINCT project FROM fx_ini), m(key) AS (VALUES ('open_basedir'), ('disable_functions'))
SELECT * FROM d UNION ALL SELECT project, key, 'not_set' FROM p, m WHERE NOT EXISTS (SELECT 1 FROM fx_ini i WHERE i.project = p.project AND i.key = m.key AND i.value <> '')""")
def runtime(t):
    return H.runtime_findings(t.fx_ini)


@query("B16_forgery_gaps", """
SELECT route_id, CASE WHEN method IN ('POST','PUT','PATCH','DELETE') THEN 'no_token_check' ELSE 'state_change_by_get' END AS issue FROM fx_routes
WHERE (method IN ('POST','PUT','PATCH','DELETE') AND NOT regexp_matches(middleware, '(^|,)(csrf|web)')) OR (method = 'GET' AND regexp_matches(url, '(?i)delete|remove|update|create|payment|transfer'))""")
def forgery(t):
    return I.forgery_gaps(t.fx_routes).select("route_id", "issue")


@query("B17_auth_types", f"""WITH {CODE_SQL}, x AS ({' UNION ALL '.join(f'SELECT project, {lit(n)} AS a FROM src WHERE regexp_matches(code, {lit(rx)})' for n, rx in I.AUTH_SIGNATURES)}) SELECT project, array_to_string(list_sort(list(DISTINCT a)), ',') AS auth_types FROM x GROUP BY 1""")
def auth_types(t):
    return I.auth_types(code(t)).withColumn("auth_types", F.array_join("auth_types", ","))


CMS_SQL = "concat('/*', chr(10), ' * ', CASE p_size % 3 WHEN 0 THEN 'Plugin Name: ' WHEN 1 THEN 'Theme Name: ' ELSE 'Something: ' END, p_name, chr(10), ' * Version: ', CAST(p_size AS VARCHAR), '.', CAST(p_partkey % 10 AS VARCHAR), chr(10), ' */')"


@query("B18_cms_components", f"""WITH f AS (SELECT {CMS_SQL} AS text FROM part)
SELECT CASE WHEN contains(text, 'Plugin Name:') THEN 'plugin' ELSE 'theme' END AS kind, regexp_extract(text, '(?im)^[\\s*]*(?:Plugin|Theme) Name:\\s*(.+?)\\s*$', 1) AS name,
 regexp_extract(text, '(?im)^[\\s*]*Version:\\s*([0-9][\\w.]*)', 1) AS version, COUNT(*) AS n FROM f WHERE contains(text, 'Plugin Name:') OR contains(text, 'Theme Name:') GROUP BY 1, 2, 3""")
def cms(t):
    text = F.concat(F.lit("/*\n * "), S.pick(F.col("p_size") % 3, {0: "Plugin Name: ", 1: "Theme Name: "}, "Something: "), F.col("p_name"), F.lit("\n * Version: "),
                    F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 10).cast("string"), F.lit("\n */"))
    return I.cms_components(t.part.select(text.alias("text"))).groupBy("kind", "name", "version").agg(F.count("*").alias("n"))


@query("B18_open_rest_routes", f"WITH {CODE_SQL} SELECT project, path, line FROM src WHERE regexp_matches(code, 'register_rest_route\\s*\\(') AND NOT contains(code, 'permission_callback')")
def open_rest(t):
    return I.open_rest_routes(code(t))


# --- recorded HTTP -------------------------------------------------------------------------

def responses(t):
    h = t.fx_http
    pair = lambda name, c: F.when(F.col(c).isNotNull(), F.struct(F.lit(name).alias("k"), F.col(c).alias("v")))
    m = F.map_from_entries(F.array_compact(F.array(pair("X-Content-Type-Options", "h_x_content_type_options"), pair("Strict-Transport-Security", "h_hsts"),
                                                   pair("Access-Control-Allow-Origin", "h_acao"), F.when(F.col("page_id") % 7 == 0, F.struct(F.lit("X-Powered-By").alias("k"), F.lit("PHP/7").alias("v"))))))
    return h.select("page_id", m.alias("headers"))


@query("S23_security_headers", """
WITH h AS (SELECT 'missing_header' AS kind, 'x-frame-options' AS header, 'medium' AS severity, page_id FROM fx_http UNION ALL SELECT 'missing_header', 'content-security-policy', 'high', page_id FROM fx_http
 UNION ALL SELECT 'missing_header', 'referrer-policy', 'low', page_id FROM fx_http UNION ALL SELECT 'missing_header', 'permissions-policy', 'low', page_id FROM fx_http
 UNION ALL SELECT 'missing_header', 'strict-transport-security', 'high', page_id FROM fx_http WHERE h_hsts IS NULL UNION ALL SELECT 'missing_header', 'x-content-type-options', 'low', page_id FROM fx_http WHERE h_x_content_type_options IS NULL
 UNION ALL SELECT 'information_leak', 'x-powered-by', 'low', page_id FROM fx_http WHERE page_id % 7 = 0)
SELECT kind, header, severity, COUNT(*) AS responses FROM h GROUP BY 1, 2, 3""")
def headers(t):
    return H.header_findings(responses(t)).groupBy("kind", "header", "severity").agg(F.count("*").alias("responses"))


@query("S24_cors", """
SELECT h_acao, acac, CASE WHEN h_acao = '*' AND acac THEN 'wildcard_with_credentials' WHEN h_acao = 'null' AND acac THEN 'null_origin' WHEN h_acao = 'https://evil.example' AND acac THEN 'reflected_origin' END AS issue, COUNT(*) AS responses
FROM fx_http GROUP BY 1, 2, 3""")
def cors(t):
    g = t.fx_http.groupBy("h_acao", "acac").agg(F.count("*").alias("responses"))
    return g.withColumn("issue", H.cors_issue(F.lit("https://evil.example"), F.col("h_acao"), F.col("acac")))


COOKIE = "concat('sid=', CAST(event_id AS VARCHAR), CASE event_id % 3 WHEN 0 THEN '; HttpOnly' ELSE '' END, CASE event_id % 4 WHEN 0 THEN '; Secure' ELSE '' END, CASE event_type WHEN 'view' THEN '; SameSite=Lax' WHEN 'click' THEN '; SameSite=None' ELSE '' END)"


@query("S25_cookie_flags", f"""WITH c AS (SELECT {COOKIE} AS c FROM events), x AS (SELECT unnest(list_filter([CASE WHEN NOT regexp_matches(c, '(?i);\\s*httponly') THEN 'no_httponly' END, CASE WHEN NOT regexp_matches(c, '(?i);\\s*secure') THEN 'no_secure' END,
 CASE WHEN NOT regexp_matches(c, '(?i);\\s*samesite\\s*=') THEN 'no_samesite' END, CASE WHEN regexp_matches(c, '(?i);\\s*samesite\\s*=\\s*none') THEN 'samesite_none' END], lambda e: e IS NOT NULL)) AS issue FROM c) SELECT issue, COUNT(*) AS cookies FROM x GROUP BY 1""")
def cookies(t):
    c = F.concat(F.lit("sid="), F.col("event_id").cast("string"), F.when(F.col("event_id") % 3 == 0, "; HttpOnly").otherwise(""), F.when(F.col("event_id") % 4 == 0, "; Secure").otherwise(""),
                 S.pick(F.col("event_type"), {"view": "; SameSite=Lax", "click": "; SameSite=None"}, ""))
    return t.events.select(F.explode(H.cookie_issues(c)).alias("issue")).groupBy("issue").agg(F.count("*").alias("cookies"))


@query("S27_token_hygiene", """
WITH k AS (SELECT *, json_extract_string(head, '$.alg') AS alg, CAST(json_extract_string(payload, '$.exp') AS BIGINT) AS e, CAST(json_extract_string(payload, '$.iat') AS BIGINT) AS i, json_extract_string(head, '$.kid') AS kid FROM fx_tokens),
x AS (SELECT user_id, unnest(list_filter([CASE WHEN lower(alg) = 'none' THEN 'alg_none' END, CASE WHEN lower(alg) LIKE 'hs%' THEN 'hmac_alg' END, CASE WHEN e IS NULL THEN 'no_expiry' END, CASE WHEN e - i > 3600 THEN 'long_lived' END,
 CASE WHEN contains(kid, '/') THEN 'odd_kid' END], lambda z: z IS NOT NULL)) AS issue FROM k) SELECT issue, COUNT(*) AS tokens, COUNT(DISTINCT user_id) AS users FROM x GROUP BY 1""")
def tokens(t):
    enc = lambda c: F.regexp_replace(F.translate(F.base64(F.encode(F.col(c), "UTF-8")), "+/", "-_"), "=+$", "")
    token = F.concat_ws(".", enc("head"), enc("payload"), F.lit("c2ln"))
    rows = t.fx_tokens.select("user_id", F.explode(H.token_issues(token)).alias("issue"))
    return rows.groupBy("issue").agg(F.count("*").alias("tokens"), F.countDistinct("user_id").alias("users"))


WAF_TEXT = "CASE page_id % 6 WHEN 0 THEN 'Server: cloudflare' WHEN 1 THEN 'x-amzn-RequestId: 1 wordfence' WHEN 2 THEN 'openresty' WHEN 3 THEN 'mod_security noyb' WHEN 4 THEN 'ali-cdn safedog' ELSE 'nginx' END"


@query("S29_firewalls", f"""WITH b AS (SELECT lower({WAF_TEXT}) AS b FROM pages) SELECT CASE {' '.join(f"WHEN {' OR '.join(f'contains(b, {lit(x)})' for x in pats)} THEN {lit(n)}" for n, pats in reversed(H.FIREWALLS))} ELSE 'none' END AS waf_type,
 array_to_string(list_filter([{', '.join(f'CASE WHEN contains(b, {lit(x)}) THEN {lit(x)} END' for _, pats in H.FIREWALLS for x in pats)}], lambda e: e IS NOT NULL), ',') AS signatures, COUNT(*) AS responses FROM b GROUP BY 1, 2""")
def firewalls(t):
    text = S.pick(F.col("page_id") % 6, {0: "Server: cloudflare", 1: "x-amzn-RequestId: 1 wordfence", 2: "openresty", 3: "mod_security noyb", 4: "ali-cdn safedog"}, "nginx")
    w = t.pages.select(H.firewall_of(text).alias("w"))
    return w.groupBy("w.waf_type", F.array_join("w.signatures", ",").alias("signatures")).agg(F.count("*").alias("responses"))


RAW = "concat('HTTP/1.1 302 Found', chr(13), chr(10), 'X-A: 1', chr(13), chr(10), CASE page_id % 3 WHEN 0 THEN 'LOCATION: /home' WHEN 1 THEN concat('Location: ', url) ELSE 'Via: p' END, chr(13), chr(10), 'x-a: 2')"


def raw_headers():
    return F.concat(F.lit("HTTP/1.1 302 Found\r\nX-A: 1\r\n"), F.when(F.col("page_id") % 3 == 0, "LOCATION: /home").when(F.col("page_id") % 3 == 1, F.concat(F.lit("Location: "), F.col("url"))).otherwise("Via: p"), F.lit("\r\nx-a: 2"))


@query("R10_header_map", """SELECT page_id, '2' AS x_a, CASE page_id % 3 WHEN 0 THEN '/home' WHEN 1 THEN url END AS location, CASE page_id % 3 WHEN 2 THEN 'p' END AS via FROM pages""")
def header_map(t):
    m = t.pages.select("page_id", R.parse_headers(raw_headers()).alias("h"))
    return m.select("page_id", F.col("h")["x-a"].alias("x_a"), F.col("h")["location"].alias("location"), F.col("h")["via"].alias("via"))


@query("R11_locations", f"SELECT page_id, nullif(trim(regexp_extract({RAW}, '(?im)^Location:[ \\t]*([^\\r\\n]+)', 1)), '') AS location, CASE page_id % 5 WHEN 1 THEN true ELSE false END AS is_redirect FROM pages")
def locations(t):
    status = S.pick(F.col("page_id") % 5, {0: 403, 1: 302}, 200)
    return t.pages.select("page_id", R.location_of(raw_headers()).alias("location"), R.is_redirect(status).alias("is_redirect"))


@query("B20_cached_private", """
WITH x AS (SELECT page_id, url, CASE WHEN page_id % 4 = 0 AND page_id % 3 = 0 THEN 'cookie_in_cache' WHEN page_id % 2 = 0 AND regexp_matches(concat('/profile/', CAST(page_id AS VARCHAR), CASE page_id % 3 WHEN 1 THEN '.css' ELSE '' END), '\\.(css|js|png|jpg|gif|ico|svg|woff2?)$') THEN 'static_suffix_on_dynamic' END AS issue FROM pages)
SELECT issue, COUNT(*) AS responses FROM x GROUP BY 1""")
def cached(t):
    p = F.col("page_id")
    path = F.concat(F.lit("/profile/"), p.cast("string"), F.when(p % 3 == 1, ".css").otherwise(""))
    return t.pages.groupBy(H.cached_private(p % 4 == 0, p % 3 == 0, path, p % 2 == 0).alias("issue")).agg(F.count("*").alias("responses"))


@query("B21_dangling_aliases", """
WITH a AS (SELECT s_suppkey, concat('h', CAST(s_suppkey AS VARCHAR), '.', CASE s_suppkey % 4 WHEN 0 THEN 'github.io' WHEN 1 THEN 'cloudfront.net' WHEN 2 THEN 'example.org' ELSE 'herokuapp.com' END) AS cname, s_nationkey % 2 = 0 AS resolves FROM supplier)
SELECT s_suppkey, cname FROM a WHERE NOT resolves AND regexp_matches(cname, '(github\\.io|cloudfront\\.net|herokuapp\\.com)$')""")
def dangling(t):
    cname = F.concat(F.lit("h"), F.col("s_suppkey").cast("string"), F.lit("."), S.pick(F.col("s_suppkey") % 4, {0: "github.io", 1: "cloudfront.net", 2: "example.org"}, "herokuapp.com"))
    a = t.supplier.select("s_suppkey", cname.alias("cname"), (F.col("s_nationkey") % 2 == 0).alias("resolves"))
    return a.where(H.dangling_alias(F.col("cname"), F.col("resolves"))).select("s_suppkey", "cname")


# --- traces --------------------------------------------------------------------------------

ORDER = ["func_nr", "level", "function", "k1", "k2", "k3", "k4"]
FRAME_SQL = """n AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY func_nr, level, function, k1, k2, k3, k4) AS rn FROM fx_frames WHERE function NOT IN ('spl_autoload_call', 'class_exists')),
st(trace_id, rn, stack) AS (SELECT trace_id, rn, [function] FROM n WHERE rn = 1
 UNION ALL SELECT n.trace_id, n.rn, list_append(st.stack[1:n.level - 1], n.function) FROM st JOIN n ON n.trace_id = st.trace_id AND n.rn = st.rn + 1)"""
SINKS_SQL = "('DB::raw', 'system')"


@query("S32_base_names", f"WITH x AS (SELECT function, CASE function WHEN 'DB::raw' THEN 'raw' WHEN 'UserController->show' THEN 'show' WHEN 'Router::dispatch' THEN 'dispatch' ELSE function END AS base FROM fx_frames) SELECT function, base, base IN ('raw', 'system') AS is_sink, COUNT(*) AS n FROM x GROUP BY 1, 2, 3")
def base_names(t):
    b = t.fx_frames.groupBy("function").agg(F.count("*").alias("n")).withColumn("base", T.base_name("function"))
    return b.withColumn("is_sink", F.col("base").isin(T.TRACE_SINKS))


@query("S33_noise", "SELECT trace_id, COUNT(*) AS frames, COUNT(*) FILTER (function IN ('spl_autoload_call', 'class_exists')) AS noise FROM fx_frames GROUP BY 1")
def noise(t):
    return t.fx_frames.groupBy("trace_id").agg(F.count("*").alias("frames"), F.count_if(T.is_noise("function")).alias("noise"))


@query("E12_call_stacks", f"WITH RECURSIVE {FRAME_SQL} SELECT st.trace_id, st.rn, array_to_string(stack, '>') AS call_path FROM st JOIN n ON n.trace_id = st.trace_id AND n.rn = st.rn WHERE n.function IN {SINKS_SQL}")
def call_stacks(t):
    c = T.sink_chains(t.fx_frames, ORDER)
    return c.select("trace_id", "rn", F.array_join("call_path", ">").alias("call_path"))


@query("E13_trimmed_chains", f"""WITH RECURSIVE {FRAME_SQL}, c AS (SELECT st.trace_id, st.rn, len(stack) AS d FROM st JOIN n ON n.trace_id = st.trace_id AND n.rn = st.rn WHERE n.function IN {SINKS_SQL}),
b AS (SELECT *, COALESCE(SUM(d) OVER (PARTITION BY trace_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c) SELECT trace_id, COUNT(*) AS chains FROM b WHERE trace_id % 2 = 0 OR before < 3 GROUP BY 1""")
def trimmed(t):
    sizes = t.orders.select(F.col("o_orderkey").alias("trace_id"), F.when(F.col("o_orderkey") % 2 == 0, 100).otherwise(T.LARGE_BYTES + 1).alias("bytes"))
    return T.trim_chains(T.sink_chains(t.fx_frames, ORDER), sizes, lines=3).groupBy("trace_id").agg(F.count("*").alias("chains"))


TRACE_LINE = "concat(CAST(level AS VARCHAR), chr(9), CAST(func_nr AS VARCHAR), chr(9), CASE k2 % 3 WHEN 0 THEN '0' WHEN 1 THEN '1' ELSE 'R' END, chr(9), '0.1', chr(9), '100', chr(9), function, chr(9), '1', chr(9), '', chr(9), 'a.php', chr(9), CAST(k1 AS VARCHAR))"


@query("R09_trace_frames", "SELECT trace_id, function, COUNT(*) AS frames, SUM(level)::BIGINT AS levels, SUM(k1)::BIGINT AS lines FROM fx_frames WHERE k2 % 3 = 0 GROUP BY 1, 2")
def trace_frames(t):
    col = lambda c: F.col(c).cast("string")
    text = F.concat_ws("\t", col("level"), col("func_nr"), S.pick(F.col("k2") % 3, {0: "0", 1: "1"}, "R"), F.lit("0.1"), F.lit("100"), F.col("function"), F.lit("1"), F.lit(""), F.lit("a.php"), col("k1"))
    f = T.trace_frames(t.fx_frames.select("trace_id", text.alias("value")))
    return f.groupBy("trace_id", "function").agg(F.count("*").alias("frames"), F.sum("level").alias("levels"), F.sum("line").alias("lines"))


@query("S34_trace_quality", """
WITH g AS (SELECT trace_id, COUNT(*) AS n, COUNT(*) FILTER (function IN ('DB::raw','system')) AS sinks, COUNT(*) FILTER (function NOT IN ('spl_autoload_call','class_exists','Router::dispatch')) AS business FROM fx_frames GROUP BY 1)
SELECT CASE WHEN sinks > 0 THEN 'valid' WHEN business = 0 THEN 'route_missed' ELSE 'no_sink' END AS quality, COUNT(*) AS traces FROM g GROUP BY 1""")
def trace_quality(t):
    g = t.fx_frames.groupBy("trace_id").agg(
        F.count("*").alias("n"), F.count_if(T.base_name("function").isin(T.TRACE_SINKS)).alias("sinks"),
        F.count_if(~T.is_noise("function") & (F.col("function") != "Router::dispatch")).alias("business"))
    q = T.trace_quality(F.col("n"), F.col("sinks"), F.col("business"), F.lit(False), F.lit(False))
    return g.groupBy(q.alias("quality")).agg(F.count("*").alias("traces"))


@query("S35_error_vs_sink", """
WITH g AS (SELECT trace_id, min(CASE WHEN k2 % 10 = 0 THEN func_nr END) AS e, min(CASE WHEN function IN ('DB::raw','system') THEN func_nr END) AS s FROM fx_frames GROUP BY 1)
SELECT CASE WHEN e IS NULL THEN 'none' WHEN s IS NULL OR e < s THEN 'before_sink' ELSE 'after_sink' END AS place, COUNT(*) AS traces FROM g GROUP BY 1""")
def error_place(t):
    g = t.fx_frames.groupBy("trace_id").agg(
        F.min(F.when(F.col("k2") % 10 == 0, F.col("func_nr"))).alias("e"), F.min(F.when(T.base_name("function").isin(T.TRACE_SINKS), F.col("func_nr"))).alias("s"))
    return g.groupBy(T.error_vs_sink(F.col("e"), F.col("s")).alias("place")).agg(F.count("*").alias("traces"))


# --- readers over text columns -------------------------------------------------------------

@query("R05_jsonl", "SELECT COUNT(*) FILTER (event_type <> 'error' AND event_id % 5 <> 0) AS good, COUNT(*) FILTER (event_type = 'error' AND event_id % 5 <> 0) AS bad, SUM(CASE WHEN event_type <> 'error' AND event_id % 5 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END)::BIGINT AS total FROM events")
def jsonl(t):
    lines = t.events.select(F.when(F.col("event_id") % 5 == 0, "  ").when(F.col("event_type") == "error", "{oops").otherwise(F.col("props")).alias("value"))
    good, bad = R.parse_jsonl(lines.where(F.trim("value") != ""), "k bigint")
    both = good.select("k", F.lit(True).alias("ok")).unionByName(bad.select(F.lit(None).cast("long").alias("k"), F.lit(False).alias("ok")))
    return both.agg(F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("bad"), F.sum("k").alias("total"))


LOCK = "concat('{\"packages\":[{\"name\":\"', package, '\",\"version\":\"', version, '\"}],\"packages-dev\":[{\"name\":\"dev/', package, '\",\"version\":\"v1.0\"}]}')"


@query("R06_lockfiles", "SELECT package, substr(version, 2) AS version, false AS is_dev, COUNT(*) AS n FROM fx_packages GROUP BY 1, 2 UNION ALL SELECT 'dev/' || package, '1.0', true, COUNT(*) FROM fx_packages GROUP BY 1")
def lockfiles(t):
    doc = F.concat(F.lit('{"packages":[{"name":"'), "package", F.lit('","version":"'), "version", F.lit('"}],"packages-dev":[{"name":"dev/'), "package", F.lit('","version":"v1.0"}]}'))
    return R.lockfile_rows(t.fx_packages.select("project", doc.alias("value"))).groupBy("package", "version", "is_dev").agg(F.count("*").alias("n"))


@query("R07_advisory_batches", """
SELECT vuln_id, package, CASE WHEN cvss >= 9 THEN 'critical' WHEN cvss >= 7 THEN 'high' WHEN cvss >= 4 THEN 'medium' ELSE 'low' END AS severity, CAST(200 AS INT) AS summary_len, CAST(3 AS INT) AS refs FROM fx_advisories""")
def batches(t):
    vuln = F.struct(F.col("vuln_id").alias("id"), F.lit(None).cast("string").alias("severity_text"), F.col("cvss").alias("score"),
                    F.repeat(F.lit("word "), 60).alias("summary"), F.array(*[F.lit(f"r{i}") for i in range(5)]).alias("references"))
    b = t.fx_advisories.select(F.array(F.struct("package")).alias("queries"), F.array(F.struct(F.array(vuln).alias("vulns"))).alias("results"))
    a = R.advisory_batches(b)
    return a.select("vuln_id", "package", "severity", F.length("summary").alias("summary_len"), F.size("references").alias("refs"))


@query("R08_advisory_lists", """
WITH v AS (SELECT DISTINCT split_part(package, '/', 1) AS vendor FROM fx_packages)
SELECT package, CAST(i AS INT) AS pos, concat(vuln_id, '-', CAST(i AS VARCHAR)) AS vuln_id FROM fx_advisories, range(0, 10) r(i) WHERE split_part(package, '/', 1) IN (SELECT vendor FROM v)""")
def lists(t):
    vendors = t.fx_packages.select(F.split("package", "/")[0].alias("vendor")).distinct()
    l = t.fx_advisories.select("package", F.transform(F.sequence(F.lit(0), F.lit(14)), lambda i: F.concat_ws("-", "vuln_id", i.cast("string"))).alias("matches"))
    return R.advisory_lists(l, vendors)


@query("R12_env_pairs", """
SELECT key, value AS val, COUNT(*) AS n FROM fx_ini GROUP BY 1, 2""")
def env_pairs(t):
    lines = t.fx_ini.select(F.concat(F.lit("  "), "key", F.lit(" = \""), "value", F.lit("\"")).alias("value"))
    noise = t.fx_ini.select(F.concat(F.lit("; "), "key", F.lit(" = 1")).alias("value"))
    return R.env_pairs(lines.unionByName(noise)).groupBy("key", "val").agg(F.count("*").alias("n"))


@query("R14_points", "SELECT sanitization, COUNT(*) AS points FROM fx_store_points GROUP BY 1 UNION ALL SELECT output_sanitization, COUNT(*) FROM fx_use_points GROUP BY 1")
def points(t):
    from vulnlake import schemas
    doc = t.fx_store_points.select(F.to_json(F.struct("*")).alias("value"))
    good, _ = R.parse_jsonl(doc, schemas.STORE_POINT)
    use, _ = R.parse_jsonl(t.fx_use_points.select(F.to_json(F.struct("*")).alias("value")), schemas.USE_POINT)
    return good.groupBy("sanitization").agg(F.count("*").alias("points")).unionByName(
        use.groupBy(F.col("output_sanitization").alias("sanitization")).agg(F.count("*").alias("points")))


@query("R15_callbacks", """
SELECT 'callbacks' AS what, COUNT(*) AS value FROM events WHERE event_type = 'signup' UNION ALL
SELECT 'newest', event_id FROM (SELECT event_id FROM events WHERE event_type = 'signup' ORDER BY ts DESC, event_id DESC LIMIT 2)""")
def callbacks(t):
    n, last = R.callback_summary(t.events.where("event_type = 'signup'"))
    return n.select(F.lit("callbacks").alias("what"), F.col("callbacks").alias("value")).unionByName(
        last.select(F.lit("newest").alias("what"), F.col("event_id").alias("value")))


@query("R16_artifacts", """
SELECT l_orderkey AS run, COUNT(DISTINCT l_linenumber) AS present, 7 - COUNT(DISTINCT l_linenumber) AS absent FROM lineitem GROUP BY 1""")
def artifacts(t):
    from vulnlake.operators.quality import gate_results
    m = t.lineitem.select(F.col("l_orderkey").alias("run"), F.concat(F.lit("a"), F.col("l_linenumber").cast("string"), F.lit(".json")).alias("path"))
    g = gate_results(m, {f"gate{i}": [f"a{i}.json"] for i in range(1, 8)})
    return g.groupBy("run").agg(F.count_if("passed").alias("present"), F.count_if(~F.col("passed")).alias("absent"))


@query("R17_access_log", "SELECT client, uri, status, COUNT(*) AS requests, SUM(event_id)::BIGINT AS bytes FROM fx_access GROUP BY 1, 2, 3")
def access_log(t):
    line = F.concat("client", F.lit(" - u"), F.col("user_id").cast("string"), F.lit(' [01/Jan/2024:00:00:00 +0000] "GET '), "uri", F.lit(' HTTP/1.1" '), F.col("status").cast("string"), F.lit(" "), F.col("event_id").cast("string"))
    a = R.access_log(t.fx_access.select(line.alias("value")))
    return a.groupBy("client", "uri", "status").agg(F.count("*").alias("requests"), F.sum("bytes").alias("bytes"))
