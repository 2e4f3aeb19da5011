"""Findings-shaped views over the given tables.

Each view is a projection of one whole table: (source, select expressions).
The expressions read the same in Spark SQL and in DuckDB.
"""

from __future__ import annotations

from vulnlake.plans.corpus import line_sql

FUNCTIONS = (
    "CASE l_partkey % 10 WHEN 0 THEN 'eval' WHEN 1 THEN 'system' WHEN 2 THEN 'unserialize' "
    "WHEN 3 THEN 'include' WHEN 4 THEN 'mysql_query' WHEN 5 THEN 'file_put_contents' "
    "WHEN 6 THEN 'curl_exec' WHEN 7 THEN 'simplexml_load_string' WHEN 8 THEN 'printf' ELSE 'md5' END"
)
SINK_TYPES = (
    "CASE l_partkey % 10 WHEN 0 THEN 'RCE' WHEN 1 THEN 'RCE' WHEN 2 THEN 'Deserialization' "
    "WHEN 3 THEN 'LFI' WHEN 4 THEN 'SQLi' WHEN 5 THEN 'FileWrite' WHEN 6 THEN 'SSRF' "
    "WHEN 7 THEN 'XXE' WHEN 8 THEN 'XSS' ELSE 'Crypto' END"
)


def _s(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def _n(expr: str) -> str:
    return f"CAST(CAST(floor({expr}) AS BIGINT) AS STRING)"


def _bigint(expr: str) -> str:
    return f"CAST(floor({expr}) AS BIGINT)"


def _odd(k: int) -> str:
    """True for one row in 1,511, another one for every k."""
    return f"((l_orderkey * 7 + l_linenumber) % 1511 = {k})"


VERDICT = "CASE l_partkey % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'suspected' WHEN 2 THEN 'potential' ELSE 'not_vulnerable' END"

VIEWS: dict[str, tuple[str, list[str]]] = {
    # scanner reports after normalisation: 37 orders make one file, 10 files one project
    "fx_tool_findings": ("lineitem", [
        f"concat('proj', {_n('l_orderkey / 370')}) AS project",
        f"concat('app/Mod', {_n('l_orderkey / 37')}, '.php') AS file",
        "CAST(l_linenumber * 10 AS INT) AS line",
        f"{FUNCTIONS} AS sink_function",
        f"{SINK_TYPES} AS sink_type",
        "CASE l_suppkey % 5 WHEN 0 THEN 'ast_sinks' WHEN 1 THEN 'psalm' WHEN 2 THEN 'progpilot' "
        "WHEN 3 THEN 'semgrep' ELSE 'codeql' END AS source",
    ]),
    # one row per scored sink, with every axis the scoring rules read
    "fx_sinks": ("lineitem", [
        f"concat('proj', {_n('l_orderkey / 370')}) AS project",
        f"concat('app/Mod', {_n('l_orderkey / 37')}, '.php') AS file",
        "CAST(l_linenumber * 10 AS INT) AS line", f"{SINK_TYPES} AS sink_type",
        "CASE l_suppkey % 3 WHEN 0 THEN 'anonymous' WHEN 1 THEN 'authenticated' ELSE 'admin' END AS auth_level",
        "l_orderkey % 2 = 0 AS filtered",
        "CASE l_linenumber % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'partial' ELSE 'parameterised' END AS control",
        "CASE l_orderkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'blacklist' WHEN 2 THEN 'weak_whitelist' ELSE 'whitelist' END AS filtering",
        "CASE l_suppkey % 4 WHEN 0 THEN 'payment' WHEN 1 THEN 'pii' WHEN 2 THEN 'admin' ELSE 'other' END AS area",
        "CAST(l_suppkey % 4 AS INT) AS r", "CAST(l_partkey % 4 AS INT) AS i", "CAST(l_linenumber % 4 AS INT) AS c",
        "CASE l_orderkey % 3 WHEN 0 THEN 'directly_exploitable' WHEN 1 THEN 'conditionally_exploitable' "
        "ELSE 'not_exploitable' END AS judgment",
        "CAST(l_quantity AS INT) % 11 AS evidence_score",
        "CASE l_partkey % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'suspected' WHEN 2 THEN 'potential' "
        "ELSE 'not_vulnerable' END AS verdict",
        "CASE l_suppkey % 4 WHEN 0 THEN 'RESOLVED' WHEN 1 THEN 'UNRESOLVED' WHEN 2 THEN 'INCOMPLETE' END AS trace_status",
        "l_linenumber % 2 = 0 AS evidence_complete",
        "CASE l_suppkey % 10 WHEN 0 THEN 'htmlspecialchars' WHEN 1 THEN 'addslashes' WHEN 2 THEN 'intval' "
        "WHEN 3 THEN 'strip_tags' WHEN 4 THEN 'mysqli_real_escape_string' WHEN 5 THEN 'prepared_statement' "
        "WHEN 6 THEN 'escapeshellarg' WHEN 7 THEN 'escapeshellcmd' WHEN 8 THEN CASE l_linenumber % 2 WHEN 0 THEN 'floatval' ELSE 'base64_decode' END "
        "ELSE 'strict_whitelist' END AS filter_name",
        "l_returnflag = 'R' AS global_waf",
    ]),
    "fx_routes": ("part", [
        f"concat('proj', {_n('p_partkey / 5')}) AS project",
        f"concat('route_', {_s('p_partkey')}) AS route_id",
        f"concat('Ctl', {_n('p_partkey / 20')}) AS controller",
        "CASE p_partkey % 5 WHEN 0 THEN '/api/payment' WHEN 1 THEN '/login' WHEN 2 THEN '/profile' "
        "WHEN 3 THEN '/admin/panel' ELSE '/catalog' END AS url",
        "CASE p_size % 3 WHEN 0 THEN 'anonymous' WHEN 1 THEN 'authenticated' ELSE 'admin' END AS auth_level",
        "CASE p_size % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' ELSE 'DELETE' END AS method",
        "CASE p_size % 5 WHEN 0 THEN 'auth' WHEN 1 THEN 'csrf,auth' WHEN 2 THEN '' WHEN 3 THEN 'can:admin' "
        "ELSE 'throttle' END AS middleware",
    ]),
    # every second file has a context pack, so about half of the findings stay unlinked
    "fx_packs": ("part", [
        f"concat('app/Mod', {_s('p_partkey * 2')}, '.php') AS file",
        f"concat('route_', {_s('p_partkey')}) AS route_id",
    ]),
    "fx_packages": ("part", [
        f"concat('proj', {_n('p_partkey / 20')}) AS project",
        f"concat('vendor', {_s('p_partkey % 20')}, '/lib', {_s('p_partkey % 5')}) AS package",
        f"concat('v', {_s('p_size')}, '.', {_s('p_partkey % 10')}, '.', {_s('p_partkey % 7')}) AS version",
        "CAST(p_size AS INT) AS v_major", "CAST(p_partkey % 10 AS INT) AS v_minor",
        "CAST(p_partkey % 7 AS INT) AS v_patch", "p_partkey % 4 = 0 AS is_dev",
    ]),
    "fx_advisories": ("supplier", [
        f"concat('ADV-', {_s('s_suppkey')}) AS vuln_id",
        f"concat('vendor', {_s('s_suppkey % 20')}, '/lib', {_s('s_suppkey % 5')}) AS package",
        "CAST(s_suppkey % 25 AS INT) AS intro_major", "CAST(s_suppkey % 25 + 10 AS INT) AS fixed_major",
        "CAST(s_suppkey % 101 AS DOUBLE) / 10 AS cvss",
    ]),
    "fx_nodes": ("customer", [
        f"concat('proj', {_n('c_custkey / 25')}) AS project",
        f"concat('n', {_s('c_custkey')}) AS node_id",
        "CASE c_custkey % 6 WHEN 0 THEN 'sqli' WHEN 1 THEN 'xss' WHEN 2 THEN 'rce' WHEN 3 THEN 'ssrf' "
        "WHEN 4 THEN 'authz' ELSE 'infoleak' END AS vuln_type",
        "CASE c_custkey % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity",
        "CASE c_nationkey % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'suspected' ELSE 'potential' END AS status",
        "CASE c_nationkey WHEN 0 THEN 'no_rate_limit' WHEN 1 THEN 'weak_password' WHEN 2 THEN 'no_httponly' WHEN 3 THEN 'no_csp' "
        "WHEN 4 THEN 'cloud' WHEN 5 THEN 'admin_reachable' WHEN 6 THEN 'file_privilege' WHEN 7 THEN 'writable_dir' "
        "WHEN 8 THEN 'payment' WHEN 9 THEN 'reset_token' WHEN 10 THEN 'open_signup' ELSE 'none' END AS condition",
        f"concat('obj', {_s('c_nationkey')}, '_', {_n('c_custkey / 100')}) AS data_object",
        f"concat('route_', {_n('c_custkey / 3')}) AS route_id",
        "c_custkey AS seq",
    ]),
    # edges stay inside a block of 25 nodes (one project), so paths do not explode
    "fx_edges": ("orders", [
        f"concat('proj', {_n('o_custkey / 25')}) AS project",
        f"concat('n', {_s('o_custkey')}) AS source_node",
        f"concat('n', CAST(CAST(floor(o_custkey / 25) AS BIGINT) * 25 + (o_custkey + 1 + o_orderkey % 3) % 25 AS STRING)) AS target_node",
        "CASE o_orderkey % 7 WHEN 0 THEN 'data_flows_to' WHEN 1 THEN 'enables' WHEN 2 THEN 'escalates_to' "
        "WHEN 3 THEN 'shares_data_object' WHEN 4 THEN 'same_entry_point' WHEN 5 THEN 'auth_chain' "
        "ELSE 'pivot_from' END AS relation",
        "CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'probable' ELSE 'speculative' END AS confidence",
        "o_orderkey AS seq",
    ]),
    "fx_memory": ("lineitem", [
        f"{SINK_TYPES} AS sink_type",
        "CASE l_suppkey % 4 WHEN 0 THEN 'laravel' WHEN 1 THEN 'symfony' WHEN 2 THEN 'wordpress' ELSE 'none' END AS framework",
        "CASE l_linenumber % 3 WHEN 0 THEN '5' WHEN 1 THEN '7' ELSE '8' END AS php_major",
        "CASE l_orderkey % 3 WHEN 0 THEN 'modsecurity' WHEN 1 THEN 'cloudflare' ELSE 'none' END AS waf",
        "CASE l_returnflag WHEN 'R' THEN 'confirmed' WHEN 'A' THEN 'failed' ELSE 'partial' END AS status",
        "CAST(l_quantity AS INT) % 7 AS rounds_used", "l_orderkey", "l_linenumber", "l_shipdate AS created_at",
    ]),
    "fx_targets": ("part", [
        f"concat('proj', {_s('p_partkey')}) AS project",
        "CASE p_size % 6 WHEN 0 THEN 'RCE' WHEN 1 THEN 'SQLi' WHEN 2 THEN 'XSS' WHEN 3 THEN 'LDAP' WHEN 4 THEN 'SSRF' ELSE 'LFI' END AS sink_type",
        "CASE p_partkey % 5 WHEN 0 THEN 'laravel' WHEN 1 THEN 'symfony' WHEN 2 THEN 'wordpress' WHEN 3 THEN 'thinkphp' ELSE 'yii' END AS framework",
        "CASE p_partkey % 4 WHEN 0 THEN '5' WHEN 1 THEN '7' WHEN 2 THEN '8' ELSE '9' END AS php_major",
        "CASE p_partkey % 3 WHEN 0 THEN 'modsecurity' WHEN 1 THEN 'cloudflare' ELSE 'other' END AS waf",
        "CAST(p_size AS INT) % 12 AS fw_major",
    ]),
    # caller edges climb the function numbers, so walks end at sources, at the top or at the depth limit
    "fx_calls": ("orders", [
        f"concat('f', {_s('o_custkey')}) AS callee", f"concat('f', {_s('o_custkey + 1 + o_orderkey % 3')}) AS caller",
    ]),
    "fx_lines": ("orders", [
        f"concat('proj', {_n('o_orderkey / 400')}) AS project", f"concat('src/F', {_n('o_orderkey / 40')}, '.php') AS path",
        "CAST(o_orderkey % 40 + 1 AS INT) AS line", f"{line_sql()} AS text",
    ]),
    # access log: one request per event
    "fx_access": ("events", [
        "event_id", "user_id", "ts", "concat('10.0.0.', CAST(user_id % 250 AS STRING)) AS client",
        "CASE event_id % 16 WHEN 0 THEN '/.env' WHEN 1 THEN '/%2egit/HEAD' WHEN 2 THEN '/index.php?s=index/think' WHEN 3 THEN '/login?next=https://evil.example/x' "
        "WHEN 4 THEN '/go?url=//evil.example' WHEN 5 THEN '/backup/site.sql' WHEN 6 THEN '/catalog?id=7' WHEN 7 THEN '/%252e%2565nv' WHEN 8 THEN '/adminer?x=1' "
        "WHEN 9 THEN '/xmlrpc.php' WHEN 10 THEN '/_ignition/execute-solution' WHEN 11 THEN '/out?to=javascript:alert(1)' WHEN 12 THEN '/r?next=%2Fhome' "
        "WHEN 13 THEN '/r?next=%2F%2Fevil.example' WHEN 14 THEN '/profile/a.css' ELSE '/home' END AS uri",
        "CASE event_type WHEN 'error' THEN 404 WHEN 'view' THEN 200 WHEN 'click' THEN 302 ELSE 200 END AS status", "event_type",
    ]),
    "fx_tokens": ("events", [
        "event_id", "user_id", """CASE event_id % 4 WHEN 0 THEN '{"alg":"HS256","typ":"JWT"}' WHEN 1 THEN '{"alg":"none"}' WHEN 2 THEN '{"alg":"RS256","kid":"../key"}' ELSE '{"alg":"RS256"}' END AS head""",
        """CASE event_type WHEN 'view' THEN '{"sub":1}' WHEN 'click' THEN '{"iat":1000,"exp":2000}' ELSE '{"iat":1000,"exp":90000}' END AS payload""",
    ]),
    "fx_require": ("part", [
        f"concat('proj', {_n('p_partkey / 6')}) AS project",
        "CASE p_size % 12 WHEN 0 THEN 'laravel/framework' WHEN 1 THEN 'topthink/framework' WHEN 2 THEN 'yiisoft/yii2' WHEN 3 THEN 'symfony/symfony' "
        "WHEN 4 THEN 'cakephp/cakephp' WHEN 5 THEN 'slim/slim' WHEN 6 THEN 'monolog/monolog' WHEN 7 THEN 'guzzlehttp/guzzle' "
        "WHEN 8 THEN 'ext-pdo_mysql' WHEN 9 THEN 'ext-pdo_pgsql' WHEN 10 THEN 'illuminate/routing' ELSE 'acme/tools' END AS package",
        "CAST(p_size AS INT) AS age_months", "CAST(p_partkey % 97 AS INT) AS stars", "CAST(p_partkey % 9 AS INT) AS open_issues",
        "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'MIT' END AS license", "CAST(p_partkey % 4 AS INT) AS maintainers", "p_partkey % 11 = 0 AS abandoned",
        "CASE p_partkey % 5 WHEN 0 THEN 'php -r eval(x)' WHEN 1 THEN 'curl https://x | sh' ELSE 'phpunit' END AS script",
        "CASE p_partkey % 5 WHEN 0 THEN 'ionCube Loader' WHEN 1 THEN 'xdebug' WHEN 2 THEN 'ffi' WHEN 3 THEN 'mcrypt' ELSE 'mbstring' END AS extension",
        "p_partkey",
    ]),
    "fx_tree": ("part", [
        f"concat('proj', {_n('p_partkey / 7')}) AS project",
        "CASE p_size % 13 WHEN 0 THEN 'wp-config.php' WHEN 1 THEN 'site/wp-content/plugins/forms/a.php' WHEN 2 THEN 'wp-content/themes/plain/style.css' WHEN 3 THEN 'core/lib/Drupal.php' "
        "WHEN 4 THEN 'sites/all/modules/views/v.module' WHEN 5 THEN 'modules/node/n.module' WHEN 6 THEN 'libraries/joomla/factory.php' WHEN 7 THEN 'wp-includes/version.php' ELSE 'src/app.php' END AS path",
    ]),
    "fx_ini": ("orders", [
        f"concat('proj', {_s('o_custkey')}) AS project",
        "CASE o_orderkey % 13 WHEN 0 THEN 'allow_url_include' WHEN 1 THEN 'allow_url_fopen' WHEN 2 THEN 'display_errors' WHEN 3 THEN 'expose_php' "
        "WHEN 4 THEN 'register_argc_argv' WHEN 5 THEN 'open_basedir' WHEN 6 THEN 'disable_functions' WHEN 7 THEN 'session.cookie_httponly' "
        "WHEN 8 THEN 'session.cookie_secure' WHEN 9 THEN 'session.use_strict_mode' WHEN 10 THEN 'session.sid_length' WHEN 11 THEN 'session.gc_maxlifetime' "
        "ELSE 'session.sid_bits_per_character' END AS key",
        "CASE o_orderkey % 13 WHEN 10 THEN CASE o_orderstatus WHEN 'F' THEN '26' ELSE '48' END WHEN 11 THEN CASE o_orderstatus WHEN 'F' THEN '1440' ELSE '172800' END "
        "WHEN 12 THEN CASE o_orderstatus WHEN 'F' THEN '4' ELSE '6' END ELSE CASE o_orderstatus WHEN 'F' THEN 'On' WHEN 'O' THEN 'Off' ELSE '' END END AS value",
        "o_orderkey",
    ]),
    "fx_names": ("part", [
        "lower(p_brand) AS vendor", f"concat(replace(p_name, ' ', '-'), '-', {_s('p_partkey % 10')}) AS name", "p_type = 'STANDARD' AS known",
    ]),
    "fx_rounds": ("events", [
        "user_id AS sink_no", "event_id", "ts",
        "CASE event_type WHEN 'purchase' THEN 'confirmed' WHEN 'signup' THEN 'suspected' ELSE 'failed' END AS result",
        f"concat('strategy_', {_s('event_id % 8')}) AS strategy",
        "CAST(event_id % 101 AS INT) AS filter_score",
        "event_type = 'view' AS has_evidence",
    ]),
    "fx_qc": ("orders", [
        f"concat('qc-', {_s('o_orderkey')}) AS qc_id", "substr(o_orderpriority, 1, 1) AS phase",
        f"concat('agent', {_s('o_custkey % 21')}) AS target_agent",
        "CASE o_orderstatus WHEN 'F' THEN 'fail' ELSE 'pass' END AS verdict",
        "CAST(o_orderkey % 14 AS INT) AS pass_count",
        "CAST(CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE 14 END AS INT) AS total_count",
        "CAST(o_custkey % 4 AS INT) AS redo_count", "o_orderdate AS ts",
    ]),
    "fx_store_points": ("orders", [
        f"concat('STORE-', {_s('o_orderkey')}) AS store_id", f"concat('t', {_s('o_custkey')}) AS tbl",
        f"concat('c', {_s('o_orderkey % 10')}) AS col",
        "CASE o_orderkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'partial' ELSE 'full' END AS sanitization",
    ]),
    "fx_use_points": ("part", [
        f"concat('USE-', {_s('p_partkey')}) AS use_id", f"concat('t', {_s('p_partkey')}) AS tbl",
        f"concat('c', {_s('p_size % 10')}) AS col",
        "CASE p_partkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'partial' ELSE 'full' END AS output_sanitization",
        "CASE p_size % 4 WHEN 0 THEN 'DB::raw' WHEN 1 THEN 'echo' WHEN 2 THEN 'include' ELSE 'system' END AS usage_sink",
    ]),
    # (trace_id, func_nr) repeats, so frames are ordered by every column
    "fx_frames": ("lineitem", [
        "l_orderkey AS trace_id", "CAST(l_linenumber AS INT) AS func_nr", "CAST(1 + l_partkey % 5 AS INT) AS level",
        "CASE l_partkey % 6 WHEN 0 THEN 'DB::raw' WHEN 1 THEN 'spl_autoload_call' WHEN 2 THEN 'UserController->show' "
        "WHEN 3 THEN 'system' WHEN 4 THEN 'class_exists' ELSE 'Router::dispatch' END AS function",
        "l_partkey AS k1", "l_suppkey AS k2", "l_extendedprice AS k3", "l_shipdate AS k4",
    ]),
    # what a phase leaves behind, for the published checks
    "fx_probes": ("customer", [
        f"concat('proj', {_n('c_custkey / 9')}) AS project",
        "CASE c_custkey % 9 WHEN 0 THEN 'service' WHEN 1 THEN 'php_version' WHEN 2 THEN 'extension' WHEN 3 THEN 'web' WHEN 4 THEN 'database' "
        "WHEN 5 THEN 'xdebug' WHEN 6 THEN 'ssrf' WHEN 7 THEN 'routes' ELSE 'workers' END AS probe",
        "CASE c_custkey % 9 WHEN 0 THEN CASE WHEN c_nationkey < 22 THEN 'running' ELSE 'restarting' END WHEN 1 THEN CASE WHEN c_nationkey % 5 = 0 THEN '7.4.33' ELSE '8.1.2' END "
        "WHEN 2 THEN CASE WHEN c_nationkey < 20 THEN 'pdo,pdo_mysql,mbstring,xml,curl,json,xdebug' WHEN c_nationkey < 22 THEN 'pdo,mbstring,xml,curl,json,xdebug' ELSE 'pdo_pgsql,curl' END "
        "WHEN 3 THEN CASE c_nationkey % 4 WHEN 0 THEN '500' WHEN 1 THEN '302' ELSE '200' END WHEN 4 THEN CASE WHEN c_nationkey < 5 THEN 'refused' ELSE 'connected' END "
        "WHEN 5 THEN CASE WHEN c_nationkey < 12 THEN 'develop,trace' ELSE 'debug' END WHEN 6 THEN CASE WHEN c_nationkey < 20 THEN '200' ELSE '000' END "
        "WHEN 7 THEN CASE WHEN c_nationkey < 24 THEN '12' ELSE '0' END ELSE 'idle' END AS observed",
        "'8.1.2' AS declared",
    ]),
    "fx_outputs": ("orders", [
        f"concat('proj', {_n('o_orderkey / 370')}) AS project",
        "CASE o_orderkey % 5 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '3' WHEN 3 THEN '4.5' ELSE '5' END AS phase",
        "CASE o_orderkey % 5 WHEN 0 THEN 'environment_status.json' WHEN 1 THEN 'dep_risk.json' WHEN 2 THEN 'traces/t.json' WHEN 3 THEN 'correlation_report.json' "
        "ELSE CASE o_custkey % 2 WHEN 0 THEN 'audit_report.sarif.json' ELSE 'poc/run_all.sh' END END AS path",
        "o_custkey % 43 <> 1 AS valid",
    ]),
    "fx_layers": ("lineitem", [
        f"concat('proj', {_n('l_orderkey / 370')}) AS project", f"concat('app/Mod', {_n('l_orderkey / 37')}, '.php') AS file",
        "CAST(l_linenumber AS INT) AS layer", "CASE WHEN l_partkey % 1999 = 0 THEN '' ELSE 'call();' END AS code", "l_partkey % 211 = 0 AS broken",
    ]),
    "fx_credentials": ("customer", [
        f"concat('proj', {_n('c_custkey / 9')}) AS project",
        "CASE c_custkey % 3 WHEN 0 THEN 'anonymous' WHEN 1 THEN 'authenticated' ELSE 'admin' END AS level",
        "CASE c_nationkey % 3 WHEN 0 THEN 403 ELSE 200 END AS status",
    ]),
    "fx_chains": ("orders", [
        f"concat('proj', {_n('o_orderkey / 370')}) AS project", "CASE WHEN o_orderkey % 997 = 0 THEN 0 ELSE 5 END AS steps",
        "'public/index.php' AS first_file", "'system' AS sink", "CASE WHEN o_custkey % 499 = 1 THEN 'noop' ELSE 'system' END AS last_function",
        "o_custkey % 10 < 7 AS complete", "CASE WHEN o_custkey % 149 = 1 THEN 2 ELSE 0 END AS unresolved", "CASE WHEN o_custkey % 251 = 1 THEN 1 ELSE 0 END AS unexplained",
        "o_orderkey % 401 <> 0 AS compared", "CASE o_orderkey % 4 WHEN 0 THEN 'B' ELSE 'A' END AS route_type",
        "CASE o_orderkey % 3 WHEN 0 THEN 'before_sink' WHEN 1 THEN 'after_sink' ELSE CASE WHEN o_custkey % 71 = 1 THEN NULL ELSE 'after_sink' END END AS error_vs_sink",
        "o_orderkey % 7 <> 0 OR o_custkey % 13 <> 1 AS returned",
    ]),
    "fx_agents": ("orders", [
        f"concat('proj', {_n('o_orderkey / 370')}) AS project", f"concat('agent', {_s('o_orderkey % 21')}) AS agent",
        "CASE o_orderstatus WHEN 'P' THEN 'not_applicable' WHEN 'F' THEN CASE WHEN o_orderkey % 21 = 20 THEN 'pending' ELSE 'failed' END ELSE 'executed' END AS state",
        "CASE WHEN o_custkey % 29 = 1 THEN '' ELSE 'no sink of this type' END AS reason",
    ]),
    "fx_route_state": ("part", [
        f"concat('proj', {_n('p_partkey / 5')}) AS project", f"concat('route_', {_s('p_partkey')}) AS route_id",
        f"concat('app/Mod', {_s('p_partkey * 2')}, '.php') AS file",
        "CASE p_size % 3 WHEN 0 THEN 'anonymous' WHEN 1 THEN 'authenticated' ELSE 'admin' END AS auth_level",
        "CASE p_size % 5 WHEN 2 THEN '' ELSE 'auth' END AS middleware", "CASE WHEN p_partkey % 37 = 0 THEN 'open' WHEN p_partkey % 5 = 0 THEN 'skipped' ELSE 'audited' END AS state",
        "CASE WHEN p_partkey % 3 = 0 THEN 'header trusted' ELSE '' END AS bypass_notes",
    ]),
    # one row per tested sink; a few rows in 1,511 break one rule each
    "fx_exploits": ("lineitem", [
        f"concat('proj', {_n('l_orderkey / 370')}) AS project",
        f"CASE WHEN {_bigint('l_orderkey / 37')} % 97 = 0 THEN 'app/none.php' ELSE concat('app/Mod', {_n('l_orderkey / 37')}, '.php') END AS file",
        "CAST(l_linenumber * 10 AS INT) AS line", f"{SINK_TYPES} AS sink_type", f"{VERDICT} AS verdict",
        f"CASE WHEN {_odd(1)} THEN 0 WHEN l_partkey % 4 = 0 THEN 7 + l_linenumber % 4 WHEN l_partkey % 4 = 1 THEN 4 + l_linenumber % 3 ELSE 1 + l_linenumber % 3 END AS evidence_score",
        f"(l_partkey % 4 = 0) <> {_odd(2)} AS evidence_complete",
        f"CASE WHEN l_partkey % 4 = 0 THEN CASE WHEN {_odd(3)} THEN 'UNRESOLVED' ELSE 'RESOLVED' END ELSE 'INCOMPLETE' END AS trace_status",
        f"CASE l_suppkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE CASE WHEN {_odd(4)} THEN 4 ELSE 1 END END AS r",
        "CASE l_partkey % 4 WHEN 0 THEN 3 WHEN 1 THEN CASE WHEN l_suppkey % 3 = 2 THEN 2 ELSE 1 END ELSE 0 END AS i",
        "CASE l_partkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END AS c",
        f"CASE WHEN {_odd(5)} THEN 'not_exploitable' WHEN l_partkey % 4 = 0 THEN 'directly_exploitable' WHEN l_partkey % 4 = 1 THEN 'conditionally_exploitable' ELSE 'not_exploitable' END AS judgment",
        "CASE l_suppkey % 3 WHEN 0 THEN 'anonymous' WHEN 1 THEN 'authenticated' ELSE 'admin' END AS auth_level",
        f"CASE WHEN {_odd(6)} THEN 'admin' WHEN {_odd(7)} THEN 'anonymous' WHEN l_suppkey % 3 = 0 THEN 'anonymous' WHEN l_suppkey % 3 = 1 THEN 'authenticated' ELSE 'admin' END AS auth_used",
        f"CASE WHEN {_odd(8)} THEN 'GET /page' WHEN {_odd(9)} THEN '' ELSE 'POST /page HTTP/1.1 Host: site.example' END AS request",
        f"CASE WHEN {_odd(10)} THEN NULL ELSE 200 END AS status", f"CASE WHEN {_odd(11)} THEN '' ELSE 'row uid=33 in page' END AS body",
        f"CASE WHEN {_odd(12)} THEN 'root:' ELSE 'uid=33' END AS claim",
        f"CASE WHEN {_odd(13)} THEN '' ELSE 'run($a);' END AS fix_before", f"CASE WHEN {_odd(14)} THEN 'run($a);' ELSE 'run(clean($a));' END AS fix_after",
        "l_orderkey % 2 = 0 AS filtered", f"CASE WHEN {_odd(15)} THEN '' ELSE 'no way around' END AS bypass", f"CASE WHEN {_odd(16)} THEN 1 ELSE 0 END AS empty_points",
        f"{_bigint('l_orderkey / 37')} % 31 <> 0 AS reported", f"{_bigint('l_orderkey / 37')} % 23 <> 0 AS patched", f"NOT {_odd(7)} OR l_suppkey % 2 = 0 AS authz_marked",
        f"NOT {_odd(17)} AS variant_tested", f"NOT {_odd(18)} AS compared", "CAST(l_linenumber + 3 AS INT) AS rounds", f"CASE WHEN {_odd(19)} THEN '' ELSE 'all rounds failed' END AS note",
        f"CASE WHEN {_odd(20)} THEN 'none' WHEN l_partkey % 4 = 0 THEN 'error' WHEN l_partkey % 4 = 1 THEN 'warning' ELSE 'note' END AS sarif",
        f"CASE WHEN {_odd(23)} THEN 'csrf_auditor' ELSE CASE l_partkey % 10 WHEN 0 THEN 'rce_auditor' WHEN 1 THEN 'rce_auditor' WHEN 2 THEN 'deserial_auditor' WHEN 3 THEN 'lfi_auditor' "
        "WHEN 4 THEN 'sqli_auditor' WHEN 5 THEN 'filewrite_auditor' WHEN 6 THEN 'ssrf_auditor' WHEN 7 THEN 'xxe_auditor' WHEN 8 THEN 'xss_ssti_auditor' ELSE 'crypto_auditor' END END AS auditor",
        f"NOT {_odd(21)} AS poc_compiles", "'http://site.example/page' AS url", f"CASE WHEN {_odd(22)} THEN 'http://other.example/' ELSE 'http://site.example/page' END AS poc_url",
    ]),
    # pages as a server in development leaves them
    "fx_html": ("pages", [
        "page_id", "concat(html, CASE page_id % 9 WHEN 0 THEN '<script>run()//# sourceMappingURL=app' WHEN 1 THEN '<script>list.map(f)</script>' WHEN 2 THEN '<a href=/s/app.js.map>' "
        "WHEN 3 THEN '<script src=/__webpack_hmr>' WHEN 4 THEN '<div class=phpdebugbar>' WHEN 5 THEN '<script>__VUE_DEVTOOLS_GLOBAL_HOOK__' WHEN 6 THEN '<p>site.map of all' WHEN 7 THEN '<!-- TODO remove test account -->' ELSE '' END) AS html",
    ]),
    "fx_http": ("pages", [
        "page_id", "url", "CASE page_id % 5 WHEN 0 THEN 403 WHEN 1 THEN 302 ELSE 200 END AS status",
        "CASE WHEN page_id % 2 = 0 THEN 'nosniff' END AS h_x_content_type_options",
        "CASE WHEN page_id % 3 = 0 THEN 'max-age=31536000' END AS h_hsts",
        "CASE page_id % 4 WHEN 0 THEN '*' WHEN 1 THEN 'null' WHEN 2 THEN 'https://evil.example' ELSE NULL END AS h_acao",
        "(page_id % 6 < 3) AS acac", "CAST(length(html) AS BIGINT) AS body_len",
    ]),
}


def view_sql(name: str) -> str:
    base, exprs = VIEWS[name]
    return f"SELECT {', '.join(exprs)} FROM {base}"
