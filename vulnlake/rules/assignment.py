"""Which work area handles which function or family, and forced areas."""

# function -> area
FUNCTION_AREAS = {
    "eval": "rce", "system": "rce", "exec": "rce", "extract": "rce", "parse_str": "rce", "query": "sqli", "execute": "sqli",
    "mysql_query": "sqli", "DB::raw": "sqli", "whereRaw": "sqli", "unserialize": "deserial", "include": "lfi", "require": "lfi",
    "file_put_contents": "filewrite", "move_uploaded_file": "filewrite", "curl_exec": "ssrf", "file_get_contents": "ssrf",
    "echo": "xss_ssti", "print": "xss_ssti", "printf": "xss_ssti", "simplexml_load_string": "xxe", "simplexml_load_file": "xxe",
    "md5": "crypto", "sha1": "crypto", "rand": "crypto", "mt_rand": "crypto", "ldap_search": "ldap", "ldap_bind": "ldap",
}

# (framework or None for every project, area)
FORCED_AREAS = [
    ("wordpress", "wordpress"), ("laravel", "config"), ("laravel", "authz"), ("thinkphp", "rce"), ("thinkphp", "sqli"),
    ("symfony", "config"), (None, "infoleak"), (None, "business_logic"), (None, "csrf"), (None, "session"), (None, "logging"),
]

# (framework or 'php', lower major inclusive, upper major exclusive, area, note)
VERSION_AREAS = [
    ("laravel", 0, 8, "authz", "mass assignment weight x2"), ("laravel", 9, 999, "infoleak", "manifest and debug routes"),
    ("thinkphp", 5, 6, "rce", "request routing"), ("thinkphp", 3, 4, "sqli", "where concatenation"),
    ("wordpress", 0, 6, "wordpress", "core advisory check"),
]

# check subject -> producer responsible for it
QC_PRODUCERS = {
    "route_map": "route_mapper", "auth_matrix": "auth_auditor", "ast_sinks": "tool_runner", "context_packs": "context_builder",
    "priority_queue": "priority_ranker", "dep_risk": "dep_scanner",
}
