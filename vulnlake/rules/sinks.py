"""Call tables of the source scan (name -> family)."""

import re

# Fixed values.
FUNCTION_SINKS = {
    "RCE": [
        "eval", "assert", "preg_replace", "create_function", "system", "exec", "passthru", "shell_exec", "popen", "proc_open", "pcntl_exec",
        "call_user_func", "call_user_func_array", "array_map", "array_filter", "usort", "uasort", "uksort", "array_walk", "extract", "parse_str",
        "mb_parse_str",
    ],
    "SQLi": [
        "mysql_query", "pg_query", "sqlite_query",
    ],
    "LFI": [
        "highlight_file", "show_source", "file_get_contents", "readfile", "fread", "file", "fpassthru", "fopen",
    ],
    "FileWrite": [
        "file_put_contents", "fwrite", "fputs", "move_uploaded_file", "copy", "rename",
    ],
    "Deserialization": [
        "unserialize",
    ],
    "SSRF": [
        "curl_exec", "curl_multi_exec", "get_headers", "getimagesize",
    ],
    "XSS": [
        "printf", "vprintf",
    ],
    "XXE": [
        "simplexml_load_string", "simplexml_load_file", "libxml_disable_entity_loader",
    ],
    "WordPress": [
        "update_option", "update_user_meta", "wp_set_auth_cookie", "do_shortcode", "wp_remote_get", "wp_remote_post", "is_admin",
    ],
    "Crypto": [
        "md5", "sha1", "rand", "mt_rand", "mcrypt_encrypt", "mcrypt_decrypt", "mcrypt_cbc", "mcrypt_cfb", "mcrypt_ecb", "mcrypt_ofb",
        "mcrypt_create_iv", "mcrypt_generic", "mcrypt_module_open", "openssl_encrypt",
    ],
}
METHOD_SINKS = {
    "SQLi": [
        "query", "exec", "multi_query", "raw", "whereRaw", "havingRaw", "orderByRaw", "selectRaw", "groupByRaw", "findBySql",
    ],
    "FileWrite": [
        "extractTo",
    ],
    "XXE": [
        "loadXML", "load",
    ],
    "NoSQL": [
        "find", "findOne", "aggregate", "updateOne", "deleteMany", "insertOne", "eval", "rawCommand",
    ],
    "WordPress": [
        "get_results", "get_row", "get_var",
    ],
    "GraphQL": [
        "executeQuery",
    ],
}
STATIC_SINKS = {
    "SQLi": [
        "DB::raw", "DB::select", "DB::statement", "Db::query", "Db::execute",
    ],
    "MassAssignment": [
        "Model::create",
    ],
    "GraphQL": [
        "GraphQL::executeQuery", "GraphQLServer::executeQuery",
    ],
}
SENSITIVE_NAMES = ["password", "passwd", "token", "key", "secret", "hash", "sign", "verify"]
PASSWORD_NAMES = ["password", "passwd", "pass", "pwd"]
SECURITY_SCOPES = ["token", "key", "password", "secret", "nonce", "salt", "csrf", "otp"]
MAGIC_METHODS = ["__destruct", "__wakeup", "__toString", "__call", "__get"]
NOSQL_RECEIVERS = ["collection", "mongo", "redis", "client", "db", "database", "conn"]
MONGO_METHODS = ["find", "findOne", "aggregate", "updateOne", "deleteMany", "insertOne"]
REDIS_METHODS = ["eval", "rawCommand"]
WPDB_METHODS = ["query", "get_results", "get_row", "get_var"]
BULK_METHODS = ["fill", "update", "create"]
GRAPHQL_CLASSES = ["type", "query", "mutation", "graphql", "resolver", "schema", "field"]


def pairs(table: dict[str, list[str]]) -> list[tuple[str, str]]:
    return [(name, family) for family, names in table.items() for name in names]


# The extended catalogue, (level, call or pattern) per family in published order; levels are very_high, high, medium, low.
# A row is listed if one line can show it.
CATALOGUE = {
    "rce": [
        ("very_high", "eval()"), ("very_high", "assert()"), ("very_high", r"\bpreg_replace\s*\(\s*[\x22'].*/[a-z]*e[a-z]*[\x22']\s*,"), ("very_high", "create_function()"),
        ("very_high", "system()"), ("very_high", "exec()"), ("very_high", "passthru()"), ("very_high", "shell_exec()"),
        ("very_high", "popen()"), ("very_high", "proc_open()"), ("very_high", "pcntl_exec()"),
        ("high", "call_user_func()"), ("high", "call_user_func_array()"), ("medium", r"\barray_map\s*\(\s*\$"), ("medium", r"\barray_filter\s*\([^,]*,\s*\$"),
        ("medium", r"\busort\s*\([^,]*,\s*\$"), ("medium", r"\barray_walk\s*\([^,]*,\s*\$"), ("high", r"(?:^|[^\w>:$])\$\w+\s*\("), ("high", r"\$\$\w+"), ("high", r"\$\{\s*\$"),
        ("high", "extract()"), ("high", r"(?:^|\W)parse_str\s*\("), ("high", "mb_parse_str()"),
    ],
    "sqli": [
        ("high", r"\$pdo->query\s*\("), ("high", r"\$pdo->exec\s*\("), ("high", r"\$mysqli->query\s*\("), ("very_high", "->multi_query()"), ("high", r"\bmysqli?_query\s*\("), ("high", "pg_query()"),
        ("high", "DB::raw()"), ("high", "DB::select()"), ("high", "->whereRaw()"), ("high", "->havingRaw()"), ("high", "->orderByRaw()"), ("high", "->selectRaw()"),
        ("high", "->groupByRaw()"), ("high", "Db::query()"), ("high", "Db::execute()"), ("high", r"->where\s*\(\s*[\x22'][^,)]*[\x22']\s*\.\s*\$"), ("high", r"(?:::|->)findBySql\s*\("), ("high", r"->rawSql\b"),
    ],
    "lfi": [
        ("very_high", r"\binclude\b[^;]*\$"), ("very_high", r"\binclude_once\b[^;]*\$"), ("very_high", r"\brequire\b[^;]*\$"), ("very_high", r"\brequire_once\b[^;]*\$"),
        ("high", "highlight_file()"), ("high", "show_source()"), ("high", "file_get_contents()"), ("high", "readfile()"), ("medium", "fread()"), ("high", "file()"), ("medium", "fpassthru()"),
    ],
    "filewrite": [
        ("very_high", "file_put_contents()"), ("high", "fwrite()"), ("high", "fputs()"), ("very_high", "move_uploaded_file()"), ("high", "copy()"),
        ("medium", "rename()"), ("low", "mkdir()"), ("low", "tempnam()"), ("high", "->extractTo()"),
    ],
    "deserial": [
        ("very_high", "unserialize()"), ("very_high", r"phar://"), ("high", r"\$(?:memcached?|redis|cache)->get\s*\("), ("medium", "json_decode()"),
        ("high", r"function\s+__destruct\b"), ("high", r"function\s+__wakeup\b"), ("high", r"function\s+__toString\b"), ("high", r"function\s+__call\b"), ("high", r"function\s+__get\b"),
    ],
    "ssrf": [
        ("very_high", r"\bcurl_(?:init|exec)\s*\("), ("very_high", "curl_multi_exec()"), ("high", r"\bfile_get_contents\s*\(\s*(?:\$|[\x22']https?:)"), ("high", r"\bfopen\s*\(\s*(?:\$|[\x22']https?:)"), ("high", r"\bnew\s+\\?SoapClient\b"),
        ("high", r"\bnew\s+\\?SimpleXMLElement\b"), ("high", "get_headers()"), ("medium", "getimagesize()"),
    ],
    "xss": [
        ("high", r"\becho\b[^;]*\$"), ("high", r"\bprint\b[^;]*\$"), ("medium", r"\bprintf\s*\(\s*\$"), ("medium", r"\bsprintf\s*\(\s*\$"), ("medium", "vprintf()"), ("high", r"\{!!"), ("high", r"\{:\$\w"), ("high", r"<\?=\s*\$"),
    ],
    "ssti": [
        ("very_high", r"\{\{[^}]*(?:app\.request|_GET|_POST)"), ("very_high", "->createTemplate()"), ("very_high", r"\{php\}"), ("very_high", r"->(?:render|compile)\w*\s*\([^)]*(?:\.\s*\$|\$_)"),
    ],
    "xxe": [
        ("very_high", "simplexml_load_string()"), ("very_high", "simplexml_load_file()"), ("very_high", "->loadXML()"), ("very_high", r"\$(?:dom|doc|xml)\w*->load\s*\("),
        ("high", r"XMLReader::xml|->xml\s*\(\s*\$"), ("high", r"XMLReader::open"), ("very_high", r"libxml_disable_entity_loader\s*\(\s*false"),
    ],
    "mass_assignment": [
        ("high", r"::create\s*\(\s*\$request->all\(\)"), ("high", r"->fill\s*\(\s*\$request->all\(\)"), ("high", r"->update\s*\(\s*\$request->all\(\)"), ("very_high", r"\$guarded\s*=\s*\[\s*\]"), ("medium", r"\$fillable\s*=.*(?:role|is_admin|status)"),
    ],
    "nosql": [
        ("high", "->find()"), ("high", "->findOne()"), ("high", "->aggregate()"), ("high", "->updateOne()"), ("very_high", "->deleteMany()"), ("very_high", r"[\x22']\$where[\x22']"), ("medium", r"[\x22']\$regex[\x22']"),
        ("high", r"[\x22']\$(?:gt|lt|ne|in)[\x22']"), ("high", r"::whereRaw\s*\("), ("medium", r"::where\s*\([^,)]*,\s*\$[^,)]*,"), ("very_high", r"\$redis->eval\s*\("), ("very_high", "->rawCommand()"),
    ],
    "graphql": [("medium", r"__schema\b"), ("high", r"[\x22']\s*(?:query|mutation)\b[^\x22']*[\x22']\s*\.\s*\$"), ("very_high", r"extends\s+Mutation\b"), ("high", r"extends\s+Subscription\b")],
    "race": [("high", r"\bif\s*\(\s*!?\s*file_exists\s*\("), ("very_high", r"\bif\s*\(\s*\$\w*balance\w*\s*>=?"), ("high", r"(?i)->get\s*\(\s*[\x22'][^\x22']*(?:limit|attempts)"), ("high", r"\bfile_exists\s*\([^;]*\binclude\b"), ("medium", r"\bfopen\s*\([^)]*[\x22'][wa]\+?[\x22']")],
    "cache": [("high", "Cache::put()"), ("medium", "Cache::remember()"), ("medium", r"Cache-Control:\s*public"), ("high", r"X-Forwarded-Host"), ("medium", r"session\.save_handler[^;]*(?:redis|memcache)"), ("high", r"file_put_contents\s*\([^;]*cache[^;]*\.php")],
    "crypto": [
        ("high", r"(?i)\b(?:md5|sha1)\s*\(\s*\$\w*pass"), ("high", r"\b(?:mt_)?rand\s*\("), ("high", r"(?i)openssl_encrypt\s*\([^;]*ecb"), ("high", r"(?i)\$iv\s*=\s*(?:[\x22']|str_repeat)"), ("high", r"\bmcrypt_\w+"),
        ("very_high", r"(?i)base64_encode\s*\([^)]*(?:password|secret)"), ("medium", r"\b(?:crc32|adler32)\b"), ("low", r"\bPASSWORD_DEFAULT\b"), ("high", r"[\x22']HS256[\x22']"),
    ],
    "wordpress": [
        ("very_high", r"\$wpdb->query\s*\("), ("high", r"\$wpdb->get_results\s*\("), ("high", "update_option()"), ("high", "update_user_meta()"), ("very_high", "wp_set_auth_cookie()"), ("high", "do_shortcode()"),
        ("high", r"\badd_(?:action|filter)\s*\([^)]*call_user_func"), ("high", r"\bwp_remote_(?:get|post)\s*\("), ("high", "wp_mail()"), ("medium", "sanitize_text_field()"), ("medium", "wp_kses_post()"), ("very_high", "is_admin()"),
    ],
    "jwt": [
        ("very_high", r"JWT::decode\s*\([^)]*,\s*\[\s*\]"), ("very_high", r"JWT::decode\s*\([^,)]*(?:,[^,)]*)?\)"), ("high", r"explode\s*\(\s*[\x22']\.[\x22']\s*,\s*\$\w*(?:jwt|token)"), ("high", r"openssl_verify\s*\([^;]*\)\s*==[^=]"),
        ("high", r"JWT::encode\s*\([^)]*[\x22'][^\x22']{1,16}[\x22']\s*,\s*[\x22']HS256"), ("very_high", r"[\x22']kid[\x22']\s*\]\s*\.|\.\s*\$\w*kid\b"),
    ],
    "redirect": [
        ("very_high", r"header\s*\(\s*[\x22']Location:\s*[\x22']\s*\.\s*\$"), ("high", r"strpos\s*\(\s*\$\w*url\w*\s*,\s*[\x22']https?:"), ("high", r"(?:^|[^>\w])redirect\s*\(\s*\$|Redirect::to\s*\(\s*\$"), ("high", r"\$this->redirect\s*\(\s*\$"),
        ("high", r"http-equiv=.?refresh.?[^>]*\$"), ("medium", r"window\.location\s*=\s*[^;]*(?:<\?|\$)"), ("high", "wp_redirect()"),
    ],
    "cors": [
        ("very_high", r"Access-Control-Allow-Origin:\s*[\x22']\s*\.\s*\$"), ("very_high", r"Access-Control-Allow-Credentials:\s*true"), ("high", r"Access-Control-Allow-Origin:\s*\*"), ("high", r"(?:strpos|preg_match)\s*\([^;]*\$\w*origin"),
        ("high", r"Access-Control-Allow-Headers:[^;]*Authorization"), ("medium", r"allowed_origins.*\*"), ("medium", r"add_header\s+Access-Control-Allow-Origin"),
    ],
    "method": [
        ("high", r"\bTRACE\b"), ("high", r"Route::(?:any|rule)\s*\("), ("high", r"->isMethod\s*\(|isMethod\s*\("), ("very_high", r"Route::(?:delete|put|resource)\s*\("), ("high", r"\$_SERVER\[.REQUEST_METHOD.\]|[\x22']_method[\x22']"), ("medium", r"Route::match\s*\([^)]*(?i:head)"), ("high", r"\b(?:PROPFIND|MKCOL)\b"),
    ],
    "crlf": [
        ("very_high", r"header\s*\(\s*[\x22']Location:[^;]*\.\s*\$"), ("high", r"header\s*\(\s*[\x22']X-[^;]*\.\s*\$"), ("high", r"\bsetcookie\s*\([^;]*\$"), ("very_high", r"\bmail\s*\([^;]*\$\w*[hH]eaders"), ("high", r"\$response->header\s*\([^;]*\$"), ("high", r"Content-Disposition:[^;]*filename[^;]*\$|filename=[^;]*\$"),
    ],
    "csrf": [
        ("very_high", r"(?i)<form[^>]*method=[\x22']?post"), ("high", r"\$except\s*=.*\*"), ("high", r"(?:\$|jQuery)\.(?:ajax|post)\s*\(|axios\.(?:post|put|delete)\s*\("), ("high", r"Route::any\s*\(|Route::match\s*\("), ("very_high", r"middleware\s*\([^)]*web[^)]*\)[^;]*api"), ("high", r"(?i)isset\s*\([^)]*(?:csrf|_token)"), ("high", r"(?i)samesite.*none"),
    ],
    "session": [
        ("very_high", "session_start()"), ("very_high", r"cookie_httponly[^;]*(?:0|Off|false)"), ("high", r"cookie_secure[^;]*(?:0|Off|false)"), ("high", r"use_strict_mode[^;]*(?:0|Off|false)"), ("high", r"use_only_cookies[^;]*(?:0|Off|false)"), ("high", "session_destroy()"), ("high", r"/tmp/sess_"), ("very_high", r"session\.serialize_handler"),
    ],
    "ldap": [
        ("very_high", r"\bldap_search\s*\([^;]*\.\s*\$"), ("very_high", "ldap_bind()"), ("high", r"\bldap_search\s*\([^;]*\$filter"), ("high", r"LdapAdapter|adldap"), ("high", r"\bldap_(?:add|modify)\s*\("), ("high", r"[\x22'](?:cn|uid)=[\x22']\s*\.\s*\$"),
    ],
    "logging": [
        ("high", r"(?:Log::\w+|error_log)\s*\([^;]*\$"), ("very_high", r"(?i)(?:Log::\w+|error_log)\s*\([^;]*(?:password|token|api_?key)"), ("very_high", r"(?:public|storage)/[^;]*\.log\b"), ("high", r"display_errors[^;]*1"), ("very_high", r"\binclude\b[^;]*\$log"),
    ],
}


def _pattern(row: str) -> str:
    """A row that ends in ``()`` is a call by name; the others are patterns."""
    return (r"\b" if row[0].isalpha() else "") + re.escape(row[:-2]) + r"\s*\(" if row.endswith("()") else row


def catalogue_rows() -> list[tuple[str, str]]:
    """(family:level:row, pattern) with rows numbered from 1 within a family."""
    return [(f"{family}:{level}:{n}", _pattern(row)) for family, rows in CATALOGUE.items() for n, (level, row) in enumerate(rows, 1)]
