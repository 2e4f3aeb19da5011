"""Documented insecure-code patterns per specialist family.

Entries: ("line", pattern) or (scope, first, then, never) for a scope of
"function", "file" or "project": the scope holds a line like ``first``, a later
line like ``then`` (if given) and no line like ``never`` (if given).
Patterns use no look-around, so Java and RE2 read them alike.
"""

IN = r"(?:\$_(?:GET|POST|REQUEST|COOKIE|FILES)\b|\$request->|\binput\s*\(|\$userInput\b|\$input\b)"
CAT = r"[\x22']\s*\.\s*\$"
LOG = r"(?:Log::\w+|error_log|syslog|\$logger->\w+)\s*\("

PATTERNS: dict[str, list[tuple]] = {
    "rce": [
        ("line", r"\b(?:system|exec|passthru|shell_exec|popen|proc_open)\s*\([^;]*" + IN),
        ("line", r"\b(?:eval|assert)\s*\([^;]*\$"),
        ("line", r"preg_replace\s*\([^;]*/[a-z]*e[a-z]*['\x22]"),
        ("line", r"call_user_func(?:_array)?\s*\(\s*" + IN + r"|\$\w+\s*=\s*" + IN + r"[^;]*;\s*\$\w+\s*\("),
        ("line", r"\b(?:extract|parse_str)\s*\(\s*" + IN),
        ("line", r"\bmail\s*\((?:[^,]*,){4}"),
        ("line", r"\b(?:include|require)(?:_once)?\b[^;]*php://filter"),
    ],
    "sqli": [
        ("line", r"->query\s*\([^;]*" + CAT),
        ("line", r"(?:->|::)\w*[rR]aw\s*\([^;]*" + CAT),
        ("function", r"->fetch\w*\s*\(", r"->query\s*\([^;]*\$\w+\[", None),
        ("line", r"\[\s*'exp'\s*,"),
        ("function", r"simplexml_load_string\s*\(", r"->query\s*\([^;]*\$\w+->", None),
        ("line", r"->(?:orderByRaw|orderBy|field)\s*\([^;]*" + IN),
        ("line", r"->createQuery\s*\([^;]*" + CAT),
    ],
    "xss": [
        ("line", r"(?:\becho\b|<\?=)\s*" + IN),
        ("line", r"\{!!.*!!\}"),
        ("line", r"->(?:render|createTemplate)\s*\([^;]*(?:" + CAT + r"|" + IN + r")"),
        ("line", r"\{if\s+\w+\s*\("),
        ("line", r"\.innerHTML\s*=|document\.write\s*\("),
        ("line", r"_self\.env\."),
        ("line", r"@php\b"),
    ],
    "xxe": [
        ("line", r"simplexml_load_(?:string|file)\s*\(\s*\$"),
        ("file", r"->loadXML\s*\(", None, r"LIBXML_NO|libxml_disable_entity_loader\s*\(\s*true"),
        ("line", r"libxml_disable_entity_loader\s*\(\s*false"),
        ("project", r"application/json", r"application/xml", None),
        ("line", r"PhpSpreadsheet|simplexml_load_string\s*\(\s*\$rss"),
        ("line", r"->xpath\s*\(\s*\$"),
    ],
    "ssrf": [
        ("line", r"(?:file_get_contents|curl_setopt|fopen)\s*\([^;]*" + IN),
        ("function", r"gethostbyname\s*\(", r"curl_exec\s*\(|file_get_contents\s*\(", None),
        ("line", r"http[s]?://[\x22']\s*\.\s*\$_SERVER\[.HTTP_HOST"),
        ("line", r"new SoapClient\s*\(\s*\$|getimagesize\s*\(\s*\$"),
        ("function", r"FILTER_VALIDATE_URL", r"curl_exec\s*\(|file_get_contents\s*\(", None),
    ],
    "lfi": [
        ("line", r"\b(?:include|require)(?:_once)?\b[^;]*" + IN),
        ("line", r"\b(?:file_get_contents|readfile|fopen)\s*\([^;]*" + CAT),
        ("line", r"\b(?:include|require)(?:_once)?\b[^;]*\$_COOKIE"),
        ("function", r"\bbasename\s*\([^;]*" + IN, r"\b(?:include|require)(?:_once)?\b", None),
        ("function", r"\brealpath\s*\(", r"strpos\s*\([^;]*[^=!<>]==\s*0", None),
        ("line", r"pathinfo\s*\([^;]*PATHINFO_EXTENSION"),
    ],
    "filewrite": [
        ("line", r"move_uploaded_file\s*\([^;]*\['name'\]"),
        ("line", r"file_put_contents\s*\([^,;]*(?:\.\s*\$|" + IN + r")"),
        ("function", r"PATHINFO_EXTENSION", r"move_uploaded_file\s*\(", r"in_array\s*\("),
        ("line", r"->extractTo\s*\("),
        ("function", r"getimagesize\s*\(", r"move_uploaded_file\s*\(", None),
        ("line", r"\.htaccess|\.user\.ini"),
    ],
    "deserial": [
        ("line", r"unserialize\s*\(\s*" + IN),
        ("line", r"unserialize\s*\(\s*base64_decode"),
        ("line", r"(?:file_exists|getimagesize|is_file|filesize)\s*\(\s*(?:" + IN + r"|\$)"),
        ("line", r"session\.serialize_handler"),
        ("line", r"function\s+__(?:destruct|wakeup|toString)\b"),
        ("project", r"monolog/monolog|guzzlehttp/guzzle|symfony/process", r"unserialize\s*\(", None),
    ],
    "nosql": [
        ("line", r"->find(?:One)?\s*\([^;]*=>\s*" + IN),
        ("line", r"'\$regex'\s*=>\s*\$"),
        ("line", r"'\$where'\s*=>"),
        ("line", r"\$redis->(?:eval|rawCommand)\s*\("),
        ("line", r"\$redis->set\s*\(\s*\$"),
        ("line", r"::whereRaw\s*\(\s*\["),
    ],
    "ldap": [
        ("line", r"ldap_search\s*\([^;]*\.\s*" + IN),
        ("function", r"ldap_bind\s*\(", None, r"empty\s*\(\s*\$|strlen\s*\("),
        ("line", r"[\x22'](?:uid|cn)=[\x22']\s*\.\s*" + IN),
        ("line", r"sprintf\s*\(\s*[\x22']\([&|]"),
        ("line", r"\$filter\s*=\s*[\x22']\([^;]*" + CAT),
        ("line", r"->rawFilter\s*\("),
        ("line", r"ldap_(?:add|modify)\s*\([^;]*\$"),
    ],
    "crlf": [
        ("line", r"header\s*\(\s*[\x22']Location:[^;]*" + IN),
        ("line", r"header\s*\(\s*[\x22']X-[^;]*" + CAT),
        ("line", r"setcookie\s*\([^;]*(?:" + IN + r"|\$value)"),
        ("line", r"\bmail\s*\([^;]*\$headers"),
        ("line", r"\$response->header\s*\([^;]*\$"),
        ("line", r"filename=[^;]*" + IN),
        ("line", r"(?:Response::redirect|wp_redirect|redirect\(\)->to)\s*\(\s*\$"),
        ("line", r"error_log\s*\(\s*(?:" + IN + r"|\$)"),
    ],
    "csrf": [
        ("file", r"<form[^>]*method=[\x22']?POST", None, r"csrf_field|csrf_token|_token|@csrf"),
        ("line", r"protected\s+\$except\s*="),
        ("line", r"\$except\s*=.*\*"),
        ("file", r"middleware\s*\([^)]*'web'", None, r"VerifyCsrfToken"),
        ("file", r"(?:\$|jQuery)\.ajax\s*\(|axios\.post\s*\(", None, r"X-(?:CSRF|XSRF)-TOKEN"),
        ("line", r"Route::get\s*\(\s*[\x22'][^\x22']*(?:delete|remove|update|create)"),
        ("line", r"isset\s*\(\s*\$_POST\[.token.\]\s*\)"),
        ("project", r"session_start\s*\(", None, r"(?i)samesite"),
    ],
    "authz": [
        ("line", r"(?:::|->)(?:create|update|fill)\s*\(\s*\$request->all\(\)"),
        ("line", r"\$\w*(?:password|hash|token)\w*\s*==\s*\$"),
        ("function", r"::find\s*\(\s*" + IN, None, r"Auth::id|user_id|authorize\s*\("),
        ("line", r"JWT::decode\s*\([^,)]*\)"),
        ("line", r"Route::any\s*\(\s*[\x22']/admin"),
        ("line", r"in_array\s*\(\s*\$\w+\s*,\s*\[[^\]]*\]\s*\)"),
    ],
    "session": [
        ("function", r"\$_SESSION\[[^\]]*\]\s*=|session_start\s*\(", None, r"session_regenerate_id"),
        ("line", r"setcookie\s*\(\s*[^,()]+,\s*[^,()]+\)"),
        ("line", r"cookie_httponly\W+(?:0|Off|false)"),
        ("line", r"use_strict_mode\W+(?:0|Off|false)"),
        ("line", r"use_only_cookies\W+(?:0|Off|false)"),
        ("function", r"function\s+logout\b", None, r"session_destroy"),
        ("line", r"session_set_cookie_params\s*\(\s*\d*\s*\)"),
        ("function", r"\$_SESSION\[.user_id.\]\s*=", None, r"session_regenerate_id\s*\(\s*true"),
    ],
    "crypto": [
        ("line", r"\b(?:md5|sha1)\s*\(\s*\$\w*pass"),
        ("line", r"(?i)openssl_encrypt\s*\([^;]*-ECB"),
        ("line", r"\$(?:token|reset|csrf)\w*\s*=\s*[^;]*(?:md5\s*\(\s*time|rand\s*\()"),
        ("line", r"\bmd5\s*\([^)]*\)\s*==\s*[^=]"),
        ("line", r"\$iv\s*=\s*str_repeat|\$key\s*=\s*[\x22'][^\x22']+[\x22']"),
        ("function", r"\$\w*(?:hash|mac|sig)\w*\s*===\s*\$", None, r"hash_equals"),
    ],
    "race": [
        ("function", r"\$balance\s*=|getBalance\s*\(", r"deduct\s*\(|->decrement\s*\(|transfer\s*\(", r"lockForUpdate|DB::transaction"),
        ("function", r"->exists\s*\(\)", r"->delete\s*\(\)", r"lockForUpdate|DB::transaction"),
        ("function", r"move_uploaded_file\s*\(", r"\bunlink\s*\(", None),
        ("function", r"->count\s*\(\)", r"::create\s*\(", r"lockForUpdate|DB::transaction"),
        ("function", r"file_get_contents\s*\(", r"file_put_contents\s*\(", r"flock\s*\(|LOCK_EX"),
    ],
    "infoleak": [
        ("line", r"\b(?:var_dump|print_r|dd)\s*\(\s*\$"),
        ("line", r"\becho\b[^;]*->getMessage\s*\("),
        ("line", r"(?i)(?:api_?key|secret|db_pass\w*)[\x22']?\s*(?:=|,)\s*[\x22'][^\x22']{6,}[\x22']"),
        ("line", r"->json\s*\(\s*\$(?:user|model|account)\s*\)"),
        ("line", r"\bphpinfo\s*\(|server-status|_profiler"),
        ("line", r"/\.git/|/\.env\b|composer\.lock"),
    ],
    "logging": [
        ("line", LOG + r"[^;]*" + IN),
        ("line", LOG + r"[^;]*\$request->all\s*\("),
        ("line", r"(?i)" + LOG + r"[^;]*(?:password|token|secret)"),
        ("line", r"file_put_contents\s*\(\s*\$\w+\s*\.\s*[\x22']\.log"),
        ("line", r"(?:public|www)/[\w/]*\.?log|public/logs/"),
        ("line", r"display_errors[\x22']?\s*[,=]\s*[\x22']?(?:1|On)"),
        ("function", r"function\s+(?:login|authenticate|attempt)\b", None, LOG),
        ("line", LOG + r"[^;]*HTTP_USER_AGENT"),
    ],
    "config": [
        ("line", r"APP_DEBUG\s*=\s*true|display_errors\s*=\s*On|error_reporting\s*\(\s*E_ALL"),
        ("line", r"/\.git/config|/phpinfo\.php"),
        ("project", r"Access-Control-Allow-Origin:\s*\*", r"Access-Control-Allow-Credentials:\s*true", None),
        ("project", r"\bheader\s*\(", None, r"Content-Security-Policy"),
        ("line", r"session\.cookie_(?:httponly|secure)\s*=\s*(?:Off|0)"),
        ("line", r"/(?:adminer|telescope|horizon)\b"),
    ],
    "wordpress": [
        ("file", r"\$wpdb->query\s*\([^;]*\$", None, r"->prepare\s*\("),
        ("file", r"wp_ajax_nopriv_", None, r"check_ajax_referer|wp_verify_nonce"),
        ("line", r"\becho\s+\$_GET"),
        ("line", r"system\.multicall|xmlrpc\.php"),
        ("line", r"DISALLOW_FILE_EDIT.\s*,\s*false"),
        ("line", r"update_option\s*\(\s*[\x22'](?:siteurl|home)"),
    ],
    "business": [
        ("line", r"\$(?:price|amount|total)\s*=\s*" + IN),
        ("function", r"\$step\s*==", r"processPayment\s*\(", r"completed_steps|previousStep"),
        ("function", r"Coupon::where", r"->apply\s*\(", r"used_at|isUsed"),
        ("function", r"sendResetLink\s*\(", None, r"RateLimiter|throttle"),
        ("function", r"\$balance\s*>=", r"transfer\s*\(|deduct\s*\(", r"lockForUpdate|DB::transaction"),
        ("line", r"\$qty\s*=\s*(?:abs|intval)\s*\("),
    ],
}

# Insecure framework usage: (framework, pattern)
FRAMEWORK_USAGE = [
    ("laravel", r"APP_DEBUG\s*=\s*true"), ("laravel", r"\{!!.*!!\}"), ("laravel", r"->whereRaw\s*\([^;]*\$"),
    ("thinkphp", r"\bM\s*\([^)]*\)->where\s*\([^;]*\$"), ("thinkphp", r"\[\s*'exp'\s*,"),
    ("symfony", r"_profiler|app_dev\.php"), ("symfony", r"->createQuery\s*\([^;]*\.\s*\$"),
    ("yii", r"YII_DEBUG.\s*,\s*true"), ("yii", r"->findBySql\s*\([^;]*\$"),
    ("codeigniter", r"\$this->db->query\s*\([^;]*\.\s*\$"), ("codeigniter", r"global_xss_filtering.*false"),
    ("cakephp", r"->query\s*\([^;]*\.\s*\$"), ("wordpress", r"\$wpdb->(?:query|get_results)\s*\([^;]*\$"),
    ("drupal", r"db_query\s*\([^;]*\.\s*\$"), ("zend", r"new Zend_Db_Expr\s*\([^;]*\$"),
]
