"""Recorded HTTP exchanges: headers, CORS, cookies, tokens, firewalls, redirects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Headers a response should carry, and headers that tell too much.
REQUIRED_HEADERS = {
    "x-frame-options": "medium", "content-security-policy": "high", "strict-transport-security": "high",
    "x-content-type-options": "low", "referrer-policy": "low", "permissions-policy": "low",
}
LEAKING_HEADERS = ["x-powered-by", "server", "x-aspnet-version"]
# Firewall signatures in order; the last product that matches names the type.
FIREWALLS = [
    ("cloudflare", ["server: cloudflare", "cf-ray:"]), ("aws_waf", ["x-amzn-requestid", "aws"]),
    ("modsecurity", ["mod_security", "modsecurity", "noyb"]), ("baota", ["bt-panel", "宝塔", "btpanel"]), ("yunsuo", ["yunsuo", "云锁"]),
    ("safedog", ["safedog", "安全狗", "waf/2.0"]), ("aliwaf", ["ali-cdn", "aliyun"]), ("tencent_waf", ["tencent-waf", "waf-tencent"]),
    ("nginx_waf", ["openresty", "lua-resty-waf"]), ("wordfence", ["wordfence", "wf-action"]),
]
REDIRECT_PARAMS = ["url", "redirect", "redirect_url", "redirect_uri", "return", "return_url", "returnTo", "next", "next_url", "goto", "go",
                   "target", "dest", "destination", "redir", "rurl", "out", "continue", "forward", "ref", "callback", "path", "to"]
# Paths that should never answer 200.
SENSITIVE_PATHS = ["/.env", "/.git/", "/.svn/", "/composer.json", "/composer.lock", "/phpinfo.php", "/adminer", "/phpmyadmin", "/telescope",
                   "/horizon", "/_debugbar", "/_profiler", "/swagger", "/api/documentation", "/log-viewer"]
BACKUP_SUFFIX = r"(\.(bak|swp|sql|zip|tar\.gz|old|orig|save)|~)$"
HOSTING_SUFFIXES = ["github.io", "herokuapp.com", "s3.amazonaws.com", "azurewebsites.net", "cloudfront.net", "shopify.com", "fastly.net"]
# Runtime settings and the value that is dangerous (null means unset counts).
RUNTIME_RULES = [
    ("allow_url_include", "on"), ("allow_url_fopen", "on"), ("display_errors", "on"), ("expose_php", "on"), ("register_argc_argv", "on"),
    ("open_basedir", None), ("disable_functions", None), ("session.cookie_httponly", "off"), ("session.cookie_secure", "off"),
    ("session.use_strict_mode", "off"), ("upload_max_filesize", ">100M"), ("max_input_vars", ">10000"), ("serialize_handler", "php"),
]


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def header_findings(responses: DataFrame, headers: str = "headers") -> DataFrame:
    """Missing and leaking headers per response; ``headers`` maps any-case names to values."""
    names = F.transform(F.map_keys(headers), lambda k: F.lower(k))
    missing = F.transform(F.array_except(F.array(*[F.lit(h) for h in REQUIRED_HEADERS]), names), lambda h: F.struct(
        F.lit("missing_header").alias("kind"), h.alias("header")))
    leaking = F.transform(F.array_intersect(F.array(*[F.lit(h) for h in LEAKING_HEADERS]), names), lambda h: F.struct(
        F.lit("information_leak").alias("kind"), h.alias("header")))
    keep = [c for c in responses.columns if c != headers]
    rows = responses.select(*keep, F.explode(F.concat(missing, leaking)).alias("_f")).select(*keep, "_f.*")
    sev = F.lit("low")
    for h, s in REQUIRED_HEADERS.items():
        sev = F.when((F.col("kind") == "missing_header") & (F.col("header") == h), s).otherwise(sev)
    return rows.withColumn("severity", sev)


def cors_issue(origin: Column, acao: Column, credentials: Column, host: Column | None = None) -> Column:
    """Wildcard without credentials is a known false positive and stays null."""
    foreign = acao.rlike("^https?://") & (acao == origin)
    near = F.lit(False) if host is None else (acao.contains(host) & ~acao.rlike(r"^https?://([a-z0-9-]+\.)*[a-z0-9-]+$"))
    return (F.when((acao == "*") & credentials, "wildcard_with_credentials").when((acao == "null") & credentials, "null_origin")
            .when(foreign & credentials, "reflected_origin").when(near, "substring_origin"))


def cookie_issues(set_cookie: str | Column) -> Column:
    c = _c(set_cookie)
    return F.array_compact(F.array(
        F.when(~c.rlike(r"(?i);\s*httponly"), "no_httponly"), F.when(~c.rlike(r"(?i);\s*secure"), "no_secure"),
        F.when(~c.rlike(r"(?i);\s*samesite\s*="), "no_samesite"), F.when(c.rlike(r"(?i);\s*samesite\s*=\s*none"), "samesite_none")))


def runtime_findings(settings: DataFrame, rules=RUNTIME_RULES) -> DataFrame:
    """Dangerous runtime settings per project; settings that must exist count when unset.

    The projects come from the settings themselves; the rule table has a fixed size."""
    norm = F.when(F.lower(F.trim("value")).isin("1", "on", "true", "yes"), "on").when(
        F.lower(F.trim("value")).isin("0", "off", "false", "no", ""), "off").otherwise(F.lower(F.trim("value")))
    s = settings.select("project", "key", norm.alias("_v"), F.col("value"))
    bad = F.lit(False)
    for key, value in rules:
        if value is None:
            continue
        if value.startswith(">"):
            n = F.regexp_extract("value", r"^(\d+)", 1).try_cast("long")
            bad = bad | ((F.col("key") == key) & (n > int(value[1:].rstrip("M"))))
        else:
            bad = bad | ((F.col("key") == key) & (F.col("_v") == value))
    found = s.where(F.coalesce(bad, F.lit(False))).select("project", "key", F.lit("dangerous_value").alias("issue")).distinct()
    must = [k for k, v in rules if v is None]
    have = settings.groupBy("project").agg(*[
        F.max(F.when((F.col("key") == k) & (F.trim("value") != ""), 1)).alias(f"h{i}") for i, k in enumerate(must)])
    unset = have.select("project", F.explode(F.array_compact(F.array(*[
        F.when(F.col(f"h{i}").isNull(), F.lit(k)) for i, k in enumerate(must)]))).alias("key"), F.lit("not_set").alias("issue"))
    return found.unionByName(unset)


def token_parts(token: str | Column) -> tuple[Column, Column]:
    """Decoded header and payload JSON of a recorded three-part token (null otherwise)."""
    t = _c(token)
    parts = F.split(t, "[.]")
    def decode(i):
        raw = F.translate(parts[i], "-_", "+/")
        padded = F.rpad(raw, (F.ceil(F.length(raw) / 4) * 4).cast("int"), F.lit("="))
        return F.when(F.size(parts) == 3, F.try_to_binary(padded, F.lit("base64")).try_cast("string"))
    return decode(0), decode(1)


def token_issues(token: str | Column) -> Column:
    header, payload = token_parts(token)
    alg = F.lower(F.get_json_object(header, "$.alg"))
    exp, iat = (F.get_json_object(payload, f"$.{k}").try_cast("long") for k in ("exp", "iat"))
    kid = F.get_json_object(header, "$.kid")
    return F.array_compact(F.array(
        F.when(header.isNull(), "not_three_parts"), F.when(alg == "none", "alg_none"), F.when(alg.startswith("hs"), "hmac_alg"),
        F.when(header.isNotNull() & exp.isNull(), "no_expiry"), F.when(exp - iat > 3600, "long_lived"),
        F.when(kid.rlike(r"[/'\x22;]|\.\."), "odd_kid")))


def firewall_of(text: str | Column) -> Column:
    """struct<waf_type, signatures> from lower-cased headers and body."""
    t = F.lower(_c(text))
    name = F.lit("none")
    signs = []
    for product, patterns in FIREWALLS:
        for p in patterns:
            name = F.when(t.contains(p), product).otherwise(name)
            signs.append(F.when(t.contains(p), F.lit(p)))
    return F.struct(name.alias("waf_type"), F.array_compact(F.array(*signs)).alias("signatures"))


def decoded_target(target: str | Column) -> Column:
    t = F.trim(_c(target))
    return F.coalesce(F.try_url_decode(t), t)


def redirect_class(target: str | Column, decoded: str | Column, own_host: Column) -> Column:
    """Where a redirect target leads; ``decoded`` is a column with ``decoded_target`` text."""
    t, decoded = F.trim(_c(target)), _c(decoded)
    host = F.regexp_extract(decoded, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]+)", 1)
    return (
        F.when(decoded.rlike(r"(?i)^\s*(?:javascript|data|vbscript):"), "script_scheme")
        .when(decoded.rlike(r"^[/\\]*\\"), "backslash").when(decoded.rlike(r"^//"), "protocol_relative")
        .when(decoded.rlike(r"^[a-zA-Z]+://[^/]*@"), "userinfo").when((host != "") & (host != own_host), F.when(decoded != t, "encoded_external").otherwise("external"))
        .when(decoded.rlike(r"^/($|[^/\\])"), "internal_path").otherwise("internal"))


def redirect_param(url: str | Column) -> Column:
    """Value of the first query parameter that usually holds a redirect target."""
    names = "|".join(REDIRECT_PARAMS)
    return F.nullif(F.regexp_extract(_c(url), rf"[?&](?:{names})=([^&#]*)", 1), F.lit(""))


ESCAPES = r"(?:\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4})+"


def decode_escapes(text: Column) -> Column:
    """Resolve \\xHH and \\uHHHH escapes: runs of them become UTF-16 code units, the text between them stays."""
    units = lambda run: F.replace(F.regexp_replace(run, r"\\x([0-9a-fA-F]{2})", "00$1"), F.lit("\\u"), F.lit(""))
    runs = F.transform(F.regexp_extract_all(text, F.lit(ESCAPES), F.lit(0)), lambda r: F.decode(F.unhex(units(r)), "UTF-16BE"))
    gaps = F.split(text, ESCAPES, -1)
    return F.array_join(F.zip_with(gaps, runs, lambda g, r: F.concat(g, F.coalesce(r, F.lit("")))), "")


def canonical(uri: str | Column, escapes: bool = False) -> Column:
    """URL-decode twice, resolve entities, drop inline comments and fold case."""
    u = _c(uri)
    once = F.coalesce(F.try_url_decode(u), u)
    twice = F.coalesce(F.try_url_decode(once), once)
    for entity, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        twice = F.replace(twice, F.lit(entity), F.lit(ch))
    if escapes:
        twice = F.when(twice.rlike(r"\\[xu][0-9a-fA-F]{2}"), decode_escapes(twice)).otherwise(twice)
    return F.lower(F.regexp_replace(twice, r"/\*(?:[^*]|\*[^/])*\*/", ""))


def sensitive_path(canonical_uri: str | Column) -> Column:
    """Which sensitive path a request asks for. Takes a column that holds ``canonical``
    text, so that it is decoded once per row and not once per rule."""
    u = _c(canonical_uri)
    hit = None
    for p in SENSITIVE_PATHS:
        hit = F.when(u.contains(p), F.lit(p)) if hit is None else hit.when(u.contains(p), F.lit(p))
    return hit.when(F.regexp_replace(u, r"[?#].*$", "").rlike(BACKUP_SUFFIX), F.lit("backup"))


def cached_private(cache_hit: Column, sets_cookie: Column, path: Column, dynamic: Column) -> Column:
    return (F.when(cache_hit & sets_cookie, "cookie_in_cache")
            .when(dynamic & path.rlike(r"\.(css|js|png|jpg|gif|ico|svg|woff2?)$"), "static_suffix_on_dynamic"))


def dangling_alias(cname: Column, resolves: Column) -> Column:
    hosted = F.lit(False)
    for s in HOSTING_SUFFIXES:
        hosted = hosted | cname.endswith(s)
    return hosted & ~resolves
