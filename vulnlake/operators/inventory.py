"""Routes, schema, platform and dependency inventories read off source lines and lock files
(F37-F45, S20-S22, S43-S45, J35, B12, B16-B18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.functions.score import pick

# Entry points that are not HTTP routes (kind, pattern, name group).
ENTRY_RULES = [
    ("ENTRY_CLI", r"(\$argv\b|\bgetopt\s*\(|\$this->(?:argument|option)\s*\()"), ("ENTRY_CRON", r"(\$schedule->\w+\s*\(|AsCronTask)"),
    ("ENTRY_QUEUE", r"(implements\s+ShouldQueue|think\\queue\\Job|AsMessageHandler)"), ("ENTRY_HOOK", r"(post[-_]deploy|\.githooks/|post-install-cmd)"),
]
INPUT_RULES = [
    ("$_GET", r"\$_GET\b|->query\s*\(\s*'"), ("$_POST", r"\$_POST\b|->input\s*\("), ("$_FILES", r"\$_FILES\b|->file\s*\("),
    ("$_REQUEST", r"\$_REQUEST\b"), ("route_param", r"Route::\w+\s*\([^;]*\{\w+\}"), ("Request", r"\bRequest\s+\$request\b|\$request->all\s*\("),
]
ROUTE_CALL = r"Route::(get|post|put|patch|delete|any|match)\s*\(\s*(?:\[[^\]]*\]\s*,\s*)?'([^']+)'"
ROUTE_OTHER = [("connect", r"->connect\s*\(\s*'([^']+)'"), ("rest", r"register_rest_route\s*\(\s*'[^']*'\s*,\s*'([^']+)'"),
               ("attribute", r"Route\(\s*'([^']+)'"), ("method", r"\$routes->(?:get|post|put|delete)\s*\(\s*'([^']+)'")]
RESOURCE_CALL = r"Route::resource\s*\(\s*'([^']+)'\s*,\s*(\w+)"
# The seven routes of a resource (verb, suffix, action).
RESOURCE_ROUTES = [("GET", "", "index"), ("GET", "/create", "create"), ("POST", "", "store"), ("GET", "/{id}", "show"),
                   ("GET", "/{id}/edit", "edit"), ("PUT", "/{id}", "update"), ("DELETE", "/{id}", "destroy")]
BUNDLE_PATH = r"[\x22'](/api/[^\x22']+)[\x22']"
SQL_TABLE = r"(?i)\b(?:from|into|update|join)\s+`?(\w+)"
# Migration calls and validation words with their SQL types.
COLUMN_TYPES = {"string": "VARCHAR", "integer": "INT", "text": "TEXT", "boolean": "TINYINT(1)", "timestamp": "TIMESTAMP", "json": "JSON",
                "unsignedBigInteger": "BIGINT UNSIGNED", "id": "BIGINT UNSIGNED AUTO_INCREMENT PRIMARY KEY", "timestamps": "TIMESTAMP",
                "softDeletes": "TIMESTAMP NULL", "bigInteger": "BIGINT"}
MIGRATION = r"\$table->(\w+)\s*\((?:\s*'(\w+)')?(?:\s*,\s*([0-9]+))?"
# Framework signatures in the order they are tried.
FRAMEWORKS = [("laravel/framework", "Laravel"), ("topthink/framework", "ThinkPHP"), ("yiisoft/yii2", "Yii2"), ("symfony/symfony", "Symfony"),
              ("cakephp/cakephp", "CakePHP"), ("codeigniter4/framework", "CodeIgniter"), ("slim/slim", "Slim"), ("illuminate/routing", "Lumen"),
              ("hyperf/hyperf", "Hyperf"), ("swoft/swoft", "Swoft"), ("api-platform/core", "API Platform"), ("dingo/api", "Dingo API")]
# Syntax features and the version they need, as major * 100 + minor.
SYNTAX = [(801, r"\bmatch\s*\(|^\s*enum\s+\w+|\bnew Fiber\b"), (800, r"\?->|^\s*#\[|\w+\|\w+\s+\$\w+"), (704, r"\bfn\s*\(|(?:public|private|protected)\s+(?:int|string|bool|array|\??[A-Z]\w*)\s+\$\w+")]
SYNTAX_DEFAULT = 702
RISKY_EXTENSIONS = {"ioncube loader": "encrypted code", "xdebug": "debugger in production", "ffi": "native calls", "mcrypt": "weak crypto", "xmlrpc": "xml entities"}
HTTP_STATE = ["POST", "PUT", "PATCH", "DELETE"]


def entry_points(lines: DataFrame) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(F.col("code").rlike(rx), F.struct(
        F.lit(kind).alias("entry_type"), F.regexp_extract("code", rx, 1).alias("_m"))) for kind, rx in ENTRY_RULES]))
    rows = lines.select("project", "path", "line", F.explode(found).alias("_e")).select("project", "path", "line", "_e.entry_type")
    stem = F.regexp_extract("path", r"([^/]+)\.\w+$", 1)
    return rows.withColumn("synthetic_id", F.concat("entry_type", F.lit(":"), stem)).withColumn("auth_level", F.lit("system"))


def routes(lines: DataFrame) -> DataFrame:
    """Routes registered on one line; ``any`` and ``match`` keep their name as method."""
    other = F.array_compact(F.array(*[F.when(F.col("code").rlike(rx), F.struct(
        F.lit(kind).alias("method"), F.regexp_extract("code", rx, 1).alias("url"))) for kind, rx in ROUTE_OTHER]))
    main = F.when(F.col("code").rlike(ROUTE_CALL), F.struct(
        F.upper(F.regexp_extract("code", ROUTE_CALL, 1)).alias("method"), F.regexp_extract("code", ROUTE_CALL, 2).alias("url")))
    rows = lines.select("project", "path", "line", F.explode(F.concat(F.array_compact(F.array(main)), other)).alias("_r"))
    return rows.select("project", "path", "line", "_r.*")


def resource_routes(lines: DataFrame) -> DataFrame:
    base, ctl = F.regexp_extract("code", RESOURCE_CALL, 1), F.regexp_extract("code", RESOURCE_CALL, 2)
    seven = F.array(*[F.struct(F.lit(v).alias("method"), F.concat(F.lit("/"), base, F.lit(s)).alias("url"), F.lit(a).alias("action")) for v, s, a in RESOURCE_ROUTES])
    return lines.where(F.col("code").rlike(RESOURCE_CALL)).select("project", "path", "line", ctl.alias("controller"), F.explode(seven).alias("_r")).select(
        "project", "path", "line", "controller", "_r.*")


def parameter_sources(lines: DataFrame) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(F.col("code").rlike(rx), F.lit(n)) for n, rx in INPUT_RULES]))
    return lines.select("project", "path", "line", F.explode(found).alias("source"))


def hidden_endpoints(lines: DataFrame, known: DataFrame, text: str = "code") -> DataFrame:
    """API paths in front-end text that no registered route has."""
    found = lines.select("project", F.explode(F.regexp_extract_all(text, F.lit(BUNDLE_PATH), F.lit(1))).alias("url")).distinct()
    return found.join(known.select("project", "url"), ["project", "url"], "left_anti").withColumn("hidden", F.lit(True))


def sql_tables(lines: DataFrame, text: str = "code") -> DataFrame:
    return lines.select("project", "path", "line", F.explode(F.regexp_extract_all(text, F.lit(SQL_TABLE), F.lit(1))).alias("tbl")).withColumn("tbl", F.lower("tbl"))


def migration_columns(lines: DataFrame) -> DataFrame:
    call, name, size = (F.regexp_extract("code", MIGRATION, i) for i in (1, 2, 3))
    kind = pick(call, COLUMN_TYPES)
    typed = F.when((call == "string"), F.concat(F.lit("VARCHAR("), F.when(size == "", "255").otherwise(size), F.lit(")"))).otherwise(kind)
    return lines.where(F.col("code").rlike(MIGRATION)).select("project", "path", "line", name.alias("col"), typed.alias("type")).where(F.col("type").isNotNull())


def validation_type(rule: str | Column) -> Column:
    r = F.col(rule) if isinstance(rule, str) else rule
    words = F.split(r, r"\|")
    has = lambda w: F.array_contains(words, w)
    cap = F.regexp_extract(r, r"max:([0-9]+)", 1)
    return (F.when(has("integer"), F.when(r.contains("min:0"), "INT UNSIGNED").otherwise("INT")).when(has("boolean"), "TINYINT(1)").when(has("date"), "DATE")
            .when(has("numeric"), "DECIMAL").when(has("email") | has("string"), F.concat(F.lit("VARCHAR("), F.when(cap == "", "255").otherwise(cap), F.lit(")"))))


def foreign_keys(lines: DataFrame) -> DataFrame:
    """Key columns implied by relation methods; ``owner`` is the enclosing class."""
    rx = r"->(hasMany|hasOne|belongsTo|belongsToMany)\s*\(\s*(\w+)::class"
    rel, target = F.regexp_extract("code", rx, 1), F.lower(F.regexp_extract("code", rx, 2))
    owner = F.lower(F.coalesce("in_class", F.lit("")))
    fk = (F.when(rel == "belongsTo", F.concat(target, F.lit("_id"))).when(rel == "belongsToMany", F.concat_ws(",", F.concat(owner, F.lit("_id")), F.concat(target, F.lit("_id"))))
          .otherwise(F.concat(owner, F.lit("_id"))))
    tbl = F.when(rel == "belongsToMany", F.concat_ws("_", owner, target)).when(rel == "belongsTo", owner).otherwise(target)
    return lines.where(F.col("code").rlike(rx)).select("project", "path", "line", rel.alias("relation"), tbl.alias("tbl"), fk.alias("columns"))


def framework_of(require: DataFrame) -> DataFrame:
    """First framework signature, in rule order, per project."""
    rank, name = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, (pkg, label) in enumerate(FRAMEWORKS):
        rank = F.when(F.col("package") == pkg, i).otherwise(rank)
        name = F.when(F.col("package") == pkg, label).otherwise(name)
    return require.groupBy("project").agg(F.coalesce(F.min_by(name, rank), F.lit("Native")).alias("framework"))


def syntax_floor(lines: DataFrame, default: int = SYNTAX_DEFAULT) -> DataFrame:
    level = F.lit(default)
    for v, rx in reversed(SYNTAX):
        level = F.when(F.col("code").rlike(rx), v).otherwise(level)
    return lines.groupBy("project").agg(F.max(level).alias("php_floor"))


def database_type(require: DataFrame, config: Column | None = None, env: Column | None = None) -> DataFrame:
    """First available signal per project, else the default."""
    ext = require.groupBy("project").agg(
        F.max(F.when(F.col("package") == "ext-pdo_mysql", "mysql")).alias("m"), F.max(F.when(F.col("package") == "ext-pdo_pgsql", "pgsql")).alias("p"),
        *([F.min(config).alias("c")] if config is not None else []), *([F.min(env).alias("e")] if env is not None else []))
    parts = [F.col(x) for x in ("c", "e", "m", "p") if x in ext.columns]
    return ext.select("project", F.coalesce(*parts, F.lit("mysql")).alias("db_type"))


def maintenance_flags(age_months: Column, stars: Column, issues: Column, license_: Column, maintainers: Column, abandoned: Column) -> Column:
    return F.array_compact(F.array(
        F.when(age_months > 24, "stale:high"), F.when(stars < 50, "few_stars:medium"), F.when(issues > 5, "open_security_issues:high"),
        F.when(license_.isNull(), "no_license:low"), F.when(maintainers == 1, "single_maintainer:medium"), F.when(abandoned, "abandoned:high")))


def suspicious_script(script: Column) -> Column:
    return script.rlike(r"(?i)\beval\b|base64_decode|\bcurl\b")


def changed_sources(locks: DataFrame, order, keys=("package",)) -> DataFrame:
    """Versions whose download url differs from the previous lock entry."""
    from vulnlake.operators.ordered import previous

    p = previous(locks, list(keys), order, {"prev_url": "url"})
    return p.where(F.col("prev_url").isNotNull() & (F.col("prev_url") != F.col("url")))


def event_edges(lines: DataFrame) -> DataFrame:
    """Call edges hidden in events: the dispatching function calls the listener of that event."""
    fire = lines.where(F.col("code").rlike(r"dispatch\s*\(\s*(?:new\s+)?\w+")).select(
        "project", "path", "line", "in_function", F.regexp_extract("code", r"dispatch\s*\(\s*(?:new\s+)?(\w+)", 1).alias("event"))
    rx = r"(\w+)::class\s*=>\s*\[?\s*(\w+)::class"
    listen = lines.where(F.col("code").rlike(rx)).select(
        "project", F.regexp_extract("code", rx, 1).alias("event"), F.regexp_extract("code", rx, 2).alias("listener")).distinct()
    return fire.join(listen, ["project", "event"])


def session_setting_issues(settings: DataFrame) -> DataFrame:
    n = F.col("value").try_cast("long")
    k = F.col("key")
    issue = (F.when((k == "session.sid_length") & (n < 48), "short_id").when((k == "session.sid_bits_per_character") & (n < 6), "few_bits")
             .when((k == "session.gc_maxlifetime") & (n > 86400), "long_lifetime").when((k == "session.cookie_path") & (F.col("value") == "/"), "wide_path")
             .when((k == "session.cookie_domain") & F.col("value").startswith("."), "wide_domain"))
    return settings.withColumn("issue", issue).where(F.col("issue").isNotNull())


def setting_conflicts(ini: DataFrame, runtime: DataFrame) -> DataFrame:
    """Keys whose file value and runtime value differ; each side is one row per key first."""
    a = ini.groupBy("project", "key").agg(F.min("value").alias("ini_value"))
    b = runtime.groupBy("project", "key").agg(F.min("value").alias("runtime_value"))
    return a.join(b, ["project", "key"]).where(F.col("ini_value") != F.col("runtime_value"))


def forgery_gaps(routes_: DataFrame) -> DataFrame:
    """State-changing routes without anti-forgery cover and state-changing GET routes."""
    covered = F.col("middleware").rlike("(^|,)(csrf|web)")
    verb = F.col("url").rlike("(?i)delete|remove|update|create|payment|transfer")
    issue = (F.when(F.col("method").isin(HTTP_STATE) & ~covered, "no_token_check").when((F.col("method") == "GET") & verb, "state_change_by_get"))
    return routes_.withColumn("issue", issue).where(F.col("issue").isNotNull())


AUTH_SIGNATURES = [("jwt", r"JWT::(?:decode|encode)"), ("session", r"\$_SESSION|session_start\s*\("), ("basic", r"PHP_AUTH_USER"), ("api_key", r"(?i)x-api-key|\$apiKey"),
                   ("oauth", r"(?i)passport|oauth"), ("sanctum", r"(?i)sanctum"), ("wordpress", r"wp_set_auth_cookie|check_ajax_referer"), ("ldap", r"ldap_bind\s*\(")]


def auth_types(lines: DataFrame) -> DataFrame:
    """Sign-in mechanisms seen per project (a fixed vocabulary of eight)."""
    found = F.array_compact(F.array(*[F.when(F.col("code").rlike(rx), F.lit(n)) for n, rx in AUTH_SIGNATURES]))
    return lines.select("project", F.explode(found).alias("a")).groupBy("project").agg(F.sort_array(F.collect_set("a")).alias("auth_types"))


def cms_components(files: DataFrame, text: str = "text") -> DataFrame:
    """Component, version and kind from file headers and paths."""
    version = F.regexp_extract(text, r"(?im)^[\s*]*Version:\s*([0-9][\w.]*)", 1)
    name = F.regexp_extract(text, r"(?im)^[\s*]*(?:Plugin|Theme) Name:\s*(.+?)\s*$", 1)
    kind = F.when(F.col(text).rlike("(?i)Plugin Name:"), "plugin").when(F.col(text).rlike("(?i)Theme Name:"), "theme")
    return files.where(kind.isNotNull()).select(*[c for c in files.columns if c != text], kind.alias("kind"), name.alias("name"), version.alias("version"))


def open_rest_routes(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("code").rlike(r"register_rest_route\s*\(") & ~F.col("code").contains("permission_callback")).select("project", "path", "line")
