"""Scoring rules as Column expressions (no UDFs, so they stay in codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sink families by danger class.
HIGH_DANGER = ["RCE", "Deserialization", "LFI"]
MEDIUM_DANGER = ["SQLi", "FileWrite", "SSRF", "XXE", "NoSQL", "GraphQL", "WordPress", "LDAP"]
# Words that mark a business area.
FINANCIAL_WORDS = ["payment", "order", "checkout", "transfer", "withdraw"]
PII_WORDS = ["user", "profile", "account", "personal"]
AUTH_WORDS = ["login", "auth", "password", "token", "session"]
FILE_WORDS = ["upload", "download"]
# Severity order, most urgent first.
SEVERITY_ORDER = ["critical", "high", "medium", "low"]


def C(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pick(value: Column, table: dict, default=None) -> Column:
    """A lookup with few entries as one CASE."""
    out = None
    for key, result in table.items():
        out = F.when(value == key, F.lit(result)) if out is None else out.when(value == key, F.lit(result))
    return out.otherwise(F.lit(default))


def has_word(text: Column, words: list[str]) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(words)), F.lit(False))


def rank_of(value: str | Column, ordered: list[str]) -> Column:
    """Position in an ordered enum; unknown values sort last."""
    return pick(C(value), {v: i for i, v in enumerate(ordered)}, len(ordered))


def scoring_auth(auth: str | Column) -> Column:
    """The three levels used for scoring; unknown callers count as anonymous."""
    a = C(auth)
    return (
        F.when(a.isin("admin", "system"), "admin")
        .when(a.isin("authenticated", "api_key", "oauth", "2fa"), "authenticated")
        .otherwise("anonymous")
    )


def danger_class(sink_type: str | Column) -> Column:
    t = C(sink_type)
    return F.when(t.isin(HIGH_DANGER), "high").when(t.isin(MEDIUM_DANGER), "medium").otherwise("low")


def base_priority(auth: str | Column, danger: str | Column) -> Column:
    """0..3 for P0..P3."""
    a, d = scoring_auth(auth), C(danger)
    step = pick(d, {"high": 0, "medium": 1}, 2)
    return F.when(a == "admin", F.lit(3)).when(a == "anonymous", step).otherwise(step + 1)


def business_tags(url: str | Column, controller: str | Column, writes_db: Column | None = None) -> Column:
    u, c = C(url), C(controller)
    pii = has_word(c, PII_WORDS)
    if writes_db is not None:
        pii = pii & writes_db
    return F.array_compact(
        F.array(
            F.when(has_word(u, FINANCIAL_WORDS), "financial_impact"),
            F.when(pii, "pii_exposure"),
            F.when(has_word(u, AUTH_WORDS), "auth_critical"),
            F.when(has_word(u, ["admin"]), "admin_function"),
            F.when(has_word(u, FILE_WORDS), "file_operation"),
        )
    )


def final_priority(base: Column, source_count: Column, tags: Column) -> Column:
    """Raise one level for three or more sources and one for a business area."""
    boosted = F.arrays_overlap(tags, F.array(*[F.lit(x) for x in ("financial_impact", "pii_exposure", "auth_critical")]))
    up = F.when(source_count >= 3, 1).otherwise(0) + F.when(boosted, 1).otherwise(0)
    return F.concat(F.lit("P"), F.greatest(base - up, F.lit(0)).cast("string"))


def cvss_metrics(auth: str | Column, filtered: Column, sink_type: str | Column) -> dict[str, Column]:
    a, t = scoring_auth(auth), C(sink_type)
    return {
        "AV": F.when(a == "admin", "A").otherwise("N"),
        "AC": F.when(filtered, "H").otherwise("L"),
        "PR": pick(a, {"anonymous": "N", "authenticated": "L"}, "H"),
        "UI": F.when(t == "XSS", "R").otherwise("N"),
        "S": F.when(t.isin("SSRF", "Deserialization"), "C").otherwise("U"),
        "C": F.when(t.isin("SQLi", "LFI", "InfoLeak", "RCE"), "H").when(t == "XSS", "L").otherwise("N"),
        "I": F.when(t.isin("RCE", "FileWrite", "SQLi"), "H").when(t == "XSS", "L").otherwise("N"),
        "A": F.when(t.isin("RCE", "DoS"), "H").otherwise("N"),
    }


def cvss_vector(m: dict[str, Column]) -> Column:
    parts: list[Column] = [F.lit("CVSS:3.1")]
    for key in ("AV", "AC", "PR", "UI", "S", "C", "I", "A"):
        parts.append(F.concat(F.lit(key + ":"), m[key]))
    return F.concat_ws("/", *parts)


def cvss_base(m: dict[str, Column]) -> Column:
    """CVSS 3.1 base score with the specification's integer round-up."""
    changed = m["S"] == "C"
    av = pick(m["AV"], {"N": 0.85, "A": 0.62, "L": 0.55}, 0.2)
    ac = pick(m["AC"], {"L": 0.77}, 0.44)
    pr = F.when(m["PR"] == "N", 0.85).when(m["PR"] == "L", F.when(changed, 0.68).otherwise(0.62)).otherwise(
        F.when(changed, 0.5).otherwise(0.27))
    ui = pick(m["UI"], {"N": 0.85}, 0.62)
    impact_of = {"H": 0.56, "L": 0.22}
    kept = (1 - pick(m["C"], impact_of, 0.0)) * (1 - pick(m["I"], impact_of, 0.0)) * (1 - pick(m["A"], impact_of, 0.0))
    iss = 1 - kept
    impact = F.when(changed, 7.52 * (iss - 0.029) - 3.25 * F.pow(iss - 0.02, F.lit(15.0))).otherwise(6.42 * iss)
    exploit = 8.22 * av * ac * pr * ui
    raw = F.least(F.when(changed, 1.08 * (impact + exploit)).otherwise(impact + exploit), F.lit(10.0))
    scaled = F.round(raw * 100000).cast("long")
    up = F.when(scaled % 10000 == 0, scaled / 100000).otherwise((F.floor(scaled / 10000) + 1) / 10)
    return F.when(impact <= 0, F.lit(0.0)).otherwise(up.cast("double"))


def cvss_band(score: str | Column) -> Column:
    s = C(score)
    return F.when(s >= 9, "CRITICAL").when(s >= 7, "HIGH").when(s >= 4, "MEDIUM").when(s > 0, "LOW").otherwise("NONE")


def attack_surface(auth, control, filtering, sink_type, area) -> Column:
    """0..100 from reach 30, control 25, filtering 20, danger 15, business 10 percent."""
    reach = pick(scoring_auth(auth), {"anonymous": 100, "authenticated": 60}, 20)
    ctl = pick(C(control), {"direct": 100, "partial": 60, "parameterised": 30}, 0)
    flt = pick(C(filtering), {"none": 100, "blacklist": 70, "weak_whitelist": 40, "whitelist": 10}, 0)
    danger = pick(C(sink_type), {"RCE": 100, "SQLi": 80, "Deserialization": 80, "SSRF": 70, "FileWrite": 70}, 50)
    biz = pick(C(area), {"payment": 100, "pii": 100, "admin": 80}, 40)
    return ((reach * 30 + ctl * 25 + flt * 20 + danger * 15 + biz * 10) / 100).cast("double")


def severity_hundredths(r, i, c) -> Column:
    """40R + 35I + 25C: the weighted score in exact hundredths."""
    return C(r) * 40 + C(i) * 35 + C(c) * 25


def adjusted_axes(r, i, c, judgment) -> tuple[Column, Column, Column]:
    """Exploitability: conditional lowers C by one, not exploitable clears R and C."""
    j = C(judgment)
    off = j == "not_exploitable"
    r2 = F.when(off, 0).otherwise(C(r))
    c2 = F.when(off, 0).when(j == "conditionally_exploitable", F.greatest(C(c) - 1, F.lit(0))).otherwise(C(c))
    return r2, C(i), c2


def severity_level(h: str | Column) -> Column:
    x = C(h)
    return F.when(x >= 270, "C").when(x >= 210, "H").when(x >= 120, "M").when(x >= 10, "L")


def severity_cvss(h: str | Column) -> Column:
    """score / 3 * 10, one decimal, from hundredths (half up in integers)."""
    return (F.floor((C(h) * 2 + 3) / 6) / 10).cast("double")


def report_priority(weighted: str | Column) -> Column:
    w = C(weighted)
    return F.when(w >= 8, "P0").when(w >= 6, "P1").when(w >= 4, "P2").otherwise("P3")


def report_score(auth, family, ease) -> Column:
    """The 0..10 report scale: R and I from lookups, C from the ease of use."""
    r = pick(C(auth), {"anonymous": 10, "authenticated": 7, "admin": 4, "internal_only": 2}, 0)
    i = pick(C(family), {"RCE": 10, "SQLi": 9, "FileWrite": 8, "XSS": 7, "InfoLeak": 5, "Config": 4}, 0)
    c = pick(C(ease), {"trivial": 10, "low": 8, "medium": 5, "high": 3, "theoretical": 1}, 0)
    return ((r * 40 + i * 35 + c * 25) / 100).cast("double")


def score_bucket(cvss: str | Column) -> Column:
    s = C(cvss)
    return F.when(s >= 9, "critical").when(s >= 7, "high").when(s >= 4, "medium").otherwise("low")


def expected_evidence(h: str | Column) -> Column:
    """Lowest evidence score that fits a severity in hundredths."""
    x = C(h)
    return F.when(x >= 210, 7).when(x >= 120, 4).when(x >= 10, 1).otherwise(0)


def evidence_ceiling(h: str | Column) -> Column:
    x = C(h)
    return F.when(x >= 210, 10).when(x >= 120, 6).when(x >= 10, 3).otherwise(0)


def severity_contradiction(h, evidence) -> Column:
    return (C(h) >= 270) & (C(evidence) < 7)


# Verdicts from strongest to weakest.
VERDICTS = ["confirmed", "suspected", "potential", "unverified", "not_vulnerable"]


def gated_verdict(verdict, trace_status, evidence_complete: Column, judgment) -> Column:
    """The verdict after every cap; a cap only ever weakens a verdict."""
    v, t = C(verdict), C(trace_status)
    claimed = rank_of(v, VERDICTS)
    trace_cap = F.when(t.isNull(), 3).when(t == "RESOLVED", 0).otherwise(1)
    evidence_cap = F.when(evidence_complete, 0).otherwise(F.when(claimed == 0, 1).when(claimed == 1, 3).otherwise(0))
    judge_cap = F.when(C(judgment) == "not_exploitable", 2).otherwise(0)
    worst = F.greatest(claimed, trace_cap, evidence_cap, judge_cap)
    return pick(F.when(claimed == 4, 4).otherwise(worst), dict(enumerate(VERDICTS[:4])), VERDICTS[4])


# Where each filter works (family prefix) and the case it does not cover.
FILTER_RULES = [
    ("htmlspecialchars", ["XSS"], "only encodes html output"),
    ("addslashes", ["SQLi"], "fails for wide-byte charsets"),
    ("intval", ["SQLi"], "numeric context only"),
    ("strip_tags", ["XSS"], "attribute context stays open"),
    ("mysqli_real_escape_string", ["SQLi"], "LIKE and ORDER BY stay open"),
    ("prepared_statement", ["SQLi"], "no known gap"),
    ("escapeshellarg", ["RCE"], "no known gap"),
    ("escapeshellcmd", ["RCE"], "argument injection stays open"),
    ("base64_decode", [], "decoding is not a filter"),
    ("floatval", ["SQLi"], "numeric context only"),
    ("strict_whitelist", ["RCE", "SQLi", "LFI", "FileWrite", "SSRF", "XSS", "XXE", "Deserialization"], "no known gap"),
]


def filter_effective(name, sink_type) -> Column:
    n, t = C(name), C(sink_type)
    hit = F.lit(False)
    for fn, families, _ in FILTER_RULES:
        if families:
            hit = hit | ((n == fn) & t.isin(families))
    return hit


def filter_reason(name) -> Column:
    return pick(C(name), {fn: why for fn, _, why in FILTER_RULES}, "unknown filter")


def filter_strength(filters: Column, sink_type: Column, global_waf: Column) -> Column:
    """0..100 from an array of struct<name, effective>."""
    def points(f):
        n = f["name"]
        own = (
            F.when(n == "prepared_statement", 40)
            .when(n == "strict_whitelist", 25)
            .when((n == "htmlspecialchars") & (sink_type == "XSS"), 15)
            .when(n.isin("intval", "floatval"), 20)
            .otherwise(0)
        )
        return F.when(f["effective"], own + 20).otherwise(0)

    gained = F.aggregate(filters, F.lit(0), lambda acc, f: acc + points(f))
    total = gained + F.when(global_waf, 30).otherwise(0)
    none = (F.size(filters) == 0) & ~global_waf
    return F.when(none, 0).when(total == 0, 10).otherwise(F.least(total, F.lit(100)))


def second_order_risk(store, use) -> Column:
    s, u = C(store), C(use)
    return (
        F.when((s == "none") & (u == "none"), "high")
        .when((s == "full") & (u == "full"), "safe")
        .when((s == "partial") | (u == "partial"), "candidate")
        .otherwise("medium")
    )


def second_order_type(usage_sink) -> Column:
    u = C(usage_sink)
    return (
        F.when(u.rlike("^(DB::|->query|mysql)"), "SQLi").when(u.isin("echo", "print"), "XSS")
        .when(u.rlike("^(include|require)"), "LFI").when(u.isin("system", "exec", "shell_exec"), "RCE")
        .otherwise("other")
    )


def auth_from_middleware(names: Column, body_checks_session: Column | None = None) -> Column:
    """Auth level from an array of middleware names; unsure means anonymous."""
    admin = F.exists(names, lambda n: n.rlike("^(admin|can:admin|role:admin)"))
    login = F.exists(names, lambda n: n.rlike("^auth(:|$)"))
    if body_checks_session is not None:
        login = login | body_checks_session
    return F.when(admin, "admin").when(login, "authenticated").otherwise("anonymous")


def bypass_possibility(auth_type, excepted: Column, weak_compare: Column, layers: Column) -> Column:
    a = C(auth_type)
    return (
        F.when((a == "none") | excepted, "high").when(weak_compare, "medium").when(layers >= 2, "none").otherwise("low")
    )


def route_gap(auth_required: Column, has_auth: Column, url) -> Column:
    sensitive = has_word(C(url), ["admin", "payment", "profile", "user", "delete"])
    return (
        F.when(auth_required & ~has_auth, "AUTH_MISSING").when(has_auth, "protected")
        .when(sensitive, "suspicious").otherwise("public")
    )


def password_hash_class(value) -> Column:
    v = C(value)
    return (
        F.when(v.rlike(r"^\$2[aby]\$[0-9]{2}\$.{53}$"), "bcrypt").when(v.rlike(r"^\$argon2id\$"), "argon2id")
        .when(v.rlike("^[0-9a-fA-F]{32}$"), "md5").when(v.rlike("^[0-9a-fA-F]{40}$"), "sha1").otherwise("unknown")
    )


def data_object(family, name) -> Column:
    """The object a finding is about; sign-in, session and configuration have one fixed name each."""
    f = C(family)
    return (
        F.when(f == "session", "session").when(f.isin("authz", "auth"), "auth_token")
        .when(f == "config", "config").otherwise(C(name))
    )
