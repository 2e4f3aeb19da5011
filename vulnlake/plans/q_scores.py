"""Scoring queries (S*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vulnlake.functions import score as S
from vulnlake.plans.registry import query

DANGER_SQL = ("CASE WHEN sink_type IN ('RCE','Deserialization','LFI') THEN 'high' WHEN sink_type IN "
              "('SQLi','FileWrite','SSRF','XXE','NoSQL','GraphQL','WordPress','LDAP') THEN 'medium' ELSE 'low' END")


@query("S01_danger_class", f"""
SELECT sink_type, {DANGER_SQL} AS danger, COUNT(*) AS findings FROM fx_tool_findings GROUP BY 1, 2""")
def danger(t):
    return t.fx_tool_findings.groupBy("sink_type").agg(F.count("*").alias("findings")).select(
        "sink_type", S.danger_class("sink_type").alias("danger"), "findings")


@query("S02_base_priority", f"""
WITH d AS (SELECT sink_type, auth_level, {DANGER_SQL} AS danger FROM fx_sinks)
SELECT sink_type, auth_level, CAST(CASE WHEN auth_level = 'admin' THEN 3 ELSE
 CASE danger WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END + CASE auth_level WHEN 'anonymous' THEN 0 ELSE 1 END END AS INT)
 AS priority, COUNT(*) AS findings FROM d GROUP BY 1, 2, 3""")
def base(t):
    return t.fx_sinks.groupBy("sink_type", "auth_level").agg(F.count("*").alias("findings")).withColumn(
        "priority", S.base_priority("auth_level", S.danger_class("sink_type")))


@query("S03_source_boost", """
WITH d AS (SELECT file, line, sink_function, COUNT(DISTINCT source) AS source_count FROM fx_tool_findings GROUP BY 1, 2, 3)
SELECT source_count, CAST(CASE WHEN source_count >= 3 THEN 1 ELSE 2 END AS INT) AS raised_from_2, COUNT(*) AS findings
FROM d GROUP BY 1, 2""")
def source_boost(t):
    d = t.fx_tool_findings.groupBy("file", "line", "sink_function").agg(F.countDistinct("source").alias("source_count"))
    up = F.greatest(F.lit(2) - F.when(F.col("source_count") >= 3, 1).otherwise(0), F.lit(0))
    return d.groupBy("source_count", up.alias("raised_from_2")).agg(F.count("*").alias("findings"))


@query("S04_business_tags", """
WITH w AS (SELECT url, controller, lower(url) AS u, lower(controller) AS c FROM fx_routes)
SELECT url, concat_ws(',', CASE WHEN regexp_matches(u, 'payment|order|checkout|transfer|withdraw') THEN 'financial_impact' END,
 CASE WHEN regexp_matches(c, 'user|profile|account|personal') THEN 'pii_exposure' END,
 CASE WHEN regexp_matches(u, 'login|auth|password|token|session') THEN 'auth_critical' END,
 CASE WHEN regexp_matches(u, 'admin') THEN 'admin_function' END,
 CASE WHEN regexp_matches(u, 'upload|download') THEN 'file_operation' END) AS tags, COUNT(*) AS routes
FROM w GROUP BY 1, 2""")
def tags(t):
    return t.fx_routes.groupBy("url", F.concat_ws(",", S.business_tags("url", "controller")).alias("tags")).agg(
        F.count("*").alias("routes"))


@query("S05_cvss31", """
WITH m AS (SELECT sink_type, auth_level, filtered,
 CASE auth_level WHEN 'admin' THEN 'A' ELSE 'N' END AS av, CASE WHEN filtered THEN 'H' ELSE 'L' END AS ac,
 CASE auth_level WHEN 'anonymous' THEN 'N' WHEN 'authenticated' THEN 'L' ELSE 'H' END AS pr,
 CASE sink_type WHEN 'XSS' THEN 'R' ELSE 'N' END AS ui,
 CASE WHEN sink_type IN ('SSRF','Deserialization') THEN 'C' ELSE 'U' END AS s,
 CASE WHEN sink_type IN ('SQLi','LFI','RCE') THEN 'H' WHEN sink_type = 'XSS' THEN 'L' ELSE 'N' END AS c,
 CASE WHEN sink_type IN ('RCE','FileWrite','SQLi') THEN 'H' WHEN sink_type = 'XSS' THEN 'L' ELSE 'N' END AS i,
 CASE WHEN sink_type = 'RCE' THEN 'H' ELSE 'N' END AS a FROM fx_sinks),
w AS (SELECT *, CASE av WHEN 'N' THEN 0.85e0 ELSE 0.62e0 END AS wav, CASE ac WHEN 'L' THEN 0.77e0 ELSE 0.44e0 END AS wac,
 CASE pr WHEN 'N' THEN 0.85e0 WHEN 'L' THEN CASE s WHEN 'C' THEN 0.68e0 ELSE 0.62e0 END
  ELSE CASE s WHEN 'C' THEN 0.5e0 ELSE 0.27e0 END END AS wpr, CASE ui WHEN 'N' THEN 0.85e0 ELSE 0.62e0 END AS wui,
 1e0 - (1e0 - CASE c WHEN 'H' THEN 0.56e0 WHEN 'L' THEN 0.22e0 ELSE 0e0 END) * (1e0 - CASE i WHEN 'H' THEN 0.56e0 WHEN 'L' THEN 0.22e0 ELSE 0e0 END)
  * (1e0 - CASE a WHEN 'H' THEN 0.56e0 WHEN 'L' THEN 0.22e0 ELSE 0e0 END) AS iss FROM m),
b AS (SELECT *, CASE s WHEN 'C' THEN 7.52e0 * (iss - 0.029e0) - 3.25e0 * pow(iss - 0.02e0, 15) ELSE 6.42e0 * iss END AS impact,
 8.22e0 * wav * wac * wpr * wui AS expl FROM w),
x AS (SELECT *, CAST(round(least(CASE s WHEN 'C' THEN 1.08e0 * (impact + expl) ELSE impact + expl END, 10e0) * 100000) AS BIGINT) AS n FROM b),
z AS (SELECT *, CASE WHEN impact <= 0 THEN 0e0 WHEN n % 10000 = 0 THEN n / 100000e0 ELSE (floor(n / 10000e0) + 1) / 10e0 END AS score FROM x)
SELECT sink_type, auth_level, filtered, concat('CVSS:3.1/AV:', av, '/AC:', ac, '/PR:', pr, '/UI:', ui, '/S:', s, '/C:', c, '/I:', i, '/A:', a) AS vector,
 CAST(round(score, 1) AS DOUBLE) AS score,
 CASE WHEN score >= 9 THEN 'CRITICAL' WHEN score >= 7 THEN 'HIGH' WHEN score >= 4 THEN 'MEDIUM' WHEN score > 0 THEN 'LOW' ELSE 'NONE' END AS band,
 COUNT(*) AS findings FROM z GROUP BY 1, 2, 3, 4, 5, 6""")
def cvss(t):
    g = t.fx_sinks.groupBy("sink_type", "auth_level", "filtered").agg(F.count("*").alias("findings"))
    m = S.cvss_metrics("auth_level", F.col("filtered"), "sink_type")
    return g.select("sink_type", "auth_level", "filtered", S.cvss_vector(m).alias("vector"),
                    F.round(S.cvss_base(m), 1).alias("score"), "findings").withColumn("band", S.cvss_band("score"))


@query("S06_attack_surface", """
SELECT project, CAST(round(avg((CASE auth_level WHEN 'anonymous' THEN 100 WHEN 'authenticated' THEN 60 ELSE 20 END * 30
 + CASE control WHEN 'direct' THEN 100 WHEN 'partial' THEN 60 ELSE 30 END * 25
 + CASE filtering WHEN 'none' THEN 100 WHEN 'blacklist' THEN 70 WHEN 'weak_whitelist' THEN 40 ELSE 10 END * 20
 + CASE sink_type WHEN 'RCE' THEN 100 WHEN 'SQLi' THEN 80 WHEN 'Deserialization' THEN 80 WHEN 'SSRF' THEN 70 WHEN 'FileWrite' THEN 70 ELSE 50 END * 15
 + CASE area WHEN 'payment' THEN 100 WHEN 'pii' THEN 100 WHEN 'admin' THEN 80 ELSE 40 END * 10) / 100e0), 4) AS DOUBLE) AS mean_score,
 COUNT(*) AS findings FROM fx_sinks GROUP BY project""")
def surface(t):
    x = S.attack_surface("auth_level", "control", "filtering", "sink_type", "area")
    return t.fx_sinks.groupBy("project").agg(F.round(F.avg(x), 4).alias("mean_score"), F.count("*").alias("findings"))


@query("S07_severity", """
WITH h AS (SELECT r, i, c, r * 40 + i * 35 + c * 25 AS h FROM fx_sinks)
SELECT r, i, c, h / 100e0 AS score, CAST(floor((h * 2 + 3) / 6e0) / 10e0 AS DOUBLE) AS cvss,
 CASE WHEN h >= 270 THEN 'C' WHEN h >= 210 THEN 'H' WHEN h >= 120 THEN 'M' WHEN h >= 10 THEN 'L' END AS level,
 COUNT(*) AS findings FROM h GROUP BY r, i, c, h""")
def severity(t):
    g = t.fx_sinks.groupBy("r", "i", "c").agg(F.count("*").alias("findings"))
    h = S.severity_hundredths("r", "i", "c")
    return g.select("r", "i", "c", (h / 100).cast("double").alias("score"), S.severity_cvss(h).alias("cvss"),
                    S.severity_level(h).alias("level"), "findings")


@query("S08_exploitability", """
WITH a AS (SELECT judgment, CASE judgment WHEN 'not_exploitable' THEN 0 ELSE r END AS r, i,
 CASE judgment WHEN 'not_exploitable' THEN 0 WHEN 'conditionally_exploitable' THEN greatest(c - 1, 0) ELSE c END AS c FROM fx_sinks)
SELECT judgment, CASE judgment WHEN 'not_exploitable' THEN 0e0 ELSE (r * 40 + i * 35 + c * 25) / 100e0 END AS score, COUNT(*) AS findings
FROM a GROUP BY 1, 2""")
def exploitability(t):
    r, i, c = S.adjusted_axes("r", "i", "c", "judgment")
    h = F.when(F.col("judgment") == "not_exploitable", 0).otherwise(S.severity_hundredths(r, i, c))
    return t.fx_sinks.groupBy("judgment", (h / 100).cast("double").alias("score")).agg(F.count("*").alias("findings"))


@query("S09_report_scale", """
WITH w AS (SELECT auth_level, sink_type, (CASE auth_level WHEN 'anonymous' THEN 10 WHEN 'authenticated' THEN 7 ELSE 4 END * 40
 + CASE sink_type WHEN 'RCE' THEN 10 WHEN 'SQLi' THEN 9 WHEN 'FileWrite' THEN 8 WHEN 'XSS' THEN 7 ELSE 0 END * 35
 + CASE control WHEN 'direct' THEN 10 WHEN 'partial' THEN 5 ELSE 1 END * 25) / 100e0 AS weighted FROM fx_sinks)
SELECT auth_level, sink_type, weighted,
 CASE WHEN weighted >= 8 THEN 'P0' WHEN weighted >= 6 THEN 'P1' WHEN weighted >= 4 THEN 'P2' ELSE 'P3' END AS priority,
 COUNT(*) AS findings FROM w GROUP BY 1, 2, 3, 4""")
def report_scale(t):
    ease = S.pick(F.col("control"), {"direct": "trivial", "partial": "medium"}, "theoretical")
    w = S.report_score("auth_level", "sink_type", ease)
    return t.fx_sinks.groupBy("auth_level", "sink_type", w.alias("weighted")).agg(
        F.count("*").alias("findings")).withColumn("priority", S.report_priority("weighted"))


@query("S10_score_bucket", """
SELECT package, CASE WHEN cvss >= 9 THEN 'critical' WHEN cvss >= 7 THEN 'high' WHEN cvss >= 4 THEN 'medium' ELSE 'low' END AS bucket,
 COUNT(*) AS advisories FROM fx_advisories GROUP BY 1, 2""")
def bucket(t):
    return t.fx_advisories.groupBy("package", S.score_bucket("cvss").alias("bucket")).agg(F.count("*").alias("advisories"))


@query("S11_severity_evidence", """
WITH h AS (SELECT evidence_score, r * 40 + i * 35 + c * 25 AS h FROM fx_sinks),
k AS (SELECT h, evidence_score, CASE WHEN h >= 210 THEN 7 WHEN h >= 120 THEN 4 WHEN h >= 10 THEN 1 ELSE 0 END AS lo,
 CASE WHEN h >= 210 THEN 10 WHEN h >= 120 THEN 6 WHEN h >= 10 THEN 3 ELSE 0 END AS hi FROM h)
SELECT h / 100e0 AS score, COUNT(*) AS findings, SUM(CASE WHEN evidence_score BETWEEN lo AND hi THEN 0 ELSE 1 END)::BIGINT AS inconsistent,
 SUM(CASE WHEN h >= 270 AND evidence_score < 7 THEN 1 ELSE 0 END)::BIGINT AS contradictions FROM k GROUP BY h""")
def severity_evidence(t):
    h = S.severity_hundredths("r", "i", "c")
    fits = F.col("evidence_score").between(S.expected_evidence(h), S.evidence_ceiling(h))
    return t.fx_sinks.groupBy((h / 100).cast("double").alias("score")).agg(
        F.count("*").alias("findings"), F.count_if(~fits).alias("inconsistent"),
        F.count_if(S.severity_contradiction(h, "evidence_score")).alias("contradictions"))


@query("S12_verdict_gate", """
WITH k AS (SELECT verdict, trace_status, evidence_complete, judgment, CASE verdict WHEN 'confirmed' THEN 0 WHEN 'suspected' THEN 1
 WHEN 'potential' THEN 2 ELSE 4 END AS v FROM fx_sinks),
g AS (SELECT *, CASE WHEN v = 4 THEN 4 ELSE greatest(v, CASE WHEN trace_status IS NULL THEN 3 WHEN trace_status = 'RESOLVED' THEN 0 ELSE 1 END,
 CASE WHEN evidence_complete THEN 0 WHEN v = 0 THEN 1 WHEN v = 1 THEN 3 ELSE 0 END,
 CASE WHEN judgment = 'not_exploitable' THEN 2 ELSE 0 END) END AS f FROM k)
SELECT verdict, trace_status, evidence_complete, judgment,
 CASE f WHEN 0 THEN 'confirmed' WHEN 1 THEN 'suspected' WHEN 2 THEN 'potential' WHEN 3 THEN 'unverified' ELSE 'not_vulnerable' END AS gated,
 COUNT(*) AS findings FROM g GROUP BY 1, 2, 3, 4, 5""")
def verdict_gate(t):
    keys = ["verdict", "trace_status", "evidence_complete", "judgment"]
    return t.fx_sinks.groupBy(*keys).agg(F.count("*").alias("findings")).withColumn(
        "gated", S.gated_verdict("verdict", "trace_status", F.col("evidence_complete"), "judgment"))


@query("S13_filter_effectiveness", """
SELECT filter_name, sink_type, ((filter_name IN ('htmlspecialchars','strip_tags') AND sink_type = 'XSS')
 OR (filter_name IN ('addslashes','intval','floatval','mysqli_real_escape_string','prepared_statement') AND sink_type = 'SQLi')
 OR (filter_name IN ('escapeshellarg','escapeshellcmd') AND sink_type = 'RCE')
 OR (filter_name = 'strict_whitelist' AND sink_type <> 'Crypto')) AS effective,
 CASE filter_name WHEN 'htmlspecialchars' THEN 'only encodes html output' WHEN 'addslashes' THEN 'fails for wide-byte charsets'
 WHEN 'intval' THEN 'numeric context only' WHEN 'strip_tags' THEN 'attribute context stays open'
 WHEN 'mysqli_real_escape_string' THEN 'LIKE and ORDER BY stay open' WHEN 'prepared_statement' THEN 'no known gap'
 WHEN 'escapeshellarg' THEN 'no known gap' WHEN 'escapeshellcmd' THEN 'argument injection stays open'
 WHEN 'base64_decode' THEN 'decoding is not a filter' WHEN 'floatval' THEN 'numeric context only' WHEN 'strict_whitelist' THEN 'no known gap' ELSE 'unknown filter' END AS reason, COUNT(*) AS uses
FROM fx_sinks GROUP BY 1, 2, 3, 4""")
def filters(t):
    return t.fx_sinks.groupBy("filter_name", "sink_type").agg(F.count("*").alias("uses")).select(
        "filter_name", "sink_type", S.filter_effective("filter_name", "sink_type").alias("effective"),
        S.filter_reason("filter_name").alias("reason"), "uses")


@query("S14_filter_strength", """
WITH e AS (SELECT sink_type, filter_name, global_waf, ((filter_name IN ('htmlspecialchars','strip_tags') AND sink_type = 'XSS')
 OR (filter_name IN ('addslashes','intval','floatval','mysqli_real_escape_string','prepared_statement') AND sink_type = 'SQLi')
 OR (filter_name IN ('escapeshellarg','escapeshellcmd') AND sink_type = 'RCE')
 OR (filter_name = 'strict_whitelist' AND sink_type <> 'Crypto')) AS eff FROM fx_sinks),
p AS (SELECT *, CASE WHEN eff THEN 20 + CASE filter_name WHEN 'prepared_statement' THEN 40 WHEN 'htmlspecialchars' THEN 15 WHEN 'intval' THEN 20 WHEN 'floatval' THEN 20 WHEN 'strict_whitelist' THEN 25 ELSE 0 END
 ELSE 0 END + CASE WHEN global_waf THEN 30 ELSE 0 END AS pts FROM e)
SELECT sink_type, filter_name, global_waf, CAST(CASE WHEN pts = 0 THEN 10 ELSE least(pts, 100) END AS INT) AS strength, COUNT(*) AS sinks
FROM p GROUP BY 1, 2, 3, 4""")
def strength(t):
    g = t.fx_sinks.groupBy("sink_type", "filter_name", "global_waf").agg(F.count("*").alias("sinks"))
    flt = F.array(F.struct(F.col("filter_name").alias("name"),
                           S.filter_effective("filter_name", "sink_type").alias("effective")))
    return g.withColumn("strength", S.filter_strength(flt, F.col("sink_type"), F.col("global_waf")))


@query("S17_auth_from_middleware", """
SELECT middleware, CASE WHEN list_has_any(string_split(middleware, ','), ['admin','can:admin','role:admin']) THEN 'admin'
 WHEN list_contains(string_split(middleware, ','), 'auth') THEN 'authenticated' ELSE 'anonymous' END AS level, COUNT(*) AS routes
FROM fx_routes GROUP BY 1, 2""")
def from_middleware(t):
    return t.fx_routes.groupBy("middleware").agg(F.count("*").alias("routes")).withColumn(
        "level", S.auth_from_middleware(F.split("middleware", ",")))


@query("S18_bypass_possibility", """
SELECT middleware, url, CASE WHEN middleware = '' OR url = '/login' THEN 'high' WHEN method = 'PUT' THEN 'medium'
 WHEN len(string_split(middleware, ',')) >= 2 THEN 'none' ELSE 'low' END AS bypass, COUNT(*) AS routes
FROM fx_routes GROUP BY 1, 2, 3""")
def bypass(t):
    a = F.when(F.col("middleware") == "", "none").otherwise("middleware")
    b = S.bypass_possibility(a, F.col("url") == "/login", F.col("method") == "PUT", F.size(F.split("middleware", ",")))
    return t.fx_routes.groupBy("middleware", "url", b.alias("bypass")).agg(F.count("*").alias("routes"))


@query("S19_route_gap", """
WITH f AS (SELECT url, auth_level <> 'anonymous' AS needs, regexp_matches(middleware, '(^|,)(auth|can:)') AS has_auth FROM fx_routes)
SELECT url, CASE WHEN needs AND NOT has_auth THEN 'AUTH_MISSING' WHEN has_auth THEN 'protected'
 WHEN regexp_matches(lower(url), 'admin|payment|profile|user|delete') THEN 'suspicious' ELSE 'public' END AS gap, COUNT(*) AS routes
FROM f GROUP BY 1, 2""")
def gap(t):
    has_auth = F.col("middleware").rlike("(^|,)(auth|can:)")
    g = S.route_gap(F.col("auth_level") != "anonymous", has_auth, "url")
    return t.fx_routes.groupBy("url", g.alias("gap")).agg(F.count("*").alias("routes"))


@query("S28_password_hash_class", """
WITH h AS (SELECT source, CASE doc_id % 4 WHEN 0 THEN md5(text) WHEN 1 THEN sha1(text)
 WHEN 2 THEN concat('$2y$10$', substr(concat(sha256(text), sha256(text)), 1, 53)) ELSE concat('$argon2id$v=19$', md5(text)) END AS v FROM documents)
SELECT source, CASE WHEN regexp_matches(v, '^\\$2[aby]\\$[0-9]{2}\\$.{53}$') THEN 'bcrypt' WHEN starts_with(v, '$argon2id$') THEN 'argon2id'
 WHEN regexp_matches(v, '^[0-9a-fA-F]{32}$') THEN 'md5' WHEN regexp_matches(v, '^[0-9a-fA-F]{40}$') THEN 'sha1' ELSE 'unknown' END AS kind,
 COUNT(*) AS stored FROM h GROUP BY 1, 2""".replace("\\\\", "\\"))
def hash_class(t):
    m = F.col("doc_id") % 4
    sha = F.sha2("text", 256)
    v = (F.when(m == 0, F.md5("text")).when(m == 1, F.sha1("text"))
         .when(m == 2, F.concat(F.lit("$2y$10$"), F.substring(F.concat(sha, sha), 1, 53)))
         .otherwise(F.concat(F.lit("$argon2id$v=19$"), F.md5("text"))))
    return t.documents.select("source", v.alias("v")).groupBy("source", S.password_hash_class("v").alias("kind")).agg(
        F.count("*").alias("stored"))


@query("S41_data_object", """
SELECT CASE WHEN vuln_type = 'authz' THEN 'auth_token' ELSE data_object END AS object, COUNT(*) AS nodes FROM fx_nodes GROUP BY 1""")
def objects(t):
    return t.fx_nodes.groupBy(S.data_object("vuln_type", "data_object").alias("object")).agg(F.count("*").alias("nodes"))
