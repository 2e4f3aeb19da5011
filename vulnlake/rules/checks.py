"""Published checks of every phase as rows. A predicate is SQL text over the columns of one input.

Kinds: ``share`` (rows in scope that are good), ``inside`` and ``outside`` (keys in scope that another input holds, or
does not hold), ``unique`` (keys that occur once), ``distinct`` (different keys; ``least`` of them are asked for).
A key of the other input is ``other_key`` where it is named differently. ``pct`` bounds good / total (nothing in scope holds), ``least`` and ``most`` bound the number of good ones. Levels: ``must`` and ``item`` have to
pass, ``warn`` may fail. Rows with one (phase, item) are parts of one check. No row: what needs the source tree, a tool run
or a reader's judgment (2-5 sampled lines, 4.5-3, 4.5-5 dry runs of patches, 5-8 rendering, C13, MR1 to MR3, 4-all-1 and -4),
and 4-6, whose evidence matrix is an operator of its own (``evidence.evidence_gaps``).
"""

from __future__ import annotations

from typing import NamedTuple


class Check(NamedTuple):
    phase: str
    item: str
    level: str
    source: str
    kind: str = "share"
    scope: str = "true"
    good: str = "true"
    key: str = ""
    other: str = ""
    other_key: str = ""
    other_scope: str = "true"
    pct: int = 0
    least: int = 0
    most: int | None = None


# fixed values: what an item asks for
REQUIRED_EXTENSIONS = ("pdo", "mbstring", "xml", "curl", "json", "xdebug")
AGENTS = 21
SINK_TYPES_DEFINED = 9
SINK_TYPE_PCT = 85
LOADED = " AND ".join(f"concat(',', observed, ',') LIKE '%,{e},%'" for e in REQUIRED_EXTENSIONS) + " AND observed LIKE '%pdo_%'"
REPLAYABLE = "request LIKE '% /% HTTP/1.1%Host:%'"
SCORE = "(40 * r + 35 * i + 25 * c)"  # hundredths of the severity score
BAND = "CASE WHEN {0} >= 7 THEN 3 WHEN {0} >= 4 THEN 2 WHEN {0} >= 1 THEN 1 ELSE 0 END"
EVIDENCE_BAND = BAND.format("evidence_score")
SEVERITY_BAND = f"CASE WHEN {SCORE} >= 210 THEN 3 WHEN {SCORE} >= 120 THEN 2 ELSE 1 END"
VERDICT_BAND = "CASE verdict WHEN 'confirmed' THEN 3 WHEN 'suspected' THEN 2 ELSE 1 END"
OPEN = "verdict IN ('confirmed', 'suspected', 'potential')"
FIXED = "fix_before <> '' AND fix_after <> '' AND fix_before <> fix_after"
AUDITORS = {"RCE": "rce_auditor", "SQLi": "sqli_auditor", "XSS": "xss_ssti_auditor", "LFI": "lfi_auditor", "FileWrite": "filewrite_auditor", "SSRF": "ssrf_auditor",
            "XXE": "xxe_auditor", "Deserialization": "deserial_auditor", "NoSQL": "nosql_auditor", "LDAP": "ldap_auditor"}
RIGHT_AUDITOR = " OR ".join(f"(sink_type = '{s}' AND auditor = '{a}')" for s, a in AUDITORS.items())
SPOT = "concat(file, ':', line)"


def probe(item: str, level: str, name: str, good: str) -> Check:
    return Check("1", item, level, "probes", scope=f"probe = '{name}'", good=good, pct=100, least=1)


CHECKS = [
    probe("1", "must", "service", "observed = 'running'"),
    probe("2", "must", "php_version", "observed = declared"),
    probe("3", "must", "extension", LOADED),
    probe("4", "must", "web", "observed IN ('200', '301', '302')"),
    probe("5", "warn", "database", "observed = 'connected'"),
    probe("6", "warn", "xdebug", "concat(',', observed, ',') LIKE '%,trace,%'"),
    probe("7", "warn", "ssrf", "observed = '200'"),
    probe("8", "warn", "routes", "TRY_CAST(observed AS INT) > 0"),
    Check("1", "9", "warn", "outputs", scope="path = 'environment_status.json'", good="valid", pct=100, least=1),

    Check("2", "1", "must", "routes", least=1),
    Check("2", "2", "item", "routes", "inside", key="file", other="layers", other_scope="code <> ''", pct=100),
    Check("2", "3", "warn", "routes", good="middleware <> ''", pct=80),
    Check("2", "4", "must", "findings", good="file <> '' AND line > 0", pct=100, least=1),
    Check("2", "6", "warn", "layers", "outside", key="file", other="layers", other_scope="broken", pct=50),
    Check("2", "7", "item", "layers", good="code <> ''", pct=100),
    Check("2", "8", "must", "queue", good="priority = 'P0'", least=1, most=20),
    Check("2", "8", "must", "queue", "unique", key="concat(file, ':', line, ':', sink_function)", pct=100),
    Check("2", "9", "warn", "routes", "inside", key="file", other="findings", pct=90),
    Check("2", "10", "warn", "findings", "distinct", key="sink_type", least=-(-SINK_TYPES_DEFINED * SINK_TYPE_PCT // 100)),
    Check("2", "11", "warn", "outputs", scope="phase = '2'", good="valid", pct=100),
    Check("2", "12", "warn", "findings", "distinct", scope="source IN ('psalm', 'progpilot')", key="source", least=2),
    Check("2", "13", "warn", "outputs", good="path = 'dep_risk.json'", least=1),

    Check("3", "1", "must", "credentials", least=1),
    *[Check("3", item, level, "credentials", good=f"level = '{name}' AND status = 200", least=1)
      for item, level, name in [("2", "item", "anonymous"), ("3", "warn", "authenticated"), ("4", "warn", "admin")]],
    Check("3", "5", "item", "credentials", "distinct", scope="status = 200", key="level", least=1),
    Check("3", "6", "must", "chains", good="steps > 0", pct=100, least=1),
    Check("3", "7", "item", "chains", scope="steps > 0", good="first_file LIKE '%index.php' AND last_function = sink", pct=100),
    Check("3", "8", "item", "chains", good="complete", pct=70),
    Check("3", "9", "warn", "chains", good="unresolved = 0", pct=100),
    Check("3", "10", "warn", "chains", good="unexplained = 0", pct=100),
    Check("3", "11", "warn", "chains", good="compared", pct=100),
    Check("3", "12", "warn", "chains", scope="route_type = 'B'",
          good="error_vs_sink IS NOT NULL AND (error_vs_sink <> 'before_sink' OR returned)", pct=100),
    Check("3", "13", "item", "outputs", scope="phase = '3'", good="valid", pct=100),

    Check("4", "1", "must", "exploits", least=1),
    Check("4", "2", "must", "exploits", good="sink_type <> '' AND request <> '' AND verdict <> '' AND auth_used <> ''", pct=100),
    Check("4", "3", "must", "exploits", scope="verdict = 'confirmed'", good="evidence_complete", pct=100),
    Check("4", "4", "warn", "exploits", good=REPLAYABLE, pct=100),
    Check("4", "5", "warn", "exploits", good="status IS NOT NULL AND body <> ''", pct=100),
    Check("4", "7", "warn", "exploits", scope=OPEN, good=f"{EVIDENCE_BAND} = {VERDICT_BAND}", pct=100),
    Check("4", "8", "warn", "exploits", good=FIXED, pct=100),
    Check("4", "9", "must", "exploits", scope="verdict = 'confirmed'", good="trace_status = 'RESOLVED'", pct=100),
    Check("4", "10", "must", "exploits", good="r BETWEEN 0 AND 3 AND i BETWEEN 0 AND 3 AND c BETWEEN 0 AND 3", pct=100),
    Check("4", "11", "warn", "exploits", scope=OPEN, good=f"{SEVERITY_BAND} = {EVIDENCE_BAND}", pct=100),
    Check("4", "12", "must", "exploits", good="auth_level <> '' AND judgment <> ''", pct=100),
    Check("4", "13", "must", "exploits", scope="judgment = 'not_exploitable'", good="verdict NOT IN ('confirmed', 'suspected')", pct=100),
    Check("4", "14", "warn", "exploits", good="r = CASE auth_level WHEN 'anonymous' THEN 3 WHEN 'authenticated' THEN 2 ELSE 1 END", pct=100),

    *[Check("cross", item, "must", "queue", "inside", scope=f"priority = '{p}'", key=SPOT, other="exploits", pct=100)
      for item, p in [("C1", "P0"), ("C2", "P1")]],
    Check("cross", "C3", "must", "queue", "inside", scope="priority IN ('P0', 'P1')", key=SPOT, other="exploits", other_scope="reported", pct=100),
    Check("cross", "C4", "must", "agents", scope="state = 'not_applicable'", good="reason <> ''", pct=100),
    Check("cross", "C5", "warn", "exploits", scope="auth_level = 'anonymous'", good="auth_used = 'anonymous'", pct=100),
    Check("cross", "C6", "warn", "exploits", scope="auth_level <> 'anonymous'", good="auth_used = auth_level", pct=100),
    Check("cross", "C7", "warn", "exploits", scope="auth_level = 'admin' AND auth_used <> 'admin' AND verdict = 'confirmed'", good="authz_marked", pct=100),
    Check("cross", "C8", "warn", "routes", "inside", scope="bypass_notes <> ''", key="file", other="exploits", other_scope="bypass <> ''", pct=100),
    Check("cross", "C9", "warn", "queue", "inside", key="sink_type", other="exploits", pct=100),
    Check("cross", "C10", "warn", "exploits", scope=f"sink_type IN ({', '.join(repr(s) for s in AUDITORS)})", good=RIGHT_AUDITOR, pct=100),
    Check("cross", "C11", "warn", "agents", scope="state = 'not_applicable'", good="reason <> ''", pct=100),
    Check("cross", "C12", "warn", "exploits", scope="filtered", good="bypass <> ''", pct=100),
    Check("cross", "C14", "warn", "credentials", "distinct", scope="status = 200", key="level", least=1),
    Check("cross", "C15", "warn", "routes", "inside", scope="auth_level <> 'anonymous'", key="file", other="exploits", pct=100),
    Check("cross", "C16", "must", "exploits", scope="verdict = 'confirmed'", good="empty_points = 0", pct=100),
    Check("cross", "C17", "must", "exploits", scope="verdict = 'confirmed'", good=REPLAYABLE, pct=100),
    Check("cross", "C18", "must", "exploits", scope="verdict = 'confirmed'", good="body LIKE concat('%', claim, '%')", pct=100),

    Check("4-graph", "G1", "item", "exploits", "inside", scope="verdict = 'confirmed'", key="lower(sink_type)", other="nodes", other_key="vuln_type", pct=100),
    Check("4-graph", "G2", "item", "edges", scope="relation = 'escalates_to'", good="confidence <> 'speculative'", pct=100),

    Check("4-all", "2", "item", "exploits", scope="verdict = 'confirmed'", good="variant_tested", pct=100),
    Check("4-all", "3", "item", "exploits", scope="verdict IN ('confirmed', 'suspected')", good="compared", pct=100),
    Check("4-all", "5", "item", "exploits", scope=OPEN, good=f"{EVIDENCE_BAND} = {VERDICT_BAND}", pct=100),
    Check("4-all", "6", "item", "queue", "inside", key=SPOT, other="exploits", pct=90),
    Check("4-all", "7", "item", "exploits", scope="rounds >= 8 AND verdict = 'not_vulnerable'", good="note <> ''", pct=100),
    Check("4-all", "8", "item", "agents", "distinct", scope="state IN ('executed', 'not_applicable', 'deferred', 'failed')", key="agent", least=AGENTS),

    Check("4.5", "1", "item", "nodes", least=1),
    Check("4.5", "1", "item", "edges", least=1),
    Check("4.5", "2", "item", "outputs", good="path = 'correlation_report.json'", least=1),
    Check("4.5", "4", "item", "exploits", "inside", scope="verdict = 'confirmed'", key=SPOT, other="exploits", other_scope="patched", pct=100),
    *[Check("4.5", "6", "item", "edges", "inside", key=end, other="nodes", other_key="node_id", pct=100) for end in ("source_node", "target_node")],

    Check("5", "1", "must", "queue", "inside", scope="priority IN ('P0', 'P1')", key=SPOT, other="exploits", other_scope="reported", pct=100),
    Check("5", "2", "must", "exploits", scope="verdict = 'confirmed'", good=f"{REPLAYABLE} AND body <> ''", pct=100),
    Check("5", "3", "must", "exploits", scope="reported", good=FIXED, pct=100),
    Check("5", "4", "warn", "exploits", scope="reported", good=REPLAYABLE, pct=100),
    Check("5", "5", "item", "exploits", scope="reported", good="(verdict = 'confirmed') = evidence_complete", pct=100),
    Check("5", "6", "warn", "exploits", "unique", scope="reported", key="concat(file, ':', line, ':', sink_type)", pct=100),
    Check("5", "7", "warn", "routes", good="state IN ('audited', 'skipped')", pct=100),
    Check("5", "9", "warn", "outputs", scope="path = 'audit_report.sarif.json'", good="valid", pct=100, least=1),
    Check("5", "10", "warn", "exploits", scope=OPEN,
          good="sarif = CASE verdict WHEN 'confirmed' THEN 'error' WHEN 'suspected' THEN 'warning' ELSE 'note' END", pct=100),
    Check("5", "11", "warn", "exploits", scope="verdict = 'confirmed'", good="poc_compiles", pct=100),
    Check("5", "12", "warn", "outputs", good="path = 'poc/run_all.sh'", least=1),
    Check("5", "13", "warn", "exploits", scope="verdict = 'confirmed'", good="poc_url = url", pct=100),
    Check("5", "14", "must", "agents", "distinct", key="agent", least=AGENTS),
    Check("5", "15", "must", "exploits", scope="verdict = 'confirmed'", good="empty_points = 0 AND evidence_complete", pct=100),
    Check("5", "16", "item", "queue", "inside", scope="priority IN ('P0', 'P1')", key=SPOT, other="exploits", other_scope="reported", pct=100),
    Check("5", "17", "item", "exploits", good="poc_compiles", pct=100),
]
#: How many ``warn`` items a phase may fail; no entry: any number.
MOST_WARNINGS = {"cross": 2}
