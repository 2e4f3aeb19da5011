"""Report readers: documents in the nested shapes the tools write, and what is no report."""

import json

import pytest

from tests.test_plans import plan
from vulnlake.sources import reports

DOCUMENTS = {
    "ast_sinks": {"total": 1, "sinks": [{"file": "a.php", "line": 3, "function": "eval", "sink_type": "RCE", "args": ["$x"]}]},
    "psalm": [{"type": "TaintedShell", "file_name": "a.php", "line_from": 3, "selected_text": "eval", "taint_trace": [{"file_name": "z.php", "line_from": 9}]}],
    "progpilot": [{"source_file": ["z.php"], "source_line": [1], "sink_name": "eval", "sink_line": "3", "sink_file": "a.php", "vuln_name": "code_injection"}],
    "phpstan": {"totals": {"errors": 0}, "files": {"a.php": {"errors": 1, "messages": [{"message": "m", "line": 3, "identifier": "id"}]}}},
    "semgrep": {"errors": [], "results": [{"check_id": "rule", "path": "a.php", "start": {"line": 3, "col": 1}, "extra": {"metadata": {"category": "security"}}}]},
    "codeql": {"version": "2.1.0", "runs": [{"results": [{"ruleId": "php/x", "locations": [{"physicalLocation": {
        "artifactLocation": {"uri": "a.php"}, "region": {"startLine": 3}}}]}]}]},
    "composer_audit": {"advisories": {"v/lib": [{"advisoryId": "A-1", "packageName": "v/lib"}], "v/b": {"4": {"advisoryId": "A-2"}}}},
    "context_extractor": {"sink_function": "eval", "sink_type": "RCE", "layers": [
        {"role": "SINK", "file": "a.php", "lines": "3-9"}, {"role": "CALLER", "file": "b.php", "lines": "1-2"}]},
}
WANT = {
    "ast_sinks": [("a.php", 3, "eval", "RCE")], "psalm": [("a.php", 3, "eval", "TaintedShell")], "progpilot": [("a.php", 3, "eval", "code_injection")],
    "phpstan": [("a.php", 3, "id", "m")], "semgrep": [("a.php", 3, "rule", "security")], "codeql": [("a.php", 3, "php/x", None)],
    "composer_audit": [("composer.json", 0, "v/b", "known_vuln"), ("composer.json", 0, "v/lib", "known_vuln")], "context_extractor": [("a.php", 3, "eval", "RCE")],
}


@pytest.mark.parametrize("tool", sorted(WANT))
def test_nested_shapes(spark, tool):
    texts = [json.dumps(DOCUMENTS[tool]), json.dumps({"status": "failed", "error": "no", "results": []}), "PHP Fatal error", "", None, "[]", "{}", "null", "7", '["a", null, 3]']
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "report int, value string")
    rows = sorted(tuple(r) for r in reports.findings_of(docs, tool).collect())
    assert rows == [(0, *w, tool) for w in WANT[tool]]
    assert reports.findings_of(docs.limit(0), tool).collect() == []


def test_files_and_plan(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(DOCUMENTS["phpstan"], indent=2))
    got = reports.read_findings(spark, str(tmp_path), "phpstan")
    assert [tuple(r) for r in got.collect()] == [("a.php", 3, "id", "m", "phpstan")]
    assert "Exchange" not in plan(got) and "Join" not in plan(got) and "Python" not in plan(got)


def test_missing_line_and_repeated_entries(spark):
    doc = {"sinks": [{"file": "a.php", "line": "none"}, {"file": "a.php", "line": "none"}, {"line": 3}, {"file": None, "line": 3}]}
    docs = spark.createDataFrame([(json.dumps(doc),)], "value string")
    assert [tuple(r) for r in reports.findings_of(docs, "ast_sinks").collect()] == [("a.php", None, None, None, "ast_sinks")] * 2
