"""SARIF logs: rules with names and links, warnings, property bags, edge cases."""

import json

from pyspark.sql import functions as F

from vulnlake.sources.sinks import to_sarif

SCHEMA = "project string, sink_type string, verdict string, file string, line int, sink_function string, priority string, flow string"


def logs(spark, rows, **kw):
    runs, shards = to_sarif(spark.createDataFrame(rows, SCHEMA), properties=["priority", "verdict"], **kw)
    return {r.project: json.loads(r.document)["runs"][0] for r in runs.collect()}, [json.loads(r.document)["results"] for r in shards.collect()]


def test_rules_and_warnings(spark):
    rows = [("p", "SQLi", "confirmed", "a.php", 3, "query", "P0", "f"), ("p", "Odd kind", "suspected", None, None, "x", None, None),
            ("p", "SQLi", "not_vulnerable", None, None, "query", None, None), ("q", "XSS", "potential", "b.php", 0, "echo", "P1", "f")]
    runs, shards = logs(spark, rows, flows="flow")
    rules = {r["id"]: r for r in runs["p"]["tool"]["driver"]["rules"]}
    assert rules["SQLi"] == {"id": "SQLi", "name": "SQL Injection", "shortDescription": {"text": "SQL Injection vulnerability"},
                             "helpUri": "https://cwe.mitre.org/data/definitions/89.html", "properties": {"tags": ["security", "sql-injection"]}}
    assert rules["Odd kind"]["name"] == "Odd kind" and "helpUri" not in rules["Odd kind"]
    notes = [n["message"]["text"] for n in runs["p"]["invocations"][0]["toolExecutionNotifications"]]
    assert notes == ["1 results without a file path", "1 results without a line", "1 results without a priority", "1 results without a code flow"]
    assert runs["q"]["invocations"][0]["toolExecutionNotifications"] == []
    by_rule = {r["ruleId"]: r for d in shards for r in d}
    assert by_rule["SQLi"]["properties"] == {"priority": "P0", "verdict": "confirmed"} and by_rule["Odd kind"]["properties"] == {"verdict": "suspected"}
    assert by_rule["XSS"]["locations"][0]["physicalLocation"]["region"]["startLine"] == 1 and len(by_rule) == 3


def test_shards_hold_every_result_once(spark):
    rows = [("p", "XSS", "confirmed", f"f{n}.php", n + 1, "echo", "P0", None) for n in range(90)] * 2
    runs, shards = logs(spark, rows, shard_rows=20)
    names = [x["location"]["uri"] for x in runs["p"]["externalPropertyFileReferences"]["results"]]
    assert len(names) == 9 and sum(map(len, shards)) == 180
    assert logs(spark, rows[:0])[0] == {}
