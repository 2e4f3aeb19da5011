"""Descriptions of finding types in exported reports (fixed values: names and CWE numbers)."""

from __future__ import annotations

HELP = "https://cwe.mitre.org/data/definitions/"

# type: (name, CWE number)
TYPE_RULES = {
    "RCE": ("Remote Code Execution", 94),
    "SQLi": ("SQL Injection", 89),
    "XSS": ("Cross-Site Scripting", 79),
    "LFI": ("Local File Inclusion", 98),
    "FileWrite": ("Arbitrary File Write", 434),
    "SSRF": ("Server-Side Request Forgery", 918),
    "XXE": ("XML External Entity", 611),
    "Deserialization": ("Insecure Deserialization", 502),
    "LDAP": ("LDAP Injection", 90),
    "NoSQL": ("NoSQL Injection", 943),
    "CRLF": ("CRLF Injection", 93),
    "CSRF": ("Cross-Site Request Forgery", 352),
    "RaceCondition": ("Race Condition", 362),
    "WeakComparison": ("Incorrect Comparison", 697),
    "MassAssignment": ("Mass Assignment", 915),
}

# what a log reports about its own results, by the flag that is counted
WARNINGS = {
    "no_path": "results without a file path",
    "no_line": "results without a line",
    "no_priority": "results without a priority",
    "no_flow": "results without a code flow",
}
