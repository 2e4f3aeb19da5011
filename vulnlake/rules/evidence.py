"""Evidence points per family: those always required, then those required to confirm."""

# Fixed values.
ALWAYS = {
    "CMD": ["EVID_CMD_EXEC_POINT", "EVID_CMD_STRING_CONSTRUCTION", "EVID_CMD_USER_PARAM_MAPPING"],
    "SQL": ["EVID_SQL_EXEC_POINT", "EVID_SQL_STRING_CONSTRUCTION", "EVID_SQL_USER_PARAM_MAPPING"],
    "NOSQL": ["EVID_NOSQL_QUERY_CONSTRUCTION", "EVID_NOSQL_USER_INPUT_MAPPING", "EVID_NOSQL_OPERATOR_INJECTION"],
    "FILE": ["EVID_FILE_WRAPPER_PREFIX", "EVID_FILE_RESOLVED_TARGET", "EVID_FILE_INCLUDE_EXEC_BOUNDARY"],
    "WRITE": ["EVID_WRITE_CALLSITE", "EVID_WRITE_DESTPATH_RESOLVED", "EVID_WRITE_CONTENT_SOURCE", "EVID_WRITE_EXEC_ACCESSIBILITY"],
    "SSRF": ["EVID_SSRF_URL_NORMALIZATION", "EVID_SSRF_FINAL_URL", "EVID_SSRF_DNS_INNER_BLOCK"],
    "XSS": ["EVID_XSS_OUTPUT_POINT", "EVID_XSS_USER_INPUT_MAPPING", "EVID_XSS_ESCAPE_STATUS"],
    "XXE": ["EVID_XXE_PARSER_CALL", "EVID_XXE_INPUT_SOURCE", "EVID_XXE_ENTITY_SAFETY"],
    "DESER": ["EVID_DESER_CALLSITE", "EVID_DESER_INPUT_SOURCE", "EVID_DESER_GADGET_CHAIN"],
    "AUTH": ["EVID_AUTH_PATH_MATCH", "EVID_AUTH_TOKEN_JUDGMENT", "EVID_AUTH_PERMISSION_CHECK"],
    "CFG": ["EVID_CFG_CONFIG_LOCATION", "EVID_CFG_IMPACT_SCOPE", "EVID_CFG_SECURITY_SWITCH"],
    "LEAK": ["EVID_LEAK_SOURCE_POINT", "EVID_LEAK_DATA_TYPE", "EVID_LEAK_ACCESS_PATH"],
    "RACE": ["EVID_RACE_CRITICAL_SECTION", "EVID_RACE_SHARED_RESOURCE", "EVID_RACE_WINDOW_ANALYSIS"],
    "CRYPTO": ["EVID_CRYPTO_ALGORITHM_USAGE", "EVID_CRYPTO_KEY_MANAGEMENT", "EVID_CRYPTO_SECURITY_CONTEXT"],
    "WP": ["EVID_WP_COMPONENT_SCOPE", "EVID_WP_HOOK_ENTRY"],
    "BIZ": ["EVID_BIZ_FLOW_DESCRIPTION", "EVID_BIZ_BYPASS_POINT", "EVID_BIZ_STATE_PERSISTENCE"],
    "CRLF": ["EVID_CRLF_INJECTION_POINT", "EVID_CRLF_USER_INPUT_PATH", "EVID_CRLF_SANITIZATION_STATUS"],
    "CSRF": ["EVID_CSRF_ENDPOINT_IDENTITY", "EVID_CSRF_TOKEN_STATUS", "EVID_CSRF_SAMESITE_STATUS"],
    "SESS": ["EVID_SESS_CONFIG_STATE", "EVID_SESS_COOKIE_FLAGS", "EVID_SESS_LIFECYCLE_FLOW"],
    "LDAP": ["EVID_LDAP_QUERY_POINT", "EVID_LDAP_FILTER_CONSTRUCTION", "EVID_LDAP_USER_INPUT_PATH"],
    "LOG": ["EVID_LOG_WRITE_POINT", "EVID_LOG_CONTENT_ANALYSIS", "EVID_LOG_ACCESS_CONTROL"],
}
TO_CONFIRM = {
    "CMD": ["EVID_CMD_EXECUTION_RESPONSE"],
    "SQL": ["EVID_SQL_EXECUTION_RESPONSE"],
    "NOSQL": ["EVID_NOSQL_QUERY_SEMANTIC_DIFF"],
    "FILE": ["EVID_FILE_TRAVERSAL_RESPONSE"],
    "WRITE": ["EVID_WRITE_UPLOAD_RESPONSE"],
    "SSRF": ["EVID_SSRF_EXECUTION_RESPONSE"],
    "XSS": ["EVID_XSS_PAYLOAD_REFLECTION"],
    "XXE": ["EVID_XXE_EXECUTION_RESPONSE"],
    "DESER": ["EVID_DESER_EXECUTION_RESPONSE"],
    "AUTH": ["EVID_AUTH_BYPASS_RESPONSE"],
    "CFG": [],
    "LEAK": ["EVID_LEAK_RESPONSE_CONTENT"],
    "RACE": ["EVID_RACE_STATISTICAL_RESULT"],
    "CRYPTO": ["EVID_CRYPTO_EXPLOIT_PROOF"],
    "WP": ["EVID_WP_EXPLOIT_RESPONSE"],
    "BIZ": ["EVID_BIZ_EXPLOIT_RESPONSE"],
    "CRLF": ["EVID_CRLF_INJECTION_RESPONSE"],
    "CSRF": ["EVID_CSRF_CROSS_ORIGIN_RESPONSE"],
    "SESS": ["EVID_SESS_EXPLOIT_RESPONSE"],
    "LDAP": ["EVID_LDAP_INJECTION_RESPONSE"],
    "LOG": ["EVID_LOG_EXPLOIT_RESPONSE"],
}
# Sink family -> evidence family.
FAMILY_EVIDENCE = {
    "RCE": "CMD",
    "SQLi": "SQL",
    "NoSQL": "NOSQL",
    "LFI": "FILE",
    "FileWrite": "WRITE",
    "SSRF": "SSRF",
    "XSS": "XSS",
    "XXE": "XXE",
    "Deserialization": "DESER",
    "WeakComparison": "AUTH",
    "MassAssignment": "AUTH",
    "RaceCondition": "RACE",
    "Crypto": "CRYPTO",
    "WordPress": "WP",
    "LDAP": "LDAP",
}


def required(family: str, confirming: bool = True) -> list[str]:
    return ALWAYS[family] + (TO_CONFIRM[family] if confirming else [])
