"""Escalation patterns, chains, capability pairs, feasibility weights."""

# (pattern, finding family, conditions that must all hold, combined severity)
ESCALATIONS = [
    ("account_takeover", "infoleak", ["no_rate_limit", "weak_password"], "critical"),
    ("session_hijack", "xss", ["no_httponly", "no_csp"], "high"),
    ("cloud_takeover", "ssrf", ["cloud"], "critical"),
    ("config_to_control", "infoleak", ["admin_reachable"], "critical"),
    ("sql_to_code", "sqli", ["file_privilege", "writable_dir"], "critical"),
    ("signup_privilege", "authz", ["open_signup"], "critical"),
    ("forged_admin_action", "csrf", ["admin_reachable"], "high"),
    ("forged_reset", "crypto", ["reset_token"], "critical"),
    ("race_funds", "race", ["payment"], "critical"),
    ("second_order", "store_unfiltered", ["use_unfiltered"], "high"),
]

# (chain, first family, second family, combined severity)
CROSS_CHAINS = [
    ("sqli_ssti", "sqli", "xss", "critical"),
    ("ssrf_docker", "ssrf", "infoleak", "critical"),
    ("lfi_log", "lfi", "rce", "critical"),
]

# (family that grants, capability, family that needs it)
CAPABILITIES = [
    ("infoleak", "credentials", "authz"), ("config", "secrets", "rce"), ("enumeration", "accounts", "bruteforce"),
    ("sqli", "source_code", "sqli"), ("ssrf", "internal_network", "infoleak"), ("xss", "victim_session", "csrf"),
    ("filewrite", "file_on_disk", "lfi"), ("deserialization", "object_control", "rce"),
    ("race", "repeated_action", "business"), ("crypto", "predictable_token", "authz"),
]

# chain -> families of its steps
CHAINS = {
    "chain_1_sqli_ssti": ["SQL_INJECTION", "DATA_FLOW", "SSTI", "CODE_EXECUTION"],
    "chain_2_lfi_log_rce": ["PATH_TRAVERSAL", "FILE_READ", "LOG_INJECTION", "FILE_INCLUSION", "CODE_EXECUTION"],
    "chain_3_ssrf_internal_rce": ["SSRF", "NETWORK_ACCESS", "API_ABUSE", "CODE_EXECUTION"],
    "chain_4_upload_webshell": ["FILE_UPLOAD", "CONFIG_OVERRIDE", "CODE_EXECUTION"],
    "chain_5_info_leak_token_forge": ["INFORMATION_DISCLOSURE", "SECRET_EXTRACTION", "TOKEN_FORGERY", "PRIVILEGE_ESCALATION"],
    "chain_6_deserialization_pop": ["DESERIALIZATION", "UNSAFE_DESERIALIZATION", "POP_CHAIN", "CODE_EXECUTION"],
    "chain_7_second_order_takeover": ["DATA_INPUT", "DATA_STORE", "SQL_INJECTION", "DATA_MANIPULATION", "ACCOUNT_TAKEOVER"],
    "chain_8_xxe_ssrf": ["XML_INJECTION", "XXE", "SSRF", "INFORMATION_DISCLOSURE", "LATERAL_MOVEMENT"],
    "chain_9_redirect_oauth": ["OPEN_REDIRECT", "OAUTH_MISCONFIGURATION", "SOCIAL_ENGINEERING", "TOKEN_THEFT", "ACCOUNT_TAKEOVER"],
    "chain_10_race_double_spend": ["RACE_CONDITION", "CONCURRENT_REQUEST", "TOCTOU_BYPASS", "STATE_MANIPULATION", "BUSINESS_LOGIC_BYPASS"],
}

# finding family -> chain step families it provides
FAMILY_STEPS = {
    "sqli": ["SQL_INJECTION", "DATA_FLOW", "DATA_STORE", "DATA_MANIPULATION"],
    "xss": ["SSTI", "DATA_INPUT"],
    "rce": ["CODE_EXECUTION"],
    "ssrf": ["SSRF", "NETWORK_ACCESS", "LATERAL_MOVEMENT"],
    "authz": ["PRIVILEGE_ESCALATION", "ACCOUNT_TAKEOVER"],
    "infoleak": ["INFORMATION_DISCLOSURE", "SECRET_EXTRACTION"],
    "lfi": ["PATH_TRAVERSAL", "FILE_READ", "FILE_INCLUSION"],
    "logging": ["LOG_INJECTION"],
    "api": ["API_ABUSE"],
    "filewrite": ["FILE_UPLOAD"],
    "config": ["CONFIG_OVERRIDE"],
    "crypto": ["TOKEN_FORGERY"],
    "deserialization": ["DESERIALIZATION", "UNSAFE_DESERIALIZATION", "POP_CHAIN"],
    "xxe": ["XML_INJECTION", "XXE"],
    "redirect": ["OPEN_REDIRECT", "SOCIAL_ENGINEERING"],
    "oauth": ["OAUTH_MISCONFIGURATION", "TOKEN_THEFT"],
    "race": ["RACE_CONDITION", "CONCURRENT_REQUEST", "TOCTOU_BYPASS", "STATE_MANIPULATION"],
    "business": ["BUSINESS_LOGIC_BYPASS"],
}

# check -> weight in hundredths
FEASIBILITY = {
    "docker_env": 15, "internal_services": 20, "filesystem_perms": 15, "php_config": 15, "framework_version": 10,
    "waf_filters": 10, "network_isolation": 10, "auth_requirements": 5,
}
FEASIBILITY_POINTS = {"confirmed": 10, "suspected": 5, "unknown": 0, "not_met": -3}  # tenths

# path scoring: node points, confidence factor by worst status, bonus by steps
NODE_POINTS = {"confirmed": 10, "suspected": 6, "potential": 3}
CONFIDENCE = {"confirmed": 1.0, "suspected": 0.7, "potential": 0.4}
LENGTH_BONUS = {1: 1.0, 2: 1.5, 3: 2.0}
LONG_BONUS = 2.5
