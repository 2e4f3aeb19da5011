"""Declared schemas of the input entities, as DDL text that every reader accepts."""

from __future__ import annotations

RESPONSE = ("page_id bigint, url string, status int, headers map<string,string>, body string")
DIFF_ROW = ("commit string, path string, change_type string, patch string")
STORE_POINT = ("store_id string, tbl string, col string, sanitization string")
USE_POINT = ("use_id string, tbl string, col string, output_sanitization string, usage_sink string")
TOOL_FINDING = ("file string, line int, sink_function string, sink_type string, source string")
ROUTE = ("id string, url string, method string, controller string, file string, line int, params array<string>, "
           "middleware array<string>, auth_level string, route_type string")
CONTEXT_PACK = (
    "sink_id string, trace_depth int, "
    "layers array<struct<layer:int,role:string,file:string,function:string,lines:string,code:string>>, "
    "filters_in_path array<struct<function:string,effective:boolean,reason:string>>, filter_strength_score int")
ASSESSMENT_RESULT = (
    "sink_id string, route_url string, sink_function string, specialist string, route_type string, rounds_executed int, "
    "results array<struct<round:int,strategy:string,response_status:int,result:string,failure_reason:string>>, "
    "final_verdict string, confidence string, evidence map<string,string>, "
    "severity struct<reachability:int,impact:int,complexity:int,score:double,cvss:double,level:string,vuln_id:string>, "
    "prerequisite_conditions struct<auth_requirement:string,bypass_method:string,other_preconditions:array<string>,"
    "exploitability_judgment:string>")
SHARED_FINDING = (
    "ts timestamp, source_agent string, finding_type string, priority string, "
    "data struct<key:string,value:string,context:string,source_location:string>, target_agents array<string>, consumed_by array<string>")
CHECKPOINT = (
    "project string, completed array<string>, current string, agent_states map<string,struct<status:string,"
    "spawned_at:timestamp,completed_at:timestamp,qc_verdict:string,redo_count:int,pivot_triggered:boolean>>")
ENVIRONMENT = (
    "framework string, framework_version string, php_version string, db_type string, routes_a int, routes_b int, routes_c int, "
    "version_alerts array<struct<component:string,detected_version:string,cve_id:string,severity:string,"
    "description:string,affected_auditors:array<string>>>")
QC_RECORD = ("qc_id string, phase string, target_agent string, verdict string, pass_count int, total_count int, redo_count int, ts timestamp")
MEMORY = ("id bigint, sink_type string, framework string, php_version string, waf_type string, status string, rounds_used int, "
            "eliminated_strategies array<string>, project_hash string, created_at timestamp")
