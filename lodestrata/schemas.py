"""Schemas of the record formats, as DDL."""

RECORD = (
    "messages array<struct<role:string,content:string>>, _meta struct<shape:string,source:string,language:string,label:string,cwes:array<string>,"
    "ground_truth_cwe:string,specificity:double,category:string,helper_fn:string,file_path:string,disposition:string,multi_hop:boolean,num_findings:int,"
    "vuln_type:string,oracle:string,cleaned:boolean,improved:boolean,quarantine_reasons:array<string>>"
)
FLAT_TRACE = (
    "id string, shape string, tier string, source string, language string, label string, cwe string, oracle string, prompt string, "
    "current_reasoning string, improved_reasoning string"
)
FIX_PAIR = "vuln_code string, fixed_code string, cwe string, language string, vuln_type string, source string"
REASONING_ROW = "function string, lang string, vulnerable bigint, cwe_id array<string>, cve_id string, positive_reasoning string, negative_reasoning string"
LABELLED_CSV = "code string, language string, safety string"
FIX_PAIR_CSV = "vulnerable_code string, fixed_code string, language string, vulnerability_type string"
TARGET = "owner_repo string, lang string, commit string, patch_file string"
FINDING = "file string, unit string, line int, status string, cwe string, severity string, trace string, fix string, think string"
CACHED = "key string, raw_text string"
EVAL_SHAPES = (
    "shape1", "shape1_ts", "shape1_react", "shape_react_syn", "shape1_ts_safe", "shape1_react_safe", "shape1_verified", "shape1_verified_safe",
    "shape2", "shape3", "shape3_codeql", "shape4",
)
