"""Schemas of the lineage state's tables, as DDL, and the closed value sets they use."""

from __future__ import annotations

STATE: dict[str, str] = {
    "models": "run_id string, model_id string, label string, language string, source_files array<string>, purpose string, status string, confidence string, tokens_in long, tokens_out long, est_cost double",
    "tables": "run_id string, table_id string, name string, role string, source_system string, grain string, produced_by array<string>, consumed_by array<string>, source string, confidence string, review_status string",
    "columns": "run_id string, table_id string, name string, inferred_type string, role string, used_in array<string>, control_status string, source string, confidence string, review_status string",
    "table_edges": "run_id string, edge_id string, source_table_id string, target_table_id string, model_id string, transformation_type string, notes string, source string, confidence string, review_status string",
    "column_edges": "run_id string, edge_id string, source_element string, target_element string, model_id string, transformation_type string, expression string, join_keys array<string>, source string, confidence string, review_status string",
    "usages": "run_id string, element string, usage_kind string, evidence string, model_id string, source string, confidence string, review_status string",
    "dq_rules": "run_id string, rule_id string, element string, related_elements array<string>, dimension string, rule_statement string, rationale string, code_evidence string, severity string, source string, confidence string, status string, model_ids array<string>",
    "source_systems": "run_id string, name string, tables array<string>",
    "issues": "run_id string, model_id string, severity string, message string",
    "overrides": "run_id string, seq long, target string, field string, old string, new string, by string, timestamp string",
    "runs": "run_id string, timestamp string, tool_version string, llm_provider string, llm_model string, tokens long, est_cost double, security_mode string",
}

# Fixed values of the state.
ROLES = ("Source", "Intermediate", "Output")
DIMENSIONS = ("Completeness", "Uniqueness", "Validity", "Accuracy", "Consistency", "Timeliness")
SEVERITIES = ("High", "Medium", "Low")
REVIEW = ("Proposed", "Accepted", "Rejected")
