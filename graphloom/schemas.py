"""Explicit schemas of the logs and reports the readers accept."""

from __future__ import annotations

TELEMETRY = ("event_id BIGINT, ts_ms BIGINT, task_id STRING, event_type STRING, category STRING, tool_name STRING, "
             "provider STRING, status STRING, error_code STRING, total_tokens_reported BIGINT, prompt_tokens_estimated BIGINT, "
             "completion_tokens_estimated BIGINT, latency_ms BIGINT, operation STRING, metadata STRING")
PATCHES = ("patch_id BIGINT, ts_ms BIGINT, repository STRING, target_symbol STRING, model_used STRING, edit_type STRING, "
           "approved_by_user BOOLEAN, validation_passed BOOLEAN, tests_passed BOOLEAN, rollback_occurred BOOLEAN, "
           "impacted_symbols ARRAY<STRING>")
KNOWLEDGE = "ts_ms BIGINT, category STRING, repository STRING, title STRING, details STRING"
EXPERIMENTS = ("timestamp", "provider", "symbol", "tokens_without", "tokens_with", "savings_pct")
DEPLOYMENTS = "version STRING, environment STRING, ts_ms BIGINT, config_hash STRING"
FILE_CHANGES = "path STRING, kind STRING, seq BIGINT, content STRING"

# Names an enumerated column may hold.
ENUMS = {
    "symbol_type": ("function", "class", "import"),
    "node_type": ("Loop", "Conditional", "Try", "Catch", "Finally", "Return", "Call", "Await", "Assignment", "Throw", "Switch", "Case"),
    "flow_kind": ("Next", "Branch", "LoopBack", "Exception", "AssignmentToUse", "AssignmentToReturn", "CallResult"),
    "edit_type": ("RenameSymbol", "ChangeSignature", "RefactorFunction", "ModifyLogic"),
}
