"""Spark-first engine for redaction, reporting and text-corpus operators."""

from .operators.budgets import cumulative_budget
from .operators.reports import evaluate_budgets, merge_reports, nearest_rank
from .operators.structured import omit_stream_events, redact_calls, redact_json, redact_payloads, redact_struct, redact_tool_arguments
from .operators.telemetry import map_telemetry, report_context
from .operators.text import redact_text
from .operators.tooling import commit_drift, compare_versions, contract_changed, inventory_sha256, output_path, performance_result, stable_json
from .functions.redact import built_in_detectors, regex_detector
from .options import Detector, Limits, Options, Profile, Refused, create_profile, default_token
from .plans.telemetry import with_redacted_telemetry
from .streaming.redact import redact_live_streams, redact_stored_streams

__all__ = [
    "Detector",
    "Limits",
    "Options",
    "Profile",
    "Refused",
    "built_in_detectors",
    "commit_drift",
    "compare_versions",
    "contract_changed",
    "create_profile",
    "cumulative_budget",
    "default_token",
    "evaluate_budgets",
    "inventory_sha256",
    "map_telemetry",
    "merge_reports",
    "nearest_rank",
    "omit_stream_events",
    "output_path",
    "performance_result",
    "redact_calls",
    "redact_json",
    "redact_live_streams",
    "redact_payloads",
    "redact_stored_streams",
    "redact_struct",
    "redact_text",
    "redact_tool_arguments",
    "regex_detector",
    "report_context",
    "stable_json",
    "with_redacted_telemetry",
]
