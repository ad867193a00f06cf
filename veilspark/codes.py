"""The closed vocabularies of errors and warnings, and the shape of results."""

from __future__ import annotations

from pyspark.sql import types as T

# Error codes and the safe message of each.
ERRORS = {
    "detector_failed": "A detector failed before content could be safely redacted.",
    "detector_timeout": "A detector timed out before content could be safely redacted.",
    "invalid_detection_range": "A detector returned an invalid range.",
    "invalid_redaction_input": "Redaction input must be a string.",
    "invalid_redaction_options": "Redaction options must be a valid options or profile object.",
    "invalid_redaction_profile": "Redaction profile configuration is invalid.",
    "invalid_redaction_reason": "A detector returned an unsafe redaction reason.",
    "replacement_failed": "Replacement token generation failed before content could be safely redacted.",
    "max_string_length_exceeded": "Input exceeded the configured redaction limit.",
    "max_total_string_length_exceeded": "Total string length exceeded the configured redaction limit.",
    "max_object_depth_exceeded": "Object depth exceeded the configured redaction limit.",
    "max_object_keys_exceeded": "Object key count exceeded the configured redaction limit.",
    "max_array_length_exceeded": "Array length exceeded the configured redaction limit.",
    "max_total_nodes_exceeded": "Node count exceeded the configured redaction limit.",
    "max_total_detections_exceeded": "Detection count exceeded the configured redaction limit.",
    "max_detectors_exceeded": "Detector count exceeded the configured redaction limit.",
    "max_detector_runs_exceeded": "Detector execution count exceeded the configured redaction limit.",
    "max_total_duration_exceeded": "Redaction exceeded the configured total operation duration.",
    "max_stream_buffer_length_exceeded": "Streaming redaction exceeded the configured buffer length.",
    "stream_closed": "Streaming redaction cannot accept chunks after close.",
    "stream_already_closed": "Streaming redaction has already been closed.",
    "stream_operation_in_progress": "Rolling stream redaction accepts only one awaited operation at a time.",
    "overlapping_detection": "Overlapping detector ranges could not be safely resolved.",
    "redaction_aborted": "Redaction was aborted before content could be safely redacted.",
    "circular_reference": "Circular reference encountered before content could be safely redacted.",
    "unsafe_object_key": "Object keys that look content-bearing cannot be safely preserved.",
    "malformed_tool_arguments": "Malformed tool arguments could not be safely redacted.",
    "unsupported_json_like": "Only JSON-serializable values can be safely traversed.",
    "unsupported_provider_shape": "Unsupported payload shape; content-bearing fields were not exported.",
}

#: Warnings are all errors and two that no failure goes with.
WARNINGS = frozenset(ERRORS) | {"streaming_content_omitted", "report_callback_failed"}

WARNING = T.StructType([T.StructField(n, T.StringType()) for n in ("code", "detector_id", "reason", "path")])
TIMINGS = T.StructType(
    [T.StructField("duration_ms", T.DoubleType()), T.StructField("detector_duration_ms", T.DoubleType())]
    + [T.StructField(n, T.LongType()) for n in ("detector_runs", "nodes_visited", "string_code_units")]
)
REPORT = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("total_redactions", T.LongType()),
        T.StructField("counts_by_reason", T.MapType(T.StringType(), T.LongType())),
        T.StructField("warnings", T.ArrayType(WARNING)),
        T.StructField("timings", TIMINGS),
    ]
)
ERROR = T.StructType([T.StructField(n, T.StringType()) for n in ("code", "message", "detector_id")])


def result_type(*values: str) -> T.StructType:
    """ok, the value columns (null unless ok), report and error."""
    names = values or ("value",)
    return T.StructType([T.StructField("ok", T.BooleanType()), *(T.StructField(v, T.StringType()) for v in names), T.StructField("report", REPORT), T.StructField("error", ERROR)])
