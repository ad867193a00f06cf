"""The whole way of a call: request and response redacted under one budget, reports mapped to telemetry."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..codes import ERRORS, REPORT, WARNING
from ..operators.structured import redact_calls
from ..operators.telemetry import map_telemetry, report_context
from ..options import Options, Profile, Refused


def with_redacted_telemetry(
    frame: DataFrame,
    adapter: str,
    request: str,
    response: str | None = None,
    policy: Options | Profile | Mapping | None = None,
    redact_tool_names: bool = False,
    inputs: Mapping[str, Column] | None = None,
    context: Mapping[str, Column] | None = None,
    convention_label: Column | None = None,
    on_report: Callable[[dict, dict], None] | None = None,
    prefix: str = "veilspark",
) -> DataFrame:
    """Adds ok, redacted_request, redacted_response, report, error, telemetry and report_context; drops the raw payloads.

    An unknown adapter or a bad policy makes every row a coded failure. ``on_report`` gets a row's report and
    context, never its payload, where the row is; if it raises, the report gets a warning and the result stands.
    """
    frame = report_context(frame, context or {})
    raw = [c for c in (request, response) if c]
    try:
        done = redact_calls(frame, request, response, adapter, "__call", policy, redact_tool_names)
        parts = {"ok": "__call.ok", "redacted_request": "__call.request", "redacted_response": "__call.response", "report": "__call.report", "error": "__call.error"}
        done = done.withColumns({k: F.col(v) for k, v in parts.items()}).drop("__call", *raw)
    except Refused as refused:
        done = _all_failed(frame, refused).drop(*raw)
    if on_report is not None:
        def told(report: object, about: object) -> bool:
            try:
                on_report(report.asDict(True), about.asDict(True))
            except Exception:  # a callback's failure must not carry content or lose the result
                return False
            return True

        call = F.udf(told, T.BooleanType()).asNondeterministic()
        warned = F.struct(F.lit("report_callback_failed").alias("code"), *[F.lit(None).cast("string").alias(n) for n in ("detector_id", "reason", "path")]).cast(WARNING)
        done = done.withColumn("__told", call("report", "report_context"))
        done = done.withColumn("report", F.when(F.col("__told"), F.col("report")).otherwise(F.col("report").withField("warnings", F.array_append("report.warnings", warned)))).drop("__told")
    return map_telemetry(done, "report", inputs, convention_label, prefix=prefix)


def _all_failed(frame: DataFrame, refused: Refused) -> DataFrame:
    warning = F.array(F.struct(F.lit(refused.code).alias("code"), *[F.lit(None).cast("string").alias(n) for n in ("detector_id", "reason", "path")]))
    report = F.struct(F.lit("failed").alias("status"), F.lit(0).cast("long").alias("total_redactions"), F.create_map().cast("map<string,bigint>").alias("counts_by_reason"), warning.alias("warnings"), F.lit(None).cast(REPORT["timings"].dataType).alias("timings")).cast(REPORT)
    error = F.struct(F.lit(refused.code).alias("code"), F.lit(refused.message or ERRORS[refused.code]).alias("message"), F.lit(refused.detector_id).cast("string").alias("detector_id"))
    return frame.withColumns({"ok": F.lit(False), "redacted_request": F.lit(None).cast("string"), "redacted_response": F.lit(None).cast("string"), "report": report, "error": error})

