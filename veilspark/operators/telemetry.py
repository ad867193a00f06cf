"""Telemetry attributes from reports: labels, numbers, reason counts and codes, never content."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..codes import WARNINGS
from ..functions.labels import safe_label
from ..options import BUILT_IN

# The public semantic convention that the attribute names follow.
SEMCONV_COMMIT = "150760c6252a4bb63c49c9915bad11997d316a15"
SEMCONV_LABEL = "opentelemetry-semconv-genai-150760c6252a"
SEMCONV_STATUS = "development"
SEMCONV_SOURCE = f"https://github.com/open-telemetry/semantic-conventions-genai/commit/{SEMCONV_COMMIT}"
MAX_SAFE_INTEGER = 9007199254740991

#: Inputs in the order in which unsafe ones are listed as dropped: input, attribute, kind.
INPUTS = (
    ("operationName", "gen_ai.operation.name", "label"),
    ("providerName", "gen_ai.provider.name", "label"),
    ("requestModel", "gen_ai.request.model", "label"),
    ("responseModel", "gen_ai.response.model", "label"),
    ("errorClass", "error.type", "label"),
    ("latencyMs", "{}.operation.duration_ms", "number"),
    ("report.timings.durationMs", "{}.redaction.duration_ms", "number"),
    ("report.timings.detectorDurationMs", "{}.redaction.detector_duration_ms", "number"),
    ("report.timings.detectorRuns", "{}.redaction.detector_runs", "integer"),
    ("tokenUsage.inputTokens", "gen_ai.usage.input_tokens", "integer"),
    ("tokenUsage.outputTokens", "gen_ai.usage.output_tokens", "integer"),
    ("tokenUsage.totalTokens", "{}.usage.total_tokens", "integer"),
)
_TIMINGS = {"report.timings.durationMs": "duration_ms", "report.timings.detectorDurationMs": "detector_duration_ms", "report.timings.detectorRuns": "detector_runs"}
CONTEXT = ("operationId", "attemptId", "idempotencyKey")


def _safe(value: Column, kind: str) -> Column:
    if kind == "label":
        return safe_label(value.cast("string"))
    number = value.cast("double")
    good = (number >= 0) & ~F.isnan(number) & (number != float("inf"))
    return good if kind == "number" else good & (number == F.floor(number)) & (number <= MAX_SAFE_INTEGER)


def _whole(value: Column) -> Column:
    """A count: truncated, 0 where it is no finite non-negative number."""
    number = value.cast("double")
    return F.when((number >= 0) & ~F.isnan(number) & (number != float("inf")), F.floor(number)).otherwise(0).cast("long")


def map_telemetry(frame: DataFrame, report: str = "report", inputs: Mapping[str, Column] | None = None, convention_label: Column | None = None, capture_content: Column | bool = False, prefix: str = "veilspark", out: str = "telemetry") -> DataFrame:
    """Adds ``out``: a struct of ``text``, ``number``, ``integer`` and ``flag`` attribute maps, ``warning_codes``,
    and ``dropped`` (the names of inputs that were unsafe, in a fixed order).

    ``inputs`` names columns by the first field of ``INPUTS``; ``prefix`` names the attributes outside the public
    convention. A null report is a failed one. Capturing content is never honoured, only noted as dropped.
    """
    r, given = F.col(report), dict(inputs or {})
    known = r["status"].isin("unchanged", "redacted", "failed")
    values, dropped = {}, [F.when(~F.coalesce(known, F.lit(False)), F.lit("report.status"))]
    for name, attribute, kind in INPUTS:
        value = r["timings"][_TIMINGS[name]] if name in _TIMINGS else given.get(name)
        if value is None:
            continue
        good = F.coalesce(_safe(value, kind), F.lit(False))
        values[attribute.format(prefix)] = (kind, F.when(good, value))
        dropped.append(F.when(value.isNotNull() & ~good, F.lit(name)))
    dropped.append(F.when(F.lit(capture_content) if isinstance(capture_content, bool) else capture_content, F.lit("captureContent")))
    codes = F.filter(r["warnings"], lambda w: w["code"].isin(*sorted(WARNINGS)))
    dropped.append(F.when(F.size(codes) < F.size(r["warnings"]), F.lit("report.warnings")))
    names = F.array_compact(F.array(*dropped))
    label = F.lit(SEMCONV_LABEL)
    if convention_label is not None:
        label = F.when(F.coalesce(safe_label(convention_label), F.lit(False)), convention_label).otherwise(label)
    built_in = {n: F.coalesce(r["counts_by_reason"][n], F.lit(None)) for n in BUILT_IN}
    others = F.map_filter(r["counts_by_reason"], lambda k, _: ~k.isin(*BUILT_IN))
    custom = F.when(F.size(others) > 0, F.aggregate(F.map_values(others), F.lit(0).cast("long"), lambda a, x: a + _whole(x)))
    integers = {f"{prefix}.redaction.total_count": _whole(r["total_redactions"])}
    integers |= {a: v.cast("long") for a, (k, v) in values.items() if k == "integer"}
    integers |= {f"{prefix}.redaction.reason_count.{n}": F.when(v.isNotNull(), _whole(v)) for n, v in built_in.items()}
    integers |= {f"{prefix}.redaction.reason_count.custom": custom, f"{prefix}.redaction.metadata_dropped_count": F.when(F.size(names) > 0, F.size(names)).cast("long")}
    texts = {
        f"{prefix}.otel.genai.semconv.label": label,
        f"{prefix}.otel.genai.semconv.status": F.lit(SEMCONV_STATUS),
        f"{prefix}.otel.genai.semconv.source": F.lit(SEMCONV_SOURCE),
        f"{prefix}.redaction.status": F.when(known, r["status"]).otherwise("failed"),
    } | {a: v.cast("string") for a, (k, v) in values.items() if k == "label"}
    numbers = {a: v.cast("double") for a, (k, v) in values.items() if k == "number"}
    flags = {f"{prefix}.content_capture.enabled": F.lit(False)}

    def as_map(columns: dict[str, Column], kind: str) -> Column:
        if not columns:
            return F.create_map().cast(f"map<string,{kind}>")
        return F.map_filter(F.create_map(*[x for n, c in columns.items() for x in (F.lit(n), c)]), lambda _, v: v.isNotNull()).cast(f"map<string,{kind}>")

    made = F.struct(
        as_map(texts, "string").alias("text"),
        as_map(numbers, "double").alias("number"),
        as_map(integers, "bigint").alias("integer"),
        as_map(flags, "boolean").alias("flag"),
        F.array_sort(F.array_distinct(F.transform(codes, lambda w: w["code"]))).alias("warning_codes"),
        names.alias("dropped"),
    )
    least = {f"{prefix}.redaction.total_count": F.lit(0), f"{prefix}.redaction.metadata_dropped_count": F.lit(1)}
    broken = F.struct(
        as_map({k: v for k, v in texts.items() if "semconv" in k} | {f"{prefix}.otel.genai.semconv.label": F.lit(SEMCONV_LABEL), f"{prefix}.redaction.status": F.lit("failed")}, "string").alias("text"),
        as_map({}, "double").alias("number"),
        as_map(least, "bigint").alias("integer"),
        as_map(flags, "boolean").alias("flag"),
        F.array().cast("array<string>").alias("warning_codes"),
        F.array(F.lit("mapperInput")).alias("dropped"),
    )
    return frame.withColumn(out, F.when(r.isNull(), broken).otherwise(made))


def report_context(frame: DataFrame, columns: Mapping[str, Column], out: str = "report_context") -> DataFrame:
    """Adds ``out``: the safe ones of the correlation labels ``CONTEXT``, and droppedContextKeys."""
    fields, dropped = [], []
    for name in CONTEXT:
        value = columns.get(name, F.lit(None)).cast("string")
        good = F.coalesce(safe_label(value), F.lit(False))
        fields.append(F.when(good, value).alias(name))
        dropped.append(F.when(value.isNotNull() & ~good, F.lit(name)))
    return frame.withColumn(out, F.struct(*fields, F.array_compact(F.array(*dropped)).alias("droppedContextKeys")))
