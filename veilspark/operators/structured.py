"""Redaction of nested columns and of JSON payload columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..codes import ERRORS, result_type
from ..options import Options, Profile, Refused, resolve
from . import lossless
from .payload import ADAPTERS, parse, redact_arguments_text, redact_call, redact_payload, redact_value, write
from .text import result_row

_PLAIN = (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.NullType)


def _unsupported(kind: T.DataType, path: str = "$") -> str | None:
    """The first place whose type JSON-like values do not have; known when the plan is made."""
    if isinstance(kind, T.StructType):
        return next((p for i, f in enumerate(kind) if (p := _unsupported(f.dataType, f"{path}.{{{i}}}"))), None)
    if isinstance(kind, T.ArrayType):
        return _unsupported(kind.elementType, f"{path}[0]")
    if isinstance(kind, T.MapType):
        return path if not isinstance(kind.keyType, T.StringType) else _unsupported(kind.valueType, f"{path}.{{0}}")
    return None if isinstance(kind, _PLAIN) else path


def _as_plain(value: object) -> object:
    """A row value as dicts, lists and scalars."""
    if hasattr(value, "asDict"):
        return {k: _as_plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {k: _as_plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
        return [_as_plain(v) for v in value]
    return value


def redact_struct(frame: DataFrame, column: str, out: str = "redacted", policy: Options | Profile | Mapping | None = None) -> DataFrame:
    """Adds ``out`` for a struct, array or map column: ok, value (of the column's own type), report and error.

    The schema is checked when the plan is made; dates, binaries and other types that JSON lacks make every row
    a coded failure. Field names are scanned like keys. NaN and infinities fail a row. One pass runs per row in
    an Arrow UDF, as budgets are drawn on in document order.
    """
    options, kind = resolve(policy), frame.schema[column].dataType
    bad = _unsupported(kind)
    shape = T.StructType([f if f.name != "value" else T.StructField("value", kind) for f in result_type()])

    def run(value: object) -> dict:
        if bad is not None:
            report_value, report, refused = redact_value(object(), options)
            report.warnings = [{"code": "unsupported_json_like", "path": bad}]
            return result_row(report_value, report, refused)
        from decimal import Decimal

        # Decimals are numbers; they stay as they are.
        held: dict[int, Decimal] = {}

        def numbers(x: object) -> object:
            if isinstance(x, Decimal):
                held[len(held)] = x
                return 0
            if isinstance(x, dict):
                return {k: numbers(v) for k, v in x.items()}
            return [numbers(v) for v in x] if isinstance(x, list) else x

        plain = _as_plain(value)
        new, report, refused = redact_value(numbers(plain), options)

        def back(x: object, old: object) -> object:
            if isinstance(old, Decimal):
                return old
            if isinstance(old, dict):
                return {k: back(x[k], v) for k, v in old.items()}
            return [back(a, b) for a, b in zip(x, old, strict=True)] if isinstance(old, list) else x

        return result_row(None if refused else back(new, plain), report, refused)

    return frame.withColumn(out, F.udf(run, shape, useArrow=True)(F.col(column)))


def redact_json(frame: DataFrame, column: str, out: str = "redacted", policy: Options | Profile | Mapping | None = None, keep_bytes: bool = False) -> DataFrame:
    """Adds ``out`` for a column of JSON texts. With ``keep_bytes`` all but changed string tokens stays byte for byte,
    and duplicate keys are refused; without, the value is written anew."""
    options = resolve(policy)

    def run(text: str | None) -> dict:
        try:
            if keep_bytes:
                return result_row(*redact_arguments_text(text, options)) if text is not None else failed("malformed_tool_arguments")
            new, report, refused = redact_value(parse(text), options)
            return result_row(None if refused else write(new), report, refused)
        except lossless.Malformed:
            return failed("malformed_tool_arguments")
        except Refused as refused:
            return failed(refused.code if keep_bytes else "unsupported_json_like", refused)

    return frame.withColumn(out, F.udf(run, result_type(), useArrow=True)(F.col(column)))


def failed(code: str, refused: Refused | None = None) -> dict:
    warnings = [{"code": code, "detector_id": None, "reason": None, "path": "$"}]
    report = {"status": "failed", "total_redactions": 0, "counts_by_reason": {}, "warnings": warnings, "timings": None}
    return {"ok": False, "value": None, "report": report, "error": {"code": code, "message": refused.message if refused and refused.message else ERRORS[code], "detector_id": None}}


redact_tool_arguments = redact_json


def redact_payloads(frame: DataFrame, column: str, adapter: str, boundary: str, out: str = "redacted", policy: Options | Profile | Mapping | None = None, redact_tool_names: bool = False) -> DataFrame:
    """Adds ``out`` for a column of chat payloads as JSON text; ``boundary`` is request or response."""
    if adapter not in ADAPTERS or boundary not in ("request", "response"):
        raise Refused("unsupported_provider_shape", message="Unsupported telemetry redaction adapter.")
    options = resolve(policy)
    run = F.udf(lambda text: result_row(*redact_payload(text, adapter, boundary, options, redact_tool_names)), result_type(), useArrow=True)
    return frame.withColumn(out, run(F.col(column)))


def redact_calls(frame: DataFrame, request: str, response: str | None, adapter: str, out: str = "call", policy: Options | Profile | Mapping | None = None, redact_tool_names: bool = False) -> DataFrame:
    """Adds ``out``: ok, request, response, report and error of a request with its response under one budget.

    A null response means that there is none yet.
    """
    if adapter not in ADAPTERS:
        raise Refused("unsupported_provider_shape", message="Unsupported telemetry redaction adapter.")
    options = resolve(policy)

    def run(asked: str | None, answered: str | None) -> dict:
        new, answer, report, refused = redact_call(asked, answered, answered is not None, adapter, options, redact_tool_names)
        row = result_row(new, report, refused, "request")
        return row | {"response": answer}

    return frame.withColumn(out, F.udf(run, result_type("request", "response"), useArrow=True)(F.col(request), F.col(response) if response else F.lit(None).cast("string")))


def omit_stream_events(frame: DataFrame, content: str) -> DataFrame:
    """Stream events as metadata only; the content column is dropped and so never read."""
    return frame.drop(content).withColumns({"content_omitted": F.lit(True), "warning_code": F.lit("streaming_content_omitted")})
