"""Text redaction over a string column."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..codes import ERRORS, result_type
from ..functions import native
from ..functions.redact import Report, redact
from ..options import Options, Profile, Refused, resolve


def result_row(value: str | None, report: Report, refused: Refused | None, name: str = "value") -> dict:
    """A row of ``result_type()``."""
    error = None if refused is None else {"code": refused.code, "message": refused.message or ERRORS[refused.code], "detector_id": refused.detector_id}
    return {"ok": refused is None, name: value, "report": report.row(), "error": error}


def redact_text(frame: DataFrame, column: str, out: str = "redacted", policy: Options | Profile | Mapping | None = None) -> DataFrame:
    """Adds ``out``: ok, value, report and error for each text. A failed row has no value, and no task fails.

    A policy of built-in detectors and a mapping of tokens runs in the JVM; custom detectors, replacement
    functions and time limits run in an Arrow UDF. Invalid options make every row a coded failure.
    """
    try:
        options = resolve(policy)
    except (Refused, TypeError) as refused:
        bad = refused if isinstance(refused, Refused) else Refused("invalid_redaction_options")
        report = Report(failed=True)
        report.warn(bad.code)
        constant = result_row(None, report, bad)
        return frame.withColumn(out, F.udf(lambda _: constant, result_type(), useArrow=True)(F.col(column)))
    if native.is_native(options):
        return native.redact_column(frame, column, out, options)
    run = F.udf(lambda text: result_row(*redact(text, options)), result_type(), useArrow=True)
    return frame.withColumn(out, run(F.col(column)))
