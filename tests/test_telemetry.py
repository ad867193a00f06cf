import json

import pytest
from pyspark.sql import functions as F

from veilspark import Options, cumulative_budget, evaluate_budgets, map_telemetry, merge_reports, redact_text, with_redacted_telemetry
from veilspark.codes import REPORT, WARNINGS
from veilspark.operators.telemetry import MAX_SAFE_INTEGER, SEMCONV_LABEL
from veilspark.options import Refused, create_profile

WARN = {"code": "overlapping_detection", "detector_id": None, "reason": "api_key", "path": None}
TIMES = {"duration_ms": 1.5, "detector_duration_ms": -1.0, "detector_runs": 4, "nodes_visited": 1, "string_code_units": 9}


def report(status="redacted", total=3, counts=None, warnings=(), timings=TIMES):
    return {"status": status, "total_redactions": total, "counts_by_reason": counts or {}, "warnings": list(warnings), "timings": timings}


def mapped(spark, row, prefix="p", **options):
    frame = spark.createDataFrame([(row,)], f"report {REPORT.simpleString()}")
    return map_telemetry(frame, prefix=prefix, **options).first().telemetry.asDict(True)


def test_counts_labels_and_drops(spark):
    inputs = {"operationName": F.lit("chat"), "providerName": F.lit("a b"), "requestModel": F.lit("sk-" + "abcdefgh1"), "latencyMs": F.lit(float("nan")), "tokenUsage.inputTokens": F.lit(5), "tokenUsage.outputTokens": F.lit(1.5), "tokenUsage.totalTokens": F.lit(float(MAX_SAFE_INTEGER) + 2)}
    t = mapped(spark, report(counts={"email": 2, "custom:a": 1, "custom:b": 4}, warnings=[WARN, WARN, WARN | {"code": "redaction_aborted"}]), inputs=inputs, capture_content=True)
    assert t["integer"] == {"p.redaction.total_count": 3, "p.redaction.reason_count.email": 2, "p.redaction.reason_count.custom": 5, "p.redaction.detector_runs": 4, "gen_ai.usage.input_tokens": 5, "p.redaction.metadata_dropped_count": 7}
    assert t["text"]["gen_ai.operation.name"] == "chat" and t["number"] == {"p.redaction.duration_ms": 1.5} and t["flag"] == {"p.content_capture.enabled": False}
    assert t["dropped"] == ["providerName", "requestModel", "latencyMs", "report.timings.detectorDurationMs", "tokenUsage.outputTokens", "tokenUsage.totalTokens", "captureContent"]
    assert t["warning_codes"] == ["overlapping_detection", "redaction_aborted"]


def test_unknown_status_and_codes(spark):
    t = mapped(spark, report(status="what", total=-2, warnings=[WARN | {"code": "made_up"}], timings=None))
    assert t["text"]["p.redaction.status"] == "failed" and t["integer"]["p.redaction.total_count"] == 0 and t["dropped"] == ["report.status", "report.warnings"] and t["warning_codes"] == []


def test_a_missing_report_is_a_failed_one(spark):
    t = mapped(spark, None)
    assert t["dropped"] == ["mapperInput"] and t["integer"] == {"p.redaction.total_count": 0, "p.redaction.metadata_dropped_count": 1} and t["text"]["p.redaction.status"] == "failed"


@pytest.mark.parametrize("label, used", [("own-1", "own-1"), ("not ok", SEMCONV_LABEL), ("", SEMCONV_LABEL)])
def test_convention_label(spark, label, used):
    assert mapped(spark, report(), convention_label=F.lit(label))["text"]["p.otel.genai.semconv.label"] == used


def test_codes_are_closed():
    assert len(WARNINGS) == 31 and {"streaming_content_omitted", "report_callback_failed"} <= WARNINGS


def test_reports_merge_by_group(spark):
    rows = [("a", report(counts={"email": 3})), ("a", report("failed", 0, warnings=[WARN])), ("b", report("unchanged", 0, timings=None)), (None, report(counts={"url": 3})), ("c", None)]
    frame = spark.createDataFrame(rows, f"k string, report {REPORT.simpleString()}")
    found = {r.k: r for r in merge_reports(frame, ["k"]).collect()}
    assert set(found) == {"a", "b", None}
    assert (found["a"].status, found["a"].n_reports, found["a"].counts_by_reason, found["a"].warning_counts, found["a"].detector_runs) == ("failed", 2, {"email": 3}, {"overlapping_detection": 1}, 8)
    assert (found["b"].status, found["b"].counts_by_reason, found["b"].detector_runs) == ("unchanged", {}, None) and found[None].counts_by_reason == {"url": 3}
    assert merge_reports(frame, []).first().n_reports == 4


def test_budgets_fail_whole_groups(spark):
    rows = [("a", 1, 3, 1), ("a", 2, 3, 1), ("a", 3, 3, 9), ("b", 1, 5, 1), (None, 1, 9, 0)]
    frame = spark.createDataFrame(rows, "k string, turn int, units long, runs long")
    found = cumulative_budget(frame, ["k"], ["turn"], {"max_total_string_length": "units", "max_detector_runs": "runs"}, {"max_total_string_length": 5, "max_detector_runs": 9})
    got = {(r.k, r.turn): (r.budget_error, r.budget_row) for r in found.collect()}
    over = "max_total_string_length_exceeded"
    assert got == {("a", 1): (over, False), ("a", 2): (over, True), ("a", 3): (over, False), ("b", 1): (None, False), (None, 1): (over, True)}


def test_budget_verdicts(spark):
    budgets = spark.createDataFrame([("a", 10.0, 20.0), ("b", 10.0, 20.0), ("c", 10.0, 20.0), ("d", 10.0, 20.0)], "name string, median_ms double, p95_ms double")
    results = spark.createDataFrame([("a", 10.0, 20.0), ("b", 1.0, 20.5), ("c", 1.0, float("nan"))], "name string, median_ms double, p95_ms double")
    assert {r.name: r.verdict for r in evaluate_budgets(budgets, results).collect()} == {"a": "ok", "b": "exceeded", "c": "incomplete", "d": "missing"}


ASK = json.dumps({"messages": [{"role": "user", "content": "u@example.invalid"}]})


def test_a_call_leaves_without_its_payload(spark):
    frame = spark.createDataFrame([(1, ASK, None), (2, ASK, json.dumps({"choices": [{"text": "Bearer abcdefgh"}]})), (3, "{}", None), (4, None, None)], "id int, asked string, answered string")
    done = with_redacted_telemetry(frame, "openai-compatible", "asked", "answered", context={"operationId": F.lit("op"), "attemptId": F.lit("a b")})
    assert not {"asked", "answered"} & set(done.columns)
    found = {r.id: r for r in done.collect()}
    assert [found[i].ok for i in (1, 2, 3, 4)] == [True, True, False, False] and found[2].report.total_redactions == 2 and found[1].redacted_response is None
    assert found[3].error.code == "unsupported_provider_shape" and found[3].redacted_request is None and found[1].report_context.operationId == "op" and found[1].report_context.droppedContextKeys == ["attemptId"]


@pytest.mark.parametrize("adapter, policy, code", [("none", None, "unsupported_provider_shape"), ("anthropic-messages", {"what": 1}, "invalid_redaction_options")])
def test_bad_calls_fail_every_row(spark, adapter, policy, code):
    row = with_redacted_telemetry(spark.createDataFrame([(ASK,)], "asked string"), adapter, "asked", policy=policy).first()
    assert not row.ok and row.error.code == code and row.redacted_request is None and row.telemetry.warning_codes == [code]


def test_profiles_run_like_options(spark):
    frame = spark.createDataFrame([("u@example.invalid",)], "t string")
    profile = create_profile(built_ins=("email",), replacement={"email": "<e>"})
    assert redact_text(frame, "t", "r", profile).first().r.value == "<e>" == redact_text(frame, "t", "r", Options(replacement=lambda _: "<e>")).first().r.value
    with pytest.raises(Refused):
        create_profile(built_ins=("email", "nope"))
