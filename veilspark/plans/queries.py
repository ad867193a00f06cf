"""Queries over the driver's tables for every redaction operator, and their SQL for DuckDB.

The tables hold few secrets, so most queries make texts and payloads from keys, in the same way on both
sides. The SQL spells word boundaries as ``\\b``, which is ASCII in its dialect.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import safe_label
from ..functions.redact import regex_detector
from ..operators.budgets import cumulative_budget
from ..operators.reports import evaluate_budgets, merge_reports, merged, nearest_rank
from ..operators.structured import omit_stream_events, redact_calls, redact_json, redact_payloads, redact_struct
from ..operators.telemetry import map_telemetry, report_context
from ..operators.text import redact_text
from ..operators.tooling import commit_drift, compare_versions, contract_changed, inventory_sha256, output_path, performance_result
from ..options import Detector, Limits, Options, create_profile
from ..sources.tables import read_table
from ..streaming.machines import flush_index
from ..streaming.redact import redact_stored_streams
from .telemetry import with_redacted_telemetry

EMAIL = r"\b[A-Za-z0-9.!#$%&''*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+\b"
BEARER = r"(\b(?:[Bb][Ee][Aa][Rr][Ee][Rr]|[Tt][Oo][Kk][Ee][Nn]|[Bb][Aa][Ss][Ii][Cc])\s+)[A-Za-z0-9._~+/=-]{6,}\b"
URL = r"""\bhttps?://[^\s"''<>]+"""

#: Limits that any document fits, for queries whose feature is not the limit: a string has fewer units than this.
WHOLE = Limits(max_string_length=2**32, max_stream_buffer_length=2**32)

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def _flat(frame: DataFrame, *keys: str, r: str = "redacted") -> DataFrame:
    """Keys, value, number of redactions, and the error's code."""
    return frame.select(*keys, F.col(f"{r}.value").alias("value"), F.col(f"{r}.report.total_redactions").alias("n"), F.col(f"{r}.error.code").alias("error"))


def _made(spark: SparkSession, sf_dir: str, *parts: str | Column) -> DataFrame:
    """customers with a text made of the parts; ``#`` in a part stands for the key."""
    columns = [p if isinstance(p, Column) else F.replace(F.lit(p), F.lit("#"), F.col("c_custkey").cast("string")) for p in parts]
    return read_table(spark, sf_dir, "customer").select("c_custkey", F.concat(*columns).alias("text"))


def _made_sql(text: str, out: str, n: int | None = None, error: str | None = None) -> str:
    value = "NULL::VARCHAR" if error else f"replace('{out}', '#', c_custkey::VARCHAR)"
    return f"SELECT c_custkey, {value} AS value, {n or 0}::BIGINT AS n, {f"'{error}'" if error else 'NULL::VARCHAR'} AS error FROM customer"


# ---- single detectors


@query(f"SELECT doc_id, regexp_replace(text, '{EMAIL}', '[REDACTED:email]', 'g') AS value, len(regexp_extract_all(text, '{EMAIL}'))::BIGINT AS n, NULL::VARCHAR AS error FROM documents")
def q_email_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(redact_text(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", policy=Options(built_ins=("email",), limits=WHOLE)), "doc_id")


@query(f"SELECT page_id, regexp_replace(url, '{URL}', '[REDACTED:url]', 'g') AS value, len(regexp_extract_all(url, '{URL}'))::BIGINT AS n, NULL::VARCHAR AS error FROM pages")
def q_url_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(redact_text(read_table(spark, sf_dir, "pages").select("page_id", "url"), "url", policy=Options(built_ins=("url",))), "page_id")


@query(f"SELECT c_custkey, regexp_replace('a Bearer abcdef' || c_custkey || ', bASIC qwerty.' || c_custkey || ' Tokens x', '{BEARER}', '\\1[REDACTED:bearer_token]', 'g') AS value, 2::BIGINT AS n, NULL::VARCHAR AS error FROM customer")
def q_bearer_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(redact_text(_made(spark, sf_dir, "a Bearer abcdef#, bASIC qwerty.# Tokens x"), "text", policy=Options(built_ins=("bearer_token",))), "c_custkey")


@query(_made_sql("", "keys [REDACTED:api_key] [REDACTED:api_key] é[REDACTED:api_key]", 3))
def q_api_key_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(redact_text(_made(spark, sf_dir, "keys sk", "_test_abcdef# AK", "IA", "Q" * 16, " étok", "en_abcdef#"), "text", policy=Options(built_ins=("api_key",))), "c_custkey")


@query(_made_sql("", "Mail [REDACTED:email], Basic [REDACTED:bearer_token] at [REDACTED:url] or [REDACTED:api_key] end#", 4))
def q_redact_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(redact_text(_made(spark, sf_dir, "Mail user#@example.invalid, Basic abcdef# at https://example.invalid/p?k=# or s", "k_abcdef# end#"), "text"), "c_custkey")


# ---- overlaps, limits, policies


@query("SELECT c_custkey, 'Bearer [REDACTED:bearer_token]' AS value, 1::BIGINT AS n, NULL::VARCHAR AS error, 'overlapping_detection' AS warning, 'api_key' AS reason FROM customer")
def q_overlap_same_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = redact_text(_made(spark, sf_dir, "Bearer tok", "en_example_#"), "text")
    first = F.col("redacted.report.warnings")[0]
    return _flat(done.withColumns({"warning": first["code"], "reason": first["reason"]}), "c_custkey", "warning", "reason")


@query(_made_sql("", "", 0, "overlapping_detection"))
def q_overlap_partial_fail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(redact_text(_made(spark, sf_dir, "see https://u#@example.invalid/x"), "text"), "c_custkey")


_UNITS = "(length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))"


@query(f"SELECT CASE WHEN {_UNITS} > 2000 THEN 'failed' WHEN regexp_matches(text, '{EMAIL}') THEN 'redacted' ELSE 'unchanged' END AS status, count(*) AS n, sum({_UNITS})::BIGINT AS code_units FROM documents GROUP BY 1")
def q_status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = redact_text(read_table(spark, sf_dir, "documents").select("text"), "text", policy={"limits": {"max_string_length": 2000}})
    return done.groupBy(F.col("redacted.report.status").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum("redacted.report.timings.string_code_units").alias("code_units"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE replace('[REDACTED:email] [REDACTED:email]', '', '') END AS value, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 2 END::BIGINT AS n, CASE WHEN c_custkey % 3 = 0 THEN 'max_total_detections_exceeded' END AS error FROM customer")
def q_detection_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _made(spark, sf_dir, "a@b.cd e@f.gh", F.when(F.col("c_custkey") % 3 == 0, " i@j.kl").otherwise(""))
    return _flat(redact_text(rows, "text", policy=Options(limits=Limits(max_total_detections=2))), "c_custkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN NULL::VARCHAR END AS value, 0::BIGINT AS n, 'invalid_redaction_input' AS error FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'plain ' || c_custkey, 0, NULL FROM customer WHERE c_custkey % 2 = 1")
def q_null_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _made(spark, sf_dir, "plain #").withColumn("text", F.when(F.col("c_custkey") % 2 == 1, F.col("text")))
    return _flat(redact_text(rows, "text"), "c_custkey")


@query(_made_sql("", "id [REDACTED:custom:account] by <mail>", 2))
def q_custom_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = create_profile(built_ins=("email",), detectors=(regex_detector("accounts", "custom:account", r"acct-\d+"),), replacement=lambda r: "<mail>" if r == "email" else f"[REDACTED:{r}]")
    return _flat(redact_text(_made(spark, sf_dir, "id acct-# by u#@example.invalid"), "text", policy=profile), "c_custkey")


@query(_made_sql("", "", 0, "invalid_redaction_options"))
def q_invalid_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(redact_text(_made(spark, sf_dir, "u#@example.invalid"), "text", policy={"limits": {"max_string_length": -1}}), "c_custkey")


# ---- reports and budgets


def _report_sql(table: str, key: str) -> str:
    return f"""SELECT {key}, count(*) AS n_reports, CASE WHEN sum(len(regexp_extract_all(text, '{EMAIL}'))) > 0 THEN 'redacted' ELSE 'unchanged' END AS status,
    sum(len(regexp_extract_all(text, '{EMAIL}')))::BIGINT AS total_redactions, sum(len(regexp_extract_all(text, '{EMAIL}')))::BIGINT AS emails, sum({_UNITS})::BIGINT AS string_code_units FROM {table} GROUP BY 1"""


def _merged(frame: DataFrame, key: str, limits: Limits = Limits()) -> DataFrame:
    done = redact_text(frame.select(key, "text"), "text", policy=Options(limits=limits)).select(key, F.col("redacted.report").alias("report"))
    emails = F.coalesce(F.col("counts_by_reason")["email"], F.lit(0)).alias("emails")
    return merge_reports(done, [key]).select(key, "n_reports", "status", "total_redactions", emails, "string_code_units")


@query(_report_sql("documents", "lang"))
def q_report_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(read_table(spark, sf_dir, "documents"), "lang", WHOLE)


@query("SELECT c_nationkey, count(*) AS n_reports, 'builtin:email' AS detector_id, count(*) FILTER (c_custkey % 2 = 0) AS over, count(*) FILTER (c_custkey % 2 = 1) AS overlaps FROM customer GROUP BY 1")
def q_report_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _made(spark, sf_dir, F.when(F.col("c_custkey") % 2 == 0, "a@b.cd e@f.gh i@j.kl").otherwise("Bearer tok" + "en_example")).join(read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    done = merge_reports(redact_text(rows, "text", policy=Options(limits=Limits(max_total_detections=2))).select("c_nationkey", F.col("redacted.report").alias("report")), ["c_nationkey"])
    n = lambda w: F.coalesce(F.aggregate(F.filter("warnings", w), F.lit(0).cast("long"), lambda a, x: a + x["n"]), F.lit(0))
    over = n(lambda w: (w["code"] == "max_total_detections_exceeded") & (w["detector_id"] == "builtin:email"))
    return done.select("c_nationkey", "n_reports", F.lit("builtin:email").alias("detector_id"), over.alias("over"), n(lambda w: (w["code"] == "overlapping_detection") & (w["reason"] == "api_key")).alias("overlaps"))


@query(_report_sql("conversations", "role"))
def q_report_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(read_table(spark, sf_dir, "conversations"), "role")


@query("SELECT c_custkey, 'redacted' AS status, 3::BIGINT AS total_redactions, 2::BIGINT AS emails, 1::BIGINT AS urls, 8::BIGINT AS detector_runs FROM customer")
def q_merge_two_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _made(spark, sf_dir, "u#@example.invalid v@example.invalid").withColumn("other", F.lit("https://example.invalid/x"))
    done = redact_text(redact_text(rows, "text", "a"), "other", "b").withColumn("r", merged(F.col("a.report"), F.col("b.report")))
    return done.select("c_custkey", "r.status", "r.total_redactions", F.col("r.counts_by_reason")["email"].alias("emails"), F.col("r.counts_by_reason")["url"].alias("urls"), "r.timings.detector_runs")


@query(
    f"""WITH u AS (SELECT conv_id, turn, {_UNITS} AS units, sum({_UNITS}) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM conversations),
    f AS (SELECT conv_id, min(turn) AS first FROM u WHERE run > 1500 GROUP BY 1)
    SELECT u.conv_id, turn, CASE WHEN first IS NOT NULL THEN 'max_total_string_length_exceeded' END AS error, coalesce(turn = first, false) AS budget_row FROM u LEFT JOIN f USING (conv_id)"""
)
def q_conversation_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = redact_text(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text")
    used = done.select("conv_id", "turn", F.col("redacted.report.timings.string_code_units").alias("units"))
    return cumulative_budget(used, ["conv_id"], ["turn"], {"max_total_string_length": "units"}, {"max_total_string_length": 1500}, "error").drop("units")


@query(f"SELECT conv_id, turn, role, regexp_replace(text, '{EMAIL}', '[REDACTED:email]', 'g') AS value FROM conversations")
def q_conversation_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact_text(read_table(spark, sf_dir, "conversations"), "text").select("conv_id", "turn", "role", "redacted.value")


# ---- nested values and JSON


@query("""SELECT o_orderkey, '{ "id": ' || o_orderkey || ', "ratio": 1.2300e+4, "contact": "[REDACTED:email]", "label": "safe\\u0020label" }' AS value, 1::BIGINT AS n, NULL::VARCHAR AS error FROM orders""")
def q_tool_args_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('{ "id": '), F.col("o_orderkey").cast("string"), F.lit(', "ratio": 1.2300e+4, "contact": "u\\u0040example.invalid", "label": "safe\\u0020label" }'))
    return _flat(redact_json(read_table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")), "text", keep_bytes=True), "o_orderkey")


@query("SELECT event_id, props AS value, 0::BIGINT AS n, NULL::VARCHAR AS error FROM events")
def q_event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(redact_json(read_table(spark, sf_dir, "events").select("event_id", "props"), "props", keep_bytes=True), "event_id")


@query("""SELECT o_orderkey, NULL::VARCHAR AS value, 0::BIGINT AS n, CASE o_orderkey % 3 WHEN 0 THEN 'unsupported_json_like' WHEN 1 THEN 'malformed_tool_arguments' ELSE 'max_array_length_exceeded' END AS error FROM orders""")
def q_tool_args_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey") % 3
    text = F.when(key == 0, '{"a":1,"\\u0061":2}').when(key == 1, '{"a":01}').otherwise("[1,2,3]")
    return _flat(redact_json(read_table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")), "text", policy={"limits": {"max_array_length": 2}}, keep_bytes=True), "o_orderkey")


@query("SELECT o_orderkey, o_custkey AS case_id, '[REDACTED:email]' AS contact, o_orderstatus AS note, 2::BIGINT AS n, 9::BIGINT AS nodes FROM orders")
def q_typed_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    contact = F.concat(F.lit("u"), F.col("o_custkey").cast("string"), F.lit("@example.invalid"))
    nested = F.struct(F.col("o_custkey").alias("case_id"), F.array(contact, F.col("o_orderstatus")).alias("notes"), F.struct(contact.alias("mail"), F.col("o_totalprice").alias("price")).alias("more"), F.lit(True).alias("open"))
    done = redact_struct(read_table(spark, sf_dir, "orders").select("o_orderkey", nested.alias("payload")), "payload")
    v = F.col("redacted.value")
    return done.select("o_orderkey", v["case_id"].alias("case_id"), v["more"]["mail"].alias("contact"), v["notes"][1].alias("note"), F.col("redacted.report.total_redactions").alias("n"), F.col("redacted.report.timings.nodes_visited").alias("nodes"))


@query("SELECT c_custkey, c_custkey % 2 = 0 AS ok, CASE WHEN c_custkey % 2 = 1 THEN 'unsafe_object_key' END AS error, CASE WHEN c_custkey % 2 = 1 THEN '$.{0}' END AS path FROM customer")
def q_unsafe_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(F.col("c_custkey") % 2 == 1, F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@example.invalid"))).otherwise("plain")
    done = redact_struct(read_table(spark, sf_dir, "customer").select("c_custkey", F.create_map(key, F.lit("v")).alias("m")), "m")
    return done.select("c_custkey", "redacted.ok", F.col("redacted.error.code").alias("error"), F.get("redacted.report.warnings", F.lit(0))["path"].alias("path"))


# ---- chat payloads


def _payload(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return _made(spark, sf_dir, text)


def _json_sql(out: str, n: int) -> str:
    return f"SELECT c_custkey, replace('{out}', '#', c_custkey::VARCHAR) AS value, {n}::BIGINT AS n, NULL::VARCHAR AS error FROM customer"


@query(_json_sql('{"model":"m-1","messages":[{"role":"user","content":"Mail [REDACTED:email]"},{"role":"assistant","tool_calls":[{"id":"c#","type":"function","function":{"name":"send","arguments":"{ \\"n\\": 1.50, \\"to\\": \\"[REDACTED:email]\\" }"}}]}],"max_tokens":#}', 2))
def q_chat_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = '{"model":"m-1","messages":[{"role":"user","content":"Mail u#@example.invalid"},{"role":"assistant","tool_calls":[{"id":"c#","type":"function","function":{"name":"send","arguments":"{ \\"n\\": 1.50, \\"to\\": \\"v@example.invalid\\" }"}}]}],"max_tokens":#}'
    return _flat(redact_payloads(_payload(spark, sf_dir, text), "text", "openai-compatible", "request"), "c_custkey")


@query(_json_sql('{"id":"r#","choices":[{"index":0,"message":{"role":"assistant","content":"see [REDACTED:url]"},"finish_reason":null}],"usage":{"total_tokens":#}}', 1))
def q_chat_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = '{"id":"r#","choices":[{"index":0,"message":{"role":"assistant","content":"see https://example.invalid/#"},"finish_reason":null}],"usage":{"total_tokens":#}}'
    return _flat(redact_payloads(_payload(spark, sf_dir, text), "text", "openai-compatible", "response"), "c_custkey")


@query(_json_sql('{"max_tokens":#,"system":"[REDACTED:email]","messages":[{"role":"assistant","content":[{"type":"tool_use","id":"t","name":"f","input":{"k":["[REDACTED:email]",#]}}]},{"role":"user","content":[{"type":"tool_result","tool_use_id":"t","content":"Bearer [REDACTED:bearer_token]"}]}]}', 3))
def q_blocks_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = '{"max_tokens":#,"system":"u#@example.invalid","messages":[{"role":"assistant","content":[{"type":"tool_use","id":"t","name":"f","input":{"k":["u@example.invalid",#]}}]},{"role":"user","content":[{"type":"tool_result","tool_use_id":"t","content":"Bearer abcdef#"}]}]}'
    return _flat(redact_payloads(_payload(spark, sf_dir, text), "text", "anthropic-messages", "request"), "c_custkey")


@query(_json_sql('{"role":"assistant","content":[{"type":"text","text":"[REDACTED:email]"}],"stop_reason":"end","usage":{"n":#}}', 1))
def q_blocks_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = '{"role":"assistant","content":[{"type":"text","text":"u#@example.invalid"}],"stop_reason":"end","usage":{"n":#}}'
    return _flat(redact_payloads(_payload(spark, sf_dir, text), "text", "anthropic-messages", "response"), "c_custkey")


@query("SELECT c_custkey, 'unsupported_provider_shape' AS error, CASE WHEN c_custkey % 2 = 0 THEN '$.{1}' ELSE '$.messages[0].{0}' END AS path FROM customer")
def q_unknown_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _made(spark, sf_dir, F.when(F.col("c_custkey") % 2 == 0, '{"prompt":"a","what":"u@example.invalid"}').otherwise('{"messages":[{"name":"u@example.invalid"}]}'))
    done = redact_payloads(rows, "text", "openai-compatible", "request")
    return done.select("c_custkey", F.col("redacted.error.code").alias("error"), F.get("redacted.report.warnings", F.lit(0))["path"].alias("path"))


@query("SELECT c_custkey, c_custkey % 2 = 0 AS ok, CASE WHEN c_custkey % 2 = 0 THEN '{\"prompt\":\"[REDACTED:email]\"}' END AS request, CASE WHEN c_custkey % 2 = 0 THEN '{\"choices\":[{\"text\":\"ok\"}]}' END AS response, 1::BIGINT AS n, CASE WHEN c_custkey % 2 = 1 THEN 'max_total_nodes_exceeded' END AS error FROM customer")
def q_call_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.when(F.col("c_custkey") % 2 == 1, ',{"text":"one too many"}').otherwise("")
    rows = read_table(spark, sf_dir, "customer").select("c_custkey", F.lit('{"prompt":"u@example.invalid"}').alias("asked"), F.concat(F.lit('{"choices":[{"text":"ok"}'), more, F.lit("]}")).alias("answered"))
    done = redact_calls(rows, "asked", "answered", "openai-compatible", policy={"limits": {"max_total_nodes": 2}})
    return done.select("c_custkey", "call.ok", "call.request", "call.response", F.col("call.report.total_redactions").alias("n"), F.col("call.error.code").alias("error"))


@query("SELECT event_id, true AS content_omitted, 'streaming_content_omitted' AS warning_code FROM events")
def q_stream_events_omitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omit_stream_events(read_table(spark, sf_dir, "events").select("event_id", "props"), "props")


# ---- telemetry


@query(
    """SELECT c_custkey, 'redacted' AS status, 2::BIGINT AS total, 1::BIGINT AS emails, 1::BIGINT AS custom, CASE WHEN c_custkey % 2 = 0 THEN 'chat' END AS operation,
    CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS latency, CASE WHEN c_acctbal >= 0 THEN c_custkey END AS tokens,
    (c_custkey % 2)::BIGINT + 2 * (c_acctbal < 0)::BIGINT AS n_dropped FROM customer"""
)
def q_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = Options(detectors=(regex_detector("accounts", "custom:account", r"acct-\d+"),))
    rows = _made(spark, sf_dir, "u#@example.invalid acct-#").join(read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_custkey")
    done = redact_text(rows, "text", policy=policy).withColumn("report", F.col("redacted.report"))
    label = F.when(F.col("c_custkey") % 2 == 0, "chat").otherwise("not a label!")
    tokens = F.when(F.col("c_acctbal") >= 0, F.col("c_custkey")).otherwise(F.lit(-1))
    done = map_telemetry(done, inputs={"operationName": label, "latencyMs": F.col("c_acctbal"), "tokenUsage.inputTokens": tokens}, prefix="p")
    t = F.col("telemetry")
    return done.select(
        "c_custkey", t["text"]["p.redaction.status"].alias("status"), t["integer"]["p.redaction.total_count"].alias("total"), t["integer"]["p.redaction.reason_count.email"].alias("emails"), t["integer"]["p.redaction.reason_count.custom"].alias("custom"),
        t["text"]["gen_ai.operation.name"].alias("operation"), t["number"]["p.operation.duration_ms"].alias("latency"), t["integer"]["gen_ai.usage.input_tokens"].alias("tokens"), F.size(t["dropped"]).cast("long").alias("n_dropped"),
    )


@query("SELECT c_custkey, 'overlapping_detection' AS codes, 'failed' AS status FROM customer")
def q_telemetry_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = redact_text(_made(spark, sf_dir, "Bearer tok", "en_example_# https://u#@example.invalid/x"), "text").withColumn("report", F.col("redacted.report"))
    done = map_telemetry(done, prefix="p")
    return done.select("c_custkey", F.concat_ws(",", "telemetry.warning_codes").alias("codes"), F.col("telemetry.text")["p.redaction.status"].alias("status"))


_LABEL_SQL = "regexp_full_match({0}, '[A-Za-z0-9][A-Za-z0-9._:-]{{0,127}}') AND NOT regexp_full_match({0}, '(?i:npm_|token_)[A-Za-z0-9_-]{{8,}}') AND NOT regexp_full_match({0}, '(?:sk|pk)-(?:proj-)?[A-Za-z0-9_-]{{8,}}')"


@query("WITH l AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_name WHEN 1 THEN 'ToKen_abcdefg' || s_suppkey WHEN 2 THEN 'sk-abcdefgh' || s_suppkey ELSE 'gpt.' || s_suppkey END AS label FROM supplier) SELECT s_suppkey, " + _LABEL_SQL.format("label") + " AS safe FROM l")
def q_safe_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    label = F.when(F.col("s_suppkey") % 4 == 0, F.col("s_name")).when(F.col("s_suppkey") % 4 == 1, F.concat(F.lit("ToKen_abcdefg"), key)).when(F.col("s_suppkey") % 4 == 2, F.concat(F.lit("sk-abcdefgh"), key)).otherwise(F.concat(F.lit("gpt."), key))
    return read_table(spark, sf_dir, "supplier").select("s_suppkey", safe_label(label).alias("safe"))


@query("SELECT c_custkey, 'op-' || c_custkey AS operation, 'attemptId' AS dropped FROM customer")
def q_report_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    done = report_context(read_table(spark, sf_dir, "customer"), {"operationId": F.concat(F.lit("op-"), key), "attemptId": F.concat(F.lit("u@"), key)})
    return done.select("c_custkey", F.col("report_context.operationId").alias("operation"), F.concat_ws(",", "report_context.droppedContextKeys").alias("dropped"))


def _refuse(report: dict, context: dict) -> None:
    if report["total_redactions"] > 1:
        raise RuntimeError


@query("SELECT c_custkey, true AS ok, 1 + (c_custkey % 2)::BIGINT AS n, CASE WHEN c_custkey % 2 = 1 THEN 'report_callback_failed' ELSE '' END AS codes, NULL::VARCHAR AS error FROM customer")
def q_call_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "customer").select("c_custkey", F.lit('{"prompt":"u@example.invalid"}').alias("asked"), F.when(F.col("c_custkey") % 2 == 1, '{"choices":[{"text":"Bearer abcdefgh"}]}').alias("answered"))
    done = with_redacted_telemetry(rows, "openai-compatible", "asked", "answered", on_report=_refuse, prefix="p")
    return done.select("c_custkey", "ok", F.col("telemetry.integer")["p.redaction.total_count"].alias("n"), F.concat_ws(",", "telemetry.warning_codes").alias("codes"), F.col("error.code").alias("error"))


# ---- streams


@query(r"""WITH w AS (SELECT conv_id, turn, text, regexp_extract(text, '(?s)^(.*\s)[^\s]*$', 1) AS head FROM conversations),
s AS (SELECT *, regexp_extract(rtrim(head, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '(?:^|[^A-Za-z0-9_])((?i:Bearer|Token|Basic))$', 1) AS scheme, rtrim(head, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cut FROM w)
SELECT conv_id, turn, CASE WHEN scheme <> '' THEN length(cut) - length(scheme) ELSE length(head) END::INT AS flush FROM s""")
def q_flush_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.udf(flush_index, "int", useArrow=True)("text").alias("flush"))


def _chunks(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """documents as streams of chunks with a closing row each."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("stream_id"), "text")
    pieces = docs.select("stream_id", F.posexplode(F.sequence(F.lit(0), F.length("text"), F.lit(size))).alias("seq", "at"), "text")
    chunks = pieces.select("stream_id", "seq", F.expr(f"substring(text, at + 1, {size})").alias("chunk"), F.lit(False).alias("is_close"))
    return chunks.unionByName(docs.select("stream_id", F.lit(1 << 30).alias("seq"), F.lit("").alias("chunk"), F.lit(True).alias("is_close")))


_STREAM_SQL = f"SELECT doc_id::VARCHAR AS stream_id, sha256(regexp_replace(text, '{EMAIL}', '[REDACTED:email]', 'g')) AS content_sha256, true AS ok FROM documents"


def _joined(done: DataFrame) -> DataFrame:
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "content"))), lambda x: x["content"]), "")
    return done.groupBy("stream_id").agg(F.sha2(content, 256).alias("content_sha256"), F.min("ok").alias("ok"))


@query(_STREAM_SQL)
def q_rolling_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(redact_stored_streams(_chunks(spark, sf_dir, 512), "rolling"))


@query(_STREAM_SQL)
def q_buffered_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(redact_stored_streams(_chunks(spark, sf_dir, 2048), "buffered", policy=Options(limits=WHOLE)))


# ---- tooling


@query("SELECT o_orderstatus, quantile_disc(o_totalprice, 0.5) AS median_ms, quantile_disc(o_totalprice, 0.95) AS p95_ms FROM orders GROUP BY 1")
def q_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_rank(read_table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_totalprice", {"median_ms": 0.5, "p95_ms": 0.95})


@query(
    """WITH m AS (SELECT n_name AS name, n_regionkey, CASE n_nationkey % 4 WHEN 0 THEN NULL ELSE n_nationkey * 2.0 END AS median_ms FROM nation WHERE n_nationkey % 5 <> 0)
    SELECT n.n_name AS name, CASE WHEN m.name IS NULL THEN 'missing' WHEN m.median_ms IS NULL THEN 'incomplete' WHEN m.median_ms > 20 THEN 'exceeded' ELSE 'ok' END AS verdict FROM nation n LEFT JOIN m ON n.n_name = m.name"""
)
def q_budget_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation")
    budgets = nation.select(F.col("n_name").alias("name"), F.lit(20.0).alias("median_ms"))
    key = F.col("n_nationkey")
    results = nation.where(key % 5 != 0).select(F.col("n_name").alias("name"), F.when(key % 4 != 0, key * 2.0).alias("median_ms"))
    return evaluate_budgets(budgets, results, metrics=("median_ms",)).select("name", "verdict")


_HEX = "md5(c_custkey::VARCHAR) || substr(md5(c_custkey::VARCHAR), 1, 8)"


def _hex(key: Column) -> Column:
    return F.concat(F.md5(key.cast("string")), F.substring(F.md5(key.cast("string")), 1, 8))


@query(f"SELECT c_custkey, 'veilspark/performance-result/v1' AS schema_version, '2026-07-18T00:00:00.000Z' AS generated_at, CASE WHEN c_custkey % 3 <> 0 THEN {_HEX} END AS commit, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey::VARCHAR END AS run_id, CASE WHEN c_custkey % 5 > 1 THEN c_custkey % 5 END AS attempt FROM customer")
def q_performance_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, key = read_table(spark, sf_dir, "customer").select("c_custkey"), F.col("c_custkey")
    commit = F.when(key % 3 == 0, F.lit("main")).otherwise(F.upper(_hex(key)))
    run = F.when(key % 4 == 0, F.concat(F.lit("0"), key.cast("string"))).otherwise(key.cast("string"))
    attempt = F.when(key % 5 == 1, "9" * 16).otherwise((key % 5).cast("string"))
    done = performance_result(rows, F.lit("2026-07-18 00:00:00").cast("timestamp"), commit, run, attempt)
    return done.select("c_custkey", "schema_version", "generated_at", "source.commit", "source.run_id", F.col("source.run_attempt").alias("attempt"))


@query("SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'artifacts/a' || c_custkey || '.json' WHEN 1 THEN 'artifacts/c.JSON' END AS path FROM customer")
def q_output_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    cases = ["artifacts/a#.json", "./artifacts/b/../x/.././c.JSON", "artifacts/../x#.json", "/artifacts/#.json", "artifacts/#.txt", "../artifacts/#.json", "artifacts"]
    path = F.element_at(F.array(*[F.replace(F.lit(c), F.lit("#"), key.cast("string")) for c in cases]), (key % 7 + 1).cast("int"))
    return read_table(spark, sf_dir, "customer").select("c_custkey", output_path(path).alias("path"))


@query("SELECT c_custkey, c_custkey % 3 = 0 OR c_acctbal < 0 AS changed FROM customer")
def q_contract_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, one = F.col("c_custkey"), F.lit("email").alias("id")
    expected = F.struct(F.struct(one, key.alias("n")).alias("detector"), F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2)).alias("tokens"), F.array(F.lit("x")).alias("codes"))
    actual = F.struct(F.array(F.when(F.col("c_acctbal") < 0, "y").otherwise("x")).alias("codes"), F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(1)).alias("tokens"), F.struct((key + F.when(key % 3 == 0, 1).otherwise(0)).alias("n"), one).alias("detector"))
    return contract_changed(read_table(spark, sf_dir, "customer").select("c_custkey", expected.alias("expected"), actual.alias("actual")), "expected", "actual").select("c_custkey", "changed")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN sha256('a ' || c_custkey || chr(10) || 'b') END AS digest FROM customer")
def q_inventory_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _made(spark, sf_dir, "head <!-- from -->\r\n\u00a0 a #\r\nb \ufeff", F.when(F.col("c_custkey") % 2 == 0, "<!-- to --> tail").otherwise(""))
    return rows.select("c_custkey", inventory_sha256(F.col("text"), "<!-- from -->", "<!-- to -->").alias("digest"))


@query("WITH v AS (SELECT c_custkey, c_custkey % 12 AS a, c_custkey % 7 AS b, c_custkey % 3 AS c FROM customer) SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN (a, b, c) < (10, 3, 1) THEN -1 WHEN (a, b, c) > (10, 3, 1) THEN 1 ELSE 0 END::INT AS compared FROM v")
def q_version_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    version = F.concat_ws(".", *[(key % n).cast("string") for n in (12, 7, 3)])
    version = F.when(key % 5 == 0, F.concat(version, F.lit("-rc.1"))).otherwise(version)
    return read_table(spark, sf_dir, "customer").select("c_custkey", compare_versions(version, F.lit("10.3.1")).alias("compared"))


@query(f"WITH p AS (SELECT c_custkey, {_HEX} AS pinned FROM customer) SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'current' WHEN 1 THEN 'drift' END AS status, CASE WHEN c_custkey % 3 < 2 THEN 'https://example.invalid/r/compare/' || pinned || '...' || CASE c_custkey % 3 WHEN 0 THEN pinned ELSE repeat('0', 40) END END AS compare_url FROM p")
def q_commit_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    latest = F.when(key % 3 == 0, _hex(key)).when(key % 3 == 1, "0" * 40).otherwise(F.upper(_hex(key)))
    found = read_table(spark, sf_dir, "customer").select("c_custkey", commit_drift(_hex(key), latest, "https://example.invalid/r").alias("d"))
    return found.select("c_custkey", "d.status", "d.compare_url")


# ---- refusals


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 2 THEN NULL ELSE 'unsupported_provider_shape' END AS error, c_custkey % 3 = 2 AS ok FROM customer")
def q_blocks_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey") % 3
    text = F.when(key == 0, '{"max_tokens":1,"messages":[],"what":"u@example.invalid"}').when(key == 1, '{"messages":[{"role":"user","content":[{"type":"image","source":"u@example.invalid"}]}]}').otherwise('{"messages":[{"role":"user","content":[{"type":"text","text":"hi"}]}]}')
    done = redact_payloads(read_table(spark, sf_dir, "customer").select("c_custkey", text.alias("text")), "text", "anthropic-messages", "request")
    return done.select("c_custkey", F.col("redacted.error.code").alias("error"), "redacted.ok")


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'invalid_detection_range' WHEN 1 THEN 'invalid_redaction_reason' END AS error, CASE WHEN c_custkey % 3 < 2 THEN 'own' END AS detector_id, CASE WHEN c_custkey % 3 = 2 THEN 'x[REDACTED:custom:a]' END AS value FROM customer")
def q_detection_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Detector("own", ("custom:a",), lambda text: [("custom:a", 1, 2 + 9 * (text[0] == "r"))] if text[0] != "s" else [("not a reason", 0, 1)])
    text = F.element_at(F.array(F.lit("r1"), F.lit("s1"), F.lit("x1")), (F.col("c_custkey") % 3 + 1).cast("int"))
    done = redact_text(read_table(spark, sf_dir, "customer").select("c_custkey", text.alias("text")), "text", policy=Options(built_ins=(), detectors=(own,)))
    return done.select("c_custkey", F.col("redacted.error.code").alias("error"), "redacted.error.detector_id", "redacted.value")


@query("SELECT c_custkey, 'max_total_detections_exceeded' AS error, CASE WHEN c_custkey % 2 = 0 THEN 'builtin:email' ELSE 'builtin:url' END AS detector_id FROM customer")
def q_detection_limit_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _made(spark, sf_dir, "a@b.cd ", F.when(F.col("c_custkey") % 2 == 0, "e@f.gh").otherwise("https://h.ij/#"))
    done = redact_text(rows, "text", policy=Options(limits=Limits(max_total_detections=1)))
    return done.select("c_custkey", F.col("redacted.error.code").alias("error"), "redacted.error.detector_id")


@query(f"SELECT doc_id::VARCHAR AS stream_id, CASE WHEN {_UNITS} > 1500 THEN 'max_stream_buffer_length_exceeded' END AS error FROM documents")
def q_buffered_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = redact_stored_streams(_chunks(spark, sf_dir, 512), "buffered", policy=Options(limits=Limits(max_stream_buffer_length=1500)))
    return done.groupBy("stream_id").agg(F.max("error_code").alias("error"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
