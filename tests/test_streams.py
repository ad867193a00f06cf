import pytest
from pyspark.sql import functions as F

from veilspark import Limits, redact_live_streams, redact_stored_streams, regex_detector
from veilspark.functions.redact import redact
from veilspark.options import Options
from veilspark.streaming.machines import Buffered, Rolling, flush_index

TOKEN = "tok" + "en_example_value"
SENTENCES = ["Contact user@example.invalid now", f"Use Bearer {TOKEN} today", "See https://example.invalid/private ok", "Key sk" + "_test_abcdef here"]


@pytest.mark.parametrize("kind", [Rolling, Buffered])
@pytest.mark.parametrize("text", SENTENCES)
def test_every_split_gives_the_whole_result(kind, text):
    whole = redact(text, Options())[0]
    for i in range(len(text) + 1):
        machine = kind()
        parts = [machine.push(text[:i]), machine.push(text[i:])]
        if kind is Buffered:
            assert [p["content"] for p in parts] == ["", ""]
        assert "".join(p["content"] for p in [*parts, machine.close()]) == whole


def test_scheme_waits_for_its_token():
    m = Rolling()
    assert [m.push("safe (Bearer ")["content"], m.push("abcdefghij ")["content"], m.close()["content"]] == ["safe (", "Bearer [REDACTED:bearer_token] ", ""]


@pytest.mark.parametrize("text, at", [("", 0), ("abc", 0), ("a b", 2), ("a Bearer ", 2), ("xBearer ", 8), ("Bearer ", 0), ("a  \n", 4), ("a b", 2), ("a\x1cb", 0)])
def test_flush_index(text, at):
    assert flush_index(text) == at


def test_limits_end_a_stream():
    for limits, chunks, code in [({"max_stream_buffer_length": 3}, ["abcd"], "max_stream_buffer_length_exceeded"), ({"max_total_string_length": 5}, ["abc ", "def "], "max_total_string_length_exceeded"), ({"max_detector_runs": 4}, ["a ", "b "], "max_detector_runs_exceeded"), ({"max_total_detections": 1}, ["a@b.cd ", "e@f.gh "], "max_total_detections_exceeded")]:
        m = Rolling({"limits": Limits(**limits)})
        last = [m.push(c) for c in chunks][-1]
        assert last["error"]["code"] == code and last["content"] is None and m.state["buffer"] == "" and m.close()["error"]["code"] == code


def test_closed_streams():
    for kind in (Rolling, Buffered):
        m = kind()
        m.close()
        assert m.push("x")["error"]["code"] == "stream_closed" and m.close()["error"]["code"] == "stream_already_closed" and not m.state["failed"]
        assert kind().push(None)["error"]["code"] == "unsupported_provider_shape"


def test_rolling_takes_built_ins_only():
    for bad in (Options(detectors=(regex_detector("a", "custom:a", "x"),)), Options(built_ins=()), Options(built_ins=("no",))):
        assert Rolling(bad).push("x")["error"]["code"] == "invalid_redaction_options"


def chunks(spark):
    rows = []
    for s, text in enumerate(SENTENCES):
        rows += [(f"s{s}", i, text[i * 5 : i * 5 + 5], False) for i in range(-(-len(text) // 5))] + [(f"s{s}", 99, None, True)]
    return spark.createDataFrame(rows, "stream_id string, seq long, chunk string, is_close boolean")


def joined(frame):
    rows = frame.orderBy("stream_id", "seq").collect()
    out = {}
    for r in rows:
        assert r.ok, r.error_code
        out[r.stream_id] = out.get(r.stream_id, "") + r.content
    return list(out.values())


@pytest.mark.parametrize("kind", ["rolling", "buffered"])
def test_stored_streams(spark, kind):
    assert joined(redact_stored_streams(chunks(spark), kind)) == [redact(t, Options())[0] for t in SENTENCES]


@pytest.mark.parametrize("limits", [{}, {"max_stream_buffer_length": 7}, {"max_total_string_length": 9}])
def test_chunks_held_at_once_are_held_alike(limits):
    for texts in (["a", "bc", "", "d" * 5, "e f", "gh"], ["é😀", "x"] * 4, [" ", "ab", None, "c"]):
        one, many = Rolling({"limits": limits}), Rolling({"limits": limits})
        expected = [one.push(t) for t in texts]
        k = 0
        while k < len(texts):
            if found := many.hold(texts[k:]):
                assert [(r["ok"], r["content"], r["retained"]) for r in expected[k : k + len(found)]] == [(True, "", n) for n in found]
                k += len(found)
            else:
                assert many.push(texts[k])["ok"] == expected[k]["ok"]
                k += 1
        assert {**one.state, "ms": 0} == {**many.state, "ms": 0}


def test_live_streams(spark, tmp_path):
    table, schema = chunks(spark), "stream_id string, seq long, chunk string, is_close boolean"
    for low, high in [(0, 3), (3, 200)]:
        table.where((F.col("seq") >= low) & (F.col("seq") < high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = redact_live_streams(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "rolling")
    query = live.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    assert joined(spark.read.parquet(str(tmp_path / "out"))) == [redact(t, Options())[0] for t in SENTENCES]
