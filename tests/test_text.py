import random
import re
import time

import pytest

from veilspark import Detector, Limits, Options, Refused, built_in_detectors, create_profile, default_token, redact_text, regex_detector
from veilspark.functions.labels import is_safe_label, safe_label
from veilspark.functions.redact import built_in_spans, redact, units
from veilspark.operators.text import result_row

# Credential-shaped strings are put together here, so that none lies in the file.
KEY, AWS, HUB, GOOGLE, SLACK = "sk" + "_test_abcdef", "AK" + "IA" + "Q" * 16, "gh" + "p_" + "a1" * 18, "AI" + "za" + "b" * 35, "xo" + "xb-" + "1" * 12
TOKEN = "tok" + "en_example_value"


def one(text, **options):
    return redact(text, Options(**options))


def custom(*spans):
    return Detector("own", ("custom:short", "custom:long"), lambda _: list(spans))


def test_four_categories():
    text = f"Contact user@example.invalid using Bearer {TOKEN} and {KEY} at https://example.invalid/private."
    value, report, refused = one(text)
    assert refused is None and value == "Contact [REDACTED:email] using Bearer [REDACTED:bearer_token] and [REDACTED:api_key] at [REDACTED:url]"
    assert report.counts == {"email": 1, "bearer_token": 1, "api_key": 1, "url": 1} and report.runs == 4 and report.nodes == 1
    assert [w["reason"] for w in report.warnings] == ["api_key"]


def test_key_shapes():
    value, report, _ = one(f"{AWS} {HUB} {GOOGLE} {SLACK} Basic {TOKEN}", built_ins=("bearer_token", "api_key"))
    assert report.counts == {"api_key": 4, "bearer_token": 1}


@pytest.mark.parametrize("text", ["Basic training", "bASIC training"])
def test_prose_after_a_scheme_is_redacted(text):
    assert one(text)[0].endswith("[REDACTED:bearer_token]")


def test_same_start_takes_the_longer():
    value, report, _ = one("Value acct_example_value done", built_ins=(), detectors=(custom(("custom:short", 6, 12), ("custom:long", 6, 24)),))
    assert value == "Value [REDACTED:custom:long] done" and report.warnings == [{"code": "overlapping_detection", "reason": "custom:short"}]


def test_partial_overlap_fails_closed():
    value, report, refused = one("x" * 30, built_ins=(), detectors=(custom(("custom:short", 0, 10), ("custom:long", 5, 20)),))
    assert value is None and refused.code == "overlapping_detection" and report.total == 0 and report.failed


@pytest.mark.parametrize("span, ok", [((7, 9), True), ((7, 8), False), ((0, 99), False), ((3, 3), False), ((-1, 2), False), ((1.0, 2), False)])
def test_ranges_are_utf16_and_keep_pairs_whole(span, ok):
    value, _, refused = one("Prefix \U0001f600 suffix", built_ins=(), detectors=(custom(("custom:short", *span)),))
    assert (refused is None) == ok
    assert value == "Prefix [REDACTED:custom:short] suffix" if ok else refused.code == "invalid_detection_range"


def test_detector_failures_are_coded_and_carry_no_content():
    def broken(text):
        raise ValueError(text)

    for scan, code in [(broken, "detector_failed"), (lambda _: "no list", "detector_failed"), (lambda _: [("nope nope", 0, 1)], "invalid_redaction_reason"), (lambda _: [("email", 0, 1)] * 3, "max_total_detections_exceeded")]:
        value, report, refused = one("secret", built_ins=(), detectors=(Detector("own", ("custom:x",), scan),), limits=Limits(max_total_detections=2))
        assert value is None and refused.code == code and refused.detector_id == "own" and "secret" not in str(result_row(value, report, refused))


def test_guards_come_in_order():
    assert one(None)[2].code == "invalid_redaction_input"
    assert one("xx", limits=Limits(max_string_length=1, max_detectors=0))[2].code == "max_string_length_exceeded"
    assert one("xx", limits=Limits(max_detectors=0))[2].code == "max_detectors_exceeded"
    assert one("xx", limits=Limits(max_total_duration_ms=0, max_string_length=1))[2].code == "max_total_duration_exceeded"
    assert one("a@b.cd", replacement=lambda r: 1 / 0)[2].code == "replacement_failed"


def test_profiles():
    assert create_profile(built_ins=("email",)).options.names == ("email",)
    detector = regex_detector("a", "custom:a", "x")
    for bad in [{"built_ins": ()}, {"built_ins": ("email", "email")}, {"detectors": (detector, detector)}, {"limits": Limits(max_detectors=1)}, {"what": 1}, {"limits": Limits(max_string_length=float("nan"))}, {"built_ins": ("no",)}, {"replacement": 3}]:
        with pytest.raises(Refused) as refused:
            create_profile(**bad)
        assert refused.value.code == "invalid_redaction_profile"


def test_built_in_detectors_stand_for_themselves():
    own = built_in_detectors()
    assert [(d.id, d.reasons) for d in own] == [(f"builtin:{n}", (n,)) for n in ("email", "bearer_token", "api_key", "url")]
    for text in [*random_texts(300, 5), "\U0001f600 u@example.invalid " + KEY]:
        (a, r1, e1), (b, r2, e2) = one(text), one(text, built_ins=(), detectors=own)
        assert a == b and r1.counts == r2.counts and (e1 and e1.code) == (e2 and e2.code)
    with pytest.raises(Refused):
        built_in_detectors(["no"])


def test_tokens():
    assert default_token("email") == "[REDACTED:email]" and default_token("custom:a-b") == "[REDACTED:custom:a-b]" and default_token("x y") == "[REDACTED:custom]"


LABELS = {"gpt-4o": True, "chat": True, "a" * 129: False, "-x": False, "x y": False, "x\n": False, "eyJ" + "abcd.efgh.ijklmnop": False, "gl" + "pat-" + "a" * 8: False, "py" + "pi-" + "a" * 85: False, "NP" + "M_abcdefgh": False, "AS" + "IA" + "1" * 12: False}


def test_labels(spark):
    frame = spark.createDataFrame([(k, v) for k, v in LABELS.items()], "label string, good boolean")
    assert all(r.good == r.own == is_safe_label(r.label) for r in frame.withColumn("own", safe_label(frame.label)).collect())


def random_texts(n, seed):
    rng = random.Random(seed)
    parts = ["Bearer ", "token ", "BASIC ", "tok" + "en_abc123", "sk" + "_test_abcdef", "user@example.invalid", "u@h.tld", "https://u@h.tld/x", "http://a.b/c?d", " ", "  ", "é", "\U0001f600", " ", " ", "﻿", "\x1c", ".", "@", "a.b", "-", "_", AWS, '"', "<", "x@y..z", "a@b.c.", "K", "ſ", "\n", "_user@x.yz", "a@b.c-"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(n)]


@pytest.mark.parametrize("options", [Options(), Options(limits=Limits(max_string_length=40, max_total_detections=2)), Options(built_ins=("url", "email"), replacement={"url": "U"}), Options(limits=Limits(max_detectors=2)), Options(built_ins=())], ids=range(5))
def test_jvm_path_equals_the_python_model(spark, options):
    texts = [*random_texts(1500, 3), "", None]
    rows = redact_text(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t", "r", options).collect()
    for row in rows:
        own, model = row.r.asDict(True), result_row(*redact(texts[row.i], options))
        for side in (own, model):
            for name in ("duration_ms", "detector_duration_ms"):
                (side["report"]["timings"] or {}).pop(name, None)
        assert own == model, texts[row.i]


def test_long_inputs_do_not_harm_the_jvm(spark):
    texts = ["a@" + "b." * 30000 + "c", ".a" * 500, "a@" + "b-" * 3000, "Bearer " + "x" * 60000, "https://" + "é" * 60000]
    rows = redact_text(spark.createDataFrame([(t,) for t in texts], "t string"), "t", "r").select("r.value").collect()
    assert [r.value for r in rows] == [redact(t, Options())[0] for t in texts]


#: One text for each alternative of the key grammar, each with only the characters that its shape asks for.
KEY_SHAPES = ["sk" + "_abcdef", "pk" + "_test_abcdef", "api" + "_a12345", "key" + "_A12345", "token" + "_abcdef", "sk" + "-" + "a" * 12, "sk" + "-proj-" + "a" * 12, AWS, *("gh" + c + "_" + "a1" * 18 for c in "pousr"), GOOGLE, *("xo" + "x" + c + "-" + "1" * 10 for c in "aboprst")]
SCHEMES = [f"{s} abcdef" for s in ("Bearer", "Token", "Basic", "bearer", "TOKEN", "bAsIc")]


@pytest.mark.parametrize("name, secrets", [("api_key", KEY_SHAPES), ("bearer_token", SCHEMES)])
def test_each_alternative_is_found_alone_on_both_paths(spark, name, secrets):
    texts = [f(s) for s in secrets for f in (lambda s: s, lambda s: f"key {s} end", lambda s: f"({s}), \u00e9{s}")]
    options = Options(built_ins=(name,))
    rows = redact_text(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t", "r", options).select("i", "r.value", "r.report.total_redactions").collect()
    for row in rows:
        value, report, _ = redact(texts[row.i], options)
        assert row.total_redactions == report.total == (2 if texts[row.i].startswith("(") else 1) and row.value == value, texts[row.i]


def test_email_search_is_that_of_the_plain_grammar():
    """The plain grammar tries every boundary; the linear search must give the same spans."""
    plain = re.compile(r"\b[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+\b", re.A)
    rng = random.Random(8)
    for _ in range(20_000):
        text = "".join(rng.choice("ab.-_!@@@.x9 \u00e9") for _ in range(rng.randint(1, 24)))
        assert built_in_spans("email", text) == [m.span() for m in plain.finditer(text)], text


def test_hostile_emails_take_linear_time(spark):
    texts = [unit * (128_000 // len(unit)) + "@" for unit in (".a", "a", "a@b-", "a@b.", "!a.")] + ["a@b" + ".c_" * 42_000]
    began = time.perf_counter()
    rows = redact_text(spark.createDataFrame([(t,) for t in texts], "t string"), "t", "r", Options(built_ins=("email",))).select("r.value").collect()
    model = [redact(t, Options(built_ins=("email",)))[0] for t in texts]
    assert [r.value for r in rows] == model and time.perf_counter() - began < 30


def test_no_canary_in_any_result():
    rng = random.Random(4)
    for text in random_texts(500, 9):
        at = rng.randint(0, len(text))
        value, report, refused = one(f"{text[:at]} canary77@example.invalid {text[at:]}")
        assert "canary77" not in str(result_row(value, report, refused)) and (value is None) == (refused is not None)


def test_units():
    assert units("a\U0001f600") == 3 and units("é") == 1
