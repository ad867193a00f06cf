"""The two stream redactors as state machines over chunks: pure Python, resumable from their state."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import replace

from ..functions.patterns import SPACE
from ..functions.redact import Report, redact, units
from ..operators.text import result_row
from ..options import Options, Profile, Refused, resolve

_SPACES = re.compile(f"[{SPACE}]+")
_SCHEME = re.compile(r"(?:\A|(?<=[^A-Za-z0-9_]))(?:Bearer|Token|Basic)\Z", re.I | re.A)


def flush_index(buffer: str) -> int:
    """How much of the buffer can leave: all up to the end of the last white space, or up to an authorization
    scheme right before it, as its token may still come."""
    last = None
    for last in _SPACES.finditer(buffer):
        pass
    if last is None:
        return 0
    scheme = _SCHEME.search(buffer, 0, last.start())
    return scheme.start() if scheme else last.end()


def failure(code: str, message: str | None = None) -> dict:
    report = Report(failed=True)
    report.warn(code)
    return result_row(None, report, Refused(code, message=message)) | {"content": None, "final": None, "retained": None}


class Machine:
    """One stream. ``state`` is a plain dict that can be stored between chunks."""

    def __init__(self, policy: Options | Profile | Mapping | None = None, state: dict | None = None) -> None:
        self.state = state or {"buffer": "", "held": 0, "closed": False, "failed": None, "units": 0, "redactions": 0, "runs": 0, "ms": 0.0}
        try:
            self.options = self.checked(policy)
        except (Refused, TypeError) as refused:
            self.state["failed"] = [getattr(refused, "code", "invalid_redaction_options"), getattr(refused, "message", None)]

    def checked(self, policy: object) -> Options:
        return resolve(policy)

    @property
    def most(self) -> float:
        return self.options.limits.get("max_stream_buffer_length")

    def fail(self, code: str, message: str | None = None) -> dict:
        self.state |= {"buffer": "", "held": 0, "failed": [code, message]}
        return failure(code, message)

    def push(self, chunk: object) -> dict:
        if self.state["failed"]:
            return failure(*self.state["failed"])
        if self.state["closed"]:
            return failure("stream_closed")  # the stream itself stays as it is
        if not isinstance(chunk, str):
            return self.fail("unsupported_provider_shape", "Streaming redaction chunks must be strings.")
        return self.chunk(chunk)

    def hold(self, chunks: Iterable[str | None]) -> list[int]:
        """Takes those leading chunks at once that are only held, as ``push`` would; the units retained after each."""
        return []

    def close(self) -> dict:
        if self.state["failed"]:
            return failure(*self.state["failed"])
        if self.state["closed"]:
            return failure("stream_already_closed")
        self.state["closed"] = True
        return self.rest()

    def chunk(self, chunk: str) -> dict:
        raise NotImplementedError

    def rest(self) -> dict:
        raise NotImplementedError


def _row(value: str | None, report: Report, refused: Refused | None, final: bool, retained: int) -> dict:
    row = result_row(value, report, refused)
    return row | ({"content": None, "final": None, "retained": None} if refused else {"content": value, "final": final, "retained": retained})


def _empty(*codes: str) -> dict:
    report = Report()
    for code in codes:
        report.warn(code)
    return _row("", report, None, False, 0)


#: Rows of chunks that are only held; made once.
HELD, _OMITTED = _empty(), _empty("streaming_content_omitted")


class Buffered(Machine):
    """Holds all content back until the stream closes."""

    def chunk(self, chunk: str) -> dict:
        if self.state["held"] + units(chunk) > self.most:
            return self.fail("max_stream_buffer_length_exceeded")
        self.state["buffer"] += chunk
        self.state["held"] += units(chunk)
        return _OMITTED | {"retained": self.state["held"]}

    def rest(self) -> dict:
        text = self.state["buffer"]
        self.state |= {"buffer": "", "held": 0}
        return _row(*redact(text, self.options), True, 0)


class Rolling(Machine):
    """Lets content go at white space; built-in detectors only, as their spans are known to end there."""

    def checked(self, policy: object) -> Options:
        options = resolve(policy)
        if options.detectors or not options.names:
            raise Refused("invalid_redaction_options", message="Rolling stream redaction requires at least one built-in detector and does not accept custom detectors or profiles.")
        if problem := options.detector_problem():
            raise problem
        return options

    def chunk(self, chunk: str) -> dict:
        state, limits = self.state, self.options.limits
        state["units"] += units(chunk)
        if limits.max_total_string_length is not None and state["units"] > limits.max_total_string_length:
            return self.fail("max_total_string_length_exceeded")
        # Without white space nothing can leave, so the buffer is not scanned again.
        spaced = _SPACES.search(chunk) is not None
        held = state["held"] + units(chunk)
        if not spaced and held > self.most:
            return self.fail("max_stream_buffer_length_exceeded")
        buffer = state["buffer"] + chunk
        at = flush_index(buffer) if spaced else 0
        if at:
            held = units(buffer[at:])
        if held > self.most:
            return self.fail("max_stream_buffer_length_exceeded")
        state |= {"buffer": buffer, "held": held}
        if not at:
            return HELD | {"retained": held}
        return self.release(buffer[:at], buffer[at:], False)

    def hold(self, chunks: Iterable[str | None]) -> list[int]:
        state, taken, retained = self.state, [], []
        if state["failed"] or state["closed"]:
            return retained
        held, total = state["held"], self.options.limits.max_total_string_length
        most = self.most if total is None else min(self.most, held + total - state["units"])
        for chunk in chunks:
            if chunk is None or _SPACES.search(chunk) or held + (size := units(chunk)) > most:
                break
            held += size
            taken.append(chunk)
            retained.append(held)
        state |= {"buffer": state["buffer"] + "".join(taken), "units": state["units"] + held - state["held"], "held": held}
        return retained

    def rest(self) -> dict:
        return self.release(self.state["buffer"], "", True)

    def release(self, text: str, kept: str, final: bool) -> dict:
        state, limits = self.state, self.options.limits
        if limits.max_detector_runs is not None and state["runs"] + self.options.detector_count > limits.max_detector_runs:
            return self.fail("max_detector_runs_exceeded")
        if limits.max_total_duration_ms is not None and state["ms"] >= limits.max_total_duration_ms:
            return self.fail("max_total_duration_exceeded")
        left = {}
        if limits.max_total_detections is not None:
            left["max_total_detections"] = limits.max_total_detections - state["redactions"]
        if limits.max_total_duration_ms is not None:
            left["max_total_duration_ms"] = limits.max_total_duration_ms - state["ms"]
        value, report, refused = redact(text, replace(self.options, limits=limits.lowered(**left)))
        if refused:
            state |= {"buffer": "", "held": 0, "failed": [refused.code, refused.message]}
            return _row(None, report, refused, final, 0)
        state["redactions"] += report.total
        state["runs"] += report.runs
        state["ms"] += report.duration_ms
        state |= {"buffer": kept, "held": units(kept)}
        return _row(value, report, None, final, units(kept))


MACHINES = {"buffered": Buffered, "rolling": Rolling}
