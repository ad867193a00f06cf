"""Detection, overlap resolution and replacement for one text, in Python.

Used inside Arrow UDFs where a policy has Python parts or a payload is dynamic, and as the model that
the JVM-side path is tested against.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

from ..options import BUILT_IN, Detector, Found, Options, Refused, built_in_id, is_safe_reason
from .patterns import ANY, EMAIL_NEXT, PYTHON


def units(text: str) -> int:
    """Length in UTF-16 code units."""
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


@dataclass
class Report:
    """What an operation found; associative under :meth:`add`."""

    counts: Counter = field(default_factory=Counter)
    warnings: list[dict] = field(default_factory=list)
    failed: bool = False
    timed: bool = False
    duration_ms: float = 0.0
    detector_duration_ms: float = 0.0
    runs: int = 0
    nodes: int = 0
    code_units: int = 0

    @property
    def total(self) -> int:
        return sum(self.counts.values())

    def warn(self, code: str, **more: str | None) -> None:
        self.warnings.append({"code": code, **{k: v for k, v in more.items() if v is not None}})

    def add(self, other: Report) -> None:
        self.counts += other.counts
        self.warnings += other.warnings
        self.failed |= other.failed
        self.timed |= other.timed
        for name in ("duration_ms", "detector_duration_ms", "runs", "nodes", "code_units"):
            setattr(self, name, getattr(self, name) + getattr(other, name))

    def row(self) -> dict:
        timings = {"duration_ms": self.duration_ms, "detector_duration_ms": self.detector_duration_ms, "detector_runs": self.runs, "nodes_visited": self.nodes, "string_code_units": self.code_units}
        return {
            "status": "failed" if self.failed else "redacted" if self.total else "unchanged",
            "total_redactions": self.total,
            "counts_by_reason": dict(self.counts),
            "warnings": [{k: w.get(k) for k in ("code", "detector_id", "reason", "path")} for w in self.warnings],
            "timings": timings if self.timed else None,
        }


def regex_detector(id: str, reason: str, pattern: str | re.Pattern, group: int | str = 0, choose=None) -> Detector:
    """A detector of a pattern's matches; empty ones are skipped. ``choose(match)`` may give (reason, start, end) in
    code points or None instead of the group's span."""
    compiled = re.compile(pattern) if isinstance(pattern, str) else pattern

    def scan(text: str) -> list[Found]:
        places = _utf16_places(text)
        found = []
        for m in compiled.finditer(text):
            if m.end() > m.start():
                span = choose(m) if choose else (reason, *m.span(group))
                if span is not None:
                    found.append((span[0], places(span[1]), places(span[2])))
        return found

    return Detector(id, (reason,), scan)


def _utf16_places(text: str):
    """From code points to UTF-16 units."""
    if len(text) == units(text):
        return lambda i: i
    at, places = 0, []
    for c in text:
        places.append(at)
        at += 2 if ord(c) > 0xFFFF else 1
    places.append(at)
    return lambda i: places[i]


def built_in_spans(name: str, text: str) -> list[tuple[int, int]]:
    pattern, group = PYTHON[name]
    if name != "email":
        return [m.span(group) for m in pattern.finditer(text)]
    found: list[tuple[int, int]] = []
    if "@" in text:
        at = 0
        while m := (found and EMAIL_NEXT.match(text, at)) or pattern.search(text, at):
            found.append((at if m.re is EMAIL_NEXT else m.start(group), m.end()))
            at = m.end()
    return found


def built_in_detectors(names: Iterable[str] = BUILT_IN) -> tuple[Detector, ...]:
    """The built-in detectors as detectors of their own, for policies that name their order or part of them."""

    def made(name: str) -> Detector:
        def scan(text: str) -> list[Found]:
            places = _utf16_places(text)
            return [(name, places(a), places(b)) for a, b in built_in_spans(name, text)]

        return Detector(built_in_id(name), (name,), scan)

    names = tuple(names)
    if any(n not in BUILT_IN for n in names):
        raise Refused("invalid_redaction_options", message="Redaction options included an unknown built-in detector.")
    return tuple(made(n) for n in names)


def _custom_spans(detector: Detector, text: str, most: float) -> list[tuple[str, int, int]]:
    """A custom detector's spans in code points, each checked."""
    try:
        output = detector.scan(text)
        if not isinstance(output, (list, tuple)):
            raise TypeError
        if len(output) > most:
            raise Refused("max_total_detections_exceeded", detector.id)
        found = [(item[0], item[1], item[2]) for item in output]
    except Refused:
        raise
    except Exception:  # whatever a detector raises must not leave with content
        raise Refused("detector_failed", detector.id) from None
    size = units(text)
    back = None
    if size != len(text):
        place = _utf16_places(text)
        back = {place(i): i for i in range(len(text) + 1)}
    spans = []
    for reason, start, end in found:
        whole = all(isinstance(x, int) and not isinstance(x, bool) for x in (start, end))
        if not whole or not 0 <= start < end <= size or (back is not None and (start not in back or end not in back)):
            raise Refused("invalid_detection_range", detector.id, reason=reason if is_safe_reason(reason) else None)
        if not is_safe_reason(reason):
            raise Refused("invalid_redaction_reason", detector.id)
        spans.append((reason, start, end) if back is None else (reason, back[start], back[end]))
    return spans


def resolve_overlaps(spans: Iterable[tuple[str, int, int]], report: Report) -> list[tuple[str, int, int]]:
    """Disjoint spans: of several with one start the longest (then the first) stays; any other overlap is refused."""
    chosen: list[tuple[str, int, int]] = []
    for span in sorted(spans, key=lambda s: (s[1], -s[2])):
        if chosen and span[1] < chosen[-1][2]:
            if span[1] != chosen[-1][1]:
                raise Refused("overlapping_detection", reason=span[0])
            report.warn("overlapping_detection", reason=span[0])
        else:
            chosen.append(span)
    return chosen


def redact(text: object, options: Options, deadline: float | None = None) -> tuple[str | None, Report, Refused | None]:
    """The redacted text, the report, and the failure if there is one; then there is no text.

    Checks come in a fixed order: options, type, deadline, length, detectors, each detector, overlaps, tokens.
    """
    report = Report(timed=True, nodes=1, code_units=units(text) if isinstance(text, str) else 0)
    began = time.monotonic()
    if deadline is None and options.limits.max_total_duration_ms is not None:
        deadline = began + options.limits.max_total_duration_ms / 1000
    try:
        if problem := options.problem():
            report.timed = False
            raise problem
        if not isinstance(text, str):
            raise Refused("invalid_redaction_input")
        _in_time(deadline)
        if report.code_units > options.limits.get("max_string_length"):
            raise Refused("max_string_length_exceeded")
        if problem := options.detector_problem():
            raise problem
        if options.detector_count > options.limits.get("max_detectors"):
            raise Refused("max_detectors_exceeded")
        own = options.limits.max_total_detections
        most = float("inf") if own is None else own
        spans: list[tuple[str, int, int]] = []
        plain = ANY.search(text) is None
        for detector in (*options.names, *options.detectors):
            _in_time(deadline)
            report.runs += 1
            started = time.monotonic()
            try:
                if isinstance(detector, str):
                    found = [] if plain else [(detector, *s) for s in built_in_spans(detector, text)]
                    if len(found) > most - len(spans):
                        raise Refused("max_total_detections_exceeded", built_in_id(detector))
                else:
                    found = _custom_spans(detector, text, most - len(spans))
            finally:
                took = (time.monotonic() - started) * 1000
                report.detector_duration_ms += took
            if options.limits.max_detector_duration_ms is not None and took > options.limits.max_detector_duration_ms:
                raise Refused("detector_timeout", built_in_id(detector) if isinstance(detector, str) else detector.id)
            _in_time(deadline)
            spans += found
        parts, at = [], 0
        chosen = resolve_overlaps(spans, report)
        for reason, start, end in chosen:
            try:
                parts += [text[at:start], options.token(reason)]
            except Exception:
                raise Refused("replacement_failed") from None
            at = end
        report.counts.update(reason for reason, *_ in chosen)
        report.duration_ms = (time.monotonic() - began) * 1000
        return "".join(parts) + text[at:], report, None
    except Refused as refused:
        report.counts.clear()
        report.failed = True
        report.warn(refused.code, detector_id=refused.detector_id, reason=refused.reason)
        report.duration_ms = (time.monotonic() - began) * 1000
        return None, report, refused


def _in_time(deadline: float | None) -> None:
    if deadline is not None and time.monotonic() >= deadline:
        raise Refused("max_total_duration_exceeded")
