"""Redaction policy: detectors, limits, replacement tokens, and validated profiles."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, fields, replace
from functools import cached_property

from .functions.labels import is_safe_label

# Built-in detectors in their order, and what a custom reason may look like.
BUILT_IN = ("email", "bearer_token", "api_key", "url")
CUSTOM_REASON = re.compile(r"custom:[A-Za-z0-9][A-Za-z0-9_-]{0,63}")

#: Limits where none is given.
DEFAULTS = {
    "max_string_length": 128_000,
    "max_total_string_length": 1_000_000,
    "max_object_depth": 16,
    "max_object_keys": 1_000,
    "max_array_length": 1_000,
    "max_total_nodes": 10_000,
    "max_total_detections": 10_000,
    "max_detector_runs": 50_000,
    "max_stream_buffer_length": 65_536,
}


def built_in_id(name: str) -> str:
    """The id under which a built-in detector is named in reports and errors."""
    return f"builtin:{name}"


class Refused(Exception):
    """A coded failure. It never carries content."""

    def __init__(self, code: str, detector_id: str | None = None, path: str | None = None, message: str | None = None, reason: str | None = None) -> None:
        super().__init__(code)
        self.code, self.detector_id, self.path, self.message, self.reason = code, detector_id, path, message, reason


def is_safe_reason(reason: object) -> bool:
    return isinstance(reason, str) and (reason in BUILT_IN or CUSTOM_REASON.fullmatch(reason) is not None)


def safe_reason(reason: str) -> str:
    """The reason as it may show in a token: itself if it is safe, else ``custom``."""
    return reason if is_safe_reason(reason) else "custom"


def default_token(reason: str) -> str:
    return f"[REDACTED:{safe_reason(reason)}]"


@dataclass(frozen=True)
class Limits:
    max_string_length: float | None = None
    max_total_string_length: float | None = None
    max_object_depth: float | None = None
    max_object_keys: float | None = None
    max_array_length: float | None = None
    max_total_nodes: float | None = None
    max_total_detections: float | None = None
    max_detectors: float | None = None
    max_detector_runs: float | None = None
    max_detector_duration_ms: float | None = None
    max_total_duration_ms: float | None = None
    max_stream_buffer_length: float | None = None

    def get(self, name: str) -> float:
        """The limit, its default, or infinity."""
        own = getattr(self, name)
        return DEFAULTS.get(name, math.inf) if own is None else own

    def lowered(self, **to: float) -> Limits:
        return replace(self, **{k: max(0, v) for k, v in to.items() if v != math.inf})

    @cached_property
    def valid(self) -> bool:
        values = [getattr(self, f.name) for f in fields(self)]
        return all(v is None or (isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) and v >= 0) for v in values)


Found = tuple[str, int, int]  # reason, begin and end in UTF-16 units


@dataclass(frozen=True)
class Detector:
    """A source of spans: ``scan(text)`` gives (reason, start, end) in UTF-16 code units, end exclusive."""

    id: str
    reasons: tuple[str, ...]
    scan: Callable[[str], Iterable[Found]]


@dataclass(frozen=True)
class Options:
    """``built_ins`` None stands for all, () for none; ``replacement`` is a function or a mapping of reasons to tokens."""

    built_ins: tuple[str, ...] | None = None
    detectors: tuple[Detector, ...] = ()
    limits: Limits = field(default_factory=Limits)
    replacement: Callable[[str], str] | Mapping[str, str] | None = None

    @cached_property
    def names(self) -> tuple[str, ...]:
        return BUILT_IN if self.built_ins is None else tuple(self.built_ins)

    @cached_property
    def detector_count(self) -> int:
        return len(self.names) + len(self.detectors)

    def problem(self) -> Refused | None:
        """What is wrong with the options, in the order in which an operation would meet it."""
        if not isinstance(self.limits, Limits) or not self.limits.valid:
            return Refused("invalid_redaction_options")
        if self.replacement is not None and not callable(self.replacement) and not isinstance(self.replacement, Mapping):
            return Refused("invalid_redaction_options")
        return None

    def detector_problem(self) -> Refused | None:
        """What is wrong with the detectors; found after an input's own guards."""
        return self._detector_problem

    @cached_property
    def _detector_problem(self) -> Refused | None:
        if any(name not in BUILT_IN for name in self.names):
            return Refused("invalid_redaction_options", message="Redaction options included an unknown built-in detector.")
        for d in self.detectors:
            if not isinstance(d, Detector) or not callable(d.scan):
                return Refused("invalid_redaction_options", message="Redaction options included an invalid detector.")
            if not is_safe_label(d.id):
                return Refused("invalid_redaction_options", message="Redaction options included an unsafe detector id.")
            if not all(map(is_safe_reason, d.reasons)):
                return Refused("invalid_redaction_reason", d.id, message="A detector declared an unsafe redaction reason.")
        return None

    def token(self, reason: str) -> str:
        """The replacement of a span; raises where the policy has none."""
        if self.replacement is None:
            return default_token(reason)
        made = self.replacement[reason] if isinstance(self.replacement, Mapping) else self.replacement(reason)
        return made if isinstance(made, str) else str(made)


@dataclass(frozen=True)
class Profile:
    """Options that were checked once and can be reused; made by :func:`create_profile`."""

    options: Options


def create_profile(**config: object) -> Profile:
    """A profile, or ``Refused('invalid_redaction_profile')``: it needs detectors with ids and reasons, each id once."""
    try:
        options = Options(**{**config, **({"detectors": tuple(config["detectors"])} if "detectors" in config else {})})
        ids = [*options.names, *(d.id for d in options.detectors)]
        good = not options.problem() and not options.detector_problem() and ids and len(set(ids)) == len(ids) and all(d.reasons for d in options.detectors)
        if good and len(ids) <= options.limits.get("max_detectors"):
            return Profile(options)
    except (TypeError, AttributeError):
        pass
    raise Refused("invalid_redaction_profile")


def resolve(policy: Options | Profile | Mapping | None) -> Options:
    """Options from options, a profile or a mapping of option names; anything else is refused."""
    if policy is None:
        return Options()
    if isinstance(policy, Profile):
        return policy.options
    if isinstance(policy, Mapping):
        known = {f.name for f in fields(Options)}
        if not set(policy) <= known:
            raise Refused("invalid_redaction_options")
        limits = policy.get("limits", Limits())
        if isinstance(limits, Mapping):
            if not set(limits) <= {f.name for f in fields(Limits)}:
                raise Refused("invalid_redaction_options")
            limits = Limits(**limits)
        policy = Options(**{**policy, "limits": limits})
    if not isinstance(policy, Options):
        raise Refused("invalid_redaction_options")
    if problem := policy.problem():
        raise problem
    return policy
