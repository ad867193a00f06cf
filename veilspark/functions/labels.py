"""Labels that may leave with telemetry: short plain words that do not look like credentials."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shape of a label, and credential shapes it must not have; True: in either case.
LABEL = r"[A-Za-z0-9][A-Za-z0-9._:-]{0,127}"
CREDENTIALS = (
    (r"(?:sk|pk)-(?:proj-)?[A-Za-z0-9_-]{8,}", False),
    (r"(?:gh[pousr]_|github_pat_)[A-Za-z0-9_]{8,}", True),
    (r"glpat-[A-Za-z0-9_-]{8,}", True),
    (r"pypi-[A-Za-z0-9_-]{85,}", True),
    (r"xox[baprs]-[A-Za-z0-9-]{8,}", True),
    (r"(?:AKIA|ASIA)[A-Z0-9]{12,}", False),
    (r"(?:npm_|token_)[A-Za-z0-9_-]{8,}", True),
    (r"eyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{8,}", False),
)
_LABEL = re.compile(LABEL)
_CREDENTIALS = [re.compile(p, re.A | (re.I if either else 0)) for p, either in CREDENTIALS]


def is_safe_label(value: object) -> bool:
    return isinstance(value, str) and _LABEL.fullmatch(value) is not None and not any(p.fullmatch(value) for p in _CREDENTIALS)


def safe_label(value: Column) -> Column:
    """Whether a string column is a safe label; null for null."""
    found = value.rlike(rf"\A{LABEL}\z")
    for pattern, either in CREDENTIALS:
        found = found & ~value.rlike(rf"\A{'(?i)' if either else ''}{pattern}\z")
    return found
