"""The built-in detectors' grammars, spelled for Python and for the JVM.

Word boundaries and classes are ASCII, white space is the Unicode set of web scripting engines. Each
JVM pattern has two groups, what stays before the secret and the secret, and only one unbounded group
repetition, over single characters, so that long inputs do not exhaust the JVM's stack.

An email's local part ends at the ``@`` behind a run of local characters, so if it can start anywhere in a
run, it can start at the run's first boundary. Only that place is tried, and the end of the match before,
which may lie within a run: each run is read once, whatever it holds.
"""

from __future__ import annotations

import re

# White space, and the grammars below.
SPACE = r"\t\n\x0b\x0c\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_MARKS = r".!#$%&'*+/=?^`{|}~-"
_LOCAL = rf"[A-Za-z0-9_{_MARKS}]"
_KEY = (
    r"(?:sk|pk|api|key|token)_(?:test_)?[A-Za-z0-9][A-Za-z0-9_-]{5,}"
    r"|sk-(?:proj-)?[A-Za-z0-9][A-Za-z0-9_-]{11,}"
    r"|AKIA[0-9A-Z]{16}"
    r"|gh[pousr]_[A-Za-z0-9]{36}"
    r"|AIza[0-9A-Za-z_-]{35}"
    r"|xox[aboprst]-[A-Za-z0-9-]{10,}"
)

_EMAIL = rf"{_LOCAL}++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+\b"
#: Python: an email at the end of the match before it.
EMAIL_NEXT = re.compile(_EMAIL, re.A)
#: Python: (pattern, group of the secret).
PYTHON = {
    "email": (re.compile(rf"(?<!{_LOCAL})[{_MARKS}]*+\b({_EMAIL})", re.A), 1),
    "bearer_token": (re.compile(rf"\b(?:Bearer|Token|Basic)[{SPACE}]+([A-Za-z0-9._~+/=-]{{6,}})\b", re.A | re.I), 1),
    "api_key": (re.compile(rf"\b(?:{_KEY})\b", re.A), 0),
    "url": (re.compile(rf"""\bhttps?://[^{SPACE}"'<>]+""", re.A), 0),
}

_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
# A boundary before a word character is the lack of one before it; the first letters are looked at first, as most
# places fail there.
_START = r"(?<![A-Za-z0-9_])"
#: JVM: group 1 stays, group 2 is replaced.
JVM = {
    "email": rf"((?<!{_LOCAL})[{_MARKS}]*+|\G){_EDGE}({_LOCAL}++@[A-Za-z0-9-]+\.(?!\.)(?:(?!\.[^A-Za-z0-9-]|\.\z)[A-Za-z0-9.-])*(?<!\.)){_EDGE}",
    "bearer_token": rf"((?=[BTbt]){_START}(?i:Bearer|Token|Basic)[{SPACE}]+)([A-Za-z0-9._~+/=-]{{6,}}){_EDGE}",
    "api_key": rf"()(?=[Aagkpstx]){_START}((?:{_KEY})){_EDGE}",
    "url": rf"""()(?=h){_START}(https?://[^{SPACE}"'<>]+)""",
}
#: What a text must hold for a detector to find anything; cheap to test.
NEEDS = {"email": ("@",), "bearer_token": ("bearer", "token", "basic"), "api_key": ("_", "-", "AKIA", "AIza"), "url": ("http",)}
#: Python: what any of the built-in detectors needs; most short strings and keys have nothing of it.
ANY = re.compile(rf"[@_{SPACE}-]|http|AKIA|AIza")
