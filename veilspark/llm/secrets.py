"""Secret scans: base patterns, and multipart credentials linked within scopes.

A credential often comes in parts: an identifier, a secret and an endpoint, none of which proves
anything alone. Weak candidates for each part are collected as intervals; an interval join within
a scope (a run of lines without a blank one, and at most ``WINDOW`` code points between two parts)
reports a weak secret only if an identifier or an endpoint lies near it, and a weak identifier or
endpoint only if a secret does. Each side of the join is sorted and looked up by bisection, so a
text with n candidates takes O(n log n) and no pairs are made. A text is one row and its scopes
never leave it, so the scan needs no shuffle.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import sliced

#: Most code points between two parts of one credential.
WINDOW = 240

#: Kinds in the order in which spans with one start are listed: the base, then the linked parts.
KINDS = ("assign", "access", "hex", "weak_secret", "weak_id", "weak_endpoint")
_ORDER = {kind: i for i, kind in enumerate(KINDS)}

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 12
# A failing match takes the whole run and no part of a short run is long enough, so the
# quantifier can hold the least length; the same is true for the hex runs.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")

WEAK_ID = re.compile(r"""(?<![A-Za-z0-9_])(?:[Uu]ser(?:[Nn]ame)?|[Uu]ser_id|[Ll]ogin|[Cc]lient_?[Ii]d|[Aa]ccess_?[Kk]ey(?:_?[Ii]d)?|[Aa]ccount(?:_id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]{3,})""")
WEAK_ENDPOINT = re.compile(r"""(?<![A-Za-z0-9+.-])(?:[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._-]+(?::[0-9]{1,5})?(?:/[A-Za-z0-9._~/%-]*)?|[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){1,6}:[0-9]{2,5})(?![A-Za-z0-9])""")
# A greedy run is maximal, so each is matched once; its digit and letter are asked for afterwards.
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
DIGIT, LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
BLANK_LINE = re.compile(r"\n[\x20\t\r]*\n")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def base_spans(text: str) -> list[Span]:
    """The strong patterns: leftmost, non-overlapping for each kind; offsets in code points."""
    found = []
    low = text.lower()
    if any(word in low for word in ASSIGN_WORDS) or not text.isascii():
        found += [Span("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [Span("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [Span("hex", *m.span()) for m in HEX.finditer(text)]
    return ordered(found)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s.start, _ORDER[s.kind], s.end))


class Side:
    """One side of the interval join: the parts of a kind with their scopes, sorted by start."""

    def __init__(self, parts: list[tuple[int, Span]]) -> None:
        self.parts = sorted(parts, key=lambda p: (p[0], p[1].start))
        self.keys = [(scope, span.start) for scope, span in self.parts]
        self.ends: list[int] = []  # the furthest end so far within the scope
        for i, (scope, span) in enumerate(self.parts):
            before = self.ends[-1] if i and self.parts[i - 1][0] == scope else -1
            self.ends.append(max(before, span.end))

    def near(self, scope: int, span: Span, window: int) -> bool:
        """Whether a part of this side lies in the scope, at most ``window`` from the span."""
        i = bisect_left(self.keys, (scope, span.start))
        after = i < len(self.keys) and self.keys[i][0] == scope and self.keys[i][1] - span.end <= window
        return after or (i > 0 and self.keys[i - 1][0] == scope and span.start - self.ends[i - 1] <= window)


def _overlaps(starts: list[int], ends: list[int], start: int, end: int) -> bool:
    i = bisect_left(starts, end)
    return i > 0 and ends[i - 1] > start


def _free(spans: list[Span], taken: list[Span]) -> list[Span]:
    """The spans that touch none of those taken."""
    taken = sorted(taken, key=lambda s: s.start)
    starts, ends = [s.start for s in taken], []
    for s in taken:
        ends.append(max(ends[-1], s.end) if ends else s.end)
    return [s for s in spans if not _overlaps(starts, ends, s.start, s.end)]


def linked_spans(text: str, base: list[Span], window: int = WINDOW) -> list[Span]:
    """Weak candidates whose complementary part lies in the same scope."""
    # Without a secret part and an identifying part there is nothing to link.
    secrets = _free([Span("weak_secret", *m.span()) for m in WEAK_SECRET.finditer(text) if DIGIT.search(m[0]) and LETTER.search(m[0])], base)
    strong_secrets = [s for s in base if s.kind in ("assign", "hex")]
    if not secrets and not strong_secrets:
        return []
    ids = [Span("weak_id", *m.span()) for m in WEAK_ID.finditer(text)] if ":" in text or "=" in text else []
    points = [Span("weak_endpoint", *m.span()) for m in WEAK_ENDPOINT.finditer(text)] if ":" in text else []
    ids, points = _free(ids, base), _free(points, base)
    secrets = _free(secrets, ids + points)
    breaks = [m.start() for m in BLANK_LINE.finditer(text)]
    scoped = lambda spans: [(bisect_left(breaks, s.start), s) for s in spans]
    identifying = Side(scoped(ids + points + [s for s in base if s.kind == "access"]))
    secret = Side(scoped(secrets + strong_secrets))
    found = [s for scope, s in scoped(secrets) if identifying.near(scope, s, window)]
    return found + [s for scope, s in scoped(ids + points) if secret.near(scope, s, window)]


def scan_text(text: str | None, window: int = WINDOW) -> list[Span]:
    """All spans of a text, base and linked, in their order."""
    base = base_spans(text or "")
    return ordered(base + linked_spans(text or "", base, window))


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, found.

    ``found`` has the spans as structs. Null texts count as empty and have no spans; ids may be null
    or repeat, each row is scanned by itself; an empty table gives no rows; other columns are not read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "found")}
            for text in batch.column("text").to_pylist():
                spans = scan_text(text, window)
                base = [s for s in spans if _ORDER[s.kind] < 3]
                for kind in KINDS[:3]:
                    out[f"n_{kind}"].append(sum(s.kind == kind for s in base))
                out["base_sha256"].append(hashlib.sha256(spans_text(base).encode()).hexdigest())
                out["spans"].append(spans_text(spans))
                out["found"].append([s._asdict() for s in spans])
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], ["doc_id", *out])

    fields = [StructField("doc_id", LongType()), *(StructField(f"n_{k}", LongType()) for k in KINDS[:3]), StructField("base_sha256", StringType()), StructField("spans", StringType()), StructField("found", SPANS)]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, StructType(fields))


def redact(text: str, spans: list[Span]) -> str:
    """The text with each maximal run of overlapping spans replaced by one token, named after its first."""
    parts, at = [], 0
    runs: list[list] = []
    for s in spans:
        if runs and s.start < runs[-1][2]:
            runs[-1][2] = max(runs[-1][2], s.end)
        else:
            runs.append([s.kind, s.start, s.end])
    for kind, start, end in runs:
        parts += [text[at:start], f"[SECRET:{kind}]"]
        at = end
    return "".join(parts) + text[at:]


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` with found spans replaced; all columns stay, ``length_col`` follows the text.

    Rows without a span come back as they are, null texts too.
    """
    names = docs.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text=text_col):
            texts = batch.column(text_col).to_pylist()
            spans = [scan_text(t, window) for t in texts]
            if any(spans):
                new = [redact(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
                columns = dict(zip(batch.schema.names, batch.columns, strict=True))
                columns[text_col] = pa.array(new, pa.string())
                if length_col in names:
                    old = columns[length_col].to_pylist()
                    columns[length_col] = pa.array([len(n) if s else o for n, s, o in zip(new, spans, old, strict=True)], columns[length_col].type)
                batch = pa.RecordBatch.from_arrays([columns[n] for n in batch.schema.names], batch.schema.names)
            yield batch

    return docs.mapInArrow(rows, docs.schema)
