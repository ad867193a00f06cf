"""Text redaction as Spark expressions, with no Python in the data path.

Every pattern has two groups, what stays and the secret. ``split`` gives the gaps between matches and
``regexp_extract_all`` both groups, so running sums of lengths give the spans. Sorting the spans of all
detectors as structs (start, -end, detector, reason) puts them in the order in which overlaps are
resolved; one fold over them writes the text, the warnings and the counts. Each step is a projection of
its own, so that a regular expression runs once per row and detector.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..codes import ERROR, ERRORS, REPORT, WARNING
from ..options import Options, built_in_id, default_token
from .patterns import JVM, NEEDS

#: Detectors whose first group can hold something.
PREFIXED = ("email", "bearer_token")
_SPAN = "struct<s:int,e:int,o:int,r:string>"


def code_units(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return F.when(F.length(text) == F.octet_length(text), F.length(text)).otherwise((F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")).cast("long")


def is_native(options: Options) -> bool:
    """Whether the policy has no Python parts and no clock."""
    timed = options.limits.max_detector_duration_ms is not None or options.limits.max_total_duration_ms not in (None, 0)
    return not options.detectors and not timed and (options.replacement is None or isinstance(options.replacement, Mapping))


def _needed(text: Column, name: str) -> Column:
    """A cheap test that rules out most texts without the pattern."""
    where = F.lower(text) if name == "bearer_token" else text
    found = None
    for word in NEEDS[name]:
        found = where.contains(word) if found is None else found | where.contains(word)
    return found


def _warning(code: str, **more: Column | str) -> Column:
    return F.struct(*[(more[f] if isinstance(more.get(f), Column) else F.lit(more.get(f) if f != "code" else code)).cast("string").alias(f) for f in ("code", "detector_id", "reason", "path")])


def spans(frame: DataFrame, text: str, name: str, order: int, out: str) -> DataFrame:
    """Adds the spans of one detector, as structs (s, -e, o, r) in code points."""
    pattern, own = F.lit(JVM[name]), F.col(text)
    use = own.isNotNull() & _needed(own, name)
    staged = frame.withColumns(
        {
            f"{out}_gap": F.when(use, F.split(own, JVM[name], -1)),
            f"{out}_hit": F.when(use, F.regexp_extract_all(own, pattern, F.lit(2))),
        }
    )
    before = F.transform(f"{out}_gap", lambda g: F.length(g))
    if name in PREFIXED:  # what stays before the secret counts to the gap
        staged = staged.withColumn(f"{out}_pre", F.when(use, F.regexp_extract_all(own, pattern, F.lit(1))))
        before = F.zip_with(before, F.col(f"{out}_pre"), lambda g, p: g + F.length(p))
    both = F.zip_with(before, F.col(f"{out}_hit"), lambda g, h: F.struct(g.alias("g"), F.length(h).alias("h")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["g"]
        end = start + x["h"]
        return F.struct(end.alias("at"), F.array_append(acc["found"], F.struct(start.alias("s"), (-end).alias("e"), F.lit(order).alias("o"), F.lit(name).alias("r"))).cast(f"array<{_SPAN}>").alias("found"))

    # The last gap has no match behind it.
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("found"))
    found = F.aggregate(F.filter(both, lambda x: x["h"].isNotNull()), start, step)["found"]
    found = F.when(F.size(f"{out}_hit") > 0, found).otherwise(F.array().cast(f"array<{_SPAN}>"))
    return staged.withColumn(out, found).drop(f"{out}_gap", f"{out}_pre", f"{out}_hit")


def redact_column(frame: DataFrame, column: str, out: str, options: Options) -> DataFrame:
    """Adds ``out``: the result struct (ok, value, report, error) for the string column; null texts are refused."""
    limits, names = options.limits, options.names
    text, guard = f"{out}__text", f"{out}__guard"
    own = F.col(column)
    problem = options.problem() or None
    late = options.detector_problem()
    most = limits.max_total_detections
    early = F.lit(problem.code) if problem else (
        F.when(own.isNull(), "invalid_redaction_input")
        .when(F.lit(limits.max_total_duration_ms == 0), "max_total_duration_exceeded")
        .when(code_units(own) > F.lit(float(limits.get("max_string_length"))), "max_string_length_exceeded")
        .when(F.lit(late is not None), late.code if late else None)
        .when(F.lit(len(names) > limits.get("max_detectors")), "max_detectors_exceeded")
    )
    frame = frame.withColumn(guard, early.cast("string")).withColumn(text, F.when(F.col(guard).isNull(), own))
    known = [n for n in names if n in JVM]
    for i, name in enumerate(known):
        frame = spans(frame, text, name, i, f"{out}__{i}")
    found = [F.col(f"{out}__{i}") for i in range(len(known))]
    # The detector whose spans go beyond the limit is named; spans count before overlaps are resolved.
    over = F.lit(None).cast("string")
    if most is not None:
        for i in reversed(range(len(known))):
            over = F.when(sum((F.size(f) for f in found[: i + 1]), F.lit(0)) > most, built_in_id(known[i])).otherwise(over)
    frame = frame.withColumns({f"{out}__over": over, f"{out}__all": F.array_sort(F.concat(*found)) if found else F.array().cast(f"array<{_SPAN}>")})

    given = options.replacement if isinstance(options.replacement, Mapping) else {n: default_token(n) for n in known}
    tokens = {n: str(given.get(n, "")) for n in known}
    lacking = [n for n in known if n not in given]
    token = lambda r: F.element_at(F.create_map(*[F.lit(x) for pair in tokens.items() for x in pair]), r) if tokens else F.lit("")
    kept = F.col(text)

    def fold(acc: Column, x: Column) -> Column:
        inside = x["s"] < acc["end"]
        warned = F.when(inside & ~acc["bad"], F.array_append(acc["warnings"], _warning("overlapping_detection", reason=x["r"]))).otherwise(acc["warnings"])
        bad = acc["bad"] | (inside & (x["s"] != acc["start"]))
        take = ~inside & ~acc["bad"]
        return F.struct(
            F.when(take, x["s"]).otherwise(acc["start"]).alias("start"),
            F.when(take, -x["e"]).otherwise(acc["end"]).alias("end"),
            bad.alias("bad"),
            F.when(take, F.concat(acc["out"], F.substring(kept, acc["end"] + 1, x["s"] - acc["end"]), token(x["r"]))).otherwise(acc["out"]).alias("out"),
            F.struct(*[(acc["counts"][n] + F.when(take & (x["o"] == i), 1).otherwise(0)).alias(n) for i, n in enumerate(known)]).alias("counts"),
            warned.cast(f"array<{WARNING.simpleString()}>").alias("warnings"),
        )

    none = F.struct(*[F.lit(0).alias(n) for n in known])
    zero = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(False).alias("bad"), F.lit("").alias("out"), none.alias("counts"), F.array().cast(f"array<{WARNING.simpleString()}>").alias("warnings"))
    # A first span at 0 follows no other: its start must differ from the fold's.
    zero = F.struct(F.lit(-1).alias("start"), *[zero[n].alias(n) for n in ("end", "bad", "out", "counts", "warnings")])
    usable = F.col(guard).isNull() & F.col(f"{out}__over").isNull()
    frame = frame.withColumn(f"{out}__fold", F.when(usable & (F.size(f"{out}__all") > 0), F.aggregate(F.col(f"{out}__all"), zero, fold)) if known else F.lit(None).cast("struct<start:int,end:int,bad:boolean,out:string,warnings:array<string>>"))
    folded = F.col(f"{out}__fold")
    bad = F.coalesce(folded["bad"], F.lit(False))
    missing = F.lit(False)
    for n in lacking:
        missing = missing | F.coalesce(folded["counts"][n] > 0, F.lit(False))
    code = F.coalesce(F.col(guard), F.when(F.col(f"{out}__over").isNotNull(), "max_total_detections_exceeded"), F.when(bad, "overlapping_detection"), F.when(missing, "replacement_failed"))
    message = F.element_at(F.create_map(*[F.lit(x) for pair in ERRORS.items() for x in pair]), code)
    if late is not None and late.message:
        message = F.when(F.col(guard) == late.code, F.lit(late.message)).otherwise(message)
    frame = frame.withColumns({f"{out}__code": code, f"{out}__message": message})
    code, good = F.col(f"{out}__code"), F.col(f"{out}__code").isNull()
    value = F.when(good, F.when(folded.isNull(), kept).otherwise(F.concat(folded["out"], F.substring(kept, folded["end"] + 1, F.length(kept)))))
    each = {n: F.when(good, F.coalesce(folded["counts"][n], F.lit(0))).otherwise(0) for n in known}
    total = sum(each.values(), F.lit(0))
    empty = F.array().cast(f"array<{WARNING.simpleString()}>")
    last = F.when(good | (bad & F.col(guard).isNull()), empty).otherwise(F.array(_warning("", detector_id=F.col(f"{out}__over")).withField("code", code)))
    warnings = F.concat(F.coalesce(folded["warnings"], empty) if known else empty, last).cast(f"array<{WARNING.simpleString()}>")
    # In a failure after the detectors began, they all ran or ran up to the one that failed.
    runs = F.when(F.col(guard).isNotNull(), 0)
    if most is not None:
        for i, n in enumerate(known):
            runs = runs.when(F.col(f"{out}__over") == built_in_id(n), i + 1)
    runs = runs.otherwise(len(known))
    counts = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), c.cast("long").alias("value")) for n, c in each.items()]), lambda c: c["value"] > 0) if known else F.array().cast("array<struct<key:string,value:bigint>>")
    report = F.struct(
        F.when(~good, "failed").when(total > 0, "redacted").otherwise("unchanged").alias("status"),
        total.cast("long").alias("total_redactions"),
        F.map_from_entries(counts).alias("counts_by_reason"),
        warnings.alias("warnings"),
        F.struct(F.lit(None).cast("double").alias("duration_ms"), F.lit(None).cast("double").alias("detector_duration_ms"), runs.cast("long").alias("detector_runs"), F.lit(1).cast("long").alias("nodes_visited"), F.coalesce(code_units(own), F.lit(0)).cast("long").alias("string_code_units")).alias("timings"),
    ).cast(REPORT)
    error = F.when(~good, F.struct(code.alias("code"), F.col(f"{out}__message").alias("message"), F.col(f"{out}__over").alias("detector_id")).cast(ERROR))
    result = F.struct(good.alias("ok"), value.alias("value"), report.alias("report"), error.alias("error"))
    helpers = [c for c in frame.columns if c.startswith(f"{out}__")]
    return frame.withColumn(out, result).drop(*helpers)
