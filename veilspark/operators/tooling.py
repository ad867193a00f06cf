"""Release tooling as column expressions: results with provenance, output paths, contracts, inventories, versions, pins.

Whatever has not the exact shape that is asked for gives null, so it can be told from a verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from ..functions.patterns import SPACE

#: Fixed value: the name of a result's schema, behind a prefix of one's own.
RESULT_SCHEMA = "performance-result/v1"
_SAFE_INTEGER = 2**53 - 1


def provenance(commit: Column, run_id: Column, run_attempt: Column) -> Column:
    """Where a result comes from, as far as it has the shape of a commit (lower-cased), a number and a positive number."""
    digits = F.when(run_attempt.rlike(r"\A[1-9][0-9]*\z") & (F.length(run_attempt) <= 16), run_attempt.cast("long"))
    return F.struct(
        F.when(commit.rlike(r"\A[0-9A-Fa-f]{40}\z"), F.lower(commit)).alias("commit"),
        F.when(run_id.rlike(r"\A(0|[1-9][0-9]*)\z"), run_id).alias("run_id"),
        F.when(digits <= _SAFE_INTEGER, digits).alias("run_attempt"),
    )


def performance_result(results: DataFrame, generated_at: Column, commit: Column, run_id: Column, run_attempt: Column, environment: dict[str, Column] | None = None, prefix: str = "veilspark") -> DataFrame:
    """``results`` (a row per case) with schema_version, generated_at (ISO, UTC), source and environment."""
    where = F.struct(*[c.cast("string").alias(n) for n, c in (environment or {"spark_version": F.version()}).items()])
    stamp = F.date_format(F.to_utc_timestamp(generated_at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return results.withColumns({"schema_version": F.lit(f"{prefix}/{RESULT_SCHEMA}"), "generated_at": stamp, "source": provenance(commit, run_id, run_attempt), "environment": where})


def output_path(path: Column, folder: str = "artifacts") -> Column:
    """The path below ``folder`` with ``.`` and ``..`` resolved, or null if it leaves the folder or names no JSON file."""
    steps = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    zero = F.struct(F.lit(True).alias("inside"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, p: Column) -> Column:
        up = (p == "..") & (F.size(acc["parts"]) > 0)
        parts = F.when(up, F.slice(acc["parts"], 1, F.greatest(F.size(acc["parts"]) - 1, F.lit(0)))).otherwise(F.array_append(acc["parts"], p))
        return F.struct((acc["inside"] & ((p != "..") | up)).alias("inside"), parts.alias("parts"))

    found = F.aggregate(steps, zero, step)
    whole = F.array_join(found["parts"], "/")
    good = found["inside"] & ~path.startswith("/") & whole.startswith(folder + "/") & F.lower(whole).rlike(r"[^/]\.json\z")
    return F.when(good, whole)


def _sorted(value: Column, kind: DataType) -> Column:
    """The value with the fields of structs and the entries of maps in the order of their names."""
    if isinstance(kind, StructType):
        ordered = F.struct(*[_sorted(value[f.name], f.dataType).alias(f.name) for f in sorted(kind, key=lambda f: f.name)])
        return F.when(value.isNotNull(), ordered)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _sorted(x, kind.elementType))
    if isinstance(kind, MapType):
        entries = F.array_sort(F.map_entries(value), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], _sorted(e["value"], kind.valueType))))
    return value


def stable_json(value: Column, kind: DataType) -> Column:
    """A nested value of type ``kind`` as JSON, under the name ``value``, that does not depend on the order of fields and entries."""
    return F.to_json(F.struct(_sorted(value, kind).alias("value")), {"ignoreNullFields": "false"})


def contract_changed(frame: DataFrame, expected: str, actual: str, out: str = "changed") -> DataFrame:
    """Adds whether two nested columns differ in more than the order of fields; two nulls do not."""
    return frame.withColumn(out, stable_json(F.col(expected), frame.schema[expected].dataType) != stable_json(F.col(actual), frame.schema[actual].dataType))


def inventory_sha256(text: Column, start: str, end: str) -> Column:
    """The hex digest of what stands between the first two markers, trimmed, with plain line ends; null without them."""
    a, b = F.instr(text, start), F.instr(text, end)
    inside = F.substring(text, a + F.lit(len(start)), b - a - F.lit(len(start)))
    trimmed = F.regexp_replace(inside, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")
    return F.when((a > 0) & (b > a), F.sha2(F.replace(trimmed, F.lit("\r\n"), F.lit("\n")), 256))


def compare_versions(left: Column, right: Column) -> Column:
    """-1, 0 or 1 for exact versions of three numbers; null if one is none."""
    shape = r"\A[0-9]+\.[0-9]+\.[0-9]+\z"
    number = lambda v, i: F.split(v, r"\.")[i].cast("decimal(38,0)")
    order = F.lit(0)
    for i in (2, 1, 0):
        a, b = number(left, i), number(right, i)
        order = F.when(a < b, -1).when(a > b, 1).otherwise(order)
    return F.when(left.rlike(shape) & right.rlike(shape), order)


def commit_drift(pinned: Column, latest: Column, web: str) -> Column:
    """status (current or drift) and the addresses of both commits and of their comparison; null unless both are lower-case commits."""
    shape = r"\A[0-9a-f]{40}\z"
    at = lambda *parts: F.concat(F.lit(web), *parts)
    found = F.struct(
        F.when(pinned == latest, "current").otherwise("drift").alias("status"),
        pinned.alias("pinned"),
        latest.alias("latest"),
        at(F.lit("/commit/"), pinned).alias("pinned_url"),
        at(F.lit("/commit/"), latest).alias("latest_url"),
        at(F.lit("/compare/"), pinned, F.lit("..."), latest).alias("compare_url"),
    )
    return F.when(pinned.rlike(shape) & latest.rlike(shape), found)
