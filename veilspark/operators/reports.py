"""Report aggregation: per-row reports into one per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..codes import REPORT


_TIMINGS = ("duration_ms", "detector_duration_ms", "detector_runs", "nodes_visited", "string_code_units")
_WARNING = ("code", "detector_id", "reason", "path")


def merge_reports(frame: DataFrame, keys: list[str], report: str = "report") -> DataFrame:
    """One row per group: status, total_redactions, counts_by_reason, warnings, warning_counts and summed timings.

    A failed row makes the group failed. ``warnings`` has each different warning (code, detector, reason, path) once
    with its number ``n``, ``warning_counts`` the numbers by code. Everything is a sum over reasons and warnings,
    which combine before the exchange, so a large group costs a few rows per task; the input is read once.
    """
    r = F.col(report)
    none = F.lit(None).cast("string")
    reasons = F.transform(F.map_entries(r["counts_by_reason"]), lambda e: F.struct(F.lit("reason").alias("kind"), e["key"].alias("code"), none.alias("detector_id"), none.alias("reason"), none.alias("path"), e["value"].alias("n")))
    warnings = F.transform(r["warnings"], lambda w: F.struct(F.lit("warning").alias("kind"), *[w[f].alias(f) for f in _WARNING], F.lit(1).cast("long").alias("n")))
    found = F.concat(F.coalesce(reasons, F.array()), F.coalesce(warnings, F.array()))
    rows = frame.where(r.isNotNull()).select(*keys, r.alias("__r"), F.posexplode_outer(found).alias("__at", "__x"))
    # What a report has once counts at its first reason or warning.
    first = F.coalesce(F.col("__at"), F.lit(0)) == 0
    once = lambda value: F.sum(F.when(first, value))
    r = F.col("__r")
    timed = {n: once(F.when(r["timings"][n] >= 0, r["timings"][n])) for n in _TIMINGS}
    entry = F.struct(*[F.col(f"__x.{f}").alias(f) for f in ("kind", *_WARNING)])
    partial = rows.groupBy(*keys, entry.alias("__e")).agg(
        F.sum("__x.n").alias("n"),
        F.sum(F.when(first, 1).otherwise(0)).alias("n_reports"),
        F.max((r["status"] == "failed").cast("int")).alias("failed"),
        once(r["total_redactions"]).alias("total_redactions"),
        *(c.alias(n) for n, c in timed.items()),
    )
    listed = F.array_sort(F.collect_list(F.when(F.col("__e.kind").isNotNull(), F.struct(*[F.col(f"__e.{f}").alias(f) for f in ("kind", *_WARNING)], "n"))))
    sums = partial.groupBy(*keys).agg(F.sum("n_reports").alias("n_reports"), F.max("failed").alias("failed"), F.sum("total_redactions").alias("total_redactions"), *(F.sum(n).alias(n) for n in _TIMINGS), listed.alias("__all"))
    of = lambda kind: F.filter("__all", lambda x: x["kind"] == kind)
    codes = F.array_distinct(F.transform(of("warning"), lambda x: x["code"]))
    each = lambda code: F.aggregate(F.filter(of("warning"), lambda x: x["code"] == code), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return sums.select(
        *keys,
        "n_reports",
        F.when(F.col("failed") == 1, "failed").when(F.col("total_redactions") > 0, "redacted").otherwise("unchanged").alias("status"),
        "total_redactions",
        F.map_from_entries(F.transform(of("reason"), lambda x: F.struct(x["code"], x["n"]))).alias("counts_by_reason"),
        F.transform(of("warning"), lambda x: F.struct(*[x[f].alias(f) for f in (*_WARNING, "n")])).alias("warnings"),
        F.map_from_entries(F.transform(codes, lambda c: F.struct(c, each(c)))).alias("warning_counts"),
        *_TIMINGS,
    )


def merged(first: Column, second: Column) -> Column:
    """Two reports of one row as one; null stands for none."""
    total = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    counts = F.map_zip_with(first["counts_by_reason"], second["counts_by_reason"], lambda _, a, b: total(a, b))
    timings = F.when(first["timings"].isNotNull() | second["timings"].isNotNull(), F.struct(*[total(first["timings"][n], second["timings"][n]).alias(n) for n in ("duration_ms", "detector_duration_ms", "detector_runs", "nodes_visited", "string_code_units")]))
    n = total(first["total_redactions"], second["total_redactions"])
    status = F.when((first["status"] == "failed") | (second["status"] == "failed"), "failed").when(n > 0, "redacted").otherwise("unchanged")
    both = F.struct(status.alias("status"), n.alias("total_redactions"), counts.alias("counts_by_reason"), F.concat(first["warnings"], second["warnings"]).alias("warnings"), timings.alias("timings")).cast(REPORT)
    return F.when(second.isNull(), first).when(first.isNull(), second).otherwise(both)


def nearest_rank(frame: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles: the ceil(share * n)-th least value of each group."""
    return frame.groupBy(*keys).agg(*[F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY `{value}`)").alias(name) for name, share in shares.items()])


def evaluate_budgets(budgets: DataFrame, results: DataFrame, name: str = "name", metrics: tuple[str, ...] = ("median_ms", "p95_ms")) -> DataFrame:
    """Each budget with its verdict: missing (no result), incomplete (a metric is null or not finite), exceeded or ok."""
    measured = results.select(F.col(name).alias("__name"), *[F.col(m).alias(f"measured_{m}") for m in metrics], F.lit(True).alias("__there"))
    joined = budgets.join(measured, budgets[name] == F.col("__name"), "left")
    whole, over = F.lit(True), F.lit(False)
    for m in metrics:
        value = F.col(f"measured_{m}")
        whole = whole & value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
        over = over | (value > F.col(m))
    verdict = F.when(F.col("__there").isNull(), "missing").when(~whole, "incomplete").when(over, "exceeded").otherwise("ok")
    return joined.withColumn("verdict", verdict).drop("__name", "__there")
