"""Cumulative budgets over long tables: the rows of a group in order draw on one budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cumulative_budget(frame: DataFrame, keys: list[str], order: list[str], usage: dict[str, str], limits: dict[str, float], out: str = "budget_error") -> DataFrame:
    """Adds ``out``: the code of the first budget that a row's group goes beyond, or null; and ``budget_row``:
    whether the row stands at the first place that does (rows that tie on the order columns share a place).
    A group that fails, fails whole.

    ``usage`` maps limits to numeric columns. Totals are sums by group, which combine before the exchange;
    only groups that go beyond a limit are put in order to find the row.
    """
    rows = frame.withColumn("__row", F.monotonically_increasing_id())
    totals = frame.groupBy(*keys).agg(*[F.sum(F.col(c)).alias(f"__total_{n}") for n, c in usage.items()])
    over = None
    for n in usage:
        test = F.col(f"__total_{n}") > limits[n]
        over = test if over is None else over | test
    failed = totals.where(over).select(*[F.col(k).alias(f"__key_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys]
    running = Window.partitionBy(*keys).orderBy(*order, "__row").rowsBetween(Window.unboundedPreceding, 0)
    beyond = rows.join(failed, same, "left_semi").withColumns({f"__run_{n}": F.sum(F.col(c)).over(running) for n, c in usage.items()})
    code = F.coalesce(*[F.when(F.col(f"__run_{n}") > limits[n], F.lit(f"{n}_exceeded")) for n in usage])
    first = beyond.withColumn("__code", code).where("__code is not null").groupBy(*[F.col(k).alias(f"__key_{k}") for k in keys])
    first = first.agg(F.min(F.struct(*order, F.col("__row").alias("row"), F.col("__code").alias("code"))).alias("__first"))
    joined = frame.join(first, same, "left")
    here = F.lit(True)
    for o in order:
        here = here & F.col(o).eqNullSafe(F.col("__first")[o])
    return joined.withColumns({out: F.col("__first.code"), "budget_row": F.col("__first").isNotNull() & here}).drop("__first", *[f"__key_{k}" for k in keys])
