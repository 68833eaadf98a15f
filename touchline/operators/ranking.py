"""RANK() within groups that may be few and very large."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _meet(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join on keys in which an unknown value equals another."""
    renamed = right.withColumnsRenamed({key: f"_{key}" for key in keys})
    alike = [F.col(key).eqNullSafe(F.col(f"_{key}")) for key in keys]
    return left.join(renamed, alike).drop(*[f"_{key}" for key in keys])


def rank_within(table: DataFrame, group: list[str], order: list[str], into: str) -> DataFrame:
    """Add the exact RANK() of each row in its group, by ``order`` descending.

    Equal scores are counted once, rows above are counted per value of the
    first order column, and only scores that share that value meet in a window.
    So a league of any size is ranked by many tasks, and tied rows never pile
    up in one of them.
    """
    first, *rest = order
    above = Window.unboundedPreceding, -1
    scores = table.groupBy(*group, *order).agg(F.count("*").alias("tied"))

    steps = scores.groupBy(*group, first).agg(F.sum("tied").alias("step"))
    down = Window.partitionBy(*group).orderBy(F.desc(first)).rowsBetween(*above)
    steps = steps.select(
        *group, first, F.coalesce(F.sum("step").over(down), F.lit(0)).alias("above_step")
    )

    inside = (
        Window.partitionBy(*group, first)
        .orderBy(*[F.desc(name) for name in rest])
        .rowsBetween(*above)
    )
    ranks = (
        scores.withColumn("above_tie", F.coalesce(F.sum("tied").over(inside), F.lit(0)))
        .transform(_meet, steps, [*group, first])
        .select(
            *group,
            *order,
            (F.lit(1) + F.col("above_step") + F.col("above_tie")).cast("bigint").alias(into),
        )
    )
    return _meet(table, ranks, [*group, *order])
