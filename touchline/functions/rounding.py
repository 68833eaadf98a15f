"""Exact rounding of ratios of integers.

``round(avg(x), 2)`` goes through a double and may land on either side of a
half. These forms stay in integers until the last division, so the outcome
depends neither on the engine nor on the order in which partitions are summed.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def int_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def half_up(total: Column, count: Column) -> Column:
    """``total / count`` to the nearest integer, halves away from zero; null when ``count``
    is 0. ``count`` is not negative."""
    n = F.nullif(count, F.lit(0))
    size = int_div(F.lit(2) * F.abs(total) + n, F.lit(2) * n)
    return F.when(total < 0, -size).otherwise(size)


def ratio(total: Column, count: Column, digits: int = 2) -> Column:
    """``total / count`` of integers, rounded to ``digits``."""
    scale = 10**digits
    return half_up(F.lit(scale) * total, count).cast("double") / F.lit(float(scale))


def mean(value: str | Column, digits: int = 2) -> Column:
    """The average of the known values; null when none is known."""
    return ratio(F.sum(value), F.count(value), digits)


def with_known(rows: DataFrame, *names: str) -> DataFrame:
    """Add ``known_<name>``: 1 where the value is known, else 0.

    Sums of a value and of its ``known_`` column can be folded again and again,
    by slice, day, band or pairing, and still make the average of the known
    values; a count of all rows goes beside them where it is needed.
    """
    return rows.withColumns({f"known_{name}": F.col(name).isNotNull().cast("bigint") for name in names})


def folded_mean(name: str, digits: int = 2) -> Column:
    """The average from columns that hold sums of ``name`` and of ``known_<name>``."""
    return ratio(F.sum(name), F.sum(f"known_{name}"), digits)


def percent(part: Column, whole: Column) -> Column:
    """Share of ``whole`` in percent, one decimal."""
    return ratio(F.lit(100) * part, whole, 1)


def ratio_minus_rounded(total: Column, count: Column, baseline_total: Column,
                        baseline_count: Column) -> Column:
    """``total / count`` minus the already rounded baseline ratio, two decimals."""
    cents = half_up(F.lit(100) * baseline_total, baseline_count)
    gap = F.lit(100) * total - count * cents
    return half_up(gap, count).cast("double") / F.lit(100.0)


def population_stdev(count: Column, total: Column, squares: Column) -> Column:
    """Population standard deviation from exact moments, two decimals.

    ``total`` and ``squares`` are DECIMAL(38,0), wide enough for
    ``count * squares`` of any league that fits in storage.
    """
    spread = count.cast("decimal(19,0)") * squares - total * total
    deviation = F.sqrt(spread.cast("double")) / count
    return F.floor(deviation * 100 + 0.5).cast("double") / F.lit(100.0)
