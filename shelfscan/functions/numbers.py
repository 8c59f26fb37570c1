"""Number formatting and rounding with fixed tie rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent_2dp(part: Column, total: Column) -> Column:
    """``part / total * 100`` with two decimals, ties to even, from whole numbers.

    Integer arithmetic keeps the result independent of floating point noise; null
    when ``total`` is 0.
    """
    part, total = part.cast("bigint"), total.cast("bigint")
    scaled = part * 10000
    whole = F.floor(F.try_divide(scaled.cast("decimal(38,0)"), total.cast("decimal(38,0)"))).cast("bigint")
    rest = (scaled - whole * total) * 2
    step = (
        F.when(rest > total, 1).when(rest < total, 0).otherwise(F.pmod(whole, F.lit(2)))
    )
    return (whole + step) / F.lit(100.0)


def fixed(value: Column, decimals: int) -> Column:
    """Plain text with a fixed number of decimals, no grouping."""
    pattern = "0" if decimals == 0 else "0." + "0" * decimals
    return F.call_function("format_number", value.cast("double"), F.lit(pattern))
