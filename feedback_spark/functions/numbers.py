"""Rounding and safe casts.

Two rounding rules occur: half to even for corpus figures, half up for whole
percentages shown to people. Both are written as one multiply and one divide,
so that every IEEE engine gives the same bits; a product that lands on a tie,
as 2.675 * 100 does, is rounded as that tie.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_half_even(value: Column, digits: int = 0) -> Column:
    scale = float(10**digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def round_half_up(value: Column, digits: int = 0) -> Column:
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def whole_percent(part: Column, total: Column) -> Column:
    """``part`` of ``total`` in whole percent, 0 when there is nothing to share."""
    share = F.floor(part / total * F.lit(100.0) + F.lit(0.5)).cast("long")
    return F.when(total == 0, F.lit(0).cast("long")).otherwise(share)


def number_or(value: Column, default: float) -> Column:
    """``value`` as a double, or ``default`` where it is absent or not a number."""
    return F.coalesce(value.try_cast("double"), F.lit(default))
