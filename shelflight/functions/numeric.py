"""Numeric expressions.

Everything here is a plain Catalyst expression, so it stays inside whole-stage
code generation and runs without a Python worker.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Amounts are summed as whole ten-thousandths so that totals do not depend on
# the order in which tasks deliver their partial sums.
UNIT_DIGITS = 4
UNITS = "decimal(26,0)"
# From here on an amount has no exact units of this size.
LARGE = 1e22

# Java accepts "12.5d" and "3f" as numbers; spreadsheets do not.
_JAVA_SUFFIX = r"[0-9.][dDfF]\s*$"


def nan_to_null(value: Column) -> Column:
    """Spark orders NaN above every number, so `NaN >= 0` is true; null is not."""
    return F.when(~F.isnan(value), value)


def to_number(value: Column, data_type: str, default: float | None = None) -> Column:
    """Lenient numeric cast: text that is no number becomes null, then `default`.

    `data_type` is the simple type name of the input, known when the plan is
    built, so integer columns keep their type and pay for no cast.
    """
    if data_type in ("tinyint", "smallint", "int", "bigint"):
        number = value
    elif data_type in ("float", "double") or data_type.startswith("decimal"):
        number = nan_to_null(value.cast("double"))
    else:
        # Few numbers have a letter at all, so few meet the pattern; `nullif` reads the text once where `nan_to_null` would twice.
        text = value.cast("string")
        lettered = F.contains(text, F.lit("d")) | F.contains(text, F.lit("f")) | F.contains(text, F.lit("D")) | F.contains(text, F.lit("F"))
        number = F.nullif(F.when(~(lettered & text.rlike(_JAVA_SUFFIX)), text.try_cast("double")), F.lit(float("nan")))
    return number if default is None else F.coalesce(number, F.lit(default))


def truncate_to_long(value: Column) -> Column:
    """Integer part, towards zero."""
    return value.cast("bigint")


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    """`numerator / denominator` where the denominator is positive, else 0.

    The branch also keeps ANSI mode from raising on a zero denominator.
    """
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def half_even(value: Column, digits: int) -> Column:
    """Array-style rounding: scale, round half to even, scale back."""
    scale = float(10**digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def decimal_round(value: Column, digits: int) -> Column:
    """Round the exact binary value of a double to `digits` decimals.

    `rint(x * 100)` rounds twice: 2.675 is stored slightly below the tie, yet
    2.675 * 100 is exactly 267.5. The product is therefore computed with its
    rounding error (the value split into two halves of 26 bits, whose products
    are exact) and the error decides apparent ties.
    """
    scale = float(10**digits)
    spread = value * F.lit(134217729.0)  # 2^27 + 1
    high = spread - (spread - value)
    low = value - high
    high_part, low_part = high * F.lit(scale), low * F.lit(scale)
    product = high_part + low_part
    error = low_part - (product - high_part)
    below = F.floor(product).cast("double")
    at_tie = (product - below) == F.lit(0.5)
    whole = (
        F.when(at_tie & (error > 0), below + 1)
        .when(at_tie & (error < 0), below)
        .otherwise(F.rint(product))
    )
    return whole / F.lit(scale)


def is_amount(value: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def digits_for(largest: float | None) -> int:
    """Decimals of units in which an amount of `largest` still has at most 26 digits; below `LARGE` always 4."""
    if largest is None or largest < LARGE:
        return UNIT_DIGITS
    return 25 - math.floor(math.log10(largest))


def to_units(value: Column, digits: int = UNIT_DIGITS) -> Column:
    """A double amount as a whole number of units of 10 ** -digits, by default ten-thousandths.

    NaN and infinity are missing, and so are amounts of more than 26 digits: see `digits_for`.
    """
    return F.rint(value * F.lit(float(f"1e{digits}"))).try_cast(UNITS)


def sum_units(value: Column) -> Column:
    """Sum of amounts in units: 38 digits, for 10^12 rows of the largest amount."""
    return F.sum(to_units(value).cast("decimal(28,0)"))


def units_to_amount(units: Column, digits: int = UNIT_DIGITS) -> Column:
    return units.cast("double") / F.lit(float(f"1e{digits}"))


def sum_large(value: Column) -> Column:
    """Sum, in doubles, of the amounts that have no exact units; 0 without any."""
    return F.coalesce(F.sum(F.when(is_amount(value) & (F.abs(value) >= LARGE), value)), F.lit(0.0))


def exact_sum(value: Column) -> Column:
    """Order-independent sum of a double column; the sum of nothing is 0.

    Amounts of 1e22 or more are added up apart, as doubles, so that none is lost.
    """
    return F.coalesce(units_to_amount(sum_units(value)), F.lit(0.0)) + sum_large(value)


def exact_mean(value: Column, digits: int = 6) -> Column:
    """Mean of the values, NaN and infinity left out, from the order-independent sum."""
    return half_even(F.try_divide(exact_sum(value), F.count_if(is_amount(value))), digits)
