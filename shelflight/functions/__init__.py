"""Column-level building blocks shared by every operator."""

from shelflight.functions.dates import days_until, parse_timestamp, year_month
from shelflight.functions.numeric import (
    decimal_round,
    exact_mean,
    exact_sum,
    half_even,
    nan_to_null,
    ratio_or_zero,
    to_number,
    to_units,
    truncate_to_long,
)
from shelflight.functions.text import (
    contains_literal,
    first_non_empty,
    fixed_point,
    normalize_identifier,
    number_text,
    strip_whitespace,
    title_case,
)

__all__ = [
    "contains_literal",
    "days_until",
    "decimal_round",
    "exact_mean",
    "exact_sum",
    "first_non_empty",
    "fixed_point",
    "half_even",
    "nan_to_null",
    "normalize_identifier",
    "number_text",
    "parse_timestamp",
    "ratio_or_zero",
    "strip_whitespace",
    "title_case",
    "to_number",
    "to_units",
    "truncate_to_long",
    "year_month",
]
