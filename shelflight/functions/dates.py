"""Date expressions. Each row is parsed on its own, whatever its neighbours hold."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Nothing but a date in ISO order, which none of the other spellings is.
_ISO = r"^\d{4}-\d{2}-\d{2}\z"
# Three numeric parts, the year last: 03/04/2024, 3-4-2024, 03.04.2024 10:15
_YEAR_LAST = r"^\s*(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})"
# The year first, with slashes or dots: 2024/04/03
_YEAR_FIRST = r"^\s*(\d{4})[/.](\d{1,2})[/.](\d{1,2})"
# The year last with two digits: 03/04/24
_SHORT_YEAR = r"^\s*(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{2})(?!\d)"
_COMPACT = r"^\s*(\d{4})(\d{2})(\d{2})(?!\d)"
# Month names, day or month first; a comma and a time may follow: 12 Mar 2024, March 12, 2024 10:15
_DAY_NAME = r"^\s*(\d{1,2})[ \-]([A-Za-z]{3,9})[ \-,]+(\d{4})"
_NAME_DAY = r"^\s*([A-Za-z]{3,9})[ \-](\d{1,2})[ \-,]+(\d{4})"
# Two-digit years from here on are of the last century.
_CENTURY_FROM = 69


def _two_digit_year(text: Column, day: int, month: int) -> Column:
    """Text with a two-digit year in ISO order."""
    year = F.regexp_extract(text, _SHORT_YEAR, 3).try_cast("int")
    century = F.when(year >= _CENTURY_FROM, "19").otherwise("20")
    return F.concat(century, F.regexp_replace(text, _SHORT_YEAR, f"$3-${month}-${day}"))


def _named_month(text: Column) -> Column:
    """Timestamp of text with a month name, English, short or long, in any case."""
    named = F.regexp_replace(F.regexp_replace(text, _NAME_DAY, "$2 $1 $3"), _DAY_NAME, "$1 $2 $3")
    parsed = [F.try_to_timestamp(F.trim(named), F.lit(f)) for f in ("d MMM yyyy[ H:mm[:ss]]", "d MMMM yyyy[ H:mm[:ss]]")]
    return F.coalesce(*parsed).cast("timestamp_ntz")


def parse_timestamp(value: Column, data_type: str, day_first: bool) -> Column:
    """Lenient date parse to a timestamp without time zone; the rest is null.

    ISO text goes straight to Spark's own parser. Only other spellings pay for a
    regular expression, which rewrites them to ISO order first. Known are the year
    last with four or two digits (69 to 99 are 1969 to 1999), the year first,
    eight digits, and month names. Of two numbers before the year the first is the
    day, or, without `day_first`, the month if that gives a date. Each row is
    parsed on its own; no format is guessed from the others.
    """
    if data_type == "timestamp_ntz":
        return value
    if data_type in ("timestamp", "date"):
        return value.cast("timestamp_ntz")
    text = value.cast("string")
    year_first = F.regexp_replace(text, _YEAR_FIRST, "$1-$2-$3").try_cast("timestamp_ntz")
    as_day_month = F.regexp_replace(text, _YEAR_LAST, "$3-$2-$1").try_cast("timestamp_ntz")
    if day_first:
        year_last = as_day_month
        short_year = _two_digit_year(text, 1, 2).try_cast("timestamp_ntz")
    else:
        short_year = F.coalesce(
            _two_digit_year(text, 2, 1).try_cast("timestamp_ntz"), _two_digit_year(text, 1, 2).try_cast("timestamp_ntz")
        )
        as_month_day = F.regexp_replace(text, _YEAR_LAST, "$3-$1-$2").try_cast("timestamp_ntz")
        year_last = F.coalesce(as_month_day, as_day_month)
    return (
        F.when(text.rlike(_ISO), text.try_cast("timestamp_ntz"))
        .when(text.rlike(_YEAR_LAST), year_last)
        .when(text.rlike(_YEAR_FIRST), year_first)
        .when(text.rlike(_SHORT_YEAR), short_year)
        .when(text.rlike(_COMPACT), F.regexp_replace(text, _COMPACT, "$1-$2-$3").try_cast("timestamp_ntz"))
        .when(text.rlike("[A-Za-z]{3}") & text.rlike("[0-9]{4}"), F.coalesce(text.try_cast("timestamp_ntz"), _named_month(text)))
        .otherwise(text.try_cast("timestamp_ntz"))
    )


def days_until(date: Column, as_of: dt.date) -> Column:
    """Whole days from `as_of` to `date`, negative when past."""
    return F.datediff(date.cast("date"), F.lit(as_of)).cast("bigint")


def year_month(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")
