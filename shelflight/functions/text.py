"""String expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelflight.functions.numeric import decimal_round

# The characters that count as white space in text trimming.
WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

_CASED = r"\p{IsUppercase}\p{IsLowercase}\p{IsTitlecase}"
_RUNS = f"([{_CASED}]+|[^{_CASED}]+)"
# In lower-case text: a letter after a mark or digit. Apart from the next, for as one pattern both take ten times as long.
_AFTER_MARK = r"[^a-z ][a-z]"
_ASCII = r"\A[\x00-\x7f]*+\z"


def strip_whitespace(text: Column) -> Column:
    """Trim every kind of white space.

    Blanks go first, which is cheap. The search through the whole set is left to
    text that then still begins or ends with no printable ASCII character.
    """
    bare = F.trim(text)
    first, last = F.left(bare, F.lit(1)), F.right(bare, F.lit(1))
    odd = (first < "!") | (first > "~") | (last < "!") | (last > "~")
    return F.when(odd, F.btrim(text, F.lit(WHITESPACE))).otherwise(bare)


def title_case(text: Column) -> Column:
    """Capital after every character that is not a letter: `Levi'S`, `501Abc`.

    `initcap` capitalises after blanks only. It is right, and much cheaper, for
    ASCII text in which no letter follows a mark or digit, so only the rest is
    split into letter and non-letter runs.
    """
    lowered = F.lower(text)
    runs = F.regexp_extract_all(lowered, F.lit(_RUNS), F.lit(1))
    by_runs = F.concat_ws(
        "", F.transform(runs, lambda run: F.concat(F.upper(F.left(run, F.lit(1))), F.substr(run, F.lit(2))))
    )
    return F.when(lowered.rlike(_AFTER_MARK) | ~lowered.rlike(_ASCII), by_runs).otherwise(F.initcap(text))


def normalize_identifier(text: Column) -> Column:
    """Lower case, every run of other characters as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def contains_literal(text: Column, needle: str) -> Column:
    """Case-insensitive substring test; `%`, `_` and `.` have no special meaning."""
    return F.contains(F.lower(text.cast("string")), F.lit(needle.strip().lower()))


def first_non_empty(columns: Iterable[Column], default: str) -> Column:
    candidates = [F.when(c.cast("string") != "", c.cast("string")) for c in columns]
    return F.coalesce(*candidates, F.lit(default))


def fixed_point(value: Column, digits: int) -> Column:
    """A number with a fixed count of decimals, correctly rounded."""
    return decimal_round(value.cast("double"), digits).cast(f"decimal(38,{digits})").cast("string")


def number_text(value: Column, data_type: str) -> Column:
    """A number as text: `45` for integers, `45.0` for whole doubles, no exponent."""
    if data_type not in ("float", "double"):
        return value.cast("string")
    whole = (F.floor(value).cast("double") == value) & (F.abs(value) < 1e15)
    return F.when(whole, F.concat(value.cast("bigint").cast("string"), F.lit(".0"))).otherwise(
        value.cast("string")
    )
