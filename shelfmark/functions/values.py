"""Columns that read numbers, dates and flags out of cell text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import BOOLEAN_WORDS, DATE_PREFIX_PATTERNS

_DIGITS = r"\d+(?:_\d+)*"
NUMBER_PATTERN = (
    rf"^\s*[+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?"
    r"|(?i:inf|infinity|nan))\s*$"
)
DATE_PATTERN = "^(?:" + "|".join(DATE_PREFIX_PATTERNS) + ")"


def parse_number(text: Column) -> Column:
    """The text as a double, or null: digits may be grouped by underscores, and
    ``inf``/``nan`` are numbers, but no type suffix or hexadecimal form is."""
    digits = F.regexp_replace(text, r"[_\s]", "")
    digits = F.regexp_replace(digits, r"^[+-](?=[nN])", "")
    return F.when(text.rlike(NUMBER_PATTERN), digits.try_cast("double"))


def is_integral(number: Column) -> Column:
    """A finite number without fraction; infinities and NaN are not integers."""
    return number % 1 == 0


def is_date_text(text: Column) -> Column:
    """Starts like a date; a timestamp therefore counts as one."""
    return F.coalesce(text.rlike(DATE_PATTERN), F.lit(False))


def is_boolean_text(text: Column) -> Column:
    return F.coalesce(F.lower(text).isin(BOOLEAN_WORDS), F.lit(False))


def parse_compact_date(text: Column) -> Column:
    """``[D:]YYYYMMDDHHmmSS…`` to a zone-less timestamp; anything shorter or impossible is
    null. What follows the seconds (a zone) is ignored.
    """
    digits = F.regexp_extract(text, r"^(?:D:)?(\d{14})", 1)

    def part(start: int, length: int) -> Column:
        return F.substring(digits, start, length).try_cast("int")

    year, second = part(1, 4), part(13, 2)
    return F.when(
        (digits != "") & (year >= 1) & (second < 60),
        F.try_make_timestamp_ntz(
            year, part(5, 2), part(7, 2), part(9, 2), part(11, 2), second
        ),
    )
