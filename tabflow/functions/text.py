"""Text parsing as column expressions. Malformed input gives NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digits(c: Column, unwanted: str) -> Column:
    return F.regexp_replace(F.trim(c), unwanted, "").try_cast("long")


def parse_currency(c: Column) -> Column:
    """``"$5,800"`` -> 5800."""
    return _digits(c, "[$,]")


def parse_thousands(c: Column) -> Column:
    """``"1,800,000"`` -> 1800000."""
    return _digits(c, ",")


def after_comma_word(c: Column) -> Column:
    """Title in ``"Surname, Title. Given names"``."""
    tail = F.get(F.split(c, ", ", -1), F.lit(1))
    return F.get(F.split(tail, r"\.", -1), F.lit(0))


def before_comma(c: Column) -> Column:
    """Surname in ``"Surname, Title. Given names"``."""
    return F.get(F.split(c, ", ", -1), F.lit(0))


def coerce_number(c: Column) -> Column:
    """Number in the text, NULL where there is none."""
    return c.try_cast("double")
