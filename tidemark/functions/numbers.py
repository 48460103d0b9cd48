"""Numbers: rounding that any engine repeats, counts as sites write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tenths(x: Column) -> Column:
    """Rounded to one decimal, halves up, by arithmetic alone."""
    return F.floor(x * 10 + 0.5) / F.lit(10.0)


def as_count(x: Column) -> Column:
    """A whole number of 0 or more; anything else is 0."""
    return F.greatest(F.lit(0).cast("long"), F.coalesce(x.cast("string").try_cast("double").cast("long"), F.lit(0).cast("long")))


#: What a unit multiplies by: fixed values.
UNITS = {"k": 1_000, "m": 1_000_000, "만": 10_000}


def parse_count(text: Column) -> Column:
    """First number of a text like '1.2k', '3만' or '1,234', cut to a whole one; 0 without one or for null."""
    plain = F.lower(F.replace(text, F.lit(","), F.lit("")))
    parts = r"([0-9]+(?:\.[0-9]+)?)\s*(k|m|만)?"
    unit = F.regexp_extract(plain, parts, 2)
    factor = F.lit(1)
    for name, value in UNITS.items():
        factor = F.when(unit == name, F.lit(value)).otherwise(factor)
    return F.coalesce((F.regexp_extract(plain, parts, 1).try_cast("double") * factor).cast("long"), F.lit(0).cast("long"))
