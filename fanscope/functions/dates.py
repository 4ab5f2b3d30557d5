"""Birthday, age and age-band expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values ---
# A birthday field must hold exactly one match of this pattern (month/day/year).
BIRTHDAY_PATTERN = r"\d\d/\d\d/\d\d\d\d"
BIRTHDAY_FORMAT = "MM/dd/yyyy"
# Age in years counts years of this many days.
DAYS_PER_YEAR = 365.25
# Age bands (upper bound exclusive, label), then the label above the last bound.
AGE_BANDS = [(18, "Under 18"), (25, "18-24"), (35, "25-34"), (45, "35-44"), (55, "45-54")]
AGE_BAND_TOP = "55+"
# --- End of fixed values ---


def parse_birthday(raw: Column) -> Column:
    """Date from a field holding exactly one `dd/dd/dddd` (month/day/year).

    Zero or several candidates, or an impossible date (month 13, Feb 30), give
    NULL. The original job parsed leniently and rolled such dates over.
    """
    candidate = F.regexp_extract(raw, BIRTHDAY_PATTERN, 0)
    return F.when(F.regexp_count(raw, F.lit(BIRTHDAY_PATTERN)) == 1,
                  F.try_to_date(candidate, BIRTHDAY_FORMAT))


def age_years(birthday: Column, as_of: dt.date) -> Column:
    """Whole years of 365.25 days between birthday and `as_of`, truncated
    toward zero."""
    days = F.datediff(F.lit(as_of), birthday)
    return (days / F.lit(DAYS_PER_YEAR)).cast("int")


def age_band(age: Column) -> Column:
    expr = None
    for upper, label in AGE_BANDS:
        cond = age < upper
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(AGE_BAND_TOP)
