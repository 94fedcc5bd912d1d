"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_column

# First and last birth year of each generation, with the label reports use.
GENERATION_BANDS = (
    (1901, 1924, "The Greatest Generation"),
    (1925, 1945, "The Silent Generation"),
    (1946, 1964, "The Baby Boomer Generation"),
    (1965, 1979, "Generation X"),
    (1980, 1994, "Millenials"),
    (1995, 2012, "Generation Z"),
    (2013, 2025, "Gen Alpha"),
)
NO_BIRTH_YEAR = "Unknown"
NO_BAND = "Outside Range"


def generation(birth_year: str | Column) -> Column:
    """Generation label of a birth year; both ends of a band belong to it."""
    year = as_column(birth_year)
    label = F.when(year.isNull(), NO_BIRTH_YEAR)
    for first, last, name in GENERATION_BANDS:
        label = label.when(year.between(first, last), name)
    return label.otherwise(NO_BAND)


def week_of_year(ts: str | Column) -> Column:
    """Week number where weeks run Sunday to Saturday and 1 January is in week 1 (1..54)."""
    day = as_column(ts).cast("date")
    sundays_shift = F.dayofweek(F.trunc(day, "year")) - 2
    return (F.floor((F.dayofyear(day) + sundays_shift) / 7) + 1).cast("int")
