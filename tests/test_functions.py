import datetime as dt

import pytest
from conftest import values
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyglass.functions import (
    clean_text,
    fold_case,
    generation,
    has_non_alphanumeric,
    has_non_ascii,
    is_missing,
    null_if_blank,
    recode,
    strict_cast,
    text_length,
    typed,
    week_of_year,
)


def one(spark, expression):
    return spark.range(1).select(expression).first()[0]


@pytest.mark.parametrize(
    "text,missing,kept,clean,length",
    [
        (None, True, None, None, None),
        ("", True, None, None, 0),
        (" ", True, None, None, 0),
        ("x ", False, "x ", "x", 1),
        (" x", False, " x", "x", 2),
        ("x", False, "x", "x", 1),
    ],
)
def test_blanks(spark, text, missing, kept, clean, length):
    c = F.lit(text).cast("string")
    row = spark.range(1).select(is_missing(c), null_if_blank(c), clean_text(c), text_length(c)).first()
    assert tuple(row) == (missing, kept, clean, length)


def test_recode_keeps_other_values_and_ignores_trailing_spaces(table):
    df = table("v", "zero", "zero ", "1.00", "", None)
    assert values(df.select(recode("v", {"zero": "0", "": None}))) == [None, None, "0", "0", "1.00"]


def test_fold_case_groups_spellings(table):
    df = table("v", "Soda", "SODA ", "soda", "Water")
    assert sorted(r["count"] for r in df.groupBy(fold_case("v").alias("v")).count().collect()) == [1, 3]


@pytest.mark.parametrize(
    "text,odd,foreign",
    [
        ("WALMART 1", False, False),
        ("ALDI, INC", True, False),
        ("MÁS", True, True),
        ("tab\there", True, True),
        ("line\n", True, True),
        ("", False, False),
        (None, None, None),
    ],
)
def test_character_classes(spark, text, odd, foreign):
    c = F.lit(text).cast("string")
    row = spark.range(1).select(has_non_alphanumeric(c), has_non_ascii(c)).first()
    assert tuple(row) == (odd, foreign)


@pytest.mark.parametrize(
    "text,dtype,expected",
    [
        ("052336919068", "bigint", 52336919068),
        ("0", "bigint", 0),
        ("-7", "bigint", -7),
        (" 12 ", "bigint", 12),
        ("1.5", "bigint", None),
        ("", "bigint", None),
        (" ", "bigint", None),
        (None, "bigint", None),
        ("abc", "bigint", None),
        ("12abc", "bigint", None),
        ("zero", "decimal(15,2)", None),
        ("0.23", "decimal(15,2)", 0.23),
        (".5", "decimal(15,2)", 0.5),
        ("276.00", "decimal(15,2)", 276),
        ("2024-08-21", "timestamp_ntz", dt.datetime(2024, 8, 21)),
        ("2024-08-21 14:19:06.539 Z", "timestamp_ntz", dt.datetime(2024, 8, 21, 14, 19, 6, 539000)),
        ("2023-02-29", "date", None),
        ("not a date", "timestamp_ntz", None),
    ],
)
def test_typed(spark, text, dtype, expected):
    got = one(spark, typed(F.lit(text).cast("string"), dtype))
    assert (float(got) if isinstance(expected, float) else got) == expected


def test_typed_with_a_pattern(spark):
    assert one(spark, typed(F.lit("21/08/2024"), "timestamp_ntz", "dd/MM/yyyy")) == dt.datetime(2024, 8, 21)
    assert one(spark, typed(F.lit("2024-08-21"), "timestamp_ntz", "dd/MM/yyyy")) is None


def test_strict_cast_lets_blanks_pass_and_stops_on_bad_values(spark):
    assert one(spark, strict_cast(F.lit(" "), "bigint")) is None
    assert one(spark, strict_cast(F.lit("17"), "bigint")) == 17
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        with pytest.raises(PySparkException, match="cannot cast to bigint: abc"):
            one(spark, strict_cast(F.lit("abc"), "bigint"))
    spark.conf.unset("spark.sql.ansi.enabled")


@pytest.mark.parametrize(
    "year,label",
    [
        (1900, "Outside Range"),
        (1901, "The Greatest Generation"),
        (1924, "The Greatest Generation"),
        (1925, "The Silent Generation"),
        (1945, "The Silent Generation"),
        (1946, "The Baby Boomer Generation"),
        (1964, "The Baby Boomer Generation"),
        (1965, "Generation X"),
        (1979, "Generation X"),
        (1980, "Millenials"),
        (1994, "Millenials"),
        (1995, "Generation Z"),
        (2012, "Generation Z"),
        (2013, "Gen Alpha"),
        (2025, "Gen Alpha"),
        (2026, "Outside Range"),
        (None, "Unknown"),
    ],
)
def test_generation(spark, year, label):
    assert one(spark, generation(F.lit(year).cast("int"))) == label


@pytest.mark.parametrize(
    "day,week",
    [
        ("2024-06-12", 24),
        ("2024-09-08", 37),
        ("2023-01-01", 1),  # a Sunday
        ("2023-01-07", 1),
        ("2023-01-08", 2),
        ("2024-01-01", 1),  # a Monday
        ("2024-01-06", 1),
        ("2024-01-07", 2),
        ("2024-02-29", 9),
        ("2023-12-30", 52),  # the last Saturday
        ("2023-12-31", 53),
        ("2000-12-31", 54),  # a leap year from Saturday to Sunday
    ],
)
def test_week_of_year(spark, day, week):
    assert one(spark, week_of_year(F.lit(day).cast("timestamp_ntz"))) == week


def test_week_of_year_follows_its_definition(spark):
    """Counted day by day over thirty years: a new week starts each Sunday and each 1 January is week 1."""
    days = spark.sql("SELECT explode(sequence(date'1999-01-01', date'2028-12-31')) AS d")
    for day, week in days.select("d", week_of_year("d")).orderBy("d").collect():
        if (day.month, day.day) == (1, 1):
            expected = 1
        elif day.weekday() == 6:
            expected += 1
        assert week == expected, day
