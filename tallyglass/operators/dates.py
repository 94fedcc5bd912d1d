"""Checks on dates: time of day, gaps, and the delay between two dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.casts import typed
from .values import value_counts


def hour_profile(df: DataFrame, column: str) -> DataFrame:
    """Rows per hour of day. Only hour 0 means there is no time information."""
    hour = F.hour(typed(column, "timestamp_ntz")).alias("HourofTime")
    return value_counts(df, hour, order="value")


def date_gaps(df: DataFrame, column: str, order: str = "gap") -> DataFrame:
    """Each distinct date, the date before it and the days between; by gap size or by date."""
    this, previous, days = f"CAST_{column}", f"Previous_{column}", "Days_Difference"
    # Casting first to a timestamp and then to a date takes text with and without a time of day.
    dates = df.select(typed(column, "timestamp_ntz").cast("date").alias(this)).distinct()
    # One task for the window: distinct calendar days, a few thousand per decade at any data size.
    gaps = dates.withColumn(previous, F.lag(this, 1).over(W.orderBy(this))).withColumn(
        days, F.datediff(this, previous)
    )
    return gaps.orderBy(F.desc(days), this) if order == "gap" else gaps.orderBy(this)


def _date_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    first, second = f"CAST_{a}", f"CAST_{b}"
    pairs = df.select(
        typed(a, "timestamp_ntz").cast("date").alias(first),
        typed(b, "timestamp_ntz").cast("date").alias(second),
    )
    return pairs.where(F.col(first) != F.col(second))


def date_mismatch(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of dates that differ, one per row."""
    return _date_pairs(df, a, b)


def date_lag_profile(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows per number of days from ``a`` to ``b`` where they differ, longest delay first."""
    days = F.datediff(f"CAST_{b}", f"CAST_{a}").alias("Days_Difference")
    counts = value_counts(_date_pairs(df, a, b), days, order=None)
    return counts.orderBy(F.desc("Days_Difference"))
