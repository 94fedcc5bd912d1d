"""Checks on missing values: NULL, empty text and all-space text all count as missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.casts import typed
from ..functions.text import as_column, is_missing
from .values import value_counts


def missing_counts(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    where: Column | None = None,
    total: bool = False,
) -> DataFrame:
    """Missing values per column in one pass: a single row, whatever the number of columns."""
    rows = df if where is None else df.where(where)
    counts = [F.count_if(is_missing(c)).alias(f"{c}_NULLCount") for c in (columns or df.columns)]
    if total:
        counts.append(F.count("*").alias("TotalRows"))
    return rows.agg(*counts)


def missing_range(
    df: DataFrame, column: str, range_columns: Sequence[str], dtype: str | None = "timestamp_ntz"
) -> DataFrame:
    """First and last date among rows where ``column`` is missing.

    Dates are compared as ``dtype``; ``dtype=None`` compares the raw text.
    """
    ends = []
    for c in range_columns:
        value = F.col(c) if dtype is None else typed(c, dtype)
        ends += [F.min(value).alias(f"MIN_{c}"), F.max(value).alias(f"MAX_{c}")]
    return df.where(is_missing(column)).agg(*ends)


def missing_rows(df: DataFrame, column: str) -> DataFrame:
    return df.where(is_missing(column))


def breakdown(
    df: DataFrame, by: str | Sequence[str], where: Column, order: str | None = "count"
) -> DataFrame:
    """Value counts inside the rows that satisfy ``where``."""
    return value_counts(df.where(where), by, order=order)


def missing_pair(df: DataFrame, a: str, b: str) -> DataFrame:
    """Are two columns missing together? Rows per case."""
    missing_a, missing_b = is_missing(a), is_missing(b)
    case = (
        F.when(missing_a & missing_b, "Both Missing")
        .when(missing_a | missing_b, "Only One is Missing")
        .otherwise("Neither Missing")
    )
    return df.groupBy(case.alias("Group")).agg(F.count("*").alias("TotalRows"))


def missing_xor_rows(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows where exactly one of the two columns is missing."""
    return df.where(is_missing(as_column(a)) != is_missing(as_column(b)))
