"""Checks on values: how often, which ones, how long, in which format."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.casts import typed
from ..functions.text import (
    as_column,
    has_non_alphanumeric,
    has_non_ascii,
    is_missing,
    text_length,
)

Names = str | Column | Sequence[str | Column]


def as_list(by: Names) -> list[str | Column]:
    return [by] if isinstance(by, (str, Column)) else list(by)


def _sorted_counts(counts: DataFrame, order: str | None, by: list[str], count: str = "TotalRows") -> DataFrame:
    # Counts alone are few and heavily tied, and a sort ranges on its keys: without the value as
    # second key most rows would land in one range.
    if order == "count":
        return counts.orderBy(F.desc(count), *by)
    if order == "value":
        return counts.orderBy(*by)
    if order is None:
        return counts
    raise ValueError(f"order must be 'count', 'value' or None, not {order!r}")


def value_counts(
    df: DataFrame,
    by: Names,
    order: str | None = "count",
    distinct_of: str | None = None,
    distinct_name: str | None = None,
    drop_missing: bool = False,
) -> DataFrame:
    """Rows per value or combination, and the number of different ``distinct_of`` values if asked.

    Missing values form a group of their own unless ``drop_missing``.
    """
    keys = as_list(by)
    if drop_missing:
        for key in keys:
            df = df.where(~is_missing(key))
    measures = [F.count("*").alias("TotalRows")]
    if distinct_of:
        measures.append(F.count_distinct(distinct_of).alias(distinct_name or f"Unique_{distinct_of}"))
    grouped = df.groupBy(*keys).agg(*measures)
    return _sorted_counts(grouped, order, grouped.columns[: len(keys)])


def distinct_values(df: DataFrame, columns: Names, where: Column | None = None) -> DataFrame:
    """Sorted distinct values or combinations."""
    rows = df if where is None else df.where(where)
    found = rows.select(*as_list(columns)).distinct()
    return found.orderBy(*found.columns)


def length_profile(df: DataFrame, column: str) -> DataFrame:
    """Rows per text length, most frequent first."""
    return value_counts(df, text_length(column).alias("Field_Length"))


def pattern_violations(df: DataFrame, column: str, pattern: str | None = None) -> DataFrame:
    """Distinct values holding a character outside letters, digits and space (or ``pattern``)."""
    test = has_non_alphanumeric(column) if pattern is None else F.col(column).rlike(pattern)
    return distinct_values(df, column, test)


def non_ascii_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values holding a character outside printable ASCII."""
    return distinct_values(df, column, has_non_ascii(column))


def lookup(df: DataFrame, predicate: Column, order_by: Names | None = None) -> DataFrame:
    """Rows that satisfy a predicate, for looking at examples."""
    rows = df.where(predicate)
    return rows if order_by is None else rows.orderBy(*as_list(order_by))


def cast_audit(
    df: DataFrame,
    column: str,
    dtype: str,
    ignore: Sequence[str] = (),
    ignore_missing: bool = True,
    only_failures: bool = True,
) -> DataFrame:
    """Each value beside its cast; by default only values that do not cast.

    ``ignore`` lists words that are known and dealt with in staging.
    """
    name = f"CAST_{column}"
    rows = df.select(column, typed(column, dtype).alias(name))
    if not only_failures:
        return rows
    rows = rows.where(F.col(name).isNull())
    if ignore_missing:
        rows = rows.where(~is_missing(column))
    return _without(rows, column, ignore)


def _without(df: DataFrame, column: str, ignore: Sequence[str]) -> DataFrame:
    if not ignore:
        return df
    return df.where(F.col(column).isNull() | ~F.rtrim(F.col(column)).isin(*ignore))


def decimal_format(
    df: DataFrame, column: str, test: str = "fraction", ignore: Sequence[str] = ()
) -> DataFrame:
    """Rows by the look of a number: ``fraction`` = cents other than 00, ``places`` = no ``.dd`` end."""
    rows = _without(df.where(~is_missing(column)), column, ignore)
    if test == "fraction":
        return rows.where(F.right(F.col(column), F.lit(2)) != "00")
    if test == "places":
        return rows.where(F.left(F.right(F.col(column), F.lit(3)), F.lit(1)) != ".")
    raise ValueError(f"test must be 'fraction' or 'places', not {test!r}")


def spread(
    df: DataFrame,
    column: str,
    dtype: str,
    ignore: Sequence[str] = (),
    drop_missing: bool = False,
) -> DataFrame:
    """Rows per typed value, in value order."""
    rows = _without(df, column, ignore)
    if drop_missing:
        rows = rows.where(~is_missing(column))
    return value_counts(rows, typed(column, dtype).alias(f"CAST_{column}"), order="value")


def zero_quantity_with_sale(
    quantity: str = "FINAL_QUANTITY", sale: str = "FINAL_SALE", zero_word: str = "zero"
) -> Column:
    """Rule: nothing was bought, yet money was paid."""
    none_bought = (typed(quantity, "decimal(15,2)") == 0) | (F.rtrim(as_column(quantity)) == zero_word)
    return none_bought & (typed(sale, "decimal(15,2)") > 0)


def quantity_without_sale(quantity: str = "FINAL_QUANTITY", sale: str = "FINAL_SALE") -> Column:
    """Rule: something was bought, yet the amount is missing or zero."""
    unpaid = is_missing(sale) | (typed(sale, "decimal(15,2)") == 0)
    return (typed(quantity, "decimal(15,2)") > 0) & unpaid


def rule_violations(df: DataFrame, rule: Column) -> DataFrame:
    """Rows that break a cross-field rule."""
    return df.where(rule)
