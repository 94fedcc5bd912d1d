"""Checks on keys: repeats, conflicts, and how many values hang on one key.

Distinct counts per key need no care for hot keys: Spark first removes repeats by (key, value),
which spreads a hot key over all partitions, and only then counts per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, text_length
from .values import Names, as_list


def duplicate_keys(df: DataFrame, keys: Names, sort: bool = False) -> DataFrame:
    """Key combinations with more than one row. Keys may be expressions such as casts."""
    by = as_list(keys)
    counts = df.groupBy(*by).agg(F.count("*").alias("TotalRows"))
    repeated = counts.where(F.col("TotalRows") > 1)
    return repeated.orderBy(F.desc("TotalRows"), *counts.columns[: len(by)]) if sort else repeated


def length_varies(df: DataFrame, by: Names, column: str) -> DataFrame:
    """Groups in which ``column`` has more than one text length."""
    lengths = F.count_distinct(text_length(column)).alias("UniqueField_Length")
    return df.groupBy(*as_list(by)).agg(lengths).where(F.col("UniqueField_Length") > 1)


def single_valued(
    df: DataFrame, key: str, column: str, mode: str = "not_one", missing: str = "as_is"
) -> DataFrame:
    """Keys that break a rule on the number of different ``column`` values.

    ``mode``: ``not_one`` (anything but one), ``many`` (two or more), ``not_rows`` (differs from
    the number of rows, so some value repeats).
    ``missing``: ``as_is`` counts blank text as a value and NULL not; ``ignore`` counts neither;
    ``one_value`` counts all missing as one common value.
    """
    kept = {
        "as_is": lambda: F.col(column),
        "ignore": lambda: clean_text(column),
        "one_value": lambda: F.coalesce(clean_text(column), F.lit("0")),
    }[missing]()
    unique, rows = f"Unique_{column}", "TotalRows"
    breaks = {
        "not_one": F.col(unique) != 1,
        "many": F.col(unique) > 1,
        "not_rows": F.col(unique) != F.col(rows),
    }[mode]
    return (
        df.groupBy(key)
        .agg(F.count_distinct(kept).alias(unique), F.count("*").alias(rows))
        .where(breaks)
    )


def parents_per_child(df: DataFrame, child: str, parent: str) -> DataFrame:
    """How many different parents each child has, most first."""
    unique = f"Unique_{parent}"
    parents = df.groupBy(child).agg(F.count_distinct(parent).alias(unique))
    return parents.orderBy(F.desc(unique), child)


def conflicting_keys(
    df: DataFrame, key: str | Column, attributes: Sequence[str], name: str = "CAST_BARCODE"
) -> DataFrame:
    """Keys, such as barcodes after a cast, that come with more than one set of attributes."""
    keyed = df.select(*attributes, (F.col(key) if isinstance(key, str) else key).alias(name))
    variants = keyed.where(F.col(name).isNotNull()).distinct()
    return variants.groupBy(name).agg(F.count("*").alias("TotalRows")).where(F.col("TotalRows") > 1)


def review_conflicts(
    df: DataFrame,
    conflicts: DataFrame,
    key: str | Column,
    name: str = "CAST_BARCODE",
    sort: bool = True,
) -> DataFrame:
    """All source rows of the conflicting keys with the number of variants, in key order.

    The list of conflicts grows with the data, so it carries no broadcast hint: Spark broadcasts
    it when it is measured small and otherwise joins by shuffle. Sorting ranges on whole rows, so
    only full copies of a row meet; ``sort=False`` leaves it out.
    """
    keyed = df.withColumn(name, F.col(key) if isinstance(key, str) else key)
    rows = keyed.join(conflicts, name)
    return rows.orderBy(name, *df.columns) if sort else rows
