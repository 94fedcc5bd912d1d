"""Many counters, one scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.casts import typed
from ..functions.text import has_non_alphanumeric, has_non_ascii, is_missing, text_length

_COUNTERS = (
    "missing",
    "min_length",
    "max_length",
    "with_comma",
    "non_alphanumeric",
    "non_ascii",
    "cast_failures",
)


def scan_profile(
    df: DataFrame, columns: Sequence[str] | None = None, types: Mapping[str, str] | None = None
) -> DataFrame:
    """One row per column: missing values, text lengths, odd characters, failed casts.

    All counters of all columns come from a single aggregate over a single scan; the one wide
    row is then turned into a row per column. ``types`` names the type each column should cast to.
    """
    columns, types = list(columns or df.columns), types or {}
    measures = [F.count("*").alias("rows")]
    for c in columns:
        fails = F.lit(False)
        if c in types:
            fails = ~is_missing(c) & typed(c, types[c]).isNull()
        by_name = {
            "missing": F.count_if(is_missing(c)),
            "min_length": F.min(text_length(c)),
            "max_length": F.max(text_length(c)),
            "with_comma": F.count_if(F.col(c).contains(",")),
            "non_alphanumeric": F.count_if(has_non_alphanumeric(c)),
            "non_ascii": F.count_if(has_non_ascii(c)),
            "cast_failures": F.count_if(fails),
        }
        measures += [by_name[k].alias(f"{c}.{k}") for k in _COUNTERS]
    wide = df.agg(*measures)
    per_column = [
        F.struct(F.lit(c).alias("column"), F.col("rows"), *[F.col(f"`{c}.{k}`").alias(k) for k in _COUNTERS])
        for c in columns
    ]
    return wide.select(F.inline(F.array(*per_column)))


def value_counts_of_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Value counts of several text columns from one scan and one shuffle.

    Each task counts its own values first, so what is shuffled is values, not rows.
    """
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns]
    long = df.select(F.inline(F.array(*pairs)))
    counts = long.groupBy("column", "value").agg(F.count("*").alias("TotalRows"))
    return counts.orderBy("column", F.desc("TotalRows"), "value")
