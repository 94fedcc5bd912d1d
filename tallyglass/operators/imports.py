"""First looks at an imported table: size, delimiter, control total, sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.casts import strict_cast, typed
from ..functions.text import as_column, is_missing, null_if_blank


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("TotalRows"))


def shape(df: DataFrame) -> DataFrame:
    """Rows and columns, as one row."""
    return df.agg(F.count("*").alias("TotalRows")).withColumn("TotalColumns", F.lit(len(df.columns)))


def delimiter_check(df: DataFrame, column: str, delimiter: str = ",") -> DataFrame:
    """Rows whose text holds the delimiter.

    A free-text column should have some: quoting was understood. The last column should have
    none: no line was split at the wrong place.
    """
    return df.where(F.col(column).contains(delimiter))


def control_total(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Sum of a numeric text column, blanks counting as 0, to compare with the source file.

    An amount that cannot be read stops the job, whatever the session's ANSI setting.
    """
    amount = strict_cast(F.coalesce(null_if_blank(column), F.lit("0")), "decimal(30,10)")
    return df.agg(F.sum(amount).alias(name or f"Total_{column}"))


def preview(
    df: DataFrame,
    n: int = 100,
    columns: Sequence[str] | None = None,
    order_by: Sequence[str | Column] | None = None,
) -> DataFrame:
    """Any ``n`` rows, or the first ``n`` in a given order."""
    rows = df.select(*columns) if columns else df
    if order_by:
        rows = rows.orderBy(*[as_column(c) for c in order_by])
    return rows.limit(n)


def load_measures(df: DataFrame, amount: str | None = None) -> list[Column]:
    """Aggregates that say whether a file came in whole: rows, commas in the last column, a total.

    ``ControlTotal`` adds the ``amount`` column, blanks counting as 0; ``UnreadableAmounts`` counts
    what is neither blank nor a number, so that a load is measured and not stopped by it. The same
    measures can be asked of a table or be observed while it is written.
    """
    total, unreadable = F.lit(None).cast("decimal(38,10)"), F.lit(None).cast("bigint")
    if amount is not None:
        read = typed(amount, "decimal(30,10)")
        total = F.coalesce(F.sum(read), F.lit(0)).cast("decimal(38,10)")
        unreadable = F.count_if(~is_missing(amount) & read.isNull())
    return [
        F.count("*").alias("TotalRows"),
        F.count_if(F.coalesce(F.col(df.columns[-1]).contains(","), F.lit(False))).alias("CommasInLast"),
        (F.max(total) if amount is None else total).alias("ControlTotal"),
        (F.max(unreadable) if amount is None else unreadable).alias("UnreadableAmounts"),
    ]
