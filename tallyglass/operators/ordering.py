"""Global row numbers, running totals and percent ranks without a single-task window.

``row_number() over (order by ...)`` with no partition moves every row into one task. Here the
rows are range-partitioned and sorted once and stored with their place (partition, position).
One small row per partition then carries how much lies before it.

The layout is stored, not cached: range bounds are sampled, so recomputing could cut elsewhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import as_column
from ..sources.scratch import store

PART, POSITION = "_part", "_position"
_BEFORE, _AMOUNT, _ARRIVAL, _TIES = "_before", "_amount", "_arrival", "_ties"
_POSITION_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def _sorted_layout(
    df: DataFrame, order_by: Sequence[Column], drop: Sequence[str] = (), partitions: int | None = None
) -> DataFrame:
    ranged = (
        df.repartitionByRange(partitions, *order_by) if partitions else df.repartitionByRange(*order_by)
    )
    slot = F.monotonically_increasing_id()
    placed = (
        ranged.sortWithinPartitions(*order_by)
        .withColumn("_slot", slot)
        .withColumn(PART, F.shiftright("_slot", _POSITION_BITS))
        .withColumn(POSITION, F.col("_slot").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)))
        .drop("_slot", *drop)
    )
    return store(placed, "sorted")


def _amount_before(layout: DataFrame, amount: Column) -> DataFrame:
    """Per partition, the amount in all earlier partitions. One row per sort partition."""
    totals = layout.groupBy(PART).agg(amount.alias(_AMOUNT))
    earlier = W.orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    return totals.select(PART, F.coalesce(F.sum(_AMOUNT).over(earlier), F.lit(0)).alias(_BEFORE))


def add_row_id(
    df: DataFrame,
    order_by: Sequence[str | Column],
    name: str = "row_id",
    unique_order: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """Number all rows 1..n in ``order_by`` order (NULL first). Runs a job.

    Rows equal in every order column may get their numbers in any order. Unless ``unique_order``
    says there are none, the arrival order breaks such ties, so a large group of copies spreads
    over many range partitions. Arrival order repeats when a task is rerun over files; give this
    a file scan or a stored table, not a fresh shuffle.
    """
    keys = [as_column(c) for c in order_by]
    ties: list[str] = []
    if not unique_order:
        df = df.withColumn(_ARRIVAL, F.monotonically_increasing_id())
        keys.append(F.col(_ARRIVAL))
        ties = [_ARRIVAL]
    layout = _sorted_layout(df, keys, drop=ties, partitions=partitions)
    # Broadcast size: one row of two numbers per sort partition, whatever the data size.
    before = F.broadcast(_amount_before(layout, F.count("*")))
    numbered = layout.join(before, PART)
    return numbered.withColumn(name, F.col(_BEFORE) + F.col(POSITION) + 1).drop(PART, POSITION, _BEFORE)


def add_amount_before(
    df: DataFrame, order_by: Sequence[str | Column], amount: str, name: str, partitions: int | None = None
) -> DataFrame:
    """Sum of ``amount`` over all rows sorted before this one. Runs a job.

    ``order_by`` must be unique per row, as it is for a table of grouped values.
    """
    layout = _sorted_layout(df, [as_column(c) for c in order_by], partitions=partitions)
    before = F.broadcast(_amount_before(layout, F.sum(amount)))
    inside = W.partitionBy(PART).orderBy(POSITION).rowsBetween(W.unboundedPreceding, -1)
    return (
        layout.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .join(before, PART)
        .withColumn(name, F.col(_BEFORE) + F.col("_inside"))
        .drop(PART, POSITION, _BEFORE, "_inside")
    )


def add_percent_rank(
    df: DataFrame, value: str, name: str, descending: bool = True, partitions: int | None = None
) -> DataFrame:
    """``percent_rank()`` over all rows: ties share (rank - 1) / (n - 1), 0 when n is 1. Runs a job.

    Works on the counted values: the rank of a value is one more than the rows before it.
    """
    order = F.col(value).desc() if descending else F.col(value).asc()
    counted = df.groupBy(value).agg(F.count("*").alias(_TIES))
    ranked = add_amount_before(counted, [order], _TIES, "_rows_before", partitions)
    others = ranked.agg(F.sum(_TIES) - 1).scalar()
    ranks = ranked.select(
        F.col(value).alias("_value"),
        F.when(others == 0, F.lit(0.0))
        .otherwise(F.col("_rows_before").cast("double") / others)
        .alias(name),
    )
    # No broadcast hint: there may be as many values as rows. Spark decides by measured size.
    return df.join(ranks, F.col(value).eqNullSafe(F.col("_value"))).drop("_value")
