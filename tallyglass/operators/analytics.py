"""Answers: shares, activity, leaders."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.dates import generation, week_of_year
from ..functions.text import as_column

WEEKS, RECEIPTS = "CountofWeeks", "UniqueReceiptsScanned"


def with_generation(df: DataFrame, birth_date: str, name: str = "GENERATION") -> DataFrame:
    return df.withColumn(name, generation(F.year(birth_date)))


def cut_off(share: str | Column, places: int = 6) -> Column:
    """Cut, not round, to a number of decimals: toward zero, so a negative share is cut alike.

    The result is an exact decimal(38, places).
    """
    scale = 10**places
    c = as_column(share)
    cut = F.when(c < 0, F.ceil(c * scale)).otherwise(F.floor(c * scale))
    unit = F.lit(Decimal(1).scaleb(-places)).cast(f"decimal({places + 1},{places})")
    return (cut.cast(f"decimal({37 - 2 * places},0)") * unit).cast(f"decimal(38,{places})")


def share_of_total(
    df: DataFrame,
    group: str,
    value: str,
    exclude: str | None = None,
    name: str = "PERCENTAGE_OF_TOTAL",
) -> DataFrame:
    """Share of each group in the sum of ``value``, and again with the group ``exclude`` left out.

    A total of zero or NULL gives NULL. The totals are a one-row aggregate of the group sums, read
    as scalar subqueries, so any number of groups works.
    """
    sums = df.groupBy(group).agg(F.sum(value).alias("_sum"))
    whole = sums.agg(F.nullif(F.sum("_sum"), F.lit(0)).alias("_total")).scalar()
    shares = [(F.col("_sum") / whole).alias(name)]
    if exclude is not None:
        kept = F.when(F.col(group) == exclude, None).otherwise(F.col("_sum"))
        rest = sums.agg(F.nullif(F.sum(kept), F.lit(0)).alias("_total")).scalar()
        shares.append((kept / rest).alias(f"{name}_No{exclude}"))
    return sums.select(group, *shares).orderBy(group)


def active_weeks(df: DataFrame, ts: str = "SCAN_DATE", year_aware: bool = False) -> DataFrame:
    """Distinct week numbers. ``year_aware`` tells the weeks of different years apart."""
    parts = [week_of_year(ts).alias("Week_of_Year")]
    if year_aware:
        parts.insert(0, F.year(ts).alias("Year"))
    weeks = df.select(*parts).distinct()
    return weeks.orderBy(*weeks.columns)


def user_activity(
    df: DataFrame,
    user: str = "USER_ID",
    ts: str = "SCAN_DATE",
    receipt: str = "RECEIPT_ID",
    year_aware: bool = False,
) -> DataFrame:
    """Distinct weeks and distinct receipts per user.

    Two distinct counts would make Spark double every row. There are at most 54 week numbers, so
    a 64-bit mask holds the weeks of a user exactly, and only receipts need a distinct count.
    """
    week = week_of_year(ts)
    if year_aware:
        weeks = F.count_distinct(F.year(ts) * 100 + week)
    else:
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), week)
        weeks = F.coalesce(F.bit_count(F.bit_or(bit)), F.lit(0)).cast("bigint")
    return df.groupBy(user).agg(
        weeks.alias(WEEKS), F.count_distinct(receipt).alias(RECEIPTS)
    )


def _value_ranks(activity: DataFrame, metric: str, name: str) -> DataFrame:
    """Percent rank, highest first, of each value of a metric that counts things per user."""
    # Counting pairs of values first lets both metrics share one pass over the users.
    pairs = activity.groupBy(WEEKS, RECEIPTS).agg(F.count("*").alias("_n"))
    per_value = pairs.groupBy(metric).agg(F.sum("_n").alias("_users"))
    # One task for the windows, with a proven bound: k different receipt counts need at least
    # k(k-1)/2 receipts, so even 10^11 receipts give fewer than 450,000 rows. Weeks give 55.
    higher = W.orderBy(F.desc(metric)).rowsBetween(W.unboundedPreceding, -1)
    above = F.coalesce(F.sum("_users").over(higher), F.lit(0)).cast("double")
    others = F.sum("_users").over(W.partitionBy()) - 1
    # With a single user the divisor is NULL and the rank 0.
    rank = F.coalesce(above / F.nullif(others, F.lit(0)), F.lit(0.0))
    return per_value.select(metric, rank.alias(name))


def _top_cutoff(activity: DataFrame, metric: str, p: float) -> Column:
    """The lowest value of ``metric`` whose percent rank is at most ``p``."""
    ranks = _value_ranks(activity, metric, "_rank")
    return ranks.where(F.col("_rank") <= p).agg(F.min(metric)).scalar()


def power_users(
    df: DataFrame,
    p: float = 0.01,
    user: str = "USER_ID",
    ts: str = "SCAN_DATE",
    receipt: str = "RECEIPT_ID",
    year_aware: bool = False,
) -> DataFrame:
    """Users in the top ``p`` both by active weeks and by receipts, with both counts.

    A percent rank only depends on the value, so being in the top is being at or above a cut-off.
    The two cut-offs come from one count of value pairs; the users are then only filtered.
    """
    activity = user_activity(df, user, ts, receipt, year_aware)
    return activity.where(
        (F.col(WEEKS) >= _top_cutoff(activity, WEEKS, p))
        & (F.col(RECEIPTS) >= _top_cutoff(activity, RECEIPTS, p))
    )


def ranked_users(
    df: DataFrame, user: str = "USER_ID", ts: str = "SCAN_DATE", receipt: str = "RECEIPT_ID"
) -> DataFrame:
    """Every user with both percent ranks, highest first."""
    activity = user_activity(df, user, ts, receipt)
    by_weeks = _value_ranks(activity, WEEKS, "Percentile_Weeks")
    by_receipts = _value_ranks(activity, RECEIPTS, "Percentile_Receipts")
    ranked = activity.join(by_weeks, WEEKS).join(by_receipts, RECEIPTS)
    return ranked.select(user, "Percentile_Weeks", "Percentile_Receipts")


def locate_value(df: DataFrame, columns: Sequence[str], value: str) -> DataFrame:
    """Distinct combinations of ``columns`` where any of them equals ``value``."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | (F.col(c) == value)
    return df.select(*columns).where(hit).distinct()


def leading_by_receipts(
    df: DataFrame,
    category: str,
    category_column: str = "BARCODE_CATEGORY_2",
    by: str = "BARCODE_BRAND",
    receipt: str = "RECEIPT_ID",
    leaders: bool = False,
) -> DataFrame:
    """Receipts per ``by`` value inside one category, most first. NULL values are left out.

    With ``leaders`` only the values with the most receipts stay, all of them if they tie.
    """
    rows = df.where((F.col(category_column) == category) & F.col(by).isNotNull())
    # Distinct rows, not count(distinct): a receipt without an id counts as one receipt too.
    counts = rows.select(by, receipt).distinct().groupBy(by).agg(F.count("*").alias("TotalReceipts"))
    if leaders:
        most = counts.agg(F.max("TotalReceipts")).scalar()
        counts = counts.where(F.col("TotalReceipts") == most)
    return counts.orderBy(F.desc("TotalReceipts"), by)


def top_per_group(
    df: DataFrame,
    item: str = "STORE_NAME",
    birth_date: str = "USERID_BIRTH_DATE",
    receipt: str = "RECEIPT_ID",
    top: int = 1,
) -> DataFrame:
    """The ``item`` with the most receipts in each generation; ties are all kept.

    The filter on the rank lets Spark cut each task's groups to the leaders before the shuffle.
    """
    seen = df.where(F.col(item).isNotNull()).select(
        receipt, item, F.year(birth_date).alias("_birth_year")
    )
    counts = (
        seen.distinct()
        .groupBy(generation("_birth_year").alias("GENERATION"), item)
        .agg(F.count("*").alias("TotalReceipts"))
    )
    rank = F.rank().over(W.partitionBy("GENERATION").orderBy(F.desc("TotalReceipts")))
    ranked = counts.withColumn("StoreRanking", rank).where(F.col("StoreRanking") <= top)
    return ranked.orderBy("TotalReceipts", "GENERATION", item)
