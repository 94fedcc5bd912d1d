"""The numbers a box plot draws: quartiles, whiskers, outliers. Exact at any size, and lazy.

No value is sorted. A mergeable quantile sketch says between which two values each quartile lies;
one counting pass then makes it exact: the rows below the bracket are counted, and only the
different values inside it are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.casts import typed

_QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
_REACH = 1.5  # whiskers reach at most this many quartile ranges beyond the box
_LEAST_WIDTH = 4  # rows to either side of a quartile that a bracket must hold at least


def _widths(accuracy: int) -> list[float]:
    """Bracket half-widths as shares of the rows: twice the sketch's error, and wider for few rows."""
    widths = [2 / accuracy]
    while widths[-1] < 1:
        widths.append(min(1.0, widths[-1] * 10))
    return widths


def _brackets(values: DataFrame, accuracy: int) -> Column:
    """Number of values, and the ends of each quartile's bracket, as one struct. One pass.

    All brackets that may be needed come from one sketch; the narrowest that holds enough rows is
    taken, so tables of any size go the same way.
    """
    widths = _widths(accuracy)
    # The last one takes all values and so is always wide enough.
    shares = [[p for q in _QUARTILES.values() for p in (max(q - w, 0.0), min(q + w, 1.0))] for w in widths]
    sketch = F.percentile_approx("value", [p for some in shares for p in some], accuracy)
    facts = values.agg(F.count("*").alias("n"), sketch.alias("at"))
    per_width = 2 * len(_QUARTILES)
    choice = F.lit(len(widths) - 1)
    for k in reversed(range(len(widths) - 1)):
        choice = F.when(F.col("n") * widths[k] >= _LEAST_WIDTH, k).otherwise(choice)
    ends = {
        f"{name}_{end}": F.get("at", choice * per_width + 2 * k + j)
        for k, name in enumerate(_QUARTILES)
        for j, end in enumerate(("low", "high"))
    }
    return facts.select(F.struct("n", *[c.alias(name) for name, c in ends.items()]).alias("f")).scalar()


def _exact_quartiles(values: DataFrame, counted: DataFrame, accuracy: int) -> Column:
    """The quartiles by linear interpolation between the two nearest values, as one struct."""
    # Each subquery is a column of its own, so that the plan holds it once and not at every use.
    framed = counted.withColumn("f", _brackets(values, accuracy))
    value, n = F.col("value"), F.col("n")
    under = [F.coalesce(F.sum(F.when(value < F.col(f"f.{q}_low"), n)), F.lit(0)).alias(q) for q in _QUARTILES]
    below = framed.agg(F.struct(*under).alias("b")).scalar()
    inside = [
        F.when(
            value.between(F.col(f"f.{q}_low"), F.col(f"f.{q}_high")),
            F.struct(F.lit(q).alias("q"), ((F.col("f.n") - 1) * share).alias("place"), F.col(f"b.{q}").alias("below")),
        )
        for q, share in _QUARTILES.items()
    ]
    near = framed.withColumn("b", below).select("value", "n", F.explode(F.array_compact(F.array(*inside))).alias("in"))
    # A window a quartile: the different values of its bracket, a fixed small share of the rows.
    earlier = W.partitionBy("q").orderBy("value").rowsBetween(W.unboundedPreceding, -1)
    placed = near.select("value", "n", "in.*").withColumn("before", F.col("below") + F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    low, high = F.floor("place"), F.ceil("place")

    def value_at(k: Column) -> Column:
        return F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), value))

    part = F.max(F.col("place") - low)
    found = placed.groupBy("q").agg((value_at(low) + (value_at(high) - value_at(low)) * part).alias("v"))
    return found.agg(F.struct(*[F.max(F.when(F.col("q") == q, F.col("v"))).alias(q) for q in _QUARTILES]).alias("x")).scalar()


def box_summary(df: DataFrame, column: str, accuracy: int = 10_000, approx: bool = False) -> DataFrame:
    """One row: n, q1, median, q3, whisker ends and the number of rows beyond them. Lazy.

    A whisker ends at the last value within 1.5 quartile ranges of the box, or at the box if
    there is none. ``accuracy`` sets the size of the sketch: a bracket holds at most 4 / accuracy of
    the rows. ``approx`` takes the quartiles from the sketch as they are, with an error in rank
    of at most 1 / accuracy, and saves the pass that makes them exact.
    """
    values = df.select(typed(column, "double").alias("value")).where("value IS NOT NULL")
    counted = values.groupBy("value").agg(F.count("*").alias("n"))
    if approx:
        sketch = F.percentile_approx("value", list(_QUARTILES.values()), accuracy)
        found = values.agg(sketch.alias("at")).select(F.struct(*[F.get("at", F.lit(k)).alias(q) for k, q in enumerate(_QUARTILES)]).alias("x")).scalar()
    else:
        found = _exact_quartiles(values, counted, accuracy)
    reach = (F.col("x.q3") - F.col("x.q1")) * _REACH
    value, n = F.col("value"), F.col("n")
    boxed = counted.withColumn("x", found).select("value", "n", "x.*", (F.col("x.q1") - reach).alias("floor"), (F.col("x.q3") + reach).alias("ceiling"))
    q1, q3 = F.max("q1"), F.max("q3")
    return boxed.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("n"),
        *[F.max(q).alias(q) for q in _QUARTILES],
        F.least(F.min(F.when(value >= F.col("floor"), value)), q1).alias("whisker_low"),
        F.greatest(F.max(F.when(value <= F.col("ceiling"), value)), q3).alias("whisker_high"),
        F.coalesce(F.sum(F.when(value < F.col("floor"), n)), F.lit(0)).alias("low_outliers"),
        F.coalesce(F.sum(F.when(value > F.col("ceiling"), n)), F.lit(0)).alias("high_outliers"),
    )


def box_outliers(df: DataFrame, column: str, summary: DataFrame) -> DataFrame:
    """The rows beyond the whiskers of a ``box_summary`` of the same column."""
    value = typed(column, "double")
    ends = summary.select(F.struct("whisker_low", "whisker_high").alias("ends")).scalar()
    return df.where((value < ends["whisker_low"]) | (value > ends["whisker_high"]))
