"""Many checks that group rows, one scan and one pair of shuffles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_column
from ..operators.values import Names, as_list

#: Which groups a check reports.
RULES = {
    "all": "true",
    "repeated": "TotalRows > 1",
    "not_one": "UniqueValues <> 1",
    "many": "UniqueValues > 1",
    "not_rows": "UniqueValues <> TotalRows",
}


@dataclass(frozen=True)
class GroupCheck:
    """Rows, and different values if ``value`` is given, per combination of ``keys``.

    ``rule`` says which groups are reported: ``all``, ``repeated`` (several rows), ``not_one``
    (anything but one value), ``many`` (two or more) or ``not_rows`` (some value repeats). Keys and
    values may be expressions; NULL keys form a group, NULL values are not counted.
    """

    name: str
    keys: Names
    value: str | Column | None = None
    rule: str = "all"

    def __post_init__(self) -> None:
        if self.rule not in RULES:
            raise ValueError(f"rule must be one of {', '.join(RULES)}, not {self.rule!r}")
        if self.value is None and self.rule not in ("all", "repeated"):
            raise ValueError(f"{self.name}: rule {self.rule!r} needs a value to count")


def run_group_checks(df: DataFrame, checks: Sequence[GroupCheck]) -> DataFrame:
    """The groups that every check reports: its name, keys as text, rows and different values.

    A row of the table gives one small row per check. These are folded by check, keys and value in
    each task, then counted per check and keys. The first shuffle goes by value too, so a hot key is
    dealt out over all partitions before its values are counted; a check without a value sends one
    row per task and key. Checks that share keys and value are worked out once. ``UniqueValues`` is
    NULL for a check without a value; one name may stand on one check only.
    """
    if len({c.name for c in checks}) != len(checks) or not checks:
        raise ValueError("checks need names of their own, and at least one check")
    # Checks alike in keys and value have one number, so one set of groups.
    alike = [_alike(c) for c in checks]
    number = {a: i for i, a in enumerate(dict.fromkeys(alike))}
    counted = {number[a]: c for a, c in zip(alike, checks)}
    small = [
        F.struct(F.lit(i).alias("_check"), _keys(c).alias("keys"), _value(c).alias("_value"))
        for i, c in counted.items()
    ]
    folded = (
        df.select(F.inline(F.array(*small)))
        .groupBy("_check", "keys", "_value")
        .agg(F.count("*").alias("_rows"))
    )
    has_value = F.col("_check").isin([i for i, c in counted.items() if c.value is not None])
    groups = folded.groupBy("_check", "keys").agg(
        F.sum("_rows").alias("TotalRows"),
        F.when(has_value, F.count("_value")).alias("UniqueValues"),
    )
    reported = [
        F.when((F.col("_check") == number[a]) & F.expr(RULES[c.rule]), F.lit(c.name))
        for a, c in zip(alike, checks)
    ]
    return groups.select(
        F.explode(F.array_compact(F.array(*reported))).alias("check"), "keys", "TotalRows", "UniqueValues"
    )


def _alike(check: GroupCheck) -> object:
    """Equal for checks on the same columns. Expressions are not compared, as their text can mislead."""
    keys = as_list(check.keys)
    plain = all(isinstance(k, str) for k in keys) and isinstance(check.value, str | None)
    return (tuple(keys), check.value) if plain else check.name


def _keys(check: GroupCheck) -> Column:
    return F.array(*[as_column(k).cast("string") for k in as_list(check.keys)])


def _value(check: GroupCheck) -> Column:
    return as_column(check.value if check.value is not None else F.lit(None)).cast("string")
