"""Text expressions: one definition of "missing" and "length" for the whole library."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters the format checks accept, as patterns for the whole text. One
# anchored match reads a text several times faster than a search for a character outside.
ONLY_ALPHANUMERIC = r"^[a-zA-Z0-9 ]*\z"
ONLY_ASCII = r"^[ -~]*\z"


def as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_missing(c: str | Column) -> Column:
    """True for NULL, empty and all-space text. Never NULL itself."""
    c = as_column(c)
    return c.isNull() | (F.trim(c) == "")


def null_if_blank(c: str | Column) -> Column:
    """Blank text becomes NULL; any other text is returned untouched."""
    c = as_column(c)
    return F.when(F.trim(c) != "", c)


def clean_text(c: str | Column) -> Column:
    """Trim, then turn blank into NULL."""
    return F.nullif(F.trim(as_column(c)), F.lit(""))


def text_length(c: str | Column) -> Column:
    """Length without trailing spaces; NULL for NULL."""
    return F.length(F.rtrim(as_column(c)))


def recode(c: str | Column, mapping: Mapping[str, str | None]) -> Column:
    """Replace listed values, keep all others. Trailing spaces do not count when matching."""
    c = as_column(c)
    if not mapping:
        return c
    out = None
    for old, new in mapping.items():
        test = F.rtrim(c) == old
        new_value = F.lit(new).cast("string")
        out = F.when(test, new_value) if out is None else out.when(test, new_value)
    return out.otherwise(c)


def fold_case(c: str | Column) -> Column:
    """Compare, group or sort without regard to letter case and trailing spaces."""
    return F.collate(as_column(c), "UTF8_LCASE_RTRIM")


def has_non_alphanumeric(c: str | Column) -> Column:
    return ~as_column(c).rlike(ONLY_ALPHANUMERIC)


def has_non_ascii(c: str | Column) -> Column:
    return ~as_column(c).rlike(ONLY_ASCII)
