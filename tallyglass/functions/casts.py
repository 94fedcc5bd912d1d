"""Casts from raw text. ``typed`` forgives, ``strict_cast`` stops the job on a bad value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_column, is_missing

# What numbers and dates start with: a sign, a point or a digit, maybe after spaces.
_NUMBER_START = "^ *[-+.0-9]"


def typed(c: str | Column, dtype: str, fmt: str | None = None) -> Column:
    """Cast text to a number or date type; what does not cast becomes NULL.

    Spark raises and catches an exception for each value that fails a cast, which costs far more
    than the cast. Blanks and words are therefore set to NULL before it.

    ``fmt`` is a datetime pattern for text that is not ISO; it applies to ``date`` and
    ``timestamp_ntz``. Patterns are read in the session time zone, so keep that at UTC.
    """
    c = as_column(c)
    if fmt is not None:
        return F.try_to_timestamp(F.when(~is_missing(c), c), F.lit(fmt)).cast(dtype)
    return F.when(c.rlike(_NUMBER_START), c).try_cast(dtype)


def strict_cast(c: str | Column, dtype: str, fmt: str | None = None) -> Column:
    """Cast text to ``dtype``; missing gives NULL, any other value that does not cast raises.

    The raise is part of the expression, so it does not depend on the session's ANSI setting.
    """
    c = as_column(c)
    message = F.concat(F.lit("cannot cast to "), F.lit(dtype), F.lit(": "), c)
    # The cast comes first and once; only what it leaves NULL is looked at again.
    bad_value = F.when(~is_missing(c), F.raise_error(message).cast(dtype))
    return F.coalesce(typed(c, dtype, fmt), bad_value)
