"""Column helpers. Everything here is a built-in Spark expression; there are no UDFs."""

from .casts import strict_cast, typed
from .dates import GENERATION_BANDS, generation, week_of_year
from .text import (
    as_column,
    clean_text,
    fold_case,
    has_non_alphanumeric,
    has_non_ascii,
    is_missing,
    null_if_blank,
    recode,
    text_length,
)

__all__ = [
    "GENERATION_BANDS",
    "as_column",
    "clean_text",
    "fold_case",
    "generation",
    "has_non_alphanumeric",
    "has_non_ascii",
    "is_missing",
    "null_if_blank",
    "recode",
    "strict_cast",
    "text_length",
    "typed",
    "week_of_year",
]
