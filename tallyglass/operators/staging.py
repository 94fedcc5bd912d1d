"""Staging: raw text tables become typed tables with a row number.

Row numbers follow the raw text order over all columns. The raw rows are sorted and stored, and
the casts are applied when that layout is read, so the sort moves each value once, as text.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.casts import strict_cast, typed
from ..functions.text import clean_text, is_missing, null_if_blank, recode
from ..sources.schemas import RAW_PRODUCTS, RAW_TRANSACTION
from ..sources.scratch import store
from .ordering import add_row_id

# Spellings that staging unifies.
QUANTITY_WORDS = {"zero": "0"}
GENDER_SPELLINGS = {
    "": None,
    "Prefer not to say": "prefer_not_to_say",
    "Non-Binary": "non_binary",
    "My gender isn't listed": "not_listed",
    "not_specified": "not_listed",
}
UNREVIEWED_CATEGORY = {"": None, "Needs Review": None}

# Raw column -> stage type, for the columns that change type.
TRANSACTION_TYPES = {
    "PURCHASE_DATE": "timestamp_ntz",
    "SCAN_DATE": "timestamp_ntz",
    "BARCODE": "bigint",
    "FINAL_QUANTITY": "decimal(15,2)",
    "FINAL_SALE": "decimal(15,2)",
}
USER_TYPES = {"CREATED_DATE": "timestamp_ntz", "BIRTH_DATE": "timestamp_ntz"}
PRODUCT_TYPES = {"BARCODE": "bigint"}

# Order of the row numbers, by the first column of the raw table.
_ORDER = {
    "RECEIPT_ID": RAW_TRANSACTION.fieldNames(),
    "ID": ["ID"],
    "CATEGORY_1": ["BARCODE", *(n for n in RAW_PRODUCTS.fieldNames() if n != "BARCODE")],
}


def _readable_text(column: str) -> Column:
    """The text that gets cast: known words replaced, nothing else changed."""
    return recode(column, QUANTITY_WORDS) if column == "FINAL_QUANTITY" else F.col(column)


def _fails_cast(column: str, dtype: str, fmt: str | None) -> Column:
    text = _readable_text(column)
    return ~is_missing(text) & typed(text, dtype, fmt).isNull()


def _date_format(dtype: str, fmt: str | None) -> str | None:
    return fmt if dtype == "timestamp_ntz" else None


def _worked_out(raw: DataFrame) -> DataFrame:
    """The same rows, each given by a generator, so that what is above reads finished values.

    Else Spark moves a filter on casts down to where the text is made, into a join if the raw table
    is one, and writes out the making of a text anew for each of its many uses in the filter. That
    code is then too long for the JVM to compile, and runs some twenty times slower.
    """
    return raw.select(F.inline(F.array(F.struct(*raw.columns))))


def rejected_rows(raw: DataFrame, types: Mapping[str, str], date_format: str | None = None) -> DataFrame:
    """Raw rows with a value that does not cast, and the names of the columns at fault."""
    faults = [
        F.when(_fails_cast(c, t, _date_format(t, date_format)), F.lit(c)) for c, t in types.items()
    ]
    marked = _worked_out(raw).withColumn("cast_errors", F.array_compact(F.array(*faults)))
    return marked.where(F.size("cast_errors") > 0)


def _casts(types: Mapping[str, str], on_error: str, date_format: str | None) -> dict[str, Column]:
    cast = strict_cast if on_error == "fail" else typed
    return {
        c: cast(_readable_text(c), t, _date_format(t, date_format)).alias(c) for c, t in types.items()
    }


def _accepted(raw: DataFrame, types: Mapping[str, str], on_error: str, date_format: str | None) -> DataFrame:
    if on_error in ("fail", "null"):
        return raw
    if on_error == "quarantine":
        raw = _worked_out(raw)
        for c, t in types.items():
            raw = raw.where(~_fails_cast(c, t, _date_format(t, date_format)))
        return raw
    raise ValueError(f"on_error must be 'fail', 'null' or 'quarantine', not {on_error!r}")


def _numbered(raw: DataFrame, order_by: Sequence[str], row_id: bool) -> tuple[DataFrame, list[str]]:
    if not row_id:
        return raw, [c for c in ("row_id",) if c in raw.columns]
    return add_row_id(raw, order_by, "row_id"), ["row_id"]


def _transaction_columns(on_error: str, date_format: str | None = None) -> list[Column]:
    cast = _casts(TRANSACTION_TYPES, on_error, date_format)
    return [
        F.trim("RECEIPT_ID").alias("RECEIPT_ID"),
        cast["PURCHASE_DATE"],
        cast["SCAN_DATE"],
        F.trim("STORE_NAME").alias("STORE_NAME"),
        F.trim("USER_ID").alias("USER_ID"),
        cast["BARCODE"],
        cast["FINAL_QUANTITY"],
        cast["FINAL_SALE"],
    ]


def _user_columns(on_error: str, date_format: str | None = None) -> list[Column]:
    cast = _casts(USER_TYPES, on_error, date_format)
    return [
        F.trim("ID").alias("USER_ID"),
        cast["CREATED_DATE"],
        cast["BIRTH_DATE"],
        null_if_blank("STATE").alias("STATE"),
        null_if_blank("LANGUAGE").alias("LANGUAGE"),
        recode("GENDER", GENDER_SPELLINGS).alias("GENDER"),
    ]


def _product_columns(on_error: str, date_format: str | None = None) -> list[Column]:
    return [
        F.trim(recode("CATEGORY_1", UNREVIEWED_CATEGORY)).alias("CATEGORY_1"),
        *[
            clean_text(c).alias(c)
            for c in ("CATEGORY_2", "CATEGORY_3", "CATEGORY_4", "MANUFACTURER", "BRAND")
        ],
        _casts(PRODUCT_TYPES, on_error, None)["BARCODE"],
    ]


# Columns that change type and all stage columns, by the first column of the raw table.
_STAGED = {
    "RECEIPT_ID": (TRANSACTION_TYPES, _transaction_columns),
    "ID": (USER_TYPES, _user_columns),
    "CATEGORY_1": (PRODUCT_TYPES, _product_columns),
}


def stage_transactions(
    raw: DataFrame, on_error: str = "fail", row_id: bool = True, date_format: str | None = None
) -> DataFrame:
    """Typed receipt lines. Identifiers and store are trimmed but keep blanks.

    ``on_error``: ``fail`` stops on a value that does not cast, ``null`` turns it into NULL,
    ``quarantine`` leaves its row out; ``rejected_rows`` lists the rows left out, and
    ``split_staged`` gives both from one scan.
    With ``row_id`` this runs the numbering job; without it the result stays lazy.
    """
    raw = _accepted(raw, TRANSACTION_TYPES, on_error, date_format)
    rows, extra = _numbered(raw, _ORDER["RECEIPT_ID"], row_id)
    return rows.select(*_transaction_columns(on_error, date_format), *extra)


def stage_users(
    raw: DataFrame, on_error: str = "fail", row_id: bool = True, date_format: str | None = None
) -> DataFrame:
    """Typed users under ``USER_ID``, gender spellings unified, numbered in ID order."""
    raw = _accepted(raw, USER_TYPES, on_error, date_format)
    rows, extra = _numbered(raw, _ORDER["ID"], row_id)
    return rows.select(*_user_columns(on_error, date_format), *extra)


def stage_products(raw: DataFrame, on_error: str = "fail", row_id: bool = True) -> DataFrame:
    """Typed products. Blank text and unreviewed categories become NULL."""
    raw = _accepted(raw, PRODUCT_TYPES, on_error, None)
    rows, extra = _numbered(raw, _ORDER["CATEGORY_1"], row_id)
    return rows.select(*_product_columns(on_error), *extra)


def split_staged(raw: DataFrame, date_format: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Staged rows, and raw rows with a value that does not cast, from one scan and one write.

    The same rows as ``on_error="quarantine"`` without numbers and ``rejected_rows``. Each row is
    cast once; it is stored staged if all casts succeed, else as raw text with the columns at
    fault, in a folder of its own. Which of the three raw tables it is, the first column says.
    """
    types, columns = _STAGED[raw.columns[0]]
    both = raw.select(
        F.struct(*raw.columns).alias("_raw"), F.struct(*columns("null", date_format)).alias("_staged")
    )
    # Known words such as those for zero are no blanks, so the raw text says whether one was given.
    faults = [
        F.when(~is_missing(f"_raw.{c}") & F.col(f"_staged.{c}").isNull(), F.lit(c)) for c in types
    ]
    marked = both.withColumn("cast_errors", F.array_compact(F.array(*faults)))
    fits = F.size("cast_errors") == 0
    split = store(
        marked.select(
            F.when(fits, F.col("_staged")).alias("_staged"),
            F.when(~fits, F.col("_raw")).alias("_raw"),
            "cast_errors",
            fits.alias("accepted"),
        ),
        "split",
        by="accepted",
    )
    accepted = split.where("accepted").select("_staged.*")
    return accepted, split.where("NOT accepted").select("_raw.*", "cast_errors")


def preview_staged(raw: DataFrame, stage: Callable[..., DataFrame], n: int = 100) -> DataFrame:
    """The first ``n`` staged rows with their numbers, without staging the rest.

    Row numbers follow the raw text, so the first ``n`` raw rows in that order are chosen, a heap
    of ``n`` rows per task, and only these are numbered (by a window over ``n`` rows) and cast.
    ``stage`` is one of the ``stage_...`` functions. Nothing is stored. Rows that tie in the order
    (users are numbered by ID alone) may be numbered the other way round in the whole table.
    """
    order = _ORDER[raw.columns[0]]
    first = raw.orderBy(*order).limit(n)
    number = F.row_number().over(Window.orderBy(*order)).cast("bigint")
    return stage(first.withColumn("row_id", number), row_id=False).orderBy("row_id")
