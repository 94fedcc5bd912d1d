"""Declared schemas: raw tables are all text, stage and master tables are typed.

Row identifiers are ``long``: a 32-bit number runs out at about two billion receipt lines.
"""

from __future__ import annotations

from pyspark.sql.types import StructType


def _schema(**columns: str) -> StructType:
    schema = StructType()
    for name, dtype in columns.items():
        schema = schema.add(name, dtype)
    return schema


def _text(*names: str) -> StructType:
    return _schema(**dict.fromkeys(names, "string"))


RAW_TRANSACTION = _text(
    "RECEIPT_ID",
    "PURCHASE_DATE",
    "SCAN_DATE",
    "STORE_NAME",
    "USER_ID",
    "BARCODE",
    "FINAL_QUANTITY",
    "FINAL_SALE",
)

RAW_USER = _text("ID", "CREATED_DATE", "BIRTH_DATE", "STATE", "LANGUAGE", "GENDER")

RAW_PRODUCTS = _text(
    "CATEGORY_1", "CATEGORY_2", "CATEGORY_3", "CATEGORY_4", "MANUFACTURER", "BRAND", "BARCODE"
)

_LINES = {
    "RECEIPT_ID": "string",
    "PURCHASE_DATE": "timestamp_ntz",
    "SCAN_DATE": "timestamp_ntz",
    "STORE_NAME": "string",
    "USER_ID": "string",
    "BARCODE": "long",
    "FINAL_QUANTITY": "decimal(15,2)",
    "FINAL_SALE": "decimal(15,2)",
}

_ABOUT_USER = {
    "CREATED_DATE": "timestamp_ntz",
    "BIRTH_DATE": "timestamp_ntz",
    "STATE": "string",
    "LANGUAGE": "string",
    "GENDER": "string",
}

_ABOUT_PRODUCT = {
    "CATEGORY_1": "string",
    "CATEGORY_2": "string",
    "CATEGORY_3": "string",
    "CATEGORY_4": "string",
    "MANUFACTURER": "string",
    "BRAND": "string",
}

LINE_COLUMNS = list(_LINES)
USER_COLUMNS = list(_ABOUT_USER)
PRODUCT_COLUMNS = list(_ABOUT_PRODUCT)

STAGE_TRANSACTION = _schema(**_LINES, row_id="long")

STAGE_USER = _schema(USER_ID="string", **_ABOUT_USER, row_id="long")

STAGE_PRODUCTS = _schema(**_ABOUT_PRODUCT, BARCODE="long", row_id="long")

MASTER = _schema(
    **_LINES,
    DUPE_CHECK="long",
    **{f"USERID_{name}": dtype for name, dtype in _ABOUT_USER.items()},
    **{f"BARCODE_{name}": dtype for name, dtype in _ABOUT_PRODUCT.items()},
    row_id="long",
)
