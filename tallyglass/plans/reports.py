"""Named reports: every check, table and answer of a receipt-data review, ready to run.

``REPORTS[name](tables)`` returns a DataFrame for a ``RetailTables``. Values that reports look
up are examples that occur in the derived star tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.casts import typed
from ..functions.text import clean_text, fold_case, is_missing, text_length
from ..operators import analytics, dates, imports, keys, master, missing, outliers, values
from ..operators.staging import (
    PRODUCT_TYPES,
    TRANSACTION_TYPES,
    USER_TYPES,
    preview_staged,
    stage_products,
    stage_transactions,
    stage_users,
)
from ..sources.schemas import LINE_COLUMNS
from .group_checks import GroupCheck, run_group_checks
from .profile import scan_profile, value_counts_of_columns
from .tables import RetailTables

Report = Callable[[RetailTables], DataFrame]

CATEGORIES = ["CATEGORY_1", "CATEGORY_2", "CATEGORY_3", "CATEGORY_4"]
MASTER_CATEGORIES = [f"BARCODE_{c}" for c in CATEGORIES]
SPEND_CATEGORY = "Health & Wellness"
BRAND_CATEGORY = "Dips & Salsa"
DECIMAL = "decimal(15,2)"
TIMESTAMP = "timestamp_ntz"


def _cast_barcode():
    return typed("BARCODE", "bigint").alias("CAST_BARCODE")


def _group_findings(df: DataFrame, checks: Callable[[], list[GroupCheck]]) -> DataFrame:
    """The findings with their keys in one text; a NULL among them reads as a dash."""
    return run_group_checks(df, checks()).withColumn("keys", F.array_join("keys", " | ", "-"))


def _transaction_group_checks() -> list[GroupCheck]:
    return [
        GroupCheck("repeated_rows", LINE_COLUMNS, rule="repeated"),
        GroupCheck("receipt_purchase_dates", "RECEIPT_ID", "PURCHASE_DATE", "not_one"),
        GroupCheck("receipt_scan_dates", "RECEIPT_ID", "SCAN_DATE", "not_one"),
        GroupCheck("receipt_users", "RECEIPT_ID", "USER_ID", "not_one"),
        GroupCheck("receipt_barcodes", "RECEIPT_ID", clean_text("BARCODE"), "many"),
        GroupCheck(
            "receipt_repeats_barcode", "RECEIPT_ID", F.coalesce(clean_text("BARCODE"), F.lit("0")), "not_rows"
        ),
        GroupCheck("store_barcode_lengths", "STORE_NAME", text_length("BARCODE"), "many"),
        GroupCheck("user_receipts", "USER_ID", "RECEIPT_ID"),
        GroupCheck("barcode_lengths", text_length("BARCODE")),
    ]


def _product_group_checks() -> list[GroupCheck]:
    return [
        GroupCheck("repeated_barcodes", "BARCODE", rule="repeated"),
        GroupCheck("repeated_cast_barcodes", _cast_barcode(), rule="repeated"),
        GroupCheck("repeated_barcode_maker_brand", ["BARCODE", "MANUFACTURER", "BRAND"], rule="repeated"),
        GroupCheck("brand_makers", "BRAND", "MANUFACTURER"),
        GroupCheck("brands_of_many_makers", "BRAND", "MANUFACTURER", "many"),
        GroupCheck("maker_barcode_lengths", ["MANUFACTURER", "BRAND"], text_length("BARCODE"), "many"),
        *[GroupCheck(f"rows_by_{c.lower()}", c) for c in CATEGORIES],
    ]


IMPORT: dict[str, Report] = {
    "transactions_row_count": lambda t: imports.row_count(t.raw_transactions),
    "users_row_count": lambda t: imports.row_count(t.raw_users),
    "products_row_count": lambda t: imports.row_count(t.raw_products),
    "transactions_shape": lambda t: imports.shape(t.raw_transactions),
    "users_shape": lambda t: imports.shape(t.raw_users),
    "products_shape": lambda t: imports.shape(t.raw_products),
    "transactions_with_comma_in_store": lambda t: imports.delimiter_check(t.raw_transactions, "STORE_NAME"),
    "users_with_comma_in_gender": lambda t: imports.delimiter_check(t.raw_users, "GENDER"),
    "products_with_comma_in_manufacturer": lambda t: imports.delimiter_check(t.raw_products, "MANUFACTURER"),
    "sale_control_total": lambda t: imports.control_total(t.raw_transactions, "FINAL_SALE"),
    "barcode_control_total": lambda t: imports.control_total(t.raw_products, "BARCODE"),
    "transactions_preview": lambda t: imports.preview(
        t.raw_transactions, order_by=t.raw_transactions.columns
    ),
    "users_preview": lambda t: imports.preview(t.raw_users, order_by=t.raw_users.columns),
    "products_preview": lambda t: imports.preview(t.raw_products, order_by=t.raw_products.columns),
    "load_totals": lambda t: t.load_totals,
    "transactions_any_rows": lambda t: _any_rows(t.raw_transactions),
    "scan_dates": lambda t: t.raw_transactions.select("SCAN_DATE"),
}


def _any_rows(df: DataFrame) -> DataFrame:
    """How many rows an unordered preview shows, and how many of them are in the table."""
    shown = imports.preview(df)
    known = df.select("RECEIPT_ID", F.lit(1).alias("found")).distinct()
    counted = shown.join(known, "RECEIPT_ID", "left")
    return counted.agg(F.count("*").alias("TotalRows"), F.count("found").alias("FoundRows"))


TRANSACTIONS: dict[str, Report] = {
    "transactions_missing_counts": lambda t: missing.missing_counts(t.raw_transactions),
    "transaction_group_checks": lambda t: _group_findings(t.raw_transactions, _transaction_group_checks),
    "receipt_id_lengths": lambda t: values.length_profile(t.raw_transactions, "RECEIPT_ID"),
    "receipt_line_counts": lambda t: values.value_counts(t.raw_transactions, "RECEIPT_ID"),
    "receipt_lookup": lambda t: values.lookup(t.raw_transactions, F.col("RECEIPT_ID") == "R000000000007"),
    "receipts_with_many_lines": lambda t: keys.duplicate_keys(t.raw_transactions, "RECEIPT_ID", sort=True),
    "purchase_date_casts": lambda t: values.cast_audit(
        t.raw_transactions, "PURCHASE_DATE", TIMESTAMP, only_failures=False
    ),
    "purchase_date_hours": lambda t: dates.hour_profile(t.raw_transactions, "PURCHASE_DATE"),
    "scan_date_hours": lambda t: dates.hour_profile(t.raw_transactions, "SCAN_DATE"),
    "receipts_with_many_purchase_dates": lambda t: keys.single_valued(
        t.raw_transactions, "RECEIPT_ID", "PURCHASE_DATE"
    ),
    "purchase_date_spread": lambda t: values.spread(t.raw_transactions, "PURCHASE_DATE", TIMESTAMP),
    "purchase_date_gaps": lambda t: dates.date_gaps(t.raw_transactions, "PURCHASE_DATE", order="date"),
    "scan_date_cast_failures": lambda t: values.cast_audit(
        t.raw_transactions, "SCAN_DATE", TIMESTAMP, ignore_missing=False
    ),
    "receipts_with_many_scan_dates": lambda t: keys.single_valued(
        t.raw_transactions, "RECEIPT_ID", "SCAN_DATE"
    ),
    "scan_date_spread": lambda t: values.spread(t.raw_transactions, "SCAN_DATE", TIMESTAMP),
    "purchase_scan_mismatches": lambda t: dates.date_mismatch(
        t.raw_transactions, "PURCHASE_DATE", "SCAN_DATE"
    ),
    "purchase_scan_delays": lambda t: dates.date_lag_profile(
        t.raw_transactions, "PURCHASE_DATE", "SCAN_DATE"
    ),
    "store_names": lambda t: values.distinct_values(t.raw_transactions, "STORE_NAME"),
    "odd_store_names": lambda t: values.pattern_violations(t.raw_transactions, "STORE_NAME"),
    "store_lookup": lambda t: values.lookup(
        t.raw_transactions,
        (F.col("STORE_NAME") == "K ENT 'S MARKE") | F.col("STORE_NAME").like("%LDI%"),
    ),
    "non_ascii_store_names": lambda t: values.non_ascii_values(t.raw_transactions, "STORE_NAME"),
    "transaction_user_id_lengths": lambda t: values.length_profile(t.raw_transactions, "USER_ID"),
    "user_line_and_receipt_counts": lambda t: values.value_counts(
        t.raw_transactions, "USER_ID", distinct_of="RECEIPT_ID", distinct_name="TotalReceipts"
    ),
    "receipts_with_many_users": lambda t: keys.single_valued(t.raw_transactions, "RECEIPT_ID", "USER_ID"),
    "transaction_barcode_cast_failures": lambda t: values.cast_audit(
        t.raw_transactions, "BARCODE", "bigint"
    ),
    "transaction_barcode_lengths": lambda t: values.length_profile(t.raw_transactions, "BARCODE"),
    "barcode_length_lookup": lambda t: values.lookup(t.raw_transactions, text_length("BARCODE") == 12),
    "stores_with_mixed_barcode_lengths": lambda t: keys.length_varies(
        t.raw_transactions, "STORE_NAME", "BARCODE"
    ),
    "receipts_repeating_a_barcode": lambda t: keys.single_valued(
        t.raw_transactions, "RECEIPT_ID", "BARCODE", mode="not_rows", missing="one_value"
    ),
    "receipts_with_many_barcodes": lambda t: keys.single_valued(
        t.raw_transactions, "RECEIPT_ID", "BARCODE", mode="many"
    ),
    "missing_barcode_by_quantity": lambda t: missing.breakdown(
        t.raw_transactions, "FINAL_QUANTITY", is_missing("BARCODE"), order="value"
    ),
    "missing_barcode_by_sale": lambda t: missing.breakdown(
        t.raw_transactions, "FINAL_SALE", is_missing("BARCODE"), order="value"
    ),
    "missing_barcode_by_store": lambda t: missing.breakdown(
        t.raw_transactions, "STORE_NAME", is_missing("BARCODE")
    ),
    "missing_barcode_date_range": lambda t: missing.missing_range(
        t.raw_transactions, "BARCODE", ["PURCHASE_DATE", "SCAN_DATE"]
    ),
    "quantity_with_fraction": lambda t: values.decimal_format(
        t.raw_transactions, "FINAL_QUANTITY", "fraction", ignore=["zero"]
    ),
    "quantity_without_two_places": lambda t: values.decimal_format(
        t.raw_transactions, "FINAL_QUANTITY", "places", ignore=["zero"]
    ),
    "quantity_cast_failures": lambda t: values.cast_audit(t.raw_transactions, "FINAL_QUANTITY", DECIMAL),
    "quantity_unexpected_cast_failures": lambda t: values.cast_audit(
        t.raw_transactions, "FINAL_QUANTITY", DECIMAL, ignore=["zero"]
    ),
    "quantity_spread": lambda t: values.spread(
        t.raw_transactions, "FINAL_QUANTITY", DECIMAL, ignore=["zero"], drop_missing=True
    ),
    "quantity_lookup": lambda t: values.lookup(
        t.raw_transactions, typed("FINAL_QUANTITY", DECIMAL) == 50
    ),
    "sale_with_fraction": lambda t: values.decimal_format(t.raw_transactions, "FINAL_SALE", "fraction"),
    "sale_without_two_places": lambda t: values.decimal_format(t.raw_transactions, "FINAL_SALE", "places"),
    "sale_cast_failures": lambda t: values.cast_audit(t.raw_transactions, "FINAL_SALE", DECIMAL),
    "sale_spread": lambda t: values.spread(t.raw_transactions, "FINAL_SALE", DECIMAL, drop_missing=True),
    "high_sale_lookup": lambda t: values.lookup(t.raw_transactions, typed("FINAL_SALE", DECIMAL) > 100_000),
    "zero_quantity_with_sale": lambda t: values.rule_violations(
        t.raw_transactions, values.zero_quantity_with_sale()
    ),
    "quantity_without_sale": lambda t: values.rule_violations(
        t.raw_transactions, values.quantity_without_sale()
    ),
    "rows_missing_sale": lambda t: missing.missing_rows(t.raw_transactions, "FINAL_SALE"),
    "missing_sale_date_range": lambda t: missing.missing_range(
        t.raw_transactions, "FINAL_SALE", ["PURCHASE_DATE", "SCAN_DATE"]
    ),
    "repeated_transaction_rows": lambda t: keys.duplicate_keys(
        t.raw_transactions, t.raw_transactions.columns
    ),
    "purchase_date_counts": lambda t: values.spread(
        t.raw_transactions, "PURCHASE_DATE", TIMESTAMP, drop_missing=True
    ),
    "sale_box": lambda t: _rounded_box(t.raw_transactions, "FINAL_SALE"),
    "sale_outliers": lambda t: outliers.box_outliers(
        t.raw_transactions, "FINAL_SALE", outliers.box_summary(t.raw_transactions, "FINAL_SALE")
    ),
    "transactions_profile": lambda t: scan_profile(t.raw_transactions, types=TRANSACTION_TYPES),
}


def _rounded_box(df: DataFrame, column: str) -> DataFrame:
    box = outliers.box_summary(df, column)
    return box.select(
        *[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in box.dtypes]
    )


USERS: dict[str, Report] = {
    "users_missing_counts": lambda t: missing.missing_counts(t.raw_users),
    "user_id_lengths": lambda t: values.length_profile(t.raw_users, "ID"),
    "user_id_counts": lambda t: values.value_counts(t.raw_users, "ID"),
    "created_date_casts": lambda t: values.cast_audit(
        t.raw_users, "CREATED_DATE", TIMESTAMP, only_failures=False
    ),
    "created_date_spread": lambda t: values.spread(t.raw_users, "CREATED_DATE", TIMESTAMP),
    "created_date_gaps": lambda t: dates.date_gaps(t.raw_users, "CREATED_DATE"),
    "birth_date_casts": lambda t: values.cast_audit(t.raw_users, "BIRTH_DATE", TIMESTAMP, only_failures=False),
    "birth_date_spread": lambda t: values.spread(t.raw_users, "BIRTH_DATE", TIMESTAMP),
    "birth_date_gaps": lambda t: dates.date_gaps(t.raw_users, "BIRTH_DATE"),
    "state_lengths": lambda t: values.length_profile(t.raw_users, "STATE"),
    "states": lambda t: values.distinct_values(t.raw_users, "STATE"),
    "state_counts": lambda t: values.value_counts(t.raw_users, "STATE"),
    "state_counts_present": lambda t: values.value_counts(t.raw_users, "STATE", drop_missing=True),
    "language_counts": lambda t: values.value_counts(t.raw_users, "LANGUAGE"),
    "gender_counts": lambda t: values.value_counts(t.raw_users, "GENDER"),
    "gender_counts_folded": lambda t: _folded_counts(t.raw_users, "GENDER"),
    "users_profile": lambda t: scan_profile(t.raw_users, types=USER_TYPES),
}


def _folded_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value without regard to letter case, shown in lower case."""
    counts = values.value_counts(df.withColumn(column, fold_case(column)), column)
    plain = F.lower(F.rtrim(F.collate(F.col(column), "UTF8_BINARY")))
    return counts.withColumn(column, plain)


_DEMOGRAPHICS = ["BIRTH_DATE", "STATE", "LANGUAGE", "GENDER"]


def _about_missing(column: str) -> dict[str, Report]:
    """Rows, date range and other gaps of the users that lack one field."""
    name, others = column.lower(), [c for c in _DEMOGRAPHICS if c != column]
    return {
        f"rows_missing_{name}": lambda t: missing.missing_rows(t.raw_users, column),
        f"missing_{name}_created_range": lambda t: missing.missing_range(
            t.raw_users, column, ["CREATED_DATE"]
        ),
        f"missing_{name}_other_gaps": lambda t: missing.missing_counts(
            t.raw_users, others, is_missing(column)
        ),
    }


for _column in _DEMOGRAPHICS:
    USERS.update(_about_missing(_column))

PRODUCTS: dict[str, Report] = {
    "products_missing_counts": lambda t: missing.missing_counts(t.raw_products, total=True),
    "category_1_values": lambda t: values.value_counts(t.raw_products, "CATEGORY_1", order="value"),
    "category_1_counts": lambda t: values.value_counts(t.raw_products, "CATEGORY_1"),
    "category_1_counts_present": lambda t: values.value_counts(
        t.raw_products, "CATEGORY_1", drop_missing=True
    ),
    "category_2_values": lambda t: values.value_counts(t.raw_products, "CATEGORY_2", order="value"),
    "category_3_values": lambda t: values.value_counts(t.raw_products, "CATEGORY_3", order="value"),
    "category_4_values": lambda t: values.value_counts(t.raw_products, "CATEGORY_4", order="value"),
    "needs_review_rows": lambda t: values.lookup(t.raw_products, F.col("CATEGORY_1") == "Needs Review"),
    "needs_review_by_manufacturer": lambda t: missing.breakdown(
        t.raw_products, "MANUFACTURER", F.col("CATEGORY_1") == "Needs Review"
    ),
    "spend_category_breakdown": lambda t: missing.breakdown(
        t.raw_products, ["CATEGORY_1", "CATEGORY_2"], F.col("CATEGORY_1") == SPEND_CATEGORY
    ),
    "rows_missing_category_1": lambda t: missing.missing_rows(t.raw_products, "CATEGORY_1"),
    "missing_category_1_by_manufacturer": lambda t: missing.breakdown(
        t.raw_products, "MANUFACTURER", is_missing("CATEGORY_1")
    ),
    "category_paths": lambda t: values.distinct_values(t.raw_products, CATEGORIES),
    "category_2_parents": lambda t: keys.parents_per_child(t.raw_products, "CATEGORY_2", "CATEGORY_1"),
    "category_3_parents": lambda t: keys.parents_per_child(t.raw_products, "CATEGORY_3", "CATEGORY_2"),
    "category_4_parents": lambda t: keys.parents_per_child(t.raw_products, "CATEGORY_4", "CATEGORY_3"),
    "paths_above_category_3": lambda t: values.distinct_values(
        t.raw_products, ["CATEGORY_1", "CATEGORY_2"], F.col("CATEGORY_3") == "SMALL 4"
    ),
    "manufacturers": lambda t: values.distinct_values(t.raw_products, "MANUFACTURER"),
    "placeholder_manufacturer_rows": lambda t: values.lookup(
        t.raw_products, F.col("MANUFACTURER") == "PLACEHOLDER MANUFACTURER"
    ),
    "odd_manufacturers": lambda t: values.pattern_violations(t.raw_products, "MANUFACTURER"),
    "non_ascii_manufacturers": lambda t: values.non_ascii_values(t.raw_products, "MANUFACTURER"),
    "manufacturer_counts": lambda t: values.value_counts(t.raw_products, "MANUFACTURER"),
    "rows_missing_manufacturer": lambda t: missing.missing_rows(t.raw_products, "MANUFACTURER"),
    "missing_manufacturer_by_category": lambda t: missing.breakdown(
        t.raw_products, ["CATEGORY_1", "CATEGORY_2"], is_missing("MANUFACTURER")
    ),
    "manufacturer_and_brand_missing": lambda t: missing.missing_pair(t.raw_products, "MANUFACTURER", "BRAND"),
    "manufacturer_or_brand_missing_rows": lambda t: missing.missing_xor_rows(
        t.raw_products, "MANUFACTURER", "BRAND"
    ),
    "brand_lookup": lambda t: values.lookup(t.raw_products, F.col("BRAND") == "Brand#13"),
    "brands": lambda t: values.distinct_values(t.raw_products, "BRAND"),
    "odd_brands": lambda t: values.pattern_violations(t.raw_products, "BRAND"),
    "non_ascii_brands": lambda t: values.non_ascii_values(t.raw_products, "BRAND"),
    "product_barcode_cast_failures": lambda t: values.cast_audit(t.raw_products, "BARCODE", "bigint"),
    "product_barcode_lengths": lambda t: values.length_profile(t.raw_products, "BARCODE"),
    "makers_with_mixed_barcode_lengths": lambda t: keys.length_varies(
        t.raw_products, ["MANUFACTURER", "BRAND"], "BARCODE"
    ),
    "rows_missing_product_barcode": lambda t: missing.missing_rows(t.raw_products, "BARCODE"),
    "missing_product_barcode_by_category": lambda t: missing.breakdown(
        t.raw_products, "CATEGORY_1", is_missing("BARCODE"), order=None
    ),
    "missing_product_barcode_by_manufacturer": lambda t: missing.breakdown(
        t.raw_products, "MANUFACTURER", is_missing("BARCODE")
    ),
    "repeated_barcodes": lambda t: keys.duplicate_keys(t.raw_products, "BARCODE"),
    "barcode_list_lookup": lambda t: values.lookup(
        t.raw_products, F.col("BARCODE").isin("000000000081", "81")
    ),
    "barcode_pattern_lookup": lambda t: values.lookup(t.raw_products, F.col("BARCODE").like("%0081%")),
    "repeated_barcode_maker_brand": lambda t: keys.duplicate_keys(
        t.raw_products, ["BARCODE", "MANUFACTURER", "BRAND"]
    ),
    "repeated_product_rows": lambda t: keys.duplicate_keys(
        t.raw_products, ["BARCODE", "MANUFACTURER", "BRAND", *CATEGORIES]
    ),
    "repeated_cast_barcodes": lambda t: keys.duplicate_keys(t.raw_products, _cast_barcode(), sort=True),
    "conflicting_barcodes": lambda t: t.barcode_conflicts,
    "conflicting_barcode_rows": lambda t: keys.review_conflicts(
        t.raw_products, t.barcode_conflicts, _cast_barcode()
    ),
    "product_group_checks": lambda t: _group_findings(t.raw_products, _product_group_checks),
    "products_profile": lambda t: scan_profile(t.raw_products, types=PRODUCT_TYPES),
    "product_value_counts": lambda t: value_counts_of_columns(t.raw_products, t.raw_products.columns),
}


INTEGRATION: dict[str, Report] = {
    "stage_transactions": lambda t: t.numbered_transactions,
    "stage_users": lambda t: t.numbered_users,
    "stage_products": lambda t: t.numbered_products,
    "stage_transactions_null": lambda t: stage_transactions(t.raw_transactions, "null", row_id=False),
    "stage_transactions_quarantine": lambda t: t.accepted_transactions,
    "rejected_transactions": lambda t: t.rejected_transactions.withColumn(
        "cast_errors", F.concat_ws(", ", "cast_errors")
    ),
    "stage_transactions_preview": lambda t: preview_staged(t.raw_transactions, stage_transactions),
    "stage_users_preview": lambda t: preview_staged(t.raw_users, stage_users),
    "stage_products_preview": lambda t: preview_staged(t.raw_products, stage_products),
    "user_overlap": lambda t: t.user_overlap,
    "user_overlap_summary": lambda t: master.overlap_summary(t.user_overlap),
    "user_ids_in_both": lambda t: master.overlap_examples(t.user_overlap, True, True),
    "user_ids_only_in_transactions": lambda t: master.overlap_examples(t.user_overlap, False, True),
    "user_ids_only_in_users": lambda t: master.overlap_examples(t.user_overlap, True, False),
    "user_lookup": lambda t: values.lookup(t.users, F.col("USER_ID").like("U00000013")),
    "user_pattern_lookup": lambda t: values.lookup(t.users, F.col("USER_ID").like("%00%13%")),
    "user_transactions_lookup": lambda t: values.lookup(t.transactions, F.col("USER_ID").like("%000013%")),
    "barcode_overlap": lambda t: t.barcode_overlap,
    "barcode_overlap_summary": lambda t: master.overlap_summary(t.barcode_overlap),
    "barcodes_in_both": lambda t: master.overlap_examples(t.barcode_overlap, True, True),
    "barcodes_only_in_transactions": lambda t: master.overlap_examples(t.barcode_overlap, False, True),
    "barcodes_only_in_products": lambda t: master.overlap_examples(t.barcode_overlap, True, False),
    "product_barcode_pattern_lookup": lambda t: values.lookup(
        t.products, F.col("BARCODE").cast("string").like("%16%"), order_by="BARCODE"
    ),
    "transaction_barcode_lookup": lambda t: values.lookup(
        t.transactions, F.col("BARCODE").cast("string").like("161"), order_by="BARCODE"
    ),
    "master_table": lambda t: t.numbered_master,
    "master_fanout": lambda t: t.fanout,
}

ANSWERS: dict[str, Report] = {
    "spend_share_by_generation": lambda t: _spend_share(t),
    "scan_weeks": lambda t: analytics.active_weeks(t.transactions),
    "scan_weeks_by_year": lambda t: analytics.active_weeks(t.transactions, year_aware=True),
    "user_activity": lambda t: analytics.user_activity(t.transactions),
    "user_activity_ranks": lambda t: analytics.ranked_users(t.transactions),
    "power_users": lambda t: analytics.power_users(t.transactions).select("USER_ID"),
    "category_level_of_brand_question": lambda t: analytics.locate_value(
        t.lines_with_products, MASTER_CATEGORIES, BRAND_CATEGORY
    ),
    "leading_brands": lambda t: analytics.leading_by_receipts(t.lines_with_products, BRAND_CATEGORY),
    "leading_brand": lambda t: analytics.leading_by_receipts(
        t.lines_with_products, BRAND_CATEGORY, leaders=True
    ),
    "top_store_by_generation": lambda t: analytics.top_per_group(t.lines_with_users),
}


def _spend_share(t: RetailTables) -> DataFrame:
    spend = t.master.where(F.col("BARCODE_CATEGORY_1") == SPEND_CATEGORY)
    shares = analytics.share_of_total(
        analytics.with_generation(spend, "USERID_BIRTH_DATE"),
        "GENERATION",
        "FINAL_SALE",
        exclude="Unknown",
        name="GENERATION_PERCENTAGE_OF_TOTAL",
    )
    return shares.select(
        "GENERATION", *[analytics.cut_off(c).alias(c) for c in shares.columns if c != "GENERATION"]
    )


REPORTS: dict[str, Report] = {**IMPORT, **TRANSACTIONS, **USERS, **PRODUCTS, **INTEGRATION, **ANSWERS}
