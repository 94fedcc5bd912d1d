"""One SQL text per report name."""

from __future__ import annotations

from .views import LINE, PRODUCT, USER, blank, full, ordered, with_views

T, U, P = "raw_transaction", "raw_user", "raw_products"
ODD_T, ODD_P = "unreadable_transaction", "unreadable_products"
CATEGORIES = PRODUCT[:4]
STAMP, DEC = "TIMESTAMP", "DECIMAL(15,2)"


def names(columns) -> str:
    return columns if isinstance(columns, str) else ", ".join(columns)


def counts(table: str, by, where: str = "true", extra: str = "") -> str:
    return f"SELECT {names(by)}, count(*) AS TotalRows{extra} FROM {table} WHERE {where} GROUP BY {names(by)}"


def distinct(table: str, columns, where: str = "true") -> str:
    return f"SELECT DISTINCT {names(columns)} FROM {table} WHERE {where}"


def rows(table: str, where: str) -> str:
    return f"SELECT * FROM {table} WHERE {where}"


def total(table: str) -> str:
    return f"SELECT count(*) AS TotalRows FROM {table}"


def shape(table: str, width: int) -> str:
    return f"SELECT count(*) AS TotalRows, {width}::INTEGER AS TotalColumns FROM {table}"


def first_rows(table: str, columns) -> str:
    return f"SELECT * FROM {table} ORDER BY {ordered(*columns)} LIMIT 100"


def gaps_in_fields(table: str, columns, where: str = "true", extra: str = "") -> str:
    per_column = ", ".join(f"count(*) FILTER ({blank(c)}) AS {c}_NULLCount" for c in columns)
    return f"SELECT {per_column}{extra} FROM {table} WHERE {where}"


def lengths(table: str, column: str) -> str:
    return (
        f"SELECT length(rtrim({column}))::INTEGER AS Field_Length, count(*) AS TotalRows "
        f"FROM {table} GROUP BY ALL"
    )


def mixed_lengths(table: str, by, column: str) -> str:
    return (
        f"SELECT {names(by)}, count(DISTINCT length(rtrim({column}))) AS UniqueField_Length "
        f"FROM {table} GROUP BY {names(by)} HAVING UniqueField_Length > 1"
    )


def cast_rows(table: str, column: str, kind: str, where: str = "true") -> str:
    return (
        f"SELECT {column}, try_cast(nullif(trim({column}), '') AS {kind}) AS CAST_{column} "
        f"FROM {table} WHERE {where}"
    )


def cast_failures(table: str, column: str, kind: str, where: str = "true") -> str:
    return cast_rows(
        table, column, kind, f"{full(column)} AND try_cast(trim({column}) AS {kind}) IS NULL AND {where}"
    )


def spread(table: str, column: str, kind: str, where: str = "true") -> str:
    return (
        f"SELECT CAST_{column}, count(*) AS TotalRows FROM ({cast_rows(table, column, kind, where)}) "
        f"GROUP BY CAST_{column}"
    )


def hours(table: str, column: str) -> str:
    return (
        f"SELECT hour({column}::TIMESTAMP)::INTEGER AS HourofTime, count(*) AS TotalRows "
        f"FROM {table} GROUP BY HourofTime"
    )


def date_gaps(table: str, column: str) -> str:
    this, before = f"CAST_{column}", f"Previous_{column}"
    return f"""
WITH days AS (SELECT DISTINCT try_cast(nullif({column}, '') AS TIMESTAMP)::DATE AS {this} FROM {table}),
     pairs AS (SELECT {this}, lag({this}) OVER (ORDER BY {this} NULLS FIRST) AS {before} FROM days)
SELECT {this}, {before}, date_diff('day', {before}, {this})::INTEGER AS Days_Difference FROM pairs
"""


def per_key(key: str, column: str, rule: str, value: str | None = None) -> str:
    return (
        f"SELECT {key}, count(DISTINCT {value or column}) AS Unique_{column}, count(*) AS TotalRows "
        f"FROM {T} GROUP BY {key} HAVING {rule}"
    )


def date_range(table: str, column: str, dates) -> str:
    ends = ", ".join(f"min({d}::TIMESTAMP) AS MIN_{d}, max({d}::TIMESTAMP) AS MAX_{d}" for d in dates)
    return f"SELECT {ends} FROM {table} WHERE {blank(column)}"


def repeats(table: str, columns) -> str:
    return counts(table, columns) + " HAVING count(*) > 1"


def parents(child: str, parent: str) -> str:
    return f"SELECT {child}, count(DISTINCT {parent}) AS Unique_{parent} FROM {P} GROUP BY {child}"


def odd(column: str) -> str:
    return f"regexp_matches({column}, '[^a-zA-Z0-9 ]')"


def beyond_ascii(column: str) -> str:
    return f"regexp_matches({column}, '[^ -~]')"


def profile(table: str, columns, kinds) -> str:
    parts = []
    for c in columns:
        fails = "0::BIGINT"
        if c in kinds:
            fails = f"count(*) FILTER ({full(c)} AND try_cast(trim({c}) AS {kinds[c]}) IS NULL)"
        parts.append(
            f"""SELECT '{c}' AS "column", count(*) AS "rows", count(*) FILTER ({blank(c)}) AS missing,
min(length(rtrim({c})))::INTEGER AS min_length, max(length(rtrim({c})))::INTEGER AS max_length,
count(*) FILTER (contains({c}, ',')) AS with_comma, count(*) FILTER ({odd(c)}) AS non_alphanumeric,
count(*) FILTER ({beyond_ascii(c)}) AS non_ascii, {fails} AS cast_failures FROM {table}"""
        )
    return "\nUNION ALL\n".join(parts)


def findings(table: str, checks) -> str:
    """Each check with a GROUP BY of its own: name, keys, counted value or None, rule."""
    parts = []
    for name, by, value, rule in checks:
        text = " || ' | ' || ".join(f"coalesce(({k})::VARCHAR, '-')" for k in by)
        unique = f"count(DISTINCT {value})" if value else "NULL::BIGINT"
        parts.append(
            f"""SELECT '{name}' AS "check", any_value({text}) AS keys, count(*) AS TotalRows,
{unique} AS UniqueValues FROM {table} GROUP BY {names(by)} HAVING {rule}"""
        )
    return "\nUNION ALL\n".join(parts)


QUANTITY, SALE = f"try_cast(FINAL_QUANTITY AS {DEC})", f"try_cast(nullif(trim(FINAL_SALE), '') AS {DEC})"
NO_BARCODE = blank("BARCODE")
BOTH_DATES = ["PURCHASE_DATE", "SCAN_DATE"]
DAY_PAIRS = """(SELECT PURCHASE_DATE::DATE AS CAST_PURCHASE_DATE, SCAN_DATE::TIMESTAMP::DATE AS CAST_SCAN_DATE
FROM raw_transaction WHERE PURCHASE_DATE::DATE <> SCAN_DATE::TIMESTAMP::DATE)"""
CAST_BARCODE = "try_cast(nullif(trim(BARCODE), '') AS BIGINT)"
CONFLICTS = f"""
SELECT CAST_BARCODE, count(*) AS TotalRows
FROM (SELECT DISTINCT {names(CATEGORIES)}, MANUFACTURER, BRAND, {CAST_BARCODE} AS CAST_BARCODE FROM {P})
WHERE CAST_BARCODE IS NOT NULL GROUP BY CAST_BARCODE HAVING count(*) > 1
"""
BOX = f"""
WITH sale AS (SELECT {SALE}::DOUBLE AS v FROM {T} WHERE {full("FINAL_SALE")}),
box AS (SELECT count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
               quantile_cont(v, 0.75) AS q3 FROM sale),
ends AS (SELECT n, q1, median, q3, min(v) FILTER (v >= q1 - 1.5 * (q3 - q1)) AS lo,
                max(v) FILTER (v <= q3 + 1.5 * (q3 - q1)) AS hi,
                count(*) FILTER (v < q1 - 1.5 * (q3 - q1)) AS low_outliers,
                count(*) FILTER (v > q3 + 1.5 * (q3 - q1)) AS high_outliers
         FROM sale, box GROUP BY n, q1, median, q3)
"""

READ = f"""
SELECT trim(RECEIPT_ID) AS RECEIPT_ID, try_cast(PURCHASE_DATE AS TIMESTAMP) AS PURCHASE_DATE,
       try_cast(SCAN_DATE AS TIMESTAMP) AS SCAN_DATE, trim(STORE_NAME) AS STORE_NAME, trim(USER_ID) AS USER_ID,
       try_cast(BARCODE AS BIGINT) AS BARCODE,
       try_cast(replace(FINAL_QUANTITY, 'zero', '0') AS {DEC}) AS FINAL_QUANTITY,
       try_cast(FINAL_SALE AS {DEC}) AS FINAL_SALE
FROM {ODD_T}"""
FAULTS = f"""concat_ws(', ', CASE WHEN try_cast(SCAN_DATE AS TIMESTAMP) IS NULL THEN 'SCAN_DATE' END,
  CASE WHEN {full("BARCODE")} AND try_cast(BARCODE AS BIGINT) IS NULL THEN 'BARCODE' END,
  CASE WHEN try_cast(replace(FINAL_QUANTITY, 'zero', '0') AS {DEC}) IS NULL THEN 'FINAL_QUANTITY' END,
  CASE WHEN {full("FINAL_SALE")} AND try_cast(FINAL_SALE AS {DEC}) IS NULL THEN 'FINAL_SALE' END)"""

SQL: dict[str, str] = {
    # import
    "transactions_row_count": total(T),
    "users_row_count": total(U),
    "products_row_count": total(P),
    "transactions_shape": shape(T, 8),
    "users_shape": shape(U, 6),
    "products_shape": shape(P, 7),
    "transactions_with_comma_in_store": rows(T, "STORE_NAME LIKE '%,%'"),
    "users_with_comma_in_gender": rows(U, "GENDER LIKE '%,%'"),
    "products_with_comma_in_manufacturer": rows(P, "MANUFACTURER LIKE '%,%'"),
    "sale_control_total": f"SELECT sum(coalesce({SALE}, 0)::DECIMAL(30,10)) AS Total_FINAL_SALE FROM {T}",
    "barcode_control_total": (
        f"SELECT sum(coalesce({CAST_BARCODE}, 0)::DECIMAL(30,10)) AS Total_BARCODE FROM {P}"
    ),
    "transactions_preview": first_rows(T, LINE),
    "users_preview": first_rows(U, USER),
    "products_preview": first_rows(P, PRODUCT),
    "load_totals": "\nUNION ALL\n".join(
        f"""SELECT '{name}' AS "table", {len(columns)}::INTEGER AS TotalColumns, count(*) AS TotalRows,
count(*) FILTER (contains({columns[-1]}, ',')) AS CommasInLast, {amount}::DECIMAL(38,10) AS ControlTotal,
{bad}::BIGINT AS UnreadableAmounts FROM {table}"""
        for name, table, columns, amount, bad in (
            ("transactions", T, LINE, "sum(try_cast(nullif(trim(FINAL_SALE), '') AS DECIMAL(30,10)))", "0"),
            ("users", U, USER, "NULL", "NULL"),
            ("products", P, PRODUCT, "sum(try_cast(nullif(trim(BARCODE), '') AS DECIMAL(30,10)))", "0"),
        )
    ),
    "transactions_any_rows": f"SELECT least(count(*), 100) AS TotalRows, least(count(*), 100) AS FoundRows FROM {T}",
    "scan_dates": f"SELECT SCAN_DATE FROM {T}",
    # transactions
    "transactions_missing_counts": gaps_in_fields(T, LINE),
    "transaction_group_checks": findings(
        T,
        [
            ("repeated_rows", LINE, None, "count(*) > 1"),
            ("receipt_purchase_dates", ["RECEIPT_ID"], "PURCHASE_DATE", "UniqueValues <> 1"),
            ("receipt_scan_dates", ["RECEIPT_ID"], "SCAN_DATE", "UniqueValues <> 1"),
            ("receipt_users", ["RECEIPT_ID"], "USER_ID", "UniqueValues <> 1"),
            ("receipt_barcodes", ["RECEIPT_ID"], "nullif(trim(BARCODE), '')", "UniqueValues > 1"),
            (
                "receipt_repeats_barcode",
                ["RECEIPT_ID"],
                "coalesce(nullif(trim(BARCODE), ''), '0')",
                "UniqueValues <> count(*)",
            ),
            ("store_barcode_lengths", ["STORE_NAME"], "length(rtrim(BARCODE))", "UniqueValues > 1"),
            ("user_receipts", ["USER_ID"], "RECEIPT_ID", "true"),
            ("barcode_lengths", ["length(rtrim(BARCODE))"], None, "true"),
        ],
    ),
    "receipt_id_lengths": lengths(T, "RECEIPT_ID"),
    "receipt_line_counts": counts(T, "RECEIPT_ID"),
    "receipt_lookup": rows(T, "RECEIPT_ID = 'R000000000007'"),
    "receipts_with_many_lines": repeats(T, "RECEIPT_ID"),
    "purchase_date_casts": cast_rows(T, "PURCHASE_DATE", STAMP),
    "purchase_date_hours": hours(T, "PURCHASE_DATE"),
    "scan_date_hours": hours(T, "SCAN_DATE"),
    "receipts_with_many_purchase_dates": per_key("RECEIPT_ID", "PURCHASE_DATE", "Unique_PURCHASE_DATE <> 1"),
    "purchase_date_spread": spread(T, "PURCHASE_DATE", STAMP),
    "purchase_date_gaps": date_gaps(T, "PURCHASE_DATE"),
    "scan_date_cast_failures": cast_failures(ODD_T, "SCAN_DATE", STAMP),
    "receipts_with_many_scan_dates": per_key("RECEIPT_ID", "SCAN_DATE", "Unique_SCAN_DATE <> 1"),
    "scan_date_spread": spread(T, "SCAN_DATE", STAMP),
    "purchase_scan_mismatches": f"SELECT * FROM {DAY_PAIRS}",
    "purchase_scan_delays": (
        "SELECT (CAST_SCAN_DATE - CAST_PURCHASE_DATE)::INTEGER AS Days_Difference, count(*) AS TotalRows "
        f"FROM {DAY_PAIRS} GROUP BY Days_Difference"
    ),
    "store_names": distinct(T, "STORE_NAME"),
    "odd_store_names": distinct(T, "STORE_NAME", odd("STORE_NAME")),
    "store_lookup": rows(T, "STORE_NAME = 'K ENT ''S MARKE' OR STORE_NAME LIKE '%LDI%'"),
    "non_ascii_store_names": distinct(T, "STORE_NAME", beyond_ascii("STORE_NAME")),
    "transaction_user_id_lengths": lengths(T, "USER_ID"),
    "user_line_and_receipt_counts": counts(
        T, "USER_ID", extra=", count(DISTINCT RECEIPT_ID) AS TotalReceipts"
    ),
    "receipts_with_many_users": per_key("RECEIPT_ID", "USER_ID", "Unique_USER_ID <> 1"),
    "transaction_barcode_cast_failures": cast_failures(ODD_T, "BARCODE", "BIGINT"),
    "transaction_barcode_lengths": lengths(T, "BARCODE"),
    "barcode_length_lookup": rows(T, "length(BARCODE) = 12"),
    "stores_with_mixed_barcode_lengths": mixed_lengths(T, "STORE_NAME", "BARCODE"),
    "receipts_repeating_a_barcode": per_key(
        "RECEIPT_ID", "BARCODE", "Unique_BARCODE <> TotalRows", "coalesce(nullif(trim(BARCODE), ''), '0')"
    ),
    "receipts_with_many_barcodes": per_key("RECEIPT_ID", "BARCODE", "Unique_BARCODE > 1"),
    "missing_barcode_by_quantity": counts(T, "FINAL_QUANTITY", NO_BARCODE),
    "missing_barcode_by_sale": counts(T, "FINAL_SALE", NO_BARCODE),
    "missing_barcode_by_store": counts(T, "STORE_NAME", NO_BARCODE),
    "missing_barcode_date_range": date_range(T, "BARCODE", BOTH_DATES),
    "quantity_with_fraction": rows(T, "FINAL_QUANTITY <> 'zero' AND FINAL_QUANTITY NOT LIKE '%00'"),
    "quantity_without_two_places": rows(T, "FINAL_QUANTITY <> 'zero' AND FINAL_QUANTITY NOT LIKE '%.__'"),
    "quantity_cast_failures": cast_failures(T, "FINAL_QUANTITY", DEC),
    "quantity_unexpected_cast_failures": cast_failures(
        ODD_T, "FINAL_QUANTITY", DEC, "FINAL_QUANTITY <> 'zero'"
    ),
    "quantity_spread": spread(T, "FINAL_QUANTITY", DEC, "FINAL_QUANTITY <> 'zero'"),
    "quantity_lookup": rows(T, f"{QUANTITY} = 50"),
    "sale_with_fraction": rows(T, f"{full('FINAL_SALE')} AND FINAL_SALE NOT LIKE '%00'"),
    "sale_without_two_places": rows(T, f"{full('FINAL_SALE')} AND FINAL_SALE NOT LIKE '%.__'"),
    "sale_cast_failures": cast_failures(ODD_T, "FINAL_SALE", DEC),
    "sale_spread": spread(T, "FINAL_SALE", DEC, full("FINAL_SALE")),
    "high_sale_lookup": rows(T, f"{SALE} > 100000"),
    "zero_quantity_with_sale": rows(T, f"coalesce({QUANTITY}, 0) = 0 AND {SALE} > 0"),
    "quantity_without_sale": rows(T, f"{QUANTITY} > 0 AND coalesce({SALE}, 0) = 0"),
    "rows_missing_sale": rows(T, blank("FINAL_SALE")),
    "missing_sale_date_range": date_range(T, "FINAL_SALE", BOTH_DATES),
    "repeated_transaction_rows": repeats(T, LINE),
    "purchase_date_counts": spread(T, "PURCHASE_DATE", STAMP, full("PURCHASE_DATE")),
    "sale_box": BOX
    + """SELECT n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
round(least(lo, q1), 6) AS whisker_low, round(greatest(hi, q3), 6) AS whisker_high,
low_outliers, high_outliers FROM ends""",
    "sale_outliers": BOX
    + f"SELECT {T}.* FROM {T}, ends WHERE {SALE} < least(lo, q1) OR {SALE} > greatest(hi, q3)",
    "transactions_profile": profile(
        T, LINE, dict(PURCHASE_DATE=STAMP, SCAN_DATE=STAMP, BARCODE="BIGINT", FINAL_QUANTITY=DEC, FINAL_SALE=DEC)
    ),
    # users
    "users_missing_counts": gaps_in_fields(U, USER),
    "user_id_lengths": lengths(U, "ID"),
    "user_id_counts": counts(U, "ID"),
    "created_date_casts": cast_rows(U, "CREATED_DATE", STAMP),
    "created_date_spread": spread(U, "CREATED_DATE", STAMP),
    "created_date_gaps": date_gaps(U, "CREATED_DATE"),
    "birth_date_casts": cast_rows(U, "BIRTH_DATE", STAMP),
    "birth_date_spread": spread(U, "BIRTH_DATE", STAMP),
    "birth_date_gaps": date_gaps(U, "BIRTH_DATE"),
    "state_lengths": lengths(U, "STATE"),
    "states": distinct(U, "STATE"),
    "state_counts": counts(U, "STATE"),
    "state_counts_present": counts(U, "STATE", full("STATE")),
    "language_counts": counts(U, "LANGUAGE"),
    "gender_counts": counts(U, "GENDER"),
    "gender_counts_folded": counts(f"(SELECT lower(rtrim(GENDER)) AS GENDER FROM {U})", "GENDER"),
    "users_profile": profile(U, USER, dict(CREATED_DATE=STAMP, BIRTH_DATE=STAMP)),
    # products
    "products_missing_counts": gaps_in_fields(P, PRODUCT, extra=", count(*) AS TotalRows"),
    "category_1_values": counts(P, "CATEGORY_1"),
    "category_1_counts": counts(P, "CATEGORY_1"),
    "category_1_counts_present": counts(P, "CATEGORY_1", full("CATEGORY_1")),
    "category_2_values": counts(P, "CATEGORY_2"),
    "category_3_values": counts(P, "CATEGORY_3"),
    "category_4_values": counts(P, "CATEGORY_4"),
    "needs_review_rows": rows(P, "CATEGORY_1 = 'Needs Review'"),
    "needs_review_by_manufacturer": counts(P, "MANUFACTURER", "CATEGORY_1 = 'Needs Review'"),
    "spend_category_breakdown": counts(P, CATEGORIES[:2], "CATEGORY_1 = 'Health & Wellness'"),
    "rows_missing_category_1": rows(P, blank("CATEGORY_1")),
    "missing_category_1_by_manufacturer": counts(P, "MANUFACTURER", blank("CATEGORY_1")),
    "category_paths": distinct(P, CATEGORIES),
    "category_2_parents": parents("CATEGORY_2", "CATEGORY_1"),
    "category_3_parents": parents("CATEGORY_3", "CATEGORY_2"),
    "category_4_parents": parents("CATEGORY_4", "CATEGORY_3"),
    "paths_above_category_3": distinct(P, CATEGORIES[:2], "CATEGORY_3 = 'SMALL 4'"),
    "manufacturers": distinct(P, "MANUFACTURER"),
    "placeholder_manufacturer_rows": rows(P, "MANUFACTURER = 'PLACEHOLDER MANUFACTURER'"),
    "odd_manufacturers": distinct(P, "MANUFACTURER", odd("MANUFACTURER")),
    "non_ascii_manufacturers": distinct(P, "MANUFACTURER", beyond_ascii("MANUFACTURER")),
    "manufacturer_counts": counts(P, "MANUFACTURER"),
    "rows_missing_manufacturer": rows(P, blank("MANUFACTURER")),
    "missing_manufacturer_by_category": counts(P, CATEGORIES[:2], blank("MANUFACTURER")),
    "manufacturer_and_brand_missing": f"""
SELECT ['Neither Missing', 'Only One is Missing', 'Both Missing']
         [{blank("MANUFACTURER")}::INTEGER + {blank("BRAND")}::INTEGER + 1] AS "Group", count(*) AS TotalRows
FROM {P} GROUP BY ALL""",
    "manufacturer_or_brand_missing_rows": rows(P, f"{blank('MANUFACTURER')} <> {blank('BRAND')}"),
    "brand_lookup": rows(P, "BRAND = 'Brand#13'"),
    "brands": distinct(P, "BRAND"),
    "odd_brands": distinct(P, "BRAND", odd("BRAND")),
    "non_ascii_brands": distinct(P, "BRAND", beyond_ascii("BRAND")),
    "product_barcode_cast_failures": cast_failures(ODD_P, "BARCODE", "BIGINT"),
    "product_barcode_lengths": lengths(P, "BARCODE"),
    "makers_with_mixed_barcode_lengths": mixed_lengths(P, ["MANUFACTURER", "BRAND"], "BARCODE"),
    "rows_missing_product_barcode": rows(P, NO_BARCODE),
    "missing_product_barcode_by_category": counts(P, "CATEGORY_1", NO_BARCODE),
    "missing_product_barcode_by_manufacturer": counts(P, "MANUFACTURER", NO_BARCODE),
    "repeated_barcodes": repeats(P, "BARCODE"),
    "barcode_list_lookup": rows(P, "BARCODE IN ('000000000081', '81')"),
    "barcode_pattern_lookup": rows(P, "BARCODE LIKE '%0081%'"),
    "repeated_barcode_maker_brand": repeats(P, ["BARCODE", "MANUFACTURER", "BRAND"]),
    "repeated_product_rows": repeats(P, ["BARCODE", "MANUFACTURER", "BRAND", *CATEGORIES]),
    "repeated_cast_barcodes": repeats(f"(SELECT {CAST_BARCODE} AS CAST_BARCODE FROM {P})", "CAST_BARCODE"),
    "conflicting_barcodes": CONFLICTS,
    "conflicting_barcode_rows": (
        f"SELECT {P}.*, CAST_BARCODE, TotalRows FROM {P} JOIN ({CONFLICTS}) ON {CAST_BARCODE} = CAST_BARCODE"
    ),
    "product_group_checks": findings(
        P,
        [
            ("repeated_barcodes", ["BARCODE"], None, "count(*) > 1"),
            ("repeated_cast_barcodes", [CAST_BARCODE], None, "count(*) > 1"),
            ("repeated_barcode_maker_brand", ["BARCODE", "MANUFACTURER", "BRAND"], None, "count(*) > 1"),
            ("brand_makers", ["BRAND"], "MANUFACTURER", "true"),
            ("brands_of_many_makers", ["BRAND"], "MANUFACTURER", "UniqueValues > 1"),
            ("maker_barcode_lengths", ["MANUFACTURER", "BRAND"], "length(rtrim(BARCODE))", "UniqueValues > 1"),
            *[(f"rows_by_{c.lower()}", [c], None, "true") for c in CATEGORIES],
        ],
    ),
    "products_profile": profile(P, PRODUCT, dict(BARCODE="BIGINT")),
    "product_value_counts": "\nUNION ALL\n".join(
        f'SELECT \'{c}\' AS "column", {c} AS "value", count(*) AS TotalRows FROM {P} GROUP BY {c}'
        for c in PRODUCT
    ),
    # stage, overlap, master
    "stage_transactions": "SELECT * FROM stage_transaction",
    "stage_users": "SELECT * FROM stage_user",
    "stage_products": "SELECT * FROM stage_product",
    "stage_transactions_null": READ,
    "stage_transactions_quarantine": f"{READ} WHERE {FAULTS} = ''",
    "rejected_transactions": f"SELECT *, {FAULTS} AS cast_errors FROM {ODD_T} WHERE {FAULTS} <> ''",
    "stage_transactions_preview": first_rows("stage_transaction", ["row_id"]),
    "stage_users_preview": first_rows("stage_user", ["row_id"]),
    "stage_products_preview": first_rows("stage_product", ["row_id"]),
    "user_lookup": "SELECT * EXCLUDE row_id FROM stage_user WHERE USER_ID = 'U00000013'",
    "user_pattern_lookup": "SELECT * EXCLUDE row_id FROM stage_user WHERE USER_ID LIKE '%00%13%'",
    "user_transactions_lookup": (
        "SELECT * EXCLUDE row_id FROM stage_transaction WHERE contains(USER_ID, '000013')"
    ),
    "product_barcode_pattern_lookup": (
        "SELECT * EXCLUDE row_id FROM stage_product WHERE contains(BARCODE::VARCHAR, '16')"
    ),
    "transaction_barcode_lookup": "SELECT * EXCLUDE row_id FROM stage_transaction WHERE BARCODE = 161",
    "master_table": "SELECT * FROM master",
    "master_fanout": repeats("master", "DUPE_CHECK"),
    # answers
    "spend_share_by_generation": """
WITH spend AS (
  SELECT coalesce(label, if(USERID_BIRTH_DATE IS NULL, 'Unknown', 'Outside Range')) AS GENERATION,
         sum(FINAL_SALE)::DOUBLE AS amount
  FROM master LEFT JOIN bands ON year(USERID_BIRTH_DATE) BETWEEN first_year AND last_year
  WHERE BARCODE_CATEGORY_1 = 'Health & Wellness' GROUP BY GENERATION)
SELECT GENERATION, (floor(amount / sum(amount) OVER () * 1000000) / 1000000)::DECIMAL(38,6) AS GENERATION_PERCENTAGE_OF_TOTAL,
       CASE WHEN GENERATION <> 'Unknown' THEN (floor(amount / sum(amount) FILTER (GENERATION <> 'Unknown') OVER ()
         * 1000000) / 1000000)::DECIMAL(38,6) END AS GENERATION_PERCENTAGE_OF_TOTAL_NoUnknown
FROM spend""",
    "scan_weeks": "SELECT DISTINCT week_no AS Week_of_Year FROM weeks",
    "scan_weeks_by_year": 'SELECT DISTINCT year(SCAN_DATE)::INTEGER AS "Year", week_no AS Week_of_Year FROM weeks',
    "user_activity": "SELECT * FROM activity",
    "user_activity_ranks": "SELECT * FROM ranked",
    "power_users": (
        "SELECT USER_ID FROM ranked WHERE greatest(Percentile_Weeks, Percentile_Receipts) <= 0.01"
    ),
    "category_level_of_brand_question": distinct(
        "master",
        [f"BARCODE_{c}" for c in CATEGORIES],
        "'Dips & Salsa' IN (" + ", ".join(f"BARCODE_{c}" for c in CATEGORIES) + ")",
    ),
    "leading_brands": """
SELECT BARCODE_BRAND, count(DISTINCT RECEIPT_ID) AS TotalReceipts FROM master
WHERE BARCODE_CATEGORY_2 = 'Dips & Salsa' AND BARCODE_BRAND IS NOT NULL GROUP BY BARCODE_BRAND""",
    "leading_brand": """
SELECT BARCODE_BRAND, count(DISTINCT RECEIPT_ID) AS TotalReceipts FROM master
WHERE BARCODE_CATEGORY_2 = 'Dips & Salsa' AND BARCODE_BRAND IS NOT NULL GROUP BY BARCODE_BRAND
QUALIFY rank() OVER (ORDER BY TotalReceipts DESC) = 1""",
    "top_store_by_generation": """
WITH seen AS (
  SELECT DISTINCT RECEIPT_ID, STORE_NAME, year(USERID_BIRTH_DATE) AS born FROM master
  WHERE STORE_NAME IS NOT NULL),
visits AS (
  SELECT coalesce(label, if(born IS NULL, 'Unknown', 'Outside Range')) AS GENERATION, STORE_NAME,
         count(*) AS TotalReceipts
  FROM seen LEFT JOIN bands ON born BETWEEN first_year AND last_year GROUP BY ALL)
SELECT GENERATION, STORE_NAME, TotalReceipts, 1::INTEGER AS StoreRanking FROM visits
QUALIFY TotalReceipts = max(TotalReceipts) OVER (PARTITION BY GENERATION)""",
}

DEMOGRAPHICS = ["BIRTH_DATE", "STATE", "LANGUAGE", "GENDER"]
for column in DEMOGRAPHICS:
    name, others = column.lower(), [c for c in DEMOGRAPHICS if c != column]
    SQL[f"rows_missing_{name}"] = rows(U, blank(column))
    SQL[f"missing_{name}_created_range"] = date_range(U, column, ["CREATED_DATE"])
    SQL[f"missing_{name}_other_gaps"] = gaps_in_fields(U, others, blank(column))

for overlap, right_name, ids in (
    ("user_overlap", "User_Table_Match", "user_ids"),
    ("barcode_overlap", "Products_Table_Match", "barcodes"),
):
    lookup_side = "users" if ids == "user_ids" else "products"
    SQL[overlap] = f"SELECT * FROM {overlap}"
    SQL[f"{overlap}_summary"] = (
        f"SELECT {right_name}, Transaction_Table_Match, count(*) AS TotalIDs FROM {overlap} GROUP BY ALL"
    )
    for suffix, in_lookup, in_lines in (
        ("in_both", "Yes", "Yes"),
        ("only_in_transactions", "No", "Yes"),
        (f"only_in_{lookup_side}", "Yes", "No"),
    ):
        SQL[f"{ids}_{suffix}"] = rows(
            overlap, f"{right_name} = '{in_lookup}' AND Transaction_Table_Match = '{in_lines}'"
        )

ORACLE_SQL: dict[str, str] = {name: with_views(sql) for name, sql in SQL.items()}
