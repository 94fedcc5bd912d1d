"""Raw, stage and master tables as DuckDB common table expressions over the star tables."""

from __future__ import annotations

import re


def blank(c: str) -> str:
    return f"({c} IS NULL OR trim({c}) = '')"


def full(c: str) -> str:
    return f"({c} IS NOT NULL AND trim({c}) <> '')"


def ordered(*columns: str) -> str:
    return ", ".join(f"{c} ASC NULLS FIRST" for c in columns)


LINE = [
    "RECEIPT_ID",
    "PURCHASE_DATE",
    "SCAN_DATE",
    "STORE_NAME",
    "USER_ID",
    "BARCODE",
    "FINAL_QUANTITY",
    "FINAL_SALE",
]
USER = ["ID", "CREATED_DATE", "BIRTH_DATE", "STATE", "LANGUAGE", "GENDER"]
PRODUCT = ["CATEGORY_1", "CATEGORY_2", "CATEGORY_3", "CATEGORY_4", "MANUFACTURER", "BRAND", "BARCODE"]
USER_PART = USER[1:]
PRODUCT_PART = PRODUCT[:-1]

VIEWS: dict[str, str] = {}

VIEWS["raw_transaction"] = """
SELECT 'R' || lpad(o_orderkey::VARCHAR, 12, '0') AS RECEIPT_ID,
       (o_orderdate::DATE + stray)::VARCHAR AS PURCHASE_DATE,
       (o_orderdate::DATE + stray + (o_orderkey % 32)::INTEGER)::VARCHAR || ' '
         || lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':30:00' AS SCAN_DATE,
       CASE o_orderkey % 40
         WHEN 0 THEN ' WALMART ' WHEN 1 THEN 'WALMART' WHEN 2 THEN 'WALMART'
         WHEN 7 THEN 'K ENT ''S MARKE' WHEN 11 THEN 'FRESCO Y MÁS' WHEN 13 THEN 'ALDI, INC'
         ELSE 'STORE ' || (o_orderkey % 40)::VARCHAR END AS STORE_NAME,
       CASE WHEN o_orderkey % 97 = 5 THEN ' '
            ELSE 'U' || lpad((o_custkey + stray)::VARCHAR, 8, '0') END AS USER_ID,
       CASE WHEN l_partkey % 9 = 0 THEN '' WHEN l_partkey % 17 = 0 THEN NULL
            ELSE lpad(l_partkey::VARCHAR, 12, '0') END AS BARCODE,
       CASE WHEN l_linenumber % 4 = 0 THEN 'zero'
            WHEN o_orderkey % 50 = 3 AND l_linenumber = 3 THEN l_quantity::BIGINT::VARCHAR || '.5'
            ELSE l_quantity::DECIMAL(15,2)::VARCHAR END AS FINAL_QUANTITY,
       CASE WHEN (l_orderkey + l_linenumber) % 4 = 1 THEN ' '
            WHEN o_orderkey % 100 = 7 AND l_linenumber = 1 THEN (l_extendedprice * 100)::DECIMAL(15,2)::VARCHAR
            WHEN o_orderkey % 100 = 9 AND l_linenumber = 2 THEN floor(l_extendedprice)::BIGINT::VARCHAR || '.5'
            ELSE l_extendedprice::DECIMAL(15,2)::VARCHAR END AS FINAL_SALE
FROM (SELECT *, (o_orderkey % 50 = 3 AND l_linenumber = 2)::INTEGER AS stray
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""

VIEWS["raw_user"] = """
SELECT CASE WHEN c_custkey = 7 THEN ' ' ELSE
         'U' || lpad((c_custkey + CASE WHEN c_custkey % 5 = 0 THEN 10000000 ELSE 0 END)::VARCHAR, 8, '0') END AS ID,
       (DATE '2014-04-18' + (c_custkey % 3800)::INTEGER)::VARCHAR || ' 12:00:00' AS CREATED_DATE,
       CASE WHEN c_custkey % 27 = 0 THEN ''
            ELSE (DATE '1895-01-01' + (c_custkey * 7919 % 46000)::INTEGER)::VARCHAR END AS BIRTH_DATE,
       CASE WHEN c_custkey % 21 = 0 THEN '' ELSE n_name END AS STATE,
       ['', 'en', 'es-419'][c_custkey % 3 + 1] AS LANGUAGE,
       CASE WHEN c_custkey % 40 = 9 THEN 'female, other' WHEN c_custkey % 40 = 17 THEN 'FEMALE' ELSE
       ['', 'Prefer not to say', 'prefer_not_to_say', 'Non-Binary', 'My gender isn''t listed',
        'not_specified', 'female', 'male'][c_custkey % 8 + 1] END AS GENDER
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""

VIEWS["raw_products"] = """
SELECT CASE p_type WHEN 'PROMO' THEN 'Needs Review' WHEN 'ECONOMY' THEN 'Health & Wellness'
                   WHEN 'SMALL' THEN 'Snacks' WHEN 'LARGE' THEN '' ELSE p_type END AS CATEGORY_1,
       CASE WHEN p_type = 'LARGE' THEN '' WHEN p_type = 'SMALL' AND p_size % 2 = 0 THEN 'Dips & Salsa'
            WHEN p_size % 7 = 0 THEN '' ELSE p_type || ' ' || (p_size % 3)::VARCHAR END AS CATEGORY_2,
       CASE WHEN p_type = 'LARGE' OR p_size % 3 = 0 THEN ''
            ELSE p_type || ' ' || (p_size % 9)::VARCHAR END AS CATEGORY_3,
       CASE WHEN p_size % 10 = 1 AND p_type <> 'LARGE' THEN p_type || ' ' || p_size::VARCHAR
            ELSE '' END AS CATEGORY_4,
       CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 50 = 1 THEN 'PLACEHOLDER MANUFACTURER'
            WHEN p_partkey % 50 = 2 THEN 'MÜLLER & CO'
            ELSE 'MFR & CO, ' || (p_partkey % 5)::VARCHAR END AS MANUFACTURER,
       CASE WHEN p_partkey % 4 = 0 AND p_partkey % 100 <> 0 THEN ''
            WHEN p_partkey % 60 = 6 THEN p_brand || ' É' ELSE p_brand || tail END AS BRAND,
       CASE WHEN p_partkey % 23 = 0 THEN '' WHEN tail = '' THEN lpad(p_partkey::VARCHAR, 12, '0')
            ELSE p_partkey::VARCHAR END AS BARCODE
FROM part JOIN (VALUES (''), (' X')) AS second(tail) ON tail = '' OR p_partkey % 80 = 1
"""

VIEWS["unreadable_transaction"] = """
SELECT * REPLACE (
  CASE right(RECEIPT_ID, 2) WHEN '13' THEN 'not scanned' ELSE SCAN_DATE END AS SCAN_DATE,
  CASE WHEN right(RECEIPT_ID, 2) = '17' AND BARCODE <> '' THEN BARCODE || 'x' ELSE BARCODE END AS BARCODE,
  CASE WHEN right(RECEIPT_ID, 2) = '19' AND FINAL_SALE <> ' ' THEN 'free' ELSE FINAL_SALE END AS FINAL_SALE,
  CASE right(RECEIPT_ID, 2) WHEN '23' THEN 'one' ELSE FINAL_QUANTITY END AS FINAL_QUANTITY)
FROM raw_transaction
"""

VIEWS["unreadable_products"] = """
SELECT * REPLACE (CASE WHEN BARCODE LIKE '%29' THEN BARCODE || 'x' ELSE BARCODE END AS BARCODE) FROM raw_products
"""

VIEWS["stage_transaction"] = f"""
SELECT trim(RECEIPT_ID) AS RECEIPT_ID, PURCHASE_DATE::TIMESTAMP AS PURCHASE_DATE,
       SCAN_DATE::TIMESTAMP AS SCAN_DATE, trim(STORE_NAME) AS STORE_NAME, trim(USER_ID) AS USER_ID,
       nullif(trim(BARCODE), '')::BIGINT AS BARCODE,
       replace(FINAL_QUANTITY, 'zero', '0')::DECIMAL(15,2) AS FINAL_QUANTITY,
       nullif(trim(FINAL_SALE), '')::DECIMAL(15,2) AS FINAL_SALE,
       row_number() OVER (ORDER BY {ordered(*(f"raw_transaction.{c}" for c in LINE))}) AS row_id
FROM raw_transaction
"""

VIEWS["stage_user"] = """
SELECT trim(ID) AS USER_ID, CREATED_DATE::TIMESTAMP AS CREATED_DATE,
       nullif(trim(BIRTH_DATE), '')::TIMESTAMP AS BIRTH_DATE, nullif(STATE, '') AS STATE,
       nullif(LANGUAGE, '') AS LANGUAGE,
       coalesce(wanted, nullif(GENDER, '')) AS GENDER,
       row_number() OVER (ORDER BY ID) AS row_id
FROM raw_user LEFT JOIN (VALUES
  ('Prefer not to say', 'prefer_not_to_say'), ('Non-Binary', 'non_binary'),
  ('My gender isn''t listed', 'not_listed'), ('not_specified', 'not_listed')
) AS spelling(found, wanted) ON found = GENDER
"""

VIEWS["stage_product"] = f"""
SELECT nullif(nullif(trim(CATEGORY_1), ''), 'Needs Review') AS CATEGORY_1,
       {", ".join(f"nullif(trim({c}), '') AS {c}" for c in PRODUCT_PART[1:])},
       nullif(trim(BARCODE), '')::BIGINT AS BARCODE,
       row_number() OVER (ORDER BY {ordered(*(f"raw_products.{c}" for c in ["BARCODE", *PRODUCT_PART]))}) AS row_id
FROM raw_products
"""

VIEWS["master"] = f"""
SELECT {", ".join(f"t.{c}" for c in LINE)}, t.row_id AS DUPE_CHECK,
       {", ".join(f"u.{c} AS USERID_{c}" for c in USER_PART)},
       {", ".join(f"p.{c} AS BARCODE_{c}" for c in PRODUCT_PART)},
       row_number() OVER (ORDER BY {ordered(*(f"t.{c}" for c in LINE), "t.row_id", "p.row_id")}) AS row_id
FROM stage_transaction t
LEFT JOIN stage_user u ON u.USER_ID = t.USER_ID AND u.USER_ID <> ''
LEFT JOIN stage_product p ON p.BARCODE = t.BARCODE
"""

BANDS = """
SELECT * FROM (VALUES
  (1901, 1924, 'The Greatest Generation'), (1925, 1945, 'The Silent Generation'),
  (1946, 1964, 'The Baby Boomer Generation'), (1965, 1979, 'Generation X'),
  (1980, 1994, 'Millenials'), (1995, 2012, 'Generation Z'), (2013, 2025, 'Gen Alpha')
) AS bands(first_year, last_year, label)
"""
VIEWS["bands"] = BANDS


def overlap(left: str, right: str, key: str, left_flag: str, right_flag: str) -> str:
    return f"""
SELECT {key}, if(bool_or(side = 'l'), 'Yes', 'No') AS {left_flag},
       if(bool_or(side = 'r'), 'Yes', 'No') AS {right_flag}
FROM (SELECT {key}, 'l' AS side FROM {left} UNION ALL SELECT {key}, 'r' FROM {right})
WHERE {key} IS NOT NULL GROUP BY {key}
"""


VIEWS["user_overlap"] = overlap(
    "stage_user", "stage_transaction", "USER_ID", "User_Table_Match", "Transaction_Table_Match"
)
VIEWS["barcode_overlap"] = overlap(
    "stage_product", "stage_transaction", "BARCODE", "Products_Table_Match", "Transaction_Table_Match"
)

VIEWS["activity"] = """
SELECT USER_ID, count(DISTINCT week_no) AS CountofWeeks, count(DISTINCT RECEIPT_ID) AS UniqueReceiptsScanned
FROM weeks GROUP BY USER_ID
"""
VIEWS["weeks"] = """
SELECT *, ((dayofyear(SCAN_DATE) + dayofweek(date_trunc('year', SCAN_DATE)) - 1) // 7 + 1)::INTEGER AS week_no
FROM stage_transaction
"""
VIEWS["ranked"] = """
SELECT USER_ID, percent_rank() OVER (ORDER BY CountofWeeks DESC) AS Percentile_Weeks,
       percent_rank() OVER (ORDER BY UniqueReceiptsScanned DESC) AS Percentile_Receipts
FROM activity
"""

_ORDER = [
    "raw_transaction",
    "raw_user",
    "raw_products",
    "unreadable_transaction",
    "unreadable_products",
    "stage_transaction",
    "stage_user",
    "stage_product",
    "master",
    "bands",
    "user_overlap",
    "barcode_overlap",
    "weeks",
    "activity",
    "ranked",
]


def _used(sql: str) -> set[str]:
    found: set[str] = set()
    texts = [sql]
    while texts:
        text = texts.pop()
        new = {name for name in VIEWS if re.search(rf"\b{name}\b", text)} - found
        found |= new
        texts += [VIEWS[name] for name in new]
    return found


def with_views(sql: str) -> str:
    """Put the views that ``sql`` uses in front of it."""
    needed = _used(sql)
    parts = [f"{name} AS ({VIEWS[name].strip()})" for name in _ORDER if name in needed]
    body = sql.strip()
    if not parts:
        return body
    if body.startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[len("WITH ") :]
    return "WITH " + ",\n".join(parts) + "\n" + body
