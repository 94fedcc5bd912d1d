"""Raw receipt tables derived from a star schema (lineitem, orders, customer, nation, part).

The star tables hold clean typed data. These views turn them into the dirty all-text form of a
receipt export: blanks, NULLs, padded names, words for numbers, keys without a partner. The dirt
is fixed arithmetic on the keys, so the same rows come out on any engine and at any scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import stored_bytes

# Only the columns the views use. A declared schema saves reading file footers at plan time.
_COLUMNS = {
    "lineitem": "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz",
    "customer": "c_custkey long, c_nationkey int",
    "nation": "n_nationkey int, n_name string",
    "part": "p_partkey long, p_brand string, p_type string, p_size int",
}

#: Stored bytes of ``lineitem`` to a task of its join. A line takes 10 to 20 of them, its texts some
#: 200 in memory and up to eight rows of them in the checks.
LINE_BYTES = 4 * 2**20


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_COLUMNS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _padded(c: Column, width: int) -> Column:
    return F.lpad(c.cast("string"), width, "0")


def _money_text(c: Column) -> Column:
    return c.cast("decimal(15,2)").cast("string")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines, dealt by order over as many tasks as their files ask for.

    Left alone, Spark merges the join's partitions by the size of its narrow input, and each task
    then holds millions of lines of text in the grouping that follows, more the larger the table.
    The join wants the lines dealt by order anyway; a table that keeps no more tasks busy than
    there are stays as it lies.
    """
    lines = _table(spark, sf_dir, "lineitem")
    tasks = -(-stored_bytes(spark, f"{sf_dir}/lineitem.parquet") // LINE_BYTES)
    return lines.repartition(tasks, "l_orderkey") if tasks > spark.sparkContext.defaultParallelism else lines


def raw_transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    orders = _table(spark, sf_dir, "orders")
    order, part, line = F.col("o_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    # One line of some receipts has another user and other dates than the rest.
    strays = F.when((order % 50 == 3) & (line == 2), 1).otherwise(0)
    day = F.date_add(F.col("o_orderdate").cast("date"), strays)
    scan_day = F.date_add(day, (order % 32).cast("int"))
    price, amount = F.col("l_extendedprice"), F.col("l_quantity")
    shop = order % 40
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.concat(F.lit("R"), _padded(order, 12)).alias("RECEIPT_ID"),
        day.cast("string").alias("PURCHASE_DATE"),
        F.concat(
            scan_day.cast("string"), F.lit(" "), _padded(order % 24, 2), F.lit(":30:00")
        ).alias("SCAN_DATE"),
        F.when(shop == 0, " WALMART ")
        .when(shop.isin(1, 2), "WALMART")
        .when(shop == 7, "K ENT 'S MARKE")
        .when(shop == 11, "FRESCO Y MÁS")
        .when(shop == 13, "ALDI, INC")
        .otherwise(F.concat(F.lit("STORE "), shop.cast("string")))
        .alias("STORE_NAME"),
        F.when(order % 97 == 5, " ")
        .otherwise(F.concat(F.lit("U"), _padded(F.col("o_custkey") + strays, 8)))
        .alias("USER_ID"),
        F.when(part % 9 == 0, "")
        .when(part % 17 == 0, F.lit(None).cast("string"))
        .otherwise(_padded(part, 12))
        .alias("BARCODE"),
        F.when(line % 4 == 0, "zero")
        .when((order % 50 == 3) & (line == 3), F.concat(amount.cast("bigint").cast("string"), F.lit(".5")))
        .otherwise(_money_text(amount))
        .alias("FINAL_QUANTITY"),
        F.when((order + line) % 4 == 1, " ")
        .when((order % 100 == 7) & (line == 1), _money_text(price * 100))
        .when((order % 100 == 9) & (line == 2), F.concat(F.floor(price).cast("string"), F.lit(".5")))
        .otherwise(_money_text(price))
        .alias("FINAL_SALE"),
    )


def raw_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _table(spark, sf_dir, "customer")
    nations = _table(spark, sf_dir, "nation")
    key = F.col("c_custkey")
    created = F.date_add(F.lit("2014-04-18").cast("date"), (key % 3800).cast("int"))
    born = F.date_add(F.lit("1895-01-01").cast("date"), (key * 7919 % 46000).cast("int"))
    genders = [
        "",
        "Prefer not to say",
        "prefer_not_to_say",
        "Non-Binary",
        "My gender isn't listed",
        "not_specified",
        "female",
        "male",
    ]
    languages = ["", "en", "es-419"]
    return customers.join(nations, customers.c_nationkey == nations.n_nationkey).select(
        F.when(key == 7, " ")
        .otherwise(F.concat(F.lit("U"), _padded(F.when(key % 5 == 0, key + 10_000_000).otherwise(key), 8)))
        .alias("ID"),
        F.concat(created.cast("string"), F.lit(" 12:00:00")).alias("CREATED_DATE"),
        F.when(key % 27 == 0, "").otherwise(born.cast("string")).alias("BIRTH_DATE"),
        F.when(key % 21 == 0, "").otherwise(F.col("n_name")).alias("STATE"),
        F.element_at(F.array(*map(F.lit, languages)), (key % 3 + 1).cast("int")).alias("LANGUAGE"),
        F.when(key % 40 == 9, "female, other")
        .when(key % 40 == 17, "FEMALE")
        .otherwise(F.element_at(F.array(*map(F.lit, genders)), (key % 8 + 1).cast("int")))
        .alias("GENDER"),
    )


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _table(spark, sf_dir, "part")
    key, size, kind = F.col("p_partkey"), F.col("p_size"), F.col("p_type")

    def numbered(n: Column) -> Column:
        return F.concat(kind, F.lit(" "), n.cast("string"))

    # The second copy of a part has another brand and an unpadded barcode.
    copies = F.when(key % 80 == 1, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    rows = parts.select(key, "p_brand", kind, size, F.explode(copies).alias("second"))
    second = F.col("second")
    return rows.select(
        F.when(kind == "PROMO", "Needs Review")
        .when(kind == "ECONOMY", "Health & Wellness")
        .when(kind == "SMALL", "Snacks")
        .when(kind == "LARGE", "")
        .otherwise(kind)
        .alias("CATEGORY_1"),
        F.when(kind == "LARGE", "")
        .when((kind == "SMALL") & (size % 2 == 0), "Dips & Salsa")
        .when(size % 7 == 0, "")
        .otherwise(numbered(size % 3))
        .alias("CATEGORY_2"),
        F.when((kind == "LARGE") | (size % 3 == 0), "").otherwise(numbered(size % 9)).alias("CATEGORY_3"),
        F.when((size % 10 == 1) & (kind != "LARGE"), numbered(size)).otherwise("").alias("CATEGORY_4"),
        F.when(key % 4 == 0, "")
        .when(key % 50 == 1, "PLACEHOLDER MANUFACTURER")
        .when(key % 50 == 2, "MÜLLER & CO")
        .otherwise(F.concat(F.lit("MFR & CO, "), (key % 5).cast("string")))
        .alias("MANUFACTURER"),
        F.when((key % 4 == 0) & (key % 100 != 0), "")
        .when(key % 60 == 6, F.concat(F.col("p_brand"), F.lit(" É")))
        .when(second, F.concat(F.col("p_brand"), F.lit(" X")))
        .otherwise(F.col("p_brand"))
        .alias("BRAND"),
        F.when(key % 23 == 0, "")
        .when(second, key.cast("string"))
        .otherwise(_padded(key, 12))
        .alias("BARCODE"),
    )


def unreadable_transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_transaction`` with dates, barcodes, sales and quantities that no cast can read."""
    tail = F.right("RECEIPT_ID", F.lit(2))
    return raw_transaction(spark, sf_dir).withColumns(
        {
            "SCAN_DATE": F.when(tail == "13", "not scanned").otherwise(F.col("SCAN_DATE")),
            "BARCODE": F.when((tail == "17") & (F.col("BARCODE") != ""), F.concat("BARCODE", F.lit("x"))).otherwise(
                F.col("BARCODE")
            ),
            "FINAL_SALE": F.when((tail == "19") & (F.col("FINAL_SALE") != " "), "free").otherwise(F.col("FINAL_SALE")),
            "FINAL_QUANTITY": F.when(tail == "23", "one").otherwise(F.col("FINAL_QUANTITY")),
        }
    )


def unreadable_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_products`` with barcodes that no cast can read."""
    barcode = F.col("BARCODE")
    odd = F.when(barcode.endswith("29"), F.concat(barcode, F.lit("x"))).otherwise(barcode)
    return raw_products(spark, sf_dir).withColumn("BARCODE", odd)
