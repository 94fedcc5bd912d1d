import datetime as dt
from decimal import Decimal

import pytest
from conftest import values
from pyspark.sql import functions as F

from tallyglass.operators import master, staging
from tallyglass.sources.schemas import MASTER, STAGE_PRODUCTS, STAGE_TRANSACTION, STAGE_USER
from tallyglass.sources.scratch import store

LINES = "RECEIPT_ID PURCHASE_DATE SCAN_DATE STORE_NAME USER_ID BARCODE FINAL_QUANTITY FINAL_SALE"
PEOPLE = "ID CREATED_DATE BIRTH_DATE STATE LANGUAGE GENDER"
GOODS = "CATEGORY_1 CATEGORY_2 CATEGORY_3 CATEGORY_4 MANUFACTURER BRAND BARCODE"


@pytest.fixture
def raw(table):
    day, scan = "2024-06-12", "2024-06-13 10:00:00"
    return (
        table(
            LINES,
            (" r1 ", day, scan, " WALMART ", "u1 ", "0017", "zero", " "),
            ("r2", day, scan, "ALDI", "u9", "", "1.00", "2.50"),
            ("r2", day, scan, "ALDI", "u9", "", "1.00", "2.50"),
            ("r3", day, scan, "ALDI", " ", None, "2.00", ""),
            ("r4", day, scan, None, None, "5", "2.00", "7.25"),
        ),
        table(
            PEOPLE,
            ("u2", day, "", " ", "", "Non-Binary"),
            (" u1", day, "1990-05-05", "TX", "en", "not_specified"),
            ("", day, None, "CA", "es-419", ""),
            (None, day, None, "NY", "en", "male"),
        ),
        table(
            GOODS,
            ("Needs Review", " a ", "", None, "M ", "B1", "17"),
            ("Snacks", "a", "b", "c", "", " ", "017"),
            ("", "", "", "", "", "", ""),
        ),
    )


def staged(raw):
    return (
        staging.stage_transactions(raw[0]),
        staging.stage_users(raw[1]),
        staging.stage_products(raw[2]),
    )


def test_stage_tables(raw):
    t, u, p = staged(raw)
    for df, schema in ((t, STAGE_TRANSACTION), (u, STAGE_USER), (p, STAGE_PRODUCTS)):
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in schema]
    first = t.orderBy("row_id").first()
    assert tuple(first) == (
        "r1",
        dt.datetime(2024, 6, 12),
        dt.datetime(2024, 6, 13, 10),
        "WALMART",
        "u1",
        17,
        Decimal("0.00"),
        None,
        1,
    )
    assert sorted(r.row_id for r in t.select("row_id").collect()) == [1, 2, 3, 4, 5]
    assert values(t.where("RECEIPT_ID = 'r3'").select("USER_ID", "BARCODE")) == [("", None)]
    people = {r.USER_ID: r for r in u.collect()}
    assert (people["u1"].GENDER, people["u2"].GENDER, people[""].GENDER) == ("not_listed", "non_binary", None)
    assert (people["u2"].BIRTH_DATE, people["u2"].STATE, people["u2"].LANGUAGE) == (None, None, None)
    goods = p.orderBy("row_id").collect()
    assert [(r.CATEGORY_1, r.CATEGORY_2, r.MANUFACTURER, r.BRAND, r.BARCODE) for r in goods] == [
        (None, None, None, None, None),
        ("Snacks", "a", None, None, 17),
        (None, "a", "M", "B1", 17),
    ]


def test_values_that_do_not_cast(raw, table):
    bad = raw[0].unionByName(
        table(LINES, ("r5", "someday", "2024-06-13", "ALDI", "u1", "12x", "1.00", "3.00"))
    )
    with pytest.raises(Exception, match="cannot cast to"):
        staging.stage_transactions(bad, row_id=False).collect()
    nulled = staging.stage_transactions(bad, on_error="null", row_id=False)
    assert values(nulled.where("RECEIPT_ID = 'r5'").select("PURCHASE_DATE", "BARCODE")) == [(None, None)]
    kept = staging.stage_transactions(bad, on_error="quarantine", row_id=False)
    rejected = staging.rejected_rows(bad, staging.TRANSACTION_TYPES)
    assert kept.count() + rejected.count() == bad.count() == 6
    assert values(rejected.select("RECEIPT_ID", "cast_errors")) == [("r5", ["PURCHASE_DATE", "BARCODE"])]
    with pytest.raises(ValueError):
        staging.stage_transactions(bad, on_error="skip", row_id=False)


def test_date_format(table):
    df = table(PEOPLE, ("u", "13/06/2024", "", "", "", ""))
    row = staging.stage_users(df, row_id=False, date_format="dd/MM/yyyy").first()
    assert row.CREATED_DATE == dt.datetime(2024, 6, 13)


def test_key_overlap(raw):
    t, u, p = staged(raw)
    users = master.key_overlap(u, t, "USER_ID", "in_users", "in_lines")
    assert values(users) == [("", "Yes", "Yes"), ("u1", "Yes", "Yes"), ("u2", "Yes", "No"), ("u9", "No", "Yes")]
    summary = [tuple(r) for r in master.overlap_summary(users).collect()]
    assert summary == [("No", "Yes", 1), ("Yes", "No", 1), ("Yes", "Yes", 2)]
    assert values(master.overlap_examples(users, False, True).select("USER_ID")) == ["u9"]


def test_master_keeps_every_line_and_shows_fanout(raw):
    t, u, p = staged(raw)
    wide = master.build_master(t, u, p)
    assert [(f.name, f.dataType) for f in wide.schema] == [(f.name, f.dataType) for f in MASTER]
    rows = wide.orderBy("row_id").collect()
    assert [r.row_id for r in rows] == [1, 2, 3, 4, 5, 6]
    assert [(r.RECEIPT_ID, r.USERID_STATE, r.BARCODE_CATEGORY_1, r.BARCODE_BRAND) for r in rows] == [
        ("r1", "TX", "Snacks", None),
        ("r1", "TX", None, "B1"),
        ("r2", None, None, None),
        ("r2", None, None, None),
        ("r3", None, None, None),
        ("r4", None, None, None),
    ]
    assert values(master.fanout_check(wide)) == [(1, 2)]
    assert values(master.expected_fanout(t, u, p)) == [(1, 2)]
    lean = master.build_master(t.drop("row_id"), u.drop("row_id"), p.drop("row_id"), row_id=False)
    assert values(lean) == values(wide.drop("row_id", "DUPE_CHECK"))
    with pytest.raises(ValueError):
        master.build_master(t.drop("row_id"), u, p)


def test_shuffle_join_gives_the_same_rows_with_hot_and_null_keys(spark):
    """With broadcasts off, a third of the lines on one key and a third without a key."""
    lines = spark.range(3000).select(
        F.concat(F.lit("r"), (F.col("id") % 700).cast("string")).alias("RECEIPT_ID"),
        F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 1).otherwise(F.col("id") % 90).alias("BARCODE"),
    )
    products = spark.range(0, 100).select(
        F.when(F.col("id") < 3, None).otherwise(F.col("id") % 60).cast("long").alias("BARCODE"),
        *[F.concat(F.lit(c), F.col("id").cast("string")).alias(c) for c in GOODS.split()[:-1]],
    )
    expected = values(
        lines.join(products.where("BARCODE IS NOT NULL"), "BARCODE", "left").select(
            "RECEIPT_ID", "BARCODE", F.col("BRAND")
        )
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        joined = master.add_products(lines, products)
        assert values(joined.select("RECEIPT_ID", "BARCODE", "BARCODE_BRAND")) == expected
        plan = joined._jdf.queryExecution().executedPlan().toString()
        # The NULL rows are hashed on the spread as well as on the key.
        assert "SortMergeJoin" in plan and "hashpartitioning(BARCODE" in plan and "_spread" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("shuffled", [False, True])
def test_lines_are_numbered_before_they_are_widened(spark, shuffled):
    """Repeated barcodes and users, equal lines and hot keys: the same rows and order as a sort of the wide table."""
    lines = spark.range(600).select(
        *[F.concat(F.lit(c[0]), (F.col("id") % k).cast("string")).alias(c) for c, k in (("RECEIPT_ID", 90), ("STORE_NAME", 3))],
        F.lit(None).cast("timestamp_ntz").alias("PURCHASE_DATE"),
        F.lit(None).cast("timestamp_ntz").alias("SCAN_DATE"),
        F.when(F.col("id") % 4 == 0, None).when(F.col("id") % 4 == 1, " ").otherwise(F.concat(F.lit("u"), (F.col("id") % 13).cast("string"))).alias("USER_ID"),
        F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 31).cast("bigint").alias("BARCODE"),
        F.lit(Decimal("1.00")).cast("decimal(15,2)").alias("FINAL_QUANTITY"),
        F.lit(None).cast("decimal(15,2)").alias("FINAL_SALE"),
        (F.col("id") + 1).alias("row_id"),
    )
    users = spark.range(20).select(
        F.when(F.col("id") > 17, " ").otherwise(F.concat(F.lit("u"), (F.col("id") % 15).cast("string"))).alias("USER_ID"),
        *[F.concat(F.lit(c), F.col("id").cast("string")).alias(c) for c in PEOPLE.split()[1:]],
        (F.col("id") + 1).alias("row_id"),
    )
    products = spark.range(60).select(
        *[F.concat(F.lit(c), F.col("id").cast("string")).alias(c) for c in GOODS.split()[:-1]],
        F.when(F.col("id") > 55, None).when(F.col("id") % 5 == 0, 1).otherwise(F.col("id") % 20).cast("bigint").alias("BARCODE"),
        (60 - F.col("id")).alias("row_id"),
    )
    setting = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    for name in setting if shuffled else ():
        spark.conf.set(name, "-1")
    try:
        ours = master.build_master(lines, users, products)
        rows = [tuple(r) for r in ours.orderBy("row_id").collect()]
        plan = ours._jdf.queryExecution().optimizedPlan().toString()
        fanout = values(master.expected_fanout(lines, users, products))
    finally:
        for name in setting if shuffled else ():
            spark.conf.unset(name)
    named = users.where("trim(USER_ID) <> ''").select("USER_ID", F.col("row_id").alias("_u"), *[F.col(c).alias(f"USERID_{c}") for c in PEOPLE.split()[1:]])
    goods = products.select("BARCODE", F.col("row_id").alias("_p"), *[F.col(c).alias(f"BARCODE_{c}") for c in GOODS.split()[:-1]])
    wide = lines.withColumnRenamed("row_id", "DUPE_CHECK").join(named, "USER_ID", "left").join(goods, "BARCODE", "left")
    plain = wide.orderBy(*LINES.split(), "DUPE_CHECK", "_p", "_u").select(*ours.columns[:-1]).collect()
    assert rows == [(*r, k + 1) for k, r in enumerate(plain)]
    assert "Sort " not in plan  # nothing is ordered once the lines are wide
    assert fanout == values(master.fanout_check(ours))


def _lines_with_a_hot_barcode(spark, rows=20_000):
    """Half of the lines name one barcode, a twentieth none, the rest 500 others; users alike."""
    n = F.col("id")
    other = (n % 500 + 1000).cast("string")
    columns = {
        "RECEIPT_ID": F.concat(F.lit("R"), (n / 3).cast("int")),
        "PURCHASE_DATE": F.lit("2024-01-01"),
        "SCAN_DATE": F.lit("2024-01-02"),
        "STORE_NAME": F.lit("SHOP"),
        "USER_ID": F.when(n % 3 == 0, "u1").when(n % 20 == 1, "").otherwise(F.concat(F.lit("u"), other)),
        "BARCODE": F.when(n % 2 == 0, "7").when(n % 20 == 1, None).otherwise(other),
        "FINAL_QUANTITY": F.lit("1"),
        "FINAL_SALE": (n % 10).cast("string"),
    }
    return store(spark.range(rows).select(*[c.alias(k) for k, c in columns.items()]), "hot_lines")


def test_hot_keys_are_few_and_dealt_out_evenly(spark):
    lines = staging.stage_transactions(_lines_with_a_hot_barcode(spark))
    hot = master.hot_keys(lines, "BARCODE", 32)
    assert values(hot) == [(7, 135)]  # 10,000 of the 19,000 lines with a barcode: 16.8 shares of 32, 8 pieces each
    assert master.hot_keys(lines.where("BARCODE <> 7"), "BARCODE", 32).count() == 0
    assert master.hot_keys(lines.limit(0), "BARCODE", 32).count() == 0

    def largest_to_median(spread):
        dealt = spread.repartition(32, "BARCODE", "_spread").groupBy(F.spark_partition_id()).count()
        sizes = sorted(r["count"] for r in dealt.collect())
        return sizes[-1] / sizes[len(sizes) // 2]

    assert largest_to_median(master.spread_lines(lines, "BARCODE")) > 10
    assert largest_to_median(master.spread_lines(lines, "BARCODE", hot)) <= 2


def test_a_master_with_hot_keys_equals_the_plain_join(spark, table):
    lines = staging.stage_transactions(_lines_with_a_hot_barcode(spark, 3000))
    goods = table(
        GOODS,
        ("A", "", "", "", "M", "X", "7"), ("B", "", "", "", "M", "Y", "7"), ("C", "", "", "", "M", "Z", "1001"),
        ("D", "", "", "", "M", "N", None),
    )
    people = table(
        PEOPLE,
        ("u1", "2024-01-01", "1990-01-01", "WI", "en", "female"), ("u1001", "2024-01-01", "", "", "", ""),
        ("", "2024-01-01", "", "XX", "", ""),
    )
    users, products = staging.stage_users(people), staging.stage_products(goods)
    wide = master.build_master(lines, users, products)
    plain = lines.withColumnRenamed("row_id", "DUPE_CHECK").join(
        users.where("USER_ID <> ''").select("USER_ID", F.col("STATE").alias("USERID_STATE")), "USER_ID", "left"
    ).join(products.select("BARCODE", F.col("BRAND").alias("BARCODE_BRAND")), "BARCODE", "left")
    columns = ["DUPE_CHECK", "USER_ID", "BARCODE", "USERID_STATE", "BARCODE_BRAND", "FINAL_SALE"]
    assert values(wide.select(columns)) == values(plain.select(columns))
    assert wide.count() == 4500 and wide.select("row_id").distinct().count() == 4500
    joined = wide._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(cast(sequence(0" in joined  # the hot keys were found and their right rows repeated
