from decimal import Decimal

import pytest
from conftest import values
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyglass.operators import analytics


def test_shares(table):
    df = table("g v:decimal(15,2)", ("a", Decimal(1)), ("b", Decimal(2)), ("u", Decimal(3)), ("n", None))
    out = {r.g: r for r in analytics.share_of_total(df, "g", "v", exclude="u", name="s").collect()}
    assert [float(out[k].s) for k in "abu"] == pytest.approx([1 / 6, 1 / 3, 1 / 2])
    assert [float(out[k].s_Nou) for k in "ab"] == pytest.approx([1 / 3, 2 / 3])
    assert out["u"].s_Nou is None and out["n"].s is None


def test_shares_are_cut_not_rounded(table):
    df = table("g v:decimal(15,2)", *[(g, Decimal(n)) for g, n in (("a", 1), ("b", 1), ("c", 4))])
    shares = analytics.share_of_total(df, "g", "v", name="s")
    cut = [r[0] for r in shares.select(analytics.cut_off("s").alias("s"), "g").orderBy("g").collect()]
    assert cut == [Decimal("0.166666"), Decimal("0.166666"), Decimal("0.666666")]


def test_a_zero_total_gives_null_shares(table):
    df = table("g v:decimal(15,2)", ("a", Decimal(1)), ("b", Decimal(-1)))
    assert values(analytics.share_of_total(df, "g", "v", name="s").select("s")) == [None, None]


@pytest.fixture
def visits(table):
    rows = [("u1", f"2024-0{m}-0{d}", f"r{m}{d}") for m in range(1, 10) for d in (1, 2)]
    rows += [("u2", "2024-01-01", "x"), ("u2", "2025-01-02", "y"), (None, "2024-05-05", "z"), ("u3", None, "w")]
    df = table("USER_ID SCAN_DATE RECEIPT_ID", *rows)
    return df.withColumn("SCAN_DATE", F.col("SCAN_DATE").cast("timestamp_ntz"))


def test_weeks_and_activity(visits):
    assert values(analytics.user_activity(visits)) == [(None, 1, 1), ("u1", 10, 18), ("u2", 1, 2), ("u3", 0, 1)]
    by_year = analytics.user_activity(visits, year_aware=True)
    assert values(by_year.where("USER_ID = 'u2'")) == [("u2", 2, 2)]
    weeks = [r[0] for r in analytics.active_weeks(visits).collect()]
    assert weeks == sorted(weeks, key=lambda w: (w is not None, w)) and len(weeks) == len(set(weeks))
    assert (2025, 1) in values(analytics.active_weeks(visits, year_aware=True))


@pytest.mark.parametrize("p", [0.0, 0.01, 0.2, 0.5, 1.0])
def test_power_users_equal_the_plain_definition(spark, p):
    df = spark.range(4000).select(
        F.concat(F.lit("u"), F.floor(F.sqrt("id")).cast("string")).alias("USER_ID"),
        F.timestamp_add("DAY", F.col("id") * 31 % 340, F.lit("2024-01-01").cast("timestamp_ntz")).alias("SCAN_DATE"),
        (F.col("id") * 17 % 1500).cast("string").alias("RECEIPT_ID"),
    )
    ranks = analytics.user_activity(df).select(
        "USER_ID",
        F.percent_rank().over(W.orderBy(F.desc(analytics.WEEKS))).alias("Percentile_Weeks"),
        F.percent_rank().over(W.orderBy(F.desc(analytics.RECEIPTS))).alias("Percentile_Receipts"),
    )
    expected = ranks.where((F.col("Percentile_Weeks") <= p) & (F.col("Percentile_Receipts") <= p))
    assert values(analytics.power_users(df, p).select("USER_ID")) == values(expected.select("USER_ID"))
    assert values(analytics.ranked_users(df)) == values(ranks)


def test_a_single_user_is_a_power_user(visits):
    assert values(analytics.power_users(visits.where("USER_ID = 'u2'")).select("USER_ID")) == ["u2"]


def test_locate_and_lead(table):
    df = table(
        "BARCODE_CATEGORY_1 BARCODE_CATEGORY_2 BARCODE_BRAND RECEIPT_ID",
        ("Snacks", "Dips", "A", "r1"),
        ("Snacks", "Dips", "A", "r1"),
        ("Snacks", "Dips", "A", None),
        ("Snacks", "Dips", "B", "r1"),
        ("Snacks", "Dips", None, "r2"),
        ("Dips", None, "C", "r3"),
        ("Soda", "Cola", "D", "r4"),
    )
    found = analytics.locate_value(df, ["BARCODE_CATEGORY_1", "BARCODE_CATEGORY_2"], "Dips")
    assert values(found) == [("Dips", None), ("Snacks", "Dips")]
    assert [tuple(r) for r in analytics.leading_by_receipts(df, "Dips").collect()] == [("A", 2), ("B", 1)]
    assert [tuple(r) for r in analytics.leading_by_receipts(df, "Dips", leaders=True).collect()] == [("A", 2)]


def test_top_store_keeps_ties(table):
    df = table(
        "RECEIPT_ID STORE_NAME USERID_BIRTH_DATE",
        ("r1", "A", "1970-01-01"),
        ("r1", "A", "1970-01-01"),
        ("r2", "B", "1971-01-01"),
        ("r3", "C", None),
        ("r4", "C", None),
        ("r5", "D", None),
        ("r6", None, None),
    ).withColumn("USERID_BIRTH_DATE", F.col("USERID_BIRTH_DATE").cast("timestamp_ntz"))
    assert values(analytics.top_per_group(df)) == [
        ("Generation X", "A", 1, 1),
        ("Generation X", "B", 1, 1),
        ("Unknown", "C", 2, 1),
    ]
    assert analytics.top_per_group(df, top=2).where("GENERATION = 'Unknown'").count() == 2


def test_leaders_that_tie_all_stay(table):
    df = table("RECEIPT_ID BARCODE_CATEGORY_2 BARCODE_BRAND", ("1", "Dips", "A"), ("2", "Dips", "B"))
    tied = analytics.leading_by_receipts(df, "Dips", leaders=True)
    assert [tuple(r) for r in tied.collect()] == [("A", 1), ("B", 1)]


def test_a_negative_share_is_cut_toward_zero(table):
    df = table("s:decimal(38,13)").sparkSession.sql("SELECT CAST(-0.3333333333333 AS DECIMAL(38,13)) AS s")
    assert df.select(analytics.cut_off("s")).first()[0] == Decimal("-0.333333")
