import datetime as dt
from decimal import Decimal

import pytest
from conftest import values
from pyspark.sql import functions as F

from tallyglass.functions import is_missing, typed
from tallyglass.operators import dates, keys, missing, outliers
from tallyglass.operators import values as checks


@pytest.fixture
def goods(table):
    return table(
        "maker brand code",
        ("A", "a1", "052336919068"),
        ("A", "a2", "52336919068"),
        ("", "a1", " "),
        (None, " ", None),
        ("B", "", "0"),
        ("B", "b1", "17"),
        ("B", "b1", "17"),
    )


def test_missing_counts(goods):
    row = missing.missing_counts(goods, total=True).first().asDict()
    assert row == {"maker_NULLCount": 2, "brand_NULLCount": 2, "code_NULLCount": 2, "TotalRows": 7}
    only = missing.missing_counts(goods, ["brand"], where=is_missing("maker")).first()
    assert tuple(only) == (1,)


def test_missing_counts_of_nothing_are_zero(goods):
    assert tuple(missing.missing_counts(goods.limit(0)).first()) == (0, 0, 0)


def test_missing_rows_pair_and_xor(goods):
    assert missing.missing_rows(goods, "code").count() == 2
    assert values(missing.missing_pair(goods, "maker", "brand")) == [
        ("Both Missing", 1),
        ("Neither Missing", 4),
        ("Only One is Missing", 2),
    ]
    assert values(missing.missing_xor_rows(goods, "maker", "brand").select("maker", "brand")) == [
        ("", "a1"),
        ("B", ""),
    ]


def test_missing_range_compares_dates_not_text(table):
    df = table("v d", ("", "2024-10-01"), (None, "2024-9-30"), ("x", "2030-01-01"), (" ", ""))
    assert tuple(missing.missing_range(df, "v", ["d"]).first()) == (
        dt.datetime(2024, 9, 30),
        dt.datetime(2024, 10, 1),
    )
    assert tuple(missing.missing_range(df, "v", ["d"], dtype=None).first()) == ("", "2024-9-30")


def test_breakdown_and_value_counts(goods):
    assert values(missing.breakdown(goods, "maker", F.col("brand") == "a1")) == [("", 1), ("A", 1)]
    counted = checks.value_counts(goods, "maker", distinct_of="brand")
    assert [tuple(r) for r in counted.collect()] == [("B", 3, 2), ("A", 2, 2), (None, 1, 1), ("", 1, 1)]
    assert values(checks.value_counts(goods, "maker", drop_missing=True)) == [("A", 2), ("B", 3)]
    by_value = checks.value_counts(goods, "maker", order="value").collect()
    assert [r["maker"] for r in by_value] == [None, "", "A", "B"]


def test_distinct_lengths_and_patterns(table):
    df = table("v", "x", "x ", "é-1", None, "x")
    assert [r[0] for r in checks.distinct_values(df, "v").collect()] == [None, "x", "x ", "é-1"]
    assert values(checks.length_profile(df, "v")) == [(None, 1), (1, 3), (3, 1)]
    assert values(checks.pattern_violations(df, "v")) == ["é-1"]
    assert values(checks.pattern_violations(df, "v", "x ")) == ["x "]
    assert values(checks.non_ascii_values(df, "v")) == ["é-1"]
    assert [r[0] for r in checks.lookup(df, F.col("v").like("x%"), "v").collect()] == ["x", "x", "x "]


def test_cast_audit_formats_and_spread(table):
    df = table("v", "zero", "0.00", "1.00", "0.23", "276.00", "1.5", "abc", "", None)
    dec = "decimal(15,2)"
    assert values(checks.cast_audit(df, "v", dec).select("v")) == ["abc", "zero"]
    assert values(checks.cast_audit(df, "v", dec, ignore=["zero"]).select("v")) == ["abc"]
    assert checks.cast_audit(df, "v", dec, ignore_missing=False).count() == 4
    assert checks.cast_audit(df, "v", dec, only_failures=False).count() == 9
    assert values(checks.decimal_format(df, "v", "fraction", ["zero"])) == ["0.23", "1.5", "abc"]
    assert values(checks.decimal_format(df, "v", "places", ["zero"])) == ["1.5", "abc"]
    spread = checks.spread(df, "v", dec, ignore=["zero", "abc"], drop_missing=True).collect()
    assert [tuple(r) for r in spread] == [
        (Decimal(x), 1) for x in ("0.00", "0.23", "1.00", "1.50", "276.00")
    ]


def test_cross_field_rules(table):
    df = table(
        "FINAL_QUANTITY FINAL_SALE",
        ("zero", "1.00"),
        ("0.00", "2.00"),
        ("zero", " "),
        ("1.00", ""),
        ("1.00", "0.00"),
        ("2.00", "5.00"),
        (None, "5.00"),
    )
    assert values(checks.rule_violations(df, checks.zero_quantity_with_sale())) == [
        ("0.00", "2.00"),
        ("zero", "1.00"),
    ]
    assert values(checks.rule_violations(df, checks.quantity_without_sale())) == [
        ("1.00", ""),
        ("1.00", "0.00"),
    ]


def test_keys(goods):
    assert values(keys.duplicate_keys(goods, "code")) == [("17", 2)]
    cast = typed("code", "bigint").alias("CAST_BARCODE")
    assert values(keys.duplicate_keys(goods, cast, sort=True)) == [(None, 2), (17, 2), (52336919068, 2)]
    assert values(keys.length_varies(goods, "maker", "code")) == [("A", 2), ("B", 2)]
    assert [tuple(r) for r in keys.parents_per_child(goods, "brand", "maker").collect()][0] == ("a1", 2)
    conflicts = keys.conflicting_keys(goods, cast, ["maker", "brand"])
    assert values(conflicts) == [(52336919068, 2)]
    reviewed = keys.review_conflicts(goods, conflicts, cast)
    assert values(reviewed.select("brand", "TotalRows")) == [("a1", 2), ("a2", 2)]


def test_single_valued(table):
    df = table("k v", ("a", "1"), ("a", "2"), ("b", "1"), ("b", "1"), ("c", ""), ("c", None), ("d", "1"), ("d", ""))
    found = lambda **kw: values(keys.single_valued(df, "k", "v", **kw).select("k"))
    assert found() == ["a", "d"]
    assert found(missing="ignore") == ["a", "c"]
    assert found(missing="one_value") == ["a", "d"]
    assert found(mode="many") == ["a", "d"]
    assert found(mode="not_rows", missing="one_value") == ["b", "c"]


def test_dates(table):
    df = table(
        "p s",
        ("2024-02-28", "2024-02-28 13:30:00"),
        ("2024-02-29", "2024-03-01 00:10:00"),
        ("2024-02-29", "2024-02-29 23:30:00"),
        ("2024-04-09", "2024-04-10 13:00:00"),
        ("", None),
    )
    assert values(dates.hour_profile(df, "s")) == [(None, 1), (0, 1), (13, 2), (23, 1)]
    day = dt.date
    gaps = [tuple(r) for r in dates.date_gaps(df, "p").collect()]
    assert gaps == [
        (day(2024, 4, 9), day(2024, 2, 29), 40),
        (day(2024, 2, 29), day(2024, 2, 28), 1),
        (None, None, None),
        (day(2024, 2, 28), None, None),
    ]
    assert [r[0] for r in dates.date_gaps(df, "p", order="date").collect()][:2] == [None, day(2024, 2, 28)]
    assert dates.date_mismatch(df, "p", "s").count() == 2
    assert values(dates.date_lag_profile(df, "p", "s")) == [(1, 2)]


@pytest.mark.parametrize(
    "numbers",
    [[1, 2, 3, 4, 100], [5], [1, 1, 1, 1, 9, -9], list(range(50)) + [500, 501, -300], [3, 4], [10] * 7 + [1, 99]],
)
def test_box_summary_against_numpy(spark, numbers):
    import numpy as np

    df = spark.createDataFrame([(str(x),) for x in numbers] + [(" ",), (None,)], "v string")
    q1, median, q3 = np.percentile(numbers, [25, 50, 75])
    reach = 1.5 * (q3 - q1)
    inside = [x for x in numbers if q1 - reach <= x <= q3 + reach]
    low, high = min([*inside, q1]), max([*inside, q3])
    summary = outliers.box_summary(df, "v")
    row = summary.first().asDict()
    assert row["n"] == len(numbers)
    expected = dict(q1=q1, median=median, q3=q3, whisker_low=low, whisker_high=high)
    assert {k: row[k] for k in expected} == pytest.approx(expected)
    beyond = [float(x) for x in numbers if x < low or x > high]
    assert row["low_outliers"] + row["high_outliers"] == len(beyond)
    assert sorted(float(r[0]) for r in outliers.box_outliers(df, "v", summary).collect()) == sorted(beyond)


def test_box_summary_of_nothing(table):
    row = outliers.box_summary(table("v", " ", None), "v").first()
    assert (row["n"], row["q1"], row["low_outliers"]) == (0, None, 0)


def test_quartiles_are_made_exact_inside_the_brackets_of_a_coarse_sketch(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    for numbers in (rng.normal(size=4000).round(3), np.r_[np.zeros(3000), rng.integers(0, 50, 999)], rng.exponential(size=5001)):
        df = spark.createDataFrame([(repr(float(x)),) for x in numbers], "v string").repartition(7)
        row = outliers.box_summary(df, "v", accuracy=50).first()
        assert [row.q1, row.median, row.q3] == pytest.approx(list(np.percentile(numbers, [25, 50, 75])), rel=1e-12)
        rough = outliers.box_summary(df, "v", accuracy=50, approx=True).first()
        assert rough.n == len(numbers)
        for q, share in ((rough.q1, 0.25), (rough.median, 0.5), (rough.q3, 0.75)):
            assert np.mean(numbers < q) - 0.03 <= share <= np.mean(numbers <= q) + 0.03


def test_a_box_runs_no_job_while_it_is_planned(spark):
    df = spark.createDataFrame([("1",), ("2",)], "v string")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    spark.sparkContext.setJobGroup("box", "planning")
    try:
        box = outliers.box_summary(df, "v")
        outliers.box_outliers(df, "v", box)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("box") and before is not None
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    plan = box._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort " not in plan
