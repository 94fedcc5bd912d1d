"""Many checks in one scan, totals taken while loading, previews that stage only what they show."""

import pytest
from conftest import values
from pyspark.sql import functions as F
from test_tables import STAR, plan_of

from tallyglass.functions.text import text_length
from tallyglass.operators import keys
from tallyglass.operators import values as value_checks
from tallyglass.operators.imports import load_measures
from tallyglass.operators.staging import preview_staged, stage_products, stage_transactions, stage_users
from tallyglass.plans.group_checks import GroupCheck, run_group_checks
from tallyglass.plans.reports import REPORTS
from tallyglass.plans.tables import RetailTables


@pytest.fixture(scope="module")
def star(spark):
    return RetailTables.from_star(spark, STAR)


@pytest.fixture(scope="module")
def saved(star, tmp_path_factory):
    return star.save(str(tmp_path_factory.mktemp("loaded")))


def eight_checks():
    return [
        GroupCheck("repeated", ["RECEIPT_ID", "BARCODE"], rule="repeated"),
        GroupCheck("stores", "STORE_NAME"),
        GroupCheck("lengths", text_length("BARCODE")),
        GroupCheck("not_one_date", "RECEIPT_ID", "PURCHASE_DATE", "not_one"),
        GroupCheck("many_barcodes", "RECEIPT_ID", "BARCODE", "many"),
        GroupCheck("repeats_a_barcode", "RECEIPT_ID", "BARCODE", "not_rows"),
        GroupCheck("mixed_lengths", "STORE_NAME", text_length("BARCODE"), "many"),
        GroupCheck("receipts", "USER_ID", "RECEIPT_ID"),
    ]


def test_each_check_finds_what_its_own_query_finds(saved):
    raw = saved.raw_transactions
    found = run_group_checks(raw, eight_checks()).withColumn("keys", F.array_join("keys", "|", "-")).cache()

    def ours(name, unique=True):
        rows = found.where(F.col("check") == name)
        return values(rows.select("keys", *(["UniqueValues"] if unique else []), "TotalRows"))

    def theirs(df, width=1):
        key = F.array_join(F.array(*[F.col(c).cast("string") for c in df.columns[:width]]), "|", "-")
        return values(df.select(key, *df.columns[width:]))

    assert ours("repeated", False) == theirs(keys.duplicate_keys(raw, ["RECEIPT_ID", "BARCODE"]), 2)
    assert ours("stores", False) == theirs(value_checks.value_counts(raw, "STORE_NAME"))
    assert ours("lengths", False) == theirs(value_checks.length_profile(raw, "BARCODE"))
    for name, column, mode in (
        ("not_one_date", "PURCHASE_DATE", "not_one"),
        ("many_barcodes", "BARCODE", "many"),
        ("repeats_a_barcode", "BARCODE", "not_rows"),
    ):
        assert ours(name) == theirs(keys.single_valued(raw, "RECEIPT_ID", column, mode)), name
    mixed = found.where("check = 'mixed_lengths'").select("keys", "UniqueValues")
    assert values(mixed) == theirs(keys.length_varies(raw, "STORE_NAME", "BARCODE"))
    per_user = value_checks.value_counts(raw, "USER_ID", distinct_of="RECEIPT_ID")
    assert ours("receipts") == theirs(per_user.select("USER_ID", "Unique_RECEIPT_ID", "TotalRows"))


def test_all_checks_read_the_table_once_and_shuffle_twice(saved):
    plan = plan_of(run_group_checks(saved.raw_transactions, eight_checks()))
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 2 and "Join" not in plan
    # The first shuffle goes by value as well, after a fold in the task.
    assert plan.count("hashpartitioning(_check") == 2 and "_value" in plan[plan.rindex("hashpartitioning") :]
    assert "FINAL_SALE" not in plan and "SCAN_DATE" not in plan


def test_missing_keys_and_values(table):
    df = table("k v", (None, "1"), (None, "2"), ("", None), ("a", None), ("a", "1"), ("a", "1"))
    checks = [GroupCheck("n", "k"), GroupCheck("u", "k", "v"), GroupCheck("same", "k", "v", "not_rows")]
    assert values(run_group_checks(df, checks).select("check", F.col("keys")[0], "TotalRows", "UniqueValues")) == sorted(
        [
            ("n", None, 2, None), ("n", "", 1, None), ("n", "a", 3, None),
            ("u", None, 2, 2), ("u", "", 1, 0), ("u", "a", 3, 1),
            ("same", "", 1, 0), ("same", "a", 3, 1),
        ],
        key=lambda r: tuple((x is not None, str(x)) for x in r),
    )
    assert run_group_checks(df.limit(0), checks).count() == 0


def test_a_text_and_a_column_of_that_name_are_different_keys(table):
    df = table("k v", ("a", "1"), ("b", "1"))
    found = run_group_checks(df, [GroupCheck("column", F.col("k")), GroupCheck("text", F.lit("k"))])
    assert values(found.groupBy("check").count()) == [("column", 2), ("text", 1)]


def test_checks_that_make_no_sense_are_refused(table):
    with pytest.raises(ValueError, match="rule must be one of"):
        GroupCheck("a", "k", "v", "some")
    with pytest.raises(ValueError, match="needs a value"):
        GroupCheck("a", "k", rule="many")
    for checks in ([], [GroupCheck("a", "k"), GroupCheck("a", "v")]):
        with pytest.raises(ValueError, match="names of their own"):
            run_group_checks(table("k v", ("1", "2")), checks)


def test_totals_taken_while_saving_equal_counted_ones(star, saved):
    assert values(saved.load_totals) == values(star.load_totals)
    plan = plan_of(REPORTS["load_totals"](saved))
    assert plan.count("FileScan") == 1 and "/load_totals]" in plan and "Aggregate" not in plan
    assert values(saved.load_totals.select("table", "TotalRows")) == [
        (name, getattr(saved, f"raw_{name}").count()) for name in ("products", "transactions", "users")
    ]


def test_a_load_is_measured_not_stopped(table):
    df = table("id amount last", ("1", "2.50", "x"), ("2", " ", "a,b"), ("3", "two", None), ("4", None, ""))
    measured = df.agg(*load_measures(df, "amount")).first()
    assert (measured[0], measured[1], float(measured[2]), measured[3]) == (4, 1, 2.5, 1)
    assert tuple(df.agg(*load_measures(df)).first()) == (4, 1, None, None)
    none = df.limit(0)
    assert [float(v) for v in none.agg(*load_measures(none, "amount")).first()] == [0, 0, 0, 0]


def test_a_preview_stages_only_what_it_shows(star, tmp_path, monkeypatch):
    monkeypatch.setattr("tallyglass.sources.scratch.shared_dir", lambda _: str(tmp_path))
    for raw, stage in (
        (star.raw_transactions, stage_transactions),
        (star.raw_users, stage_users),
        (star.raw_products, stage_products),
    ):
        shown = preview_staged(raw, stage, 7)
        assert "TakeOrderedAndProject(limit=7" in plan_of(shown) and [r.row_id for r in shown.collect()] == list(range(1, 8))
    assert list(tmp_path.iterdir()) == []  # nothing was stored
    whole = star.numbered_products.where("row_id <= 7")
    assert values(whole) == values(preview_staged(star.raw_products, stage_products, 7))
