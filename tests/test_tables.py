"""CSV files to stored tables to answers, and what the plans look like."""

import pytest
from conftest import values
from pyspark.sql import functions as F

from tallyglass.operators.analytics import top_per_group
from tallyglass.operators.staging import stage_transactions, stage_users
from tallyglass.plans.profile import scan_profile, value_counts_of_columns
from tallyglass.plans.reports import REPORTS
from tallyglass.plans.session import shuffle_partitions
from tallyglass.plans.tables import RetailTables
from tallyglass.sources import star_tables
from tallyglass.sources.scratch import stored_bytes
from tallyglass.sources.stored import write_bucketed

STAR = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def star(spark):
    return RetailTables.from_star(spark, STAR)


@pytest.fixture(scope="module")
def saved(spark, star, tmp_path_factory):
    folder = tmp_path_factory.mktemp("csv")
    for name, df in (("t", star.raw_transactions), ("u", star.raw_users), ("p", star.raw_products)):
        df.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
            "ignoreTrailingWhiteSpace", False
        ).csv(f"{folder}/{name}")
    read = RetailTables.from_csv(spark, f"{folder}/t", f"{folder}/u", f"{folder}/p")
    return read.save(str(tmp_path_factory.mktemp("tables")))


@pytest.mark.parametrize(
    "name",
    [
        "stage_transactions",
        "stage_users",
        "stage_products",
        "spend_share_by_generation",
        "power_users",
        "leading_brands",
        "top_store_by_generation",
        "category_level_of_brand_question",
        "user_overlap_summary",
        "barcode_overlap_summary",
    ],
)
def test_csv_and_stored_tables_give_the_same_answers(star, saved, name):
    ours, theirs = REPORTS[name](saved), REPORTS[name](star)
    # Empty fields come back from CSV as NULL, so equal stage rows may swap numbers among each other.
    assert values(ours.drop("row_id")) == values(theirs.drop("row_id"))


def test_saved_master(star, saved):
    assert saved.numbered_master.count() == 6035
    assert values(REPORTS["master_fanout"](saved).select("TotalRows")) == values(
        REPORTS["master_fanout"](star).select("TotalRows")
    )


def test_filters_and_columns_reach_the_scan_of_stored_tables(saved):
    plan = plan_of(REPORTS["leading_brands"](saved))
    scan = plan[plan.index("FileScan") :]
    assert "EqualTo(BARCODE_CATEGORY_2,Dips & Salsa)" in scan and "Join" not in plan
    assert "ReadSchema: struct<RECEIPT_ID:string,BARCODE_CATEGORY_2:string,BARCODE_BRAND:string>" in scan


def test_overlap_reports_over_saved_tables_read_one_small_table(saved):
    for key, table in (("user", "user_overlap"), ("barcode", "barcode_overlap")):
        ids = "user_ids" if key == "user" else "barcodes"
        names = [f"{key}_overlap", f"{key}_overlap_summary", *[n for n in REPORTS if n.startswith(f"{ids}_in_both") or n.startswith(f"{ids}_only")]]
        assert len(names) == 5
        for name in names:
            plan = plan_of(REPORTS[name](saved))
            assert plan.count("FileScan") == 1 and f"/{table}]" in plan and "Union" not in plan, name
    assert "/barcode_conflicts]" in plan_of(REPORTS["conflicting_barcode_rows"](saved))


def test_saved_intermediates_equal_fresh_ones(saved, star):
    for name in ("user_overlap", "barcode_overlap", "conflicting_barcodes", "user_ids_in_both"):
        assert values(REPORTS[name](saved)) == values(REPORTS[name](star)), name


def test_intermediates_live_as_long_as_their_scope(spark, star, tmp_path, monkeypatch):
    monkeypatch.setattr("tallyglass.sources.scratch.shared_dir", lambda _: str(tmp_path))
    stored = lambda: sorted(p.name.split("-")[0] for p in (tmp_path / "tallyglass").glob("*"))
    with RetailTables.from_star(spark, STAR) as tables:
        first = tables.user_overlap
        assert values(REPORTS["user_overlap_summary"](tables)) == values(REPORTS["user_overlap_summary"](star))
        assert tables.user_overlap is first and stored() == ["user_overlap"]  # stored once, read again
        tables.numbered_users.count()
        assert stored() == ["raw_users", "sorted", "user_overlap"]
    assert stored() == []
    with pytest.raises(RuntimeError), tables:
        assert tables.barcode_conflicts.count() > 0 and stored() == ["barcode_conflicts"]
        raise RuntimeError("a report failed")
    assert stored() == []  # also after an error
    assert tables.numbered_users.count() == 150  # made anew
    tables.close()


def test_few_columns_are_read_and_cast_under_the_answers(star):
    """Spreading lines without a key must not need every column of a line."""
    optimized = REPORTS["leading_brands"](star)._jdf.queryExecution().optimizedPlan().toString()
    assert "FINAL_SALE" not in optimized and "SCAN_DATE" not in optimized and "PURCHASE_DATE" not in optimized


def test_ranks_are_cut_before_the_shuffle(saved):
    plan = plan_of(top_per_group(saved.master))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_a_profile_is_one_scan(saved):
    plan = plan_of(scan_profile(saved.raw_transactions))
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
    assert plan_of(value_counts_of_columns(saved.raw_products, ["BRAND", "BARCODE"])).count("FileScan") == 1


def test_distinct_counts_first_spread_a_hot_key(saved):
    plan = plan_of(REPORTS["user_activity"](saved))
    assert "hashpartitioning(USER_ID" in plan and "Expand" not in plan
    assert plan.count("Exchange hashpartitioning") == 2


def test_no_report_multiplies_rows_by_rows(star):
    lazy = [n for n in REPORTS if n.startswith(("missing", "receipts", "user", "barcode", "leading", "top"))]
    for name in lazy:
        plan = plan_of(REPORTS[name](star))
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_bucketed_tables_join_without_a_shuffle(spark, star):
    lines = stage_transactions(star.raw_transactions, row_id=False)
    users = stage_users(star.raw_users, row_id=False)
    write_bucketed(lines, "bucketed_lines", ["USER_ID"], 4)
    write_bucketed(users, "bucketed_users", ["USER_ID"], 4)
    joined = spark.table("bucketed_lines").hint("merge").join(spark.table("bucketed_users"), "USER_ID")
    assert "Exchange" not in plan_of(joined)
    assert joined.count() == lines.join(users, "USER_ID").count()


def test_profile_counts(table):
    df = table("a b", ("x,1", "12"), ("é ", "zz"), (None, ""), (" ", "3"))
    rows = {r["column"]: r.asDict() for r in scan_profile(df, types={"b": "bigint"}).collect()}
    assert rows["a"] == dict(
        column="a", rows=4, missing=2, min_length=0, max_length=3, with_comma=1,
        non_alphanumeric=2, non_ascii=1, cast_failures=0,
    )
    assert (rows["b"]["cast_failures"], rows["b"]["missing"]) == (1, 1)


def test_partition_sizing():
    assert shuffle_partitions(0) == 8
    assert shuffle_partitions(100 * 10**12) == 372_530


def test_every_report_is_a_dataframe_with_named_columns(star):
    for name, report in REPORTS.items():
        if name.startswith(("stage", "master")):
            continue  # these run jobs; the oracle test covers them
        columns = report(star).columns
        assert len(columns) == len(set(columns)) and all(c and "(" not in c for c in columns), name


def test_any_rows_come_from_the_table(star):
    assert values(REPORTS["transactions_any_rows"](star)) == [(100, 100)]


def test_a_task_of_raw_lines_is_no_larger_in_a_larger_table(spark, monkeypatch):
    folder = "/root/testdata/sf0.01"
    apart = star_tables.raw_transaction(spark, folder)
    monkeypatch.setattr(star_tables, "LINE_BYTES", 2**16)
    dealt = star_tables.raw_transaction(spark, folder)
    tasks = dealt.groupBy(F.spark_partition_id()).count().toPandas()["count"]
    asked = -(-stored_bytes(spark, f"{folder}/lineitem.parquet") // 2**16)
    assert len(tasks) == asked > spark.sparkContext.defaultParallelism
    assert tasks.max() < 2 * tasks.mean()
    assert dealt.exceptAll(apart).isEmpty() and apart.exceptAll(dealt).isEmpty()
