"""Accepted and rejected rows from one scan."""

import pytest
from conftest import values
from pyspark.sql import functions as F

from tallyglass.operators import staging
from tallyglass.plans.reports import REPORTS
from tallyglass.plans.tables import RetailTables
from tallyglass.sources.schemas import RAW_TRANSACTION

STAR = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def texts(df):
    return values(df.select(*[c if c != "cast_errors" else df[c].cast("string") for c in df.columns]))


@pytest.fixture(scope="module")
def raw(spark):
    t = RetailTables.from_star(spark, STAR, unreadable=True)
    return {"transactions": t.raw_transactions, "users": t.raw_users, "products": t.raw_products}


@pytest.mark.parametrize(
    "name, stage, types",
    [
        ("transactions", staging.stage_transactions, staging.TRANSACTION_TYPES),
        ("users", staging.stage_users, staging.USER_TYPES),
        ("products", staging.stage_products, staging.PRODUCT_TYPES),
    ],
)
def test_split_equals_the_two_scans(raw, name, stage, types):
    accepted, rejected = staging.split_staged(raw[name])
    kept, left_out = stage(raw[name], on_error="quarantine", row_id=False), staging.rejected_rows(raw[name], types)
    assert accepted.dtypes == kept.dtypes and rejected.dtypes == left_out.dtypes
    assert values(accepted) == values(kept) and texts(rejected) == texts(left_out)
    assert accepted.count() + rejected.count() == raw[name].count()
    assert (rejected.count() > 0) == (name != "users")


def test_each_half_reads_its_own_files(raw):
    accepted, rejected = staging.split_staged(raw["products"])
    for df, other in ((accepted, "false"), (rejected, "true")):
        plan = plan_of(df)
        assert plan.count("FileScan") == 1 and "accepted#" in plan.split("PartitionFilters: [")[1].split("]")[0]
        read = {r[0] for r in df.select(F.input_file_name()).distinct().collect()}
        assert read and not [f for f in read if f"accepted={other}" in f]


def test_edges(table):
    columns = "ID CREATED_DATE BIRTH_DATE STATE LANGUAGE GENDER"
    rows = [
        (None, None, None, None, None, None),
        ("u1", "13/06/2024", " ", "TX", "en", ""),
        ("u1", "13/06/2024", " ", "TX", "en", ""),
        ("u2", "2024-06-13", "never", "", "", "Non-Binary"),
    ]
    accepted, rejected = staging.split_staged(table(columns, *rows), date_format="dd/MM/yyyy")
    assert sorted(r.USER_ID or "" for r in accepted.collect()) == ["", "u1", "u1"]  # equal rows all stay
    assert [(r.ID, r.cast_errors) for r in rejected.collect()] == [("u2", ["CREATED_DATE", "BIRTH_DATE"])]
    for half in staging.split_staged(table(columns, *rows).limit(0)):
        assert half.count() == 0
    accepted, rejected = staging.split_staged(table(columns, rows[3]), date_format="dd/MM/yyyy")
    assert (accepted.count(), rejected.count()) == (0, 1)


def test_reports_in_a_scope_share_one_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tallyglass.sources.scratch.shared_dir", lambda _: str(tmp_path))
    names = ("stage_transactions_quarantine", "rejected_transactions")
    alone = RetailTables.from_star(spark, STAR, unreadable=True)
    expected = [values(REPORTS[n](alone)) for n in names]
    with RetailTables.from_star(spark, STAR, unreadable=True) as tables:
        found = [REPORTS[n](tables) for n in names]
        assert [values(df) for df in found] == expected
        for df in found:
            assert plan_of(df).count("FileScan") == 1 and all("/split-" in f for f in df.inputFiles())
        assert len(list((tmp_path / "tallyglass").glob("*"))) == 1
    assert not list((tmp_path / "tallyglass").glob("*"))


def test_casts_of_a_joined_raw_table_stay_out_of_the_join(spark, table):
    lines = table("k:long", 1, 2, 3)
    texts = table("k:long a", (1, "2024-06-13"), (2, "never"), (3, None))
    made = F.concat("a", F.lit(" 08:30:00"))
    raw = lines.join(texts.hint("merge"), "k").select(
        *[made.alias(c) if c == "SCAN_DATE" else F.lit("1").alias(c) for c in RAW_TRANSACTION.fieldNames()]
    ).withColumn("PURCHASE_DATE", F.lit(None).cast("string"))
    accepted = staging.stage_transactions(raw, "quarantine", row_id=False)
    rejected = staging.rejected_rows(raw, staging.TRANSACTION_TYPES)
    for df in (accepted, rejected):
        # The text is made once, above the join, and not once more for each use in a filter.
        assert plan_of(df).count("08:30:00") == 1
    assert values(accepted.select(F.col("SCAN_DATE").cast("string"))) == [None, "2024-06-13 08:30:00"]
    assert [(r.SCAN_DATE, r.cast_errors) for r in rejected.collect()] == [("never 08:30:00", ["SCAN_DATE"])]
