"""Tables bucketed for their joins: plans without a shuffle, equal answers, even buckets."""

import pytest
from conftest import values
from pyspark.sql import functions as F

from tallyglass.operators import colocated
from tallyglass.operators.master import SPREAD, add_users
from tallyglass.plans.reports import REPORTS
from tallyglass.plans.tables import RetailTables
from tallyglass.sources.stored import read_bucketed

STAR = "/root/testdata/sf0.001"
BUCKETS = 8


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def no_broadcast(spark):
    """Tables too large to broadcast, as far as Spark knows."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture(scope="module")
def star(spark):
    return RetailTables.from_star(spark, STAR)


@pytest.fixture(scope="module")
def folder(star, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("bucketed"))
    star.save(folder, buckets=BUCKETS)
    return folder


@pytest.fixture(scope="module")
def saved(spark, folder):
    return RetailTables.from_folder(spark, folder)


def test_neither_side_of_a_stored_join_is_shuffled(saved, no_broadcast):
    for df in (saved.lines_with_users, saved.lines_with_products):
        plan = plan_of(df)
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert plan.count("Bucketed: true") == 2 and f"SelectedBucketsCount: {BUCKETS} out of {BUCKETS}" in plan


def test_the_wide_table_shuffles_its_lines_once(saved, star, no_broadcast):
    # Lines and products by barcode; the join by user finds both sides in place.
    assert plan_of(saved.master).count("Exchange") == 2
    assert plan_of(star.master).count("Exchange") >= 4


def test_few_columns_are_read(saved, no_broadcast):
    plan = plan_of(REPORTS["leading_brands"](saved))
    assert "ReadSchema: struct<RECEIPT_ID:string,BARCODE:bigint,_spread:bigint>" in plan


@pytest.mark.parametrize(
    "name",
    ["spend_share_by_generation", "leading_brands", "top_store_by_generation", "category_level_of_brand_question", "master_fanout"],
)
def test_answers_are_those_of_plain_joins(saved, star, name):
    ours, theirs = REPORTS[name](saved), REPORTS[name](star)
    if name == "master_fanout":  # equal lines may swap numbers
        ours, theirs = ours.select("TotalRows"), theirs.select("TotalRows")
    assert values(ours) == values(theirs)


def test_wide_rows_are_those_of_plain_joins(saved, star):
    assert saved.master.columns == star.master.columns
    assert values(saved.master) == values(star.master)
    assert saved.traced_master.columns == star.traced_master.columns
    assert saved.numbered_master.count() == saved.master.count()


def test_saving_again_without_buckets_reads_the_wide_table(spark, star, tmp_path):
    star.save(str(tmp_path), buckets=2)
    again = star.save(str(tmp_path))
    assert "/master]" in plan_of(again.master) and "Join" not in plan_of(again.master)


def lines_and_users(spark, hot_share: float, rows: int = 20_000):
    """Lines of which a share names one user, a tenth names nobody and the others are spread evenly."""
    user = (
        F.when(F.col("id") < rows * hot_share, "hot")
        .when(F.col("id") < rows * (hot_share + 0.1), F.when(F.col("id") % 2 == 0, F.lit(" ")))
        .otherwise(F.concat(F.lit("u"), F.col("id") % 997))
    )
    lines = spark.range(rows).select(
        F.concat(F.lit("r"), F.col("id")).alias("RECEIPT_ID"), user.alias("USER_ID"), F.col("id").alias("row_id")
    )
    known = spark.range(900).select(F.concat(F.lit("u"), F.col("id")).alias("USER_ID"), F.col("id").alias("place"))
    # The hot user stands on two rows, so its lines double; a blank id and a NULL match nothing.
    more = spark.createDataFrame([("hot", 1), ("hot", 2), (" ", 3), (None, 4)], "USER_ID string, place bigint")
    return lines, known.unionByName(more)


def test_a_hot_key_does_not_fill_one_bucket(spark, tmp_path):
    lines, users = lines_and_users(spark, 0.5)
    colocated.write_colocated(lines, users, "USER_ID", str(tmp_path), BUCKETS)
    left = read_bucketed(
        spark,
        f"{tmp_path}/left",
        lines.withColumn(SPREAD, F.lit(0).cast("bigint")).schema,
        ["USER_ID", SPREAD],
        BUCKETS,
    )
    sizes = sorted(r["count"] for r in left.groupBy(F.input_file_name()).count().collect())
    assert sum(sizes) == 20_000 and len(sizes) == BUCKETS and sizes[-1] < 2 * sizes[len(sizes) // 2]
    joined = colocated.read_colocated(spark, "USER_ID", str(tmp_path), BUCKETS, lines.schema, users.schema)
    plain = lines.join(users.where(F.trim("USER_ID") != ""), "USER_ID", "left")
    assert values(joined.select(*plain.columns)) == values(plain)
    assert joined.count() == 30_000


def test_even_keys_and_empty_sides(spark, tmp_path):
    lines, users = lines_and_users(spark, 0.0, 2_000)
    nobody = users.limit(0)
    for name, left, right in (("even", lines, users), ("no_users", lines, nobody), ("no_lines", lines.limit(0), users)):
        colocated.write_colocated(left, right, "USER_ID", f"{tmp_path}/{name}", 4)
        joined = colocated.read_colocated(spark, "USER_ID", f"{tmp_path}/{name}", 4, left.schema, right.schema)
        assert values(joined.select("row_id", "place")) == values(
            left.join(right.where(F.trim("USER_ID") != ""), "USER_ID", "left").select("row_id", "place")
        ), name


def test_quotes_in_a_path(spark, star, tmp_path):
    folder = str(tmp_path / "it's here")
    star.save(folder, buckets=2)
    read = RetailTables.from_folder(spark, folder)
    assert read.lines_with_users.count() == add_users(star.transactions, star.users).count()
