from types import SimpleNamespace

import pytest
from conftest import values
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyglass.operators.ordering import add_amount_before, add_percent_rank, add_row_id
from tallyglass.sources.scratch import shared_dir, store, stored_bytes


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows are copies of one row, some keys are NULL."""
    n = 3000
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 == 1, None)
    raw = spark.range(n).select(
        key.otherwise(F.concat(F.lit("k"), (F.col("id") * 7919 % n).cast("string"))).alias("k"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 11).cast("long").alias("v"),
    )
    return store(raw, "skewed")


def test_row_id_equals_row_number(skewed):
    ours = add_row_id(skewed, ["k", "v"], partitions=7)
    plain = skewed.withColumn("row_id", F.row_number().over(W.orderBy("k", "v")).cast("long"))
    assert values(ours) == values(plain)


def test_copies_of_one_row_spread_over_partitions(skewed):
    """The sort itself must cut inside a group of equal rows."""
    from tallyglass.operators import ordering

    kept = []
    original = ordering.store
    ordering.store = lambda df, name: kept.append(original(df, name)) or kept[-1]
    try:
        add_row_id(skewed, ["k", "v"], partitions=8)
    finally:
        ordering.store = original
    hot = kept[0].where("k = 'hot'").groupBy(ordering.PART).count().collect()
    assert len(hot) > 1 and max(r["count"] for r in hot) < 1000


def test_row_id_with_unique_order(spark):
    df = store(spark.range(1000).select((F.col("id") * 37 % 1000).alias("x")), "unique")
    got = add_row_id(df, [F.col("x").desc()], "n", unique_order=True, partitions=5)
    assert got.where("n != 1000 - x").count() == 0 and got.select("n").distinct().count() == 1000


def test_row_id_of_nothing_and_of_one_row(spark):
    one = store(spark.range(1), "one")
    assert [tuple(r) for r in add_row_id(one, ["id"]).collect()] == [(0, 1)]
    assert add_row_id(one.where("id > 0"), ["id"]).count() == 0


def test_amount_before(spark):
    df = store(spark.range(500).select("id", (F.col("id") % 13).alias("n")), "amounts")
    plain = W.orderBy(F.desc("id")).rowsBetween(W.unboundedPreceding, -1)
    expected = df.withColumn("before", F.coalesce(F.sum("n").over(plain), F.lit(0)))
    assert values(add_amount_before(df, [F.desc("id")], "n", "before", partitions=6)) == values(expected)


@pytest.mark.parametrize("descending", [True, False])
def test_percent_rank(skewed, descending):
    order = F.desc("v") if descending else F.asc("v")
    df = skewed.withColumn("v", F.when(F.col("v") != 7, F.col("v")))
    expected = df.withColumn("p", F.percent_rank().over(W.orderBy(order)))
    assert values(add_percent_rank(df, "v", "p", descending)) == values(expected)


def test_percent_rank_of_one_row(spark):
    assert [tuple(r) for r in add_percent_rank(spark.range(1), "id", "p").collect()] == [(0, 0.0)]


def test_scratch_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == named
    stored = store(spark.range(3), "kept")
    assert all(named in f for f in stored.inputFiles()) and stored.count() == 3


def test_without_a_checkpoint_folder_tables_go_to_the_warehouse():
    def session(**conf):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: conf.get(key, default)))

    for master in ("yarn", "local[2]"):
        assert shared_dir(session(**{"spark.master": master, "spark.sql.warehouse.dir": "hdfs:///w/"})) == "hdfs:///w/_stored"


def test_the_sorted_layout_is_packed(spark, tmp_path, monkeypatch):
    rows = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("a"), "id").coalesce(1)
    rows.write.parquet(str(tmp_path / "plain"))
    plain = stored_bytes(spark, str(tmp_path / "plain"))
    monkeypatch.setattr("tallyglass.sources.scratch.shared_dir", lambda _: str(tmp_path / "shared"))
    numbered = add_row_id(rows, ["a"], unique_order=True, partitions=1)
    # The layout holds the same rows and two whole numbers more.
    assert stored_bytes(spark, str(tmp_path / "shared")) < 0.9 * plain
    assert numbered.drop("row_id").exceptAll(rows).isEmpty() and numbered.count() == 20_000
