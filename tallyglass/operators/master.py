"""Integration: which keys match, the wide table, and what the joins multiplied."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_missing
from ..sources.schemas import LINE_COLUMNS, PRODUCT_COLUMNS, USER_COLUMNS
from ..sources.scratch import store
from .ordering import add_row_id

SPREAD = "_spread"
_TIMES, _FIRST, _PARTS = "_times", "_first", "_parts"

#: Into how many pieces an even share of a hot key is cut; more pieces lie more evenly in hash partitions.
PIECES = 8


def key_overlap(
    left: DataFrame, right: DataFrame, key: str, left_flag: str, right_flag: str
) -> DataFrame:
    """Every non-NULL key of either table with Yes/No per table.

    One shuffle: keys are tagged, put together and grouped. Each task first folds its own copies
    of a key, so a key that fills a third of the rows crosses the network once per task.
    """
    tagged = left.select(key, F.lit(True).alias("l"), F.lit(False).alias("r")).unionByName(
        right.select(key, F.lit(False).alias("l"), F.lit(True).alias("r"))
    )

    def yes_no(side: str) -> Column:
        return F.when(F.bool_or(side), "Yes").otherwise("No")

    return (
        tagged.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(yes_no("l").alias(left_flag), yes_no("r").alias(right_flag))
    )


def overlap_summary(overlap: DataFrame) -> DataFrame:
    """Keys per pair of flags, sorted by flags."""
    flags = overlap.columns[1:]
    return overlap.groupBy(*flags).agg(F.count("*").alias("TotalIDs")).orderBy(*flags)


def overlap_examples(overlap: DataFrame, in_left: bool, in_right: bool) -> DataFrame:
    """Keys with a given pair of flags."""
    _, left_flag, right_flag = overlap.columns
    words = {True: "Yes", False: "No"}
    return overlap.where(
        (F.col(left_flag) == words[in_left]) & (F.col(right_flag) == words[in_right])
    )


def _no_key(df: DataFrame, key: str) -> Column:
    return is_missing(key) if dict(df.dtypes)[key] == "string" else F.col(key).isNull()


def _spread_key(left: DataFrame) -> Column:
    """What deals out rows without a key: columns that stay text, as nearly every report reads them.

    Casts would run for rows that no report asks for, and more columns would be read than used.
    Lines alike in both (a blank receipt of one store) stay together; Spark splits such a group at
    run time, as its right side is empty.
    """
    named = [c for c in ("RECEIPT_ID", "STORE_NAME") if c in left.columns]
    receipt = F.xxhash64(named[0])
    return F.when(is_missing(named[0]), F.xxhash64(*named)).otherwise(receipt) if len(named) > 1 else receipt


def hot_keys(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Keys with more rows than an even share of a shuffle, and into how many parts to cut each.

    ``partitions`` is the number of shuffle partitions, that of the session if not given. Fewer keys
    than partitions can hold more than an even share each, so the result is small at every size.
    """
    ways = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.where(~_no_key(df, key)).groupBy(key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    shares = F.col("_n") * ways / total
    return counts.where(shares > 1).select(key, F.ceil(shares * PIECES).cast("int").alias(_PARTS))


def spread_lines(left: DataFrame, key: str, hot: DataFrame | None = None, number: str = "row_id") -> DataFrame:
    """The left side with a second join key, ``_spread``, that deals out the lines of one key.

    It is a hash of the receipt for lines without a key, the line's ``number`` modulo the parts for
    keys that ``hot_keys`` lists, and 0 for all others.
    """
    # pmod(.., 1) is always 0, yet not a constant the optimizer would move out of the join keys.
    part = F.pmod(F.xxhash64(key), F.lit(1))
    if hot is not None:
        left = left.join(F.broadcast(hot), key, "left")  # fewer rows than partitions
        part = F.when(F.col(_PARTS).isNotNull(), F.pmod(number, _PARTS)).otherwise(part)
    return left.withColumn(
        SPREAD, F.when(_no_key(left, key), _spread_key(left)).otherwise(part).cast("bigint")
    ).drop(_PARTS)


def spread_right(right: DataFrame, key: str, hot: DataFrame | None = None) -> DataFrame:
    """The right side's rows with a key, and ``_spread``: each row of a hot key once for each of its parts."""
    keyed = right.where(~_no_key(right, key))
    if hot is None:
        return keyed.withColumn(SPREAD, F.pmod(F.xxhash64(key), F.lit(1)).cast("bigint"))
    parts = F.sequence(F.lit(0), F.coalesce(_PARTS, F.lit(1)) - 1).cast("array<bigint>")
    return keyed.join(F.broadcast(hot), key, "left").withColumn(SPREAD, F.explode(parts)).drop(_PARTS)


def _left_join_spreading(
    left: DataFrame, right: DataFrame, key: str, also: Sequence[str] = (), hot: DataFrame | None = None
) -> DataFrame:
    """Left join in which neither rows without a key nor those of a hot key meet in one task.

    A shuffle join hashes all equal keys to one partition. A NULL or blank key names nobody and
    matches nothing, so its lines may lie anywhere. The lines of a key in ``hot`` are dealt out over
    its parts, and the right rows of that key, and of no other, are repeated once for each part, so
    each line still meets each of them once. Without ``hot`` a hot key is left to Spark's splitting
    of skewed partitions at run time. ``also`` names further join keys.
    """
    keyed = spread_right(right, key, hot)
    return spread_lines(left, key, hot).join(keyed, [key, *also, SPREAD], "left").drop(SPREAD)


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys on several rows and on how many: what a join on the key multiplies."""
    counts = df.where(~_no_key(df, key)).groupBy(key).agg(F.count("*").alias(_TIMES))
    return counts.where(F.col(_TIMES) > 1)


def _places(df: DataFrame, repeats: DataFrame, key: str, place: str) -> DataFrame:
    """Of each row on a repeated key its number (``row_id``) and place among the key's rows, from 0."""
    rows = df.select(key, "row_id").join(repeats.select(key), key, "left_semi")
    numbered = add_row_id(rows, [key, "row_id"], place, unique_order=True)
    first = numbered.groupBy(key).agg(F.min(place).alias(_FIRST))
    return store(numbered.join(first, key).select("row_id", (F.col(place) - F.col(_FIRST)).alias(place)), "places")


def users_of(users: DataFrame, *more: str) -> DataFrame:
    """User id and the other columns under their names in the master table."""
    return users.select("USER_ID", *[F.col(c).alias(f"USERID_{c}") for c in USER_COLUMNS], *more)


def products_of(products: DataFrame, *more: str) -> DataFrame:
    """Barcode and the other columns under their names in the master table."""
    return products.select("BARCODE", *[F.col(c).alias(f"BARCODE_{c}") for c in PRODUCT_COLUMNS], *more)


def add_users(lines: DataFrame, users: DataFrame) -> DataFrame:
    """Receipt lines with the columns of their user, prefixed ``USERID_``."""
    return _left_join_spreading(lines, users_of(users), "USER_ID")


def add_products(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Receipt lines with the columns of their product, prefixed ``BARCODE_``."""
    return _left_join_spreading(lines, products_of(products), "BARCODE")


def build_master(
    transactions: DataFrame, users: DataFrame, products: DataFrame, row_id: bool = True
) -> DataFrame:
    """Receipt lines with user and product columns; lines without a match keep NULLs.

    A barcode with two products gives two rows: nothing is removed, ``fanout_check`` shows them.
    If the transactions are numbered, their number is kept as ``DUPE_CHECK``. ``row_id`` numbers
    the result too, in the order of the transaction columns; transaction number, product number
    and user number break ties, so the order is total.

    Numbers are given before the lines are widened. Only keys on several rows multiply lines: a
    line of such a key is repeated once for each of its rows, with the place of that row. These
    narrow lines are sorted, numbered and stored; users and products are then joined by key and
    place, one row to a line, lazily. Runs the numbering job, nothing is sorted after the joins.
    The keys of the lines are counted first; those that would overfill a task are dealt out by number.
    """
    numbered = "row_id" in transactions.columns
    if row_id and not numbered:
        raise ValueError("numbering the master table needs numbered transactions and products")
    lines = transactions.withColumnRenamed("row_id", "DUPE_CHECK")
    columns = [
        *LINE_COLUMNS,
        *(["DUPE_CHECK"] if numbered else []),
        *[f"USERID_{c}" for c in USER_COLUMNS],
        *[f"BARCODE_{c}" for c in PRODUCT_COLUMNS],
    ]
    if not row_id:
        return add_products(add_users(lines, users), products).select(*columns)
    products, lines, by_product = _with_places(products, lines, "BARCODE", "_product")
    users, lines, by_user = _with_places(users, lines, "USER_ID", "_user")
    order = [*LINE_COLUMNS, "DUPE_CHECK", *by_product, *by_user]
    rows = add_row_id(lines, order, "row_id", unique_order=True)
    hot_users, hot_barcodes = (stored_hot(rows, key) for key in ("USER_ID", "BARCODE"))
    wide = _left_join_spreading(rows, users_of(users, *by_user), "USER_ID", by_user, hot_users)
    wide = _left_join_spreading(wide, products_of(products, *by_product), "BARCODE", by_product, hot_barcodes)
    return wide.select(*columns, "row_id")


def stored_hot(rows: DataFrame, key: str, partitions: int | None = None) -> DataFrame | None:
    """The stored list of ``hot_keys``, or None if there are none."""
    hot = store(hot_keys(rows, key, partitions), "hot_keys")
    return None if hot.isEmpty() else hot


def _with_places(
    df: DataFrame, lines: DataFrame, key: str, place: str
) -> tuple[DataFrame, DataFrame, list[str]]:
    """The right side with the place of each row among those of its key, and the lines repeated alike.

    Where no key repeats both stay as they are, without a place.
    """
    repeats = store(repeated_keys(df, key), "repeats")
    if repeats.isEmpty():
        return df, lines, []
    placed = df.join(_places(df, repeats, key, place), "row_id", "left")
    copies = _left_join_spreading(lines, repeats, key).withColumn(
        place, F.explode(F.sequence(F.lit(0), F.coalesce(_TIMES, F.lit(1)) - 1))
    )
    # Places are whole numbers on both sides, 0 for a key on one row.
    return (
        placed.withColumn(place, F.coalesce(place, F.lit(0)).cast("bigint")),
        copies.withColumn(place, F.col(place).cast("bigint")).drop(_TIMES),
        [place],
    )


def fanout_check(master: DataFrame, source_id: str = "DUPE_CHECK") -> DataFrame:
    """Source rows that became several rows, most first."""
    counts = master.groupBy(source_id).agg(F.count("*").alias("TotalRows"))
    return counts.where(F.col("TotalRows") > 1).orderBy(F.desc("TotalRows"), source_id)


def expected_fanout(lines: DataFrame, users: DataFrame, products: DataFrame) -> DataFrame:
    """The same from the keys alone: lines whose user or barcode stands on several rows.

    Reads the number and the two keys of a line and counts keys; no wide row is made.
    """
    times = lines.select("USER_ID", "BARCODE", F.col("row_id").alias("DUPE_CHECK"))
    both = []
    for df, key in ((users, "USER_ID"), (products, "BARCODE")):
        name = f"_times_{key}"
        times = times.join(repeated_keys(df, key).withColumnRenamed(_TIMES, name), key, "left")
        both.append(F.coalesce(name, F.lit(1)))
    rows = times.select("DUPE_CHECK", (both[0] * both[1]).alias("TotalRows"))
    return rows.where(F.col("TotalRows") > 1).orderBy(F.desc("TotalRows"), "DUPE_CHECK")
