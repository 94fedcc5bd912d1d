"""Tables laid out for a join: both sides are hashed alike when written, so no read shuffles them.

A table lies in the order of one key only, so lines that join users and products are written once
for each. A bucket is read by one task; what would overfill one is dealt out before it is written,
as the joins of ``master`` do: lines without a key by a hash of their receipt, lines of a hot key
by their number, with the right rows of that key repeated once for each of its parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.schemas import STAGE_TRANSACTION
from ..sources.stored import read_bucketed, write_bucketed
from .master import SPREAD, products_of, spread_lines, spread_right, stored_hot, users_of

_BY_USER, _BY_BARCODE = ("lines_by_user", "USER_ID"), ("lines_by_barcode", "BARCODE")


def write_colocated(
    left: DataFrame, right: DataFrame, key: str, folder: str, buckets: int, number: str = "row_id"
) -> None:
    """Write both sides of a left join on ``key``, bucketed and sorted by key and part. Runs the jobs.

    ``number`` is a whole number of each left row, by which lines of a hot key are dealt out. Right
    rows without a key are left out, as they match nothing.
    """
    hot = stored_hot(left, key, buckets)
    write_bucketed(spread_lines(left, key, hot, number), f"{folder}/left", [key, SPREAD], buckets)
    write_bucketed(spread_right(right, key, hot), f"{folder}/right", [key, SPREAD], buckets)


def read_colocated(
    spark: SparkSession, key: str, folder: str, buckets: int, left: StructType, right: StructType
) -> DataFrame:
    """The left join of two sides that ``write_colocated`` wrote; neither is shuffled."""
    spread = StructField(SPREAD, LongType())
    sides = [
        read_bucketed(spark, f"{folder}/{side}", StructType([*schema.fields, spread]), [key, SPREAD], buckets)
        for side, schema in (("left", left), ("right", right))
    ]
    return sides[0].join(sides[1], [key, SPREAD], "left").drop(SPREAD)


def write_lines(lines: DataFrame, users: DataFrame, products: DataFrame, folder: str, buckets: int) -> None:
    """Numbered lines beside the users, and once more beside the products."""
    for (name, key), right in ((_BY_USER, users_of(users)), (_BY_BARCODE, products_of(products))):
        write_colocated(lines, right, key, f"{folder}/{name}", buckets)


def read_lines(
    spark: SparkSession, folder: str, buckets: int, users: DataFrame, products: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Numbered lines with the columns of their user, and with those of their product.

    ``users`` and ``products`` are the stage tables; only their schemas are used.
    """
    with_users, with_products = (
        read_colocated(spark, key, f"{folder}/{name}", buckets, STAGE_TRANSACTION, right.schema)
        for (name, key), right in ((_BY_USER, users_of(users)), (_BY_BARCODE, products_of(products)))
    )
    return with_users, with_products
