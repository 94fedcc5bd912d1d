"""Stored tables: Parquet paths, or catalog tables bucketed on the join keys."""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .scratch import qualified


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def read_parquet(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def write_bucketed(
    df: DataFrame,
    table: str,
    keys: Sequence[str],
    buckets: int,
    mode: str = "overwrite",
) -> None:
    """Save as a catalog table, hashed and sorted by ``keys``.

    ``table`` is a table name, or a path for files that a later session can read with
    ``read_bucketed``. Two tables bucketed alike on the join key join without a shuffle. Choose
    ``buckets`` so that one bucket is a few hundred MB. The repartition makes one file per bucket,
    not one per task.
    """
    writer = (
        df.repartition(buckets, *keys)
        .write.mode(mode)
        .bucketBy(buckets, *keys)
        .sortBy(*keys)
        .format("parquet")
    )
    if "/" in table:
        path = qualified(df.sparkSession, table)
        writer, table = writer.option("path", path), _name_of(path)
    writer.saveAsTable(table)


def _name_of(path: str) -> str:
    return f"bucketed_{sha256(path.encode()).hexdigest()[:24]}"


def read_bucketed(
    spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], buckets: int
) -> DataFrame:
    """The table that ``write_bucketed`` put at a path, with its buckets known to this session.

    How a table is bucketed stands in the catalog, not in the files, and a catalog may end with its
    session. The table is therefore declared anew over the files; none is read or written for that.
    """
    path = qualified(spark, path)
    table = _name_of(path)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    by = ", ".join(f"`{k}`" for k in keys)
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"DROP TABLE IF EXISTS {table}")  # an external table: the files stay
    spark.sql(
        f"CREATE TABLE {table} ({columns}) USING parquet "
        f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{place}'"
    )
    return spark.table(table)
