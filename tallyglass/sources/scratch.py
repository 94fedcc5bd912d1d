"""Cutting lineage: intermediate tables in the folder all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SHARED_DIR = "spark.checkpoint.dir"
WAREHOUSE_DIR = "spark.sql.warehouse.dir"

#: Stored tables of whole rows, as large as the input, whose files are packed more tightly than by default.
PACKED = frozenset({"sorted", "raw_transactions", "raw_users", "raw_products"})

#: Paths written since the innermost open scope began.
_SCOPE: ContextVar[list[str] | None] = ContextVar("tallyglass_scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, else one beside the tables of the warehouse.

    Both are folders that all executors must reach; a machine's own temporary folder never is.
    """
    named = spark.conf.get(SHARED_DIR, None)
    return named or f"{spark.conf.get(WAREHOUSE_DIR).rstrip('/')}/_stored"


def store(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder now and return a DataFrame that reads it.

    The result survives lost executors without recomputing, and later steps read only the
    columns they use. Every call writes a new folder, so a plan never reads what it overwrites.
    ``by`` names a column to lay the files out by, so that a filter on it reads its files only.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tallyglass/{name}-{uuid.uuid4().hex}"
    written = _SCOPE.get()
    if written is not None:
        written.append(path)  # before the write, so that a failed one is removed too
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path, compression="zstd" if name in PACKED else None)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Removes at its end every table that ``store`` wrote inside it, also after an error.

    DataFrames that read those tables can't be used after that. Scopes nest: each removes its own.
    """
    written: list[str] = []
    token = _SCOPE.set(written)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        for path in written:
            remove(spark, path)


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file systems, wherever it lies; none is no error."""
    files, place = _place(spark, path)
    files.delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _place(spark, path)
    return files.exists(place)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """What the files of a table take, without reading them."""
    files, place = _place(spark, path)
    return files.getContentSummary(place).getLength()


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system and folder, as the catalog wants it."""
    files, place = _place(spark, path)
    return files.makeQualified(place).toString()
