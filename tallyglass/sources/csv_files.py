"""CSV import: every column as text, schema declared, nothing inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_BAD_LINE = "_bad_line"


def _reader(spark: SparkSession, delimiter: str) -> DataFrameReader:
    # One record per line keeps large files splittable. A doubled quote inside quotes is one quote.
    return (
        spark.read.option("header", True)
        .option("sep", delimiter)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", "UTF-8")
    )


def read_raw_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType,
    on_malformed: str = "fail",
    delimiter: str = ",",
    multiline: bool = False,
    check_header: bool = True,
) -> DataFrame:
    """Read files with a header line into an all-text table.

    ``on_malformed="fail"`` stops on a line with too few or too many fields, because such a line
    would otherwise lose text without notice. ``"keep"`` pads or cuts the line to the schema;
    ``malformed_lines`` then lists those lines whole. ``check_header`` stops on a header whose names
    or their order differ from the schema. ``multiline`` allows line breaks inside quotes; a file is
    then read by one task, so split large exports into many files.
    """
    modes = {"fail": "FAILFAST", "keep": "PERMISSIVE"}
    return (
        _reader(spark, delimiter)
        .option("mode", modes[on_malformed])
        # Judge a line by all of its fields, also when a query reads only some columns.
        .option("columnPruning", False)
        .option("multiLine", multiline)
        .option("enforceSchema", not check_header)
        .schema(schema)
        .csv(path)
    )


def malformed_lines(
    spark: SparkSession, path: str | list[str], schema: StructType, delimiter: str = ","
) -> DataFrame:
    """The lines whose number of fields differs from the schema, as unsplit text."""
    with_bad = StructType([*schema.fields, StructField(_BAD_LINE, StringType())])
    lines = (
        _reader(spark, delimiter)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _BAD_LINE)
        .option("columnPruning", False)
        .schema(with_bad)
        .csv(path)
    )
    # Spark refuses a plan that reads the bad-line column alone, so one more column is named.
    line = F.coalesce(_BAD_LINE, schema.fieldNames()[0])
    return lines.where(F.col(_BAD_LINE).isNotNull()).select(line.alias("line"))
