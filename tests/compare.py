"""Compare a Spark result with a DuckDB result: names, kinds of type, and rows as a multiset."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, Decimal):
        return value.normalize() + 0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def _multiset(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


_KINDS = {
    "VARCHAR": "string",
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "TIMESTAMP": "timestamp_ntz",
    "DATE": "date",
    "BOOLEAN": "boolean",
}


def _duck_kind(kind: str) -> str:
    return _KINDS.get(kind, kind.lower().replace(" ", ""))


def differences(spark_df, con, sql: str) -> list[str]:
    found = con.execute(sql)
    duck_columns = [d[0] for d in found.description]
    duck_types = dict(zip(duck_columns, (_duck_kind(str(d[1])) for d in found.description)))
    duck_rows = found.fetchall()
    spark_rows = spark_df.collect()
    problems = []
    if sorted(spark_df.columns) != sorted(duck_columns):
        return [f"columns {sorted(spark_df.columns)} != {sorted(duck_columns)}"]
    for name, kind in spark_df.dtypes:
        if duck_types[name] != kind:
            problems.append(f"type of {name}: {kind} != {duck_types[name]}")
    if len(spark_rows) != len(duck_rows):
        problems.append(f"rows {len(spark_rows)} != {len(duck_rows)}")
    ours, theirs = _multiset(spark_df.columns, spark_rows), _multiset(duck_columns, duck_rows)
    if ours != theirs:
        problems.append(f"only Spark {list((ours - theirs).items())[:3]}; only SQL {list((theirs - ours).items())[:3]}")
    return problems
