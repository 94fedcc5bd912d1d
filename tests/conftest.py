from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from tallyglass.plans.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    """Build a small table from rows; columns are text unless a schema says otherwise."""

    def make(columns: str, *rows):
        names = columns.split()
        schema = ", ".join(n if ":" in n else f"{n}: string" for n in names)
        rows = [r if isinstance(r, tuple) else (r,) for r in rows]
        return spark.createDataFrame(rows, schema.replace(":", " "))

    return make


def values(df) -> list:
    """Rows as tuples, single columns as plain values, in no particular order."""
    rows = [tuple(r) for r in df.collect()]
    flat = [r[0] if len(r) == 1 else r for r in rows]
    return sorted(flat, key=lambda v: tuple((x is not None, str(x)) for x in (v if isinstance(v, tuple) else (v,))))
