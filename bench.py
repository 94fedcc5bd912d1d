"""Time the headline reports and print one JSON line.

Settings: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default all).
Each report starts from the raw tables and runs to its last row; rows go to Spark's ``noop`` sink.
The better of two runs counts, so that compiling classes is not what is measured.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from tallyglass.plans.reports import REPORTS
from tallyglass.plans.session import build_session
from tallyglass.plans.tables import RetailTables

HEADLINE = [
    # import and one-pass counters
    "sale_control_total",
    "transactions_missing_counts",
    "transactions_profile",
    # values, formats, rules
    "store_names",
    "missing_barcode_by_store",
    "quantity_spread",
    "zero_quantity_with_sale",
    "purchase_scan_delays",
    "created_date_gaps",
    "sale_box",
    # keys
    "user_line_and_receipt_counts",
    "receipts_repeating_a_barcode",
    "repeated_transaction_rows",
    "conflicting_barcode_rows",
    # stage, overlap, master
    "stage_transactions",
    "user_overlap_summary",
    "barcode_overlap_summary",
    "master_table",
    "master_fanout",
    # answers
    "spend_share_by_generation",
    "scan_weeks",
    "power_users",
    "user_activity_ranks",
    "leading_brands",
    "top_store_by_generation",
]


def _run(report, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    report(RetailTables.from_star(spark, sf_dir)).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(cores),
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    _run(REPORTS["transactions_row_count"], spark, sf_dir)  # start-up
    seconds = {}
    for name in names:
        seconds[name] = round(min(_run(REPORTS[name], spark, sf_dir) for _ in range(2)), 3)
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_reports_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else sf_dir,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
