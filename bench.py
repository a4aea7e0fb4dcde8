"""Time the headline queries; prints one JSON line.

Each query runs twice untimed (JIT and file cache) and then three times; the
median counts. Building the plan and the small extent scan are part of the time.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from tallyscope import Between, Session  # noqa: E402
from tallyscope.plans import queries  # noqa: E402, F401
from tallyscope.plans.registry import QUERIES  # noqa: E402

HEADLINE = [
    "row_count", "status_count", "hist_price", "hist_orderdate_quarter", "hist_events_2day",
    "hist_compare", "vc_linestatus", "vc_props", "vc_doc_text", "vc_html_hashed", "vc_all_unique",
    "top20_rest", "top1000_customers", "cf_qty", "cf_ship", "cf_flag", "frac_returnflag", "unique_rows", "rows_page",
    "rows_after_seek", "rows_numbered", "data_view", "profile_part", "profile_lineitem",
    "profile_lineitem_filtered", "profile_documents", "profile_documents_hashed", "column_overview", "fmt_preview",
]


def timed(run, warm: int = 2, runs: int = 3) -> float:
    for _ in range(warm):
        run()
    took = []
    for _ in range(runs):
        start = time.perf_counter()
        run()
        took.append(time.perf_counter() - start)
    return round(statistics.median(took), 4)


def consume(df) -> None:
    """Run the whole plan; rows stay on the executors."""
    df.write.format("noop").mode("overwrite").save()


def refresh_times(spark, folder: str) -> dict[str, float]:
    """Three clauses, one moving: every other view asked directly, and from a cube."""
    base = Session.of_file(spark, f"{folder}/lineitem.parquet", table="bench_lineitem")
    state = base.where_value("l_returnflag", "A").where_value("l_linestatus", "F")
    moving = Between("l_quantity", 10.0, 25.0, include_hi=False)
    numbers = ["l_extendedprice", "l_discount", "l_shipdate"]
    words = ["l_returnflag", "l_linestatus"]
    state.bins("l_quantity", *numbers)

    def direct():
        seen = state.where(moving)
        for c in numbers:
            consume(seen.histogram(c))
        for c in words:
            consume(seen.value_counts(c))

    def built():
        made = state.cube("l_quantity", numbers + words)
        consume(made.refresh(moving))
        made.close()

    cube = state.cube("l_quantity", numbers + words)

    def from_cube():
        consume(cube.refresh(moving))

    return {"refresh_direct": timed(direct), "refresh_cube": timed(from_cube), "cube_build": timed(built, 1)}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tallyscope-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tallyscope-bench-"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in only or HEADLINE:
        took[name] = timed(lambda name=name: consume(QUERIES[name](spark, folder)))
    if not only:
        took |= refresh_times(spark, folder)
    spark.stop()
    found = re.search(r"sf([\d.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total of median query times",
                "value": round(sum(took.values()), 4),
                "unit": "sec",
                "queries": took,
                "sf": float(found.group(1)) if found else None,
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
