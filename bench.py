"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores and ``BENCH_RUNS``
how often each query is timed after a first run; the best time counts. Names as
arguments choose other queries, ``all`` every one.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

HEADLINE = """
    read_parquet json_records cube_query
    add_revenue classify_change map_multi_key coerce_types scalar_surface
    drop_nulls filter_where not_completed sort_desc sql_top_n
    compute_pnl customer_sales full_outer_null_safe
    group_summary monthly_rollup monthly_summary top_products sector_summary tag_counts
    top_movers deduplicate_by_key top_n_by_group add_rank_dense add_rank_first_grouped probe_row_id_all last_state
    dq_report dq_violations contract_report contract_conformance
    diff_tables diff_summary diff_repeated_keys shadow_run
    lineage_schema_diff lineage_edges lineage_closure trace_group trace_rows
    fold_status latest_per_key register_run status_changes reachable graph_levels stale_nodes sink_source_edges
    chart_pivot preview
""".split()


def session(cpus: int) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df: DataFrame) -> None:
    """Compute all rows and columns, and keep none."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    from workload import QUERIES

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(QUERIES)
    spark = session(cpus)
    times: dict[str, float] = {}
    for name in names:
        best = None
        for i in range(runs + 1):
            start = time.perf_counter()
            run(QUERIES[name](spark, folder))
            seconds = time.perf_counter() - start
            if i or runs == 0:
                best = seconds if best is None else min(best, seconds)
        times[name] = round(best, 3)
        print(f"{best:8.3f} {name}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else None,
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
