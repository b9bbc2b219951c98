"""Time the queries at one scale and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ... | all]

Each query is counted and run once to warm up, then run BENCH_RUNS times into a noop
sink; its time is the median in seconds and `value` the sum. Each run plans the query
anew. `shuffles` are the exchanges planned before run-time changes. Without names the
extraction methods and what they rest on are timed, with `all` every query.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from cellshift import engine_session
from cellshift.plans.catalog import QUERIES


HEADLINE = [
    "flatten_standard",
    "flatten_super",
    "scan_standard",
    "scan_super",
    "audit_bootstrap",
    "audit_changes",
    "audit_changes_super",
    "audit_changes_wide",
    "snapshot_standard",
    "snapshot_super",
    "differential",
    "differential_super",
    "differential_dedup",
    "diff_inserts",
    "diff_deletes",
    "diff_updates",
    "tracking_bootstrap",
    "tracking_changes",
    "tracking_window",
    "tracking_maintain",
    "parse_log_text",
    "log_changes_upsert",
    "log_changes_classified",
    "log_changes_super_scope",
    "export_cells_tombstones",
]


def session(cpus: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("cellshift-bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = engine_session(builder)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def shuffles(df: DataFrame) -> int:
    """Exchanges of the plan before run-time changes."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"(?<!Broadcast)(?<!Reused)Exchange ", text))


def broadcasts(df: DataFrame) -> int:
    """Sides that the plan broadcasts before anything was measured."""
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange ")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    spark = session(os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8)))
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(QUERIES)

    seconds, exchanges, sent, counts = {}, {}, {}, {}
    for name in names:
        df = QUERIES[name](spark, sf_dir)
        counts[name] = df.count()
        exchanges[name], sent[name] = shuffles(df), broadcasts(df)
        run(df)
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            run(QUERIES[name](spark, sf_dir))
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 4)

    rates = {n: round(counts[n] / seconds[n]) for n in names}
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "rows": counts,
                "rows_per_sec": rates,
                "shuffles": exchanges,
                "broadcasts": sent,
            }
        )
    )


if __name__ == "__main__":
    main()
