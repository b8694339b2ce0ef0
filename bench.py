"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import statistics
import sys
import time

os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

from claimflow.plans.registry import QUERIES
from claimflow.session import builder

HEADLINE = [
    "kpi_rollup",
    "claims_by_country",
    "amount_by_country",
    "latest_value",
    "risk_pivot",
    "build_curated_claims",
    "batch_evaluate_pending",
    "apply_decisions",
    "parse_decisions",
    "extract_notes",
    "repair_claim_types",
    "violation_counts",
    "semantic_query",
    "top10_claims",
    "search_vectors",
    "search_text",
]


def run(spark, name: str, sf_dir: str) -> float:
    """Seconds to compute every row and column; the rows are not collected."""
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    names = sys.argv[1:] or HEADLINE
    spark = (
        builder("bench")
        .master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        run(spark, name, sf_dir)  # warm up: class loading, code generation, Python workers
        seconds[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(runs)), 3)
    spark.stop()
    print(json.dumps({
        "metric": "median warm seconds, summed over the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cores": cpus,
    }))


if __name__ == "__main__":
    main()
