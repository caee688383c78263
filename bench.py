"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from provena.plans import registry

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "composite_group_count", "numeric_distribution", "resin_distribution", "wide_pivot", "context_rollup", "text_match", "dense_topk", "sparse_topk", "rrf_fusion", "weighted_fusion",
    "round_robin", "expand_closure", "cohort_binding", "alias_resolve", "first_wins_dedupe", "dangling_audit", "recall_mrr", "section_span", "html_strip",
)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="bench-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = registry.queries()
    took = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(2):  # the first run compiles
            began = time.perf_counter()
            found[name](spark, SF).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        took[name] = round(best, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF.rstrip("/"))}))


if __name__ == "__main__":
    main()
