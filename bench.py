"""Times the panel queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from terrapanel.plans.queries import QUERIES

HEADLINE = ["annual_indicators", "panel_skeleton", "class_share", "lags_leads", "step_detection", "contrast_grouping_sets", "annual_composites", "seasonal_anomaly", "fe_residual_balanced", "fe_residual_iterative", "fe_ols", "cluster_cov", "distance_pairs", "ring_shares"]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(2):  # the second run has its code compiled
            began = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - began)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "panel_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
