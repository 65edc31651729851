"""Runs the headline queries and prints one JSON line with their wall times.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Each query runs once to warm
up and is then timed; a time covers building the plan and computing every row of the result.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["flow_features70", "detect_end_to_end", "port_scan", "alert_cooldown", "log_segments",
            "dedupe_rows", "train_test_split", "preprocess_log_standard", "preprocess_robust", "anova_f",
            "metrics_macro", "roc_auc", "roc_macro", "confusion_matrix", "decide_binary", "pcap_scan", "stream_flows",
            "train_dt", "train_rf"]


def main() -> None:
    from pyspark.sql import SparkSession

    from wirelark.plans import all_queries
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()[0]
    names = sys.argv[1:] or HEADLINE

    def run(name):
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    times = {}
    for name in names:
        run(name)
        times[name] = round(run(name), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
