"""Times the headline audit queries at $BENCH_SF_DIR and prints one JSON line."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from lodestone.plans import registry

HEADLINE = (
    "pr01_column_profile pr03_numeric_summary pr04_categorical_summary pr14_duplicate_summary ed05_co_missingness ed07_label_distribution ed11_class_outliers ed14_feature_scaling "
    "ed15_iqr_outliers ed18_grouped_labels ed19_histogram tx1_length tx3_repetition tx5_entropy tx8_text_bundle sk6_velocity lk02_split_overlap lk04_path_label_shortcuts lk05_categorical_proxies "
    "lk06_numeric_proxies lk10_split_interleaving lk11_boundary_gaps lk12_seasonal_shift"
).split()


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.maxPartitionBytes", "4m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):  # the first also compiles
            began = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "headline audit queries, sum of medians of 3", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
