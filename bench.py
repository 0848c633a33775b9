"""Headline queries at one scale; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from subscope.plans import catalog, fixtures

HEADLINE = [
    "event_features", "feature_store_batch", "feature_store_ordinal", "rfm_behaviour_store",
    "rfm_scores", "recharge_trend_ordinal", "campaign_all", "campaign_summary", "kpi_summary",
    "drift_report", "auc_roc", "average_precision", "soft_assignment", "stratified_split",
    "churn_model_scores", "churn_attribution",
]


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("subscope-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str):
        return lambda: catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    run("event_features")()  # JVM warm-up
    # the stored tables the later queries scan are built, and timed, here
    times = {
        "build_store": timed(lambda: fixtures.store(spark, sf_dir)),
        "build_master": timed(lambda: fixtures.master(spark, sf_dir)),
    }
    for name in HEADLINE:
        times[name] = timed(run(name))
    print(
        json.dumps(
            {
                "metric": "headline query time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
