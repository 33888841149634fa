"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from tickloom.plans.queries import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["bars_m15", "vwap_sigma", "signed_ticks_cvd", "asof_cvd", "direction_matrix", "volume_clusters", "liquidity_sweeps", "volume_profile_poc", "daily_ohlc_atr",
            "feature_frame", "targets_excursions", "triple_barrier", "baseline_by_regime", "purged_split", "average_precision_auc", "session_evaluation"]


def main() -> None:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["bars_h1"](spark, SF_DIR).count()  # start-up is not measured
    found = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        found[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_wall_clock", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
