"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "alloc_uniform", "alloc_elasticity", "alloc_proximity", "alloc_decay_exp", "nearest_city", "cities_in_buffer", "grid_area_centroid", "zonal_sum",
    "gini_all_forms", "top_share_round", "summary_table", "tune_gravity_trace", "indicator_latest", "keyword_search", "ols_coefficients", "cv_r2", "shortest_paths",
)
#: Timed too, but not part of the sum, which stays comparable between rounds.
FURTHER = ("maxent_alloc", "alloc_network", "features_grid", "kernel_metrics")



def main() -> None:
    from zonalis.plans.catalog import QUERIES

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["alloc_uniform"](spark, SF_DIR).write.format("noop").mode("overwrite").save()  # starts the engine
    took = {}
    for name in HEADLINE + FURTHER:
        began = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    headline, further = ({k: took[k] for k in names} for names in (HEADLINE, FURTHER))
    print(json.dumps({"metric": "total_wall_clock", "value": round(sum(headline.values()), 3), "unit": "sec", "queries": headline, "further": further, "sf": SF_DIR.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
