"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Every
query runs in full: results go to a sink that reads all rows and keeps none.
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession

from suite.queries import QUERIES

HEADLINE = [
    "agg1_pair_counts_log", "agg1_pair_counts_on_cubed_sphere", "agg2_pair_counts_linear",
    "agg3_reduced_counts_log", "agg4_reduced_counts_linear", "agg7_degrees", "agg8_degree_summary",
    "jon3_flt2_flt3_pair_list", "agg5_weighted_cells", "til1_cubed_sphere_pixel",
    "til2_similar_radius_pixel", "til3_healpix_pixel", "til13_cube_neighbours",
    "til20_speed_cubed_sphere", "til20_speed_similar_radius", "til20_speed_healpix",
    "agg12_histogram", "agg13_histogram_2d", "agg16_sampled_radii", "agg21_time_by_nodes",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("skypairs-bench")
             .config("spark.sql.shuffle.partitions", str(3 * int(cpus)))
             .config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/orders.parquet").agg({"o_orderkey": "max"}).collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total time of the headline queries", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(found.group(1)) if found else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
