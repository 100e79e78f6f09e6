"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import re
import time

from pyspark.sql import SparkSession

QUERIES = [
    "site_ac_an_af", "allele_counts", "wide_ac_an", "filter_af", "range_query", "points_query", "block_stats", "vcf_lines", "split_biallelic",
    "join_multiallelic", "merge_intersection", "merge_union", "align_template", "merge_strand_fix", "ld_genotype", "ld_haplotype",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from varloom.plans.catalog import QUERIES as known

    seconds = {}
    for name in ["site_ac_an_af", *QUERIES]:  # the first run also starts the engine
        start = time.time()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(scale[1]) if scale else None}))


if __name__ == "__main__":
    main()
