"""Times the headline queries of the block engine; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tessera import catalog

HEADLINE = ("block_codec_distribution", "block_split", "compression_hint", "cache_hits", "engine_stats", "pipeline_results", "codec_stats", "frame_unpack", "stage_timing_stats", "index_percentiles", "policy_compare", "workload_breakdown")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.maxPartitionBytes", "2m").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found, seconds = catalog.queries(), {}
    found["stage_timing_stats"](spark, sf_dir).collect()
    for name in HEADLINE:
        began = time.time()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    began = time.time()
    found["pipeline_results"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    warm = time.time() - began
    blocks = found["block_split"](spark, sf_dir).count()
    print(json.dumps({"metric": "headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir), "cpus": int(cpus), "blocks": blocks, "pipeline_warm_mb_s": round(blocks * 4096 / 1e6 / warm, 3)}))
    spark.stop()


if __name__ == "__main__":
    main()
