"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from cladelake.plans import registry

HEADLINE = ["slice_shares", "lse_matmul", "argmax_vote", "strain_corr", "frag_freq", "pair_freq_join", "exact_match_join", "interval_merge", "overlap_join", "mate_pair_join", "first_pass_per_read", "filter_reads", "traj_quantiles", "softmax_partition", "phred_loglik", "revcomp", "jaccard_kmer", "minhash_est", "interpret_profile", "overall_abundance", "posterior_abundance"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    registry.QUERIES["revcomp"](spark, folder).write.format("noop").mode("overwrite").save()  # starts the session's machinery
    for name in HEADLINE:
        start = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
