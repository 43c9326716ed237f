"""Times the engine's own queries and prints one JSON line; BENCH_SF_DIR and BENCH_CPUS set the tables and cores."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from fraglens.plans import catalogue

HEADLINE = [
    "hist_dense", "hist_moments", "dirichlet_log_prob", "ecdf_eff_len", "tpm", "gene_rollup", "metrics_overall", "metrics_stratified", "spearman_ties", "group_summary", "run_grouping", "fragment_class", "overlap_join", "overlap_apportion",
    "containment_top1", "merge_spans", "anchor_cluster", "point_in_partition", "set_merge", "connected_components", "equivalence_classes", "prune_by_pool", "lse_mean", "em_fixed_iter", "em_map_winner", "semi_join", "three_way_inner",
    "best_hit", "sliding_windows", "set_algebra", "expected_observed", "mixture_em_k", "dense_ids",
]


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-")).config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{d}/lineitem.parquet").count()
    took = {}
    for name in HEADLINE:
        began = time.time()
        catalogue.queries()[name](spark, d).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
