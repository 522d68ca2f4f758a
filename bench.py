"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINES = (
    "gold_build", "silver_entity_report", "flag_duplicate_ids", "rule_waterfall", "availability_summary",
    "concentration_summary", "operational_timing", "dataset_tabular", "fold_training_set", "rank_runs",
    "model_croston", "regressor_ridge", "score_summary", "exclusion_curve_own", "agg_quantile_exact",
    "company_profile_daily", "company_profile_events", "series_summary", "join_knn_history", "assign_by_rules",
)


def main() -> None:
    from paytide.plans.catalog import QUERIES
    from paytide.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start the JVM before the clock
    seconds = {}
    for name in HEADLINES:
        spark.catalog.clearCache()  # every query pays for its own Gold tables
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    scale = Path(sf_dir).name.removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))


if __name__ == "__main__":
    main()
