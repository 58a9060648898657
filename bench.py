"""Headline queries at one scale; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from paneltide.plans.catalog import QUERIES  # noqa: E402
from paneltide.session import local_session  # noqa: E402

HEADLINE = (
    "dedup_keep_last",
    "impute_missing",
    "flag_outliers",
    "clean_panel",
    "build_features",
    "series_coverage",
    "zero_inflation",
    "seasonal_cycle",
    "period_over_period",
    "country_summary",
    "continent_comparison",
    "category_share",
    "binned_median",
    "correlations",
    "detect_univariate",
    "local_outlier_factor",
    "isolation_forest",
    "baseline_forecasts",
    "model_summary",
    "final_forecasts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=8)
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
