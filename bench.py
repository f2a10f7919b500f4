"""Time the headline queries: one JSON line with the seconds of each."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from rankwright.plans.catalog import QUERIES  # noqa: E402
from rankwright.session import local_session  # noqa: E402

HEADLINES = [
    "group_sizes",
    "row_minutes",
    "row_times",
    "group_ranks",
    "group_from_median",
    "group_features",
    "carrier_popularity_leg0",
    "attach_carrier_popularity",
    "attach_route_frequency",
    "rank_in_group",
    "top_k_per_group",
    "rank_requests",
    "time_split",
    "fit_artifacts",
    "apply_codes",
    "make_pairs",
    "hitrate_at_k",
    "hitrate_curve",
    "hitrate_by_stratum",
    "hitrate_by_size_bin",
    "ndcg_at_k",
    "build_features",
    "recommend",
]


def run(name: str, spark, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("rankwright-bench", cores)
    run("group_sizes", spark, folder)  # starts the JVM's work; not timed
    seconds = {name: round(run(name, spark, folder), 3) for name in HEADLINES}
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
