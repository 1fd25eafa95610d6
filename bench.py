"""Times the headline queries and prints one JSON line.

``assemble`` and ``score`` build the stage tables from the supplied tables; the
queries after them read those tables, as the published jobs do.
"""

from __future__ import annotations

import json
import os
import time

from kerbline.plans.catalog import QUERIES
from kerbline.session import local_session
from kerbline.sources.demo import Stages

HEADLINE = (
    "src_filter_in",
    "profile_value_counts",
    "source_crosscheck",
    "road_attr_join",
    "nearest_segment",
    "incident_counts",
    "adjacency_proximity",
    "ems_distance",
    "graph_diffusion_k2",
    "graph_diffusion_places",
    "score_with_coefs",
    "disparity_grouping_sets",
    "quantile_stops",
    "priority_topn",
    "attribution",
    "countermeasures",
    "counterfactual",
    "priority_list",
    "contract_check",
    "overlay_snapshot",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "kerbline-bench")
    spark.range(1000).groupBy("id").count().write.format("noop").mode("overwrite").save()
    took: dict[str, float] = {}

    def clock(name, run):
        start = time.perf_counter()
        run()
        took[name] = round(time.perf_counter() - start, 3)

    stages = Stages.of(spark, sf_dir)
    clock("assemble", lambda: stages.features)
    clock("score", lambda: stages.scores)
    for name in HEADLINE:
        clock(name, lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
