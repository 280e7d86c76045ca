"""Time the headline queries in full (every row and column computed) and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from stratalens.plans.catalog import QUERIES  # noqa: E402
from stratalens.session import build_session  # noqa: E402

HEADLINE = [
    "churn_top_files",
    "churn_process_metrics",
    "minor_contributors",
    "parse_numstat",
    "dependency_edges",
    "degree_centrality",
    "pagerank_files",
    "ranked_definitions",
    "hotspots",
    "hotspots_all_churn",
    "prioritization_matrix",
    "extract_tags",
    "backfill_refs",
    "repo_map_text",
    "symbol_tree",
    "popular_repos",
    "run_summary",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session(
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("churn_top_files")  # starts the executor threads and loads classes
    seconds = {name: run(name) for name in wanted}
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
