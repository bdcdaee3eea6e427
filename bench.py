"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import statistics
import time

from tessera.session import session

HEADLINE = ["vector_topk", "vector_topk_boosted", "duplicate_pairs", "hybrid_weighted", "code_hybrid", "task_stats", "project_kpis", "next_steps_top", "scratch_upsert_lww", "auto_resolve", "consolidate_lessons", "scrub_docs", "chunk_lines", "modularity_edges", "k_hop_2", "precision_recall_mrr", "export_markdown"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = session("bench", f"local[{cpus}]", int(cpus), spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    from tessera.plans.queries import QUERIES

    runs, took = int(os.environ.get("BENCH_RUNS", "3")), {}
    QUERIES["vector_topk"](spark, sf_dir).collect()  # warm-up
    for name in HEADLINE:
        times = []
        for _ in range(runs):
            t = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.time() - t)
            spark.catalog.clearCache()
        took[name] = round(statistics.median(times), 3)
    print(json.dumps({"metric": "sum of median query seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
