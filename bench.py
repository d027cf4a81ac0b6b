"""Times the headline queries and prints one JSON line.

Each query runs ``BENCH_RUNS`` times into a discarding sink; its figure is the median.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from statuta.catalog import registry  # noqa: E402
from statuta.session import build_session  # noqa: E402

HEADLINE = [
    "p22_retrieval", "r05_question_refs", "n11_question_normaliser", "n01_canonical_text", "n04_content_hash",
    "g01_segment_articles", "g12_structure", "g16_chunk_rows", "r19_citations", "j01_direct_articles",
    "j04_keyword_matches", "j05_chunk_vectors", "j11_change_detection", "w08_ranked_candidates",
    "q09_quality_report", "t02_missing_numbers", "w10_order_check", "a04_structure_quality", "p12_answer_routes",
    "p18_answer_audit",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry()
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in names:
        seen = []
        for _ in range(runs):
            start = time.perf_counter()
            queries[name][0](spark, sf).write.format("noop").mode("overwrite").save()
            seen.append(time.perf_counter() - start)
        times[name] = round(statistics.median(seen), 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
