"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
HEADLINE = ["f7_representations", "f1_keywords", "e2_windows", "e8_merge_continuations", "d9_section_path", "d12_path_nodes", "g8_best_layout", "i2_scoring", "i5_timing", "f9_status_rollup", "h1_weighted_assignment"]


def main() -> None:
    from lectern import plans
    from lectern.session import build

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):  # the first run compiles code
            began = time.time()
            plans.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        seconds[name] = round(min(runs), 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, wall time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
