"""Time every named query: one warm-up and three runs each, median reported, as one JSON line.

BENCH_SF_DIR is the folder of tables, BENCH_CPUS the number of local threads, BENCH_RUNS the number of timed
runs, BENCH_QUERIES a comma-separated choice of queries.
"""

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from moodspark.plans.queries import QUERIES  # noqa: E402
from moodspark.plans.session import build_session  # noqa: E402


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else list(QUERIES)
    spark = build_session(
        "moodspark-bench", f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, spread = {}, {}
    for name in names:
        def run(query=QUERIES[name]):
            query(spark, folder).write.format("noop").mode("overwrite").save()

        run()
        times = [timed(run) for _ in range(runs)]
        seconds[name] = round(statistics.median(times), 4)
        spread[name] = round(max(times) - min(times), 4)
    spark.stop()
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 4),
        "unit": "sec",
        "queries": seconds,
        "spread": spread,
        "runs": runs,
        "cpus": int(cpus),
        "sf": Path(folder).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
