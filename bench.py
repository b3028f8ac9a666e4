"""Headline-query benchmark: prints ONE JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is built and fully executed (noop sink) once to warm up, then
three more times; the median wall time is reported per query and their sum
as the metric.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from candleflow.queries import QUERIES  # noqa: E402
from candleflow.session import get_session  # noqa: E402

HEADLINE = ["ohlcv_bars", "rolling_vol", "macd", "psar", "structure_signals",
            "prediction_outcomes", "roc_auc", "feature_table"]


def run_once(spark, name, sf_dir):
    t0 = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = get_session(f"local[{cpus}]", shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    out = {}
    for name in names:
        run_once(spark, name, sf_dir)
        out[name] = round(statistics.median(run_once(spark, name, sf_dir) for _ in range(runs)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_median_sec", "value": round(sum(out.values()), 3),
                      "unit": "sec", "queries": out, "sf": sf, "cpus": cpus,
                      "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
