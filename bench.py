"""Benchmark: density-outlier detection on the events table.

Axes of the original benchmark scripts: strategy (shuffle / broadcast /
grouped), eps, sample fraction, partition count.  Each timed run builds the
whole plan from the parquet scan and counts the outliers and core points
(the reference's measured quantity is the whole run's wall time).

Prints one JSON line.  Env: BENCH_SF_DIR (default /root/testdata/sf0.1),
BENCH_CPUS (default 8).
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from epsgrid.operators.dataset import sample_by_hash  # noqa: E402
from epsgrid.operators.detect import detect  # noqa: E402
from epsgrid.plans import fixtures as fx  # noqa: E402
from epsgrid.session import get_spark  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
EPS, MIN_PTS = 2.3, 8  # sf0.1: brute force 84,948 core / 4,357 border / 10,695 outliers


def run(spark, eps=EPS, min_pts=MIN_PTS, strategy="shuffle", fraction=None, partitions=None):
    df, idc, feats = fx.events2d(spark, SF_DIR)
    if fraction is not None:
        df = sample_by_hash(df, fraction, idc)
    if partitions:
        df = df.repartition(partitions)
    t = time.time()
    det = detect(df, feats, eps, min_pts, idc, strategy=strategy, num_partitions=partitions)
    n_out = det.outliers_internal.count()
    n_core = det.core_points_internal.count()
    secs = time.time() - t
    det.release()
    return secs, n_out, n_core


def main():
    spark = get_spark(f"local[{CPUS}]", app="epsgrid-bench", shuffle_partitions=CPUS,
                      conf={"spark.driver.memory": "16g"})
    for s in ("shuffle", "grouped", "broadcast"):  # warm-up: JIT and file listing
        run(spark, strategy=s)
    q, checks = {}, {}
    for s in ("shuffle", "broadcast", "grouped"):
        q[f"detect_{s}"], checks[f"detect_{s}"], _ = run(spark, strategy=s)
    for e in (1.5, 4.6):
        q[f"eps_{e}"], checks[f"eps_{e}"], _ = run(spark, eps=e)
    for fr in (0.25, 0.5):
        q[f"sample_{fr}"], checks[f"sample_{fr}"], _ = run(spark, fraction=fr)
    for p in (4, 32):
        q[f"partitions_{p}"], checks[f"partitions_{p}"], _ = run(spark, partitions=p)
    total = sum(q.values())
    print(json.dumps({"metric": "detect_outliers_total", "value": round(total, 3), "unit": "sec",
                      "queries": {k: round(v, 3) for k, v in q.items()},
                      "outliers": checks, "sf": os.path.basename(SF_DIR.rstrip("/")).replace("sf", ""),
                      "cpus": CPUS}))


if __name__ == "__main__":
    main()
