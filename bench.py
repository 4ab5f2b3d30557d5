"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line:
  {"metric": "headline_total", "value": <sec>, "unit": "sec",
   "queries": {name: sec, ...}, "sf": ...}

Each query (median of $BENCH_REPS interleaved runs, default 2, after one run of
all at the same scale) runs on a fresh pipeline (nothing kept from earlier
queries) and is fully executed into Spark's no-op sink, so the time covers scan,
every shuffle and the result. The headline is the sum of the five queries of the
first baseline; `top_tier_implications` and `run_reports` (the whole batch run,
written to a temporary folder) are timed beside it.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fanscope.params import FIXTURE_PARAMS  # noqa: E402
from fanscope.plans.pipeline import AffinityPipeline  # noqa: E402
from fanscope.plans.queries import build  # noqa: E402
from fanscope.plans.reports import run_reports  # noqa: E402
from fanscope.session import build_session  # noqa: E402
from fanscope.sources.fixtures import load_fixture_tables  # noqa: E402

HEADLINE = ["top_implications", "edge_nonfans", "factor_report",
            "tier_implications", "estimated_fans_by_age"]
BESIDE = ["top_tier_implications"]


def _sf(sf_dir: str) -> float | str:
    m = re.search(r"sf([0-9.]+)", sf_dir)
    return float(m.group(1)) if m else sf_dir


def run_query(spark, sf_dir: str, name: str) -> float:
    t0 = time.perf_counter()
    pipe = AffinityPipeline(load_fixture_tables(spark, sf_dir, FIXTURE_PARAMS), FIXTURE_PARAMS)
    build(pipe, name).write.format("noop").mode("overwrite").save()
    elapsed = time.perf_counter() - t0
    pipe.unpersist(blocking=True)
    return elapsed


def run_all_reports(spark, sf_dir: str) -> float:
    with tempfile.TemporaryDirectory() as out:
        t0 = time.perf_counter()
        pipe = AffinityPipeline(load_fixture_tables(spark, sf_dir, FIXTURE_PARAMS), FIXTURE_PARAMS)
        run_reports(pipe, out)
        elapsed = time.perf_counter() - t0
        pipe.unpersist(blocking=True)
    return elapsed


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "2"))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus,
                          app_name="fanscope-bench")
    runs: dict[str, list[float]] = {}
    # The first round is the warm-up: JVM class loading, JIT and code
    # generation are not the queries' cost.
    for rep in range(reps + 1):
        for name in HEADLINE + BESIDE:
            took = run_query(spark, sf_dir, name)
            if rep:
                runs.setdefault(name, []).append(took)
    times = {name: round(statistics.median(took), 3) for name, took in runs.items()}
    times["run_reports"] = round(run_all_reports(spark, sf_dir), 3)
    out = {"metric": "headline_total", "value": round(sum(times[n] for n in HEADLINE), 3),
           "unit": "sec", "queries": times, "sf": _sf(sf_dir), "cpus": cpus}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
