"""bench.py prints exactly one JSON line in the driver's format."""

from __future__ import annotations

import json
import os
import subprocess
import sys

import pytest

from conftest import ROOT, TESTDATA

SF = os.path.join(TESTDATA, "sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="fixtures not present")
def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SF, BENCH_CPUS="2", BENCH_REPS="1")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env, cwd=ROOT,
                         capture_output=True, text=True, timeout=900)
    lines = [line for line in out.stdout.splitlines() if line.strip()]
    assert len(lines) == 1, out.stdout + out.stderr[-2000:]
    rec = json.loads(lines[0])
    assert rec["unit"] == "sec" and rec["sf"] == 0.001 and rec["metric"] == "headline_total"
    assert set(rec["queries"]) == {"top_implications", "edge_nonfans", "factor_report",
                                   "tier_implications", "estimated_fans_by_age", "top_tier_implications",
                                   "run_reports"}
    assert rec["value"] > 0
