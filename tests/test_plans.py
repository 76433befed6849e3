"""What the physical plans must and must not hold."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from pricetide.catalog import QUERIES

# One row per calendar period, major number, rank bucket or range of a histogram without keys only.
SMALL_WINDOWS = {
    "id_span", "version_sort", "rank_corr",
    "backtest_bias", "decay_params", "decay_path", "scenario_fixed_peak", "scenario_paths", "scenario_table",
}


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(spark, name):
    plan = plan_of(QUERIES[name](spark, "/root/testdata/sf0.001"))
    for banned in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin", "MapInPandas"):
        assert banned not in plan, banned
    if name not in SMALL_WINDOWS:
        lines = plan.splitlines()
        for at, line in enumerate(lines):
            # Only partial results of a global aggregate or of a limit may meet in one task.
            if "Exchange SinglePartition" in line:
                assert "partial_" in lines[at + 1] or "Limit" in lines[at + 1], lines[at + 1]


def test_scan_reads_only_what_is_used(spark):
    plan = plan_of(QUERIES["monthly_min"](spark, "/root/testdata/sf0.001"))
    scan = next(line for line in plan.splitlines() if "l_shipdate" in line and "ReadSchema" in line)
    read = scan.split("ReadSchema:")[1]
    assert "l_tax" not in read and "l_returnflag" not in read
    assert "GreaterThan(l_quantity,0.0)" in scan


def test_entry(spark):
    assert entry(spark).columns[:2] == ["section", "month"]
    assert set(oracle_sql()) <= set(queries()) and set(QUERIES) <= set(queries())
