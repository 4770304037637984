"""Plan shape: pruning and pushdown reach the parquet scan; fixed-size dimensions are broadcast."""

from comparo.operators import baseline as B
from comparo.plans.common import priced
from tests.conftest import SF001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_baseline_scan_is_pruned_and_filtered(spark):
    t = B.frame_median_by_day(priced(spark, SF001), ["fsa"], "ppsf", 90, 1, value_splits=1)
    plan = _plan(t)
    scans = [ln for ln in plan.split("\n") if "FileScan parquet" in ln and "lineitem" in ln]
    assert scans
    for s in scans:
        assert "l_tax" not in s and "l_returnflag" not in s and "l_orderkey" not in s  # column pruning
        assert "GreaterThan(l_extendedprice,0.0)" in s  # P5 pushed into the scan


def test_fixed_dimensions_are_broadcast(spark):
    plan = _plan(priced(spark, SF001).select("fsa", "region", "ppsf"))
    assert plan.count("BroadcastHashJoin") >= 2  # nation (25 rows) and region (5 rows)
