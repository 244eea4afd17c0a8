"""Plan checks: the per-series operators never funnel data through a single partition and never
plan a cartesian product; the global fill only merges its small per-bucket carry table."""

import pytest

import __spark_entry__ as entry

from .conftest import SF_SMALL

SERIES_QUERIES = ["fill_forward_series", "interpolate_linear", "latest_runs", "series_normalize_per_sample_std",
                  "subsample", "pad_series", "last_window"]


def _plan(spark, name):
    df = entry.queries()[name](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SERIES_QUERIES)
def test_no_single_partition_on_series_paths(spark, name):
    plan = _plan(spark, name)
    assert "SinglePartition" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_global_fill_merges_only_the_carry_table(spark):
    plan = _plan(spark, "fill_forward")
    # the one single-partition exchange feeds the window over the per-bucket carry aggregate
    lines = plan.splitlines()
    single = [i for i, ln in enumerate(lines) if "Exchange SinglePartition" in ln]
    assert len(single) == 1
    assert any("HashAggregate" in ln or "hashpartitioning(_tp_bucket" in ln for ln in lines[single[0]:])
