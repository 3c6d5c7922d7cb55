"""Physical-plan properties the scale design relies on, checked on every key."""

import re

import pytest

from sf_paths import SF_SMALL
from gauntlet.plans.catalog import QUERIES

# keys whose plans may run Python: the parse check (and the jobs built on it)
PYTHON_KEYS = {
    "job_generation_report", "actual_behavior", "mutation_validated", "variant_skip_reason",
    "baseline_join", "mutation_summary", "low_applicability", "mutation_totals", "summary_project",
    "sample_reasons", "variant_registry", "variant_cross", "job_mutation_report", "job_evaluation_report",
    "metric_report", "sink_summary_doc", "sidecar_join",
}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {k: _plan(fn(spark, SF_SMALL)) for k, fn in QUERIES.items()}


def test_no_cross_products(plans):
    bad = [k for k, p in plans.items() if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p]
    assert bad == []


def test_python_only_where_the_parser_is_needed(plans):
    with_python = {k for k, p in plans.items() if "ArrowEvalPython" in p or "BatchEvalPython" in p}
    assert with_python <= PYTHON_KEYS
    assert "classify_kernel_failure" not in with_python and "extract_code" not in with_python


def test_classifier_scan_is_pruned_and_filtered(plans):
    p = plans["classify_kernel_failure"]
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", p)
    assert scans and all(set(re.sub(r"#\d+L?", "", s).split(",")) == {"o_orderkey", "o_custkey"} for s in scans)
    assert "DataFilters: [isnotnull(o_orderkey" in p


def test_no_aggregate_holds_a_group_s_values(plans):
    assert [k for k, p in plans.items() if "percentile" in p or "median(" in p] == []


def test_rewrites_are_not_repeated(plans):
    assert plans["job_mutation_report"].count("regexp_replace(") <= 24


def test_the_parser_gets_null_where_it_is_not_needed(plans):
    assert "python_parse_status(CASE WHEN" in plans["variant_skip_reason"]


def test_survivor_listings_take_one_join(plans):
    for key in ("phase1_failures", "sorted_listing", "listing_top10"):
        assert plans[key].count("Join") <= 1, key
    # two phases, each with a listing of its own, of which only the paths are read
    assert plans["phase_survivors"].count("LeftSemi") == plans["phase_survivors"].count("Join") == 2
    assert all(s == "path" for s in re.findall(r"FileScan binaryFile \[(\w+)#", plans["phase_survivors"]))


def test_top_k_limits_before_the_shuffle(plans):
    p = plans["listing_top10"]
    assert "WindowGroupLimit" in p and "Partial" in p


def test_no_sort_aggregate_outside_the_reported_mean(plans):
    sort_agg = {k for k, p in plans.items() if "SortAggregate" in p}
    assert sort_agg <= {"reported_mean_speedup", "metric_report", "job_evaluation_report", "job_evaluate_only",
                        "sink_summary_doc"}
