
import os
import re

import pytest

from benchlens.plans.registry import all_queries

SF = "/root/testdata/sf0.001"
PYTHON_OK = {"cmp_align_seq": "FlatMapCoGroupsInArrow", "cmp_seq_lengths": "FlatMapCoGroupsInArrow", "pairwise_potential": "ArrowEvalPython",
             "energy_total": "ArrowEvalPython", "pairwise_unknown": "ArrowEvalPython",
             **dict.fromkeys(["kmer_freq", "kmer_freq_unknown", "kmer_topk", "kmer_halo", "kmer_report", "kmer_specific", "kmer_spectrum",
                              "token_usage", "token_usage_unknown"], "MapInArrow")}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_plan_has_no_cartesian_and_python_only_where_intended(spark, name):
    df = all_queries()[name](spark, SF)
    df.collect()  # run this very execution, so that the plan below is the one that ran
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.startswith("AdaptiveSparkPlan isFinalPlan=true") or "AdaptiveSparkPlan" not in plan.split("\n")[0]
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan  # no row-at-a-time Python UDFs anywhere
    py = re.findall(r"(ArrowEvalPython|FlatMapCoGroupsInArrow|FlatMapCoGroupsInPandas|FlatMapGroupsInPandas|MapInPandas|MapInArrow)", plan)
    if name in PYTHON_OK:
        assert PYTHON_OK[name] in py
    else:
        assert not py


def test_scan_prunes_columns(spark):
    df = all_queries()["ols_fit"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert any(s.startswith("l_partkey") and "l_comment" not in s and "l_shipdate" not in s for s in schemas)


def test_filters_reach_the_scan(spark):
    df = all_queries()["corpus_with_bench"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(l_quantity,50", plan)


def test_event_and_line_filters_reach_the_scan(spark):
    plan = all_queries()["event_tail"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,error)" in plan and "WindowGroupLimit" in plan
    plan = all_queries()["cmp_dup_keys"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*In\(l_linestatus", plan)


def test_momentum_reads_its_input_once(spark):
    plan = all_queries()["momentum_sum"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
