"""What the plans of some queries must and must not hold."""

import re

import pytest

from quorumframe.plans import catalog


def plan(spark, data, name: str) -> str:
    df = catalog.QUERIES[name](spark, data)
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, data):
    p = plan(spark, data, "scan_project_filter")
    assert "PushedFilters: [IsNotNull(l_returnflag), IsNotNull(l_quantity), EqualTo(l_returnflag,R), GreaterThan(l_quantity" in p
    assert "l_comment" not in p and "l_shipdate" not in p


@pytest.mark.parametrize("name", ["vav_winner", "arm_soft_cross_w2", "arm_cascade_2", "maj_winner", "argmax_winner", "maj_at_k", "temp_grid", "vote_hash", "topk_per_group"])
def test_winners_do_not_sort_a_question(spark, data, name):
    """Winners come from mergeable aggregates; the one plan with a window cuts its groups before they meet."""
    p = plan(spark, data, name)
    assert "Window " not in p or name == "topk_per_group" and "WindowGroupLimit" in p


def test_plain_rules_take_no_join(spark, data):
    p = plan(spark, data, "vav_winner")
    assert "Join" not in p and len(re.findall(r"Exchange hashpartitioning", p)) == 3  # texts, groups, questions


@pytest.mark.parametrize("name", ["tie_ranks", "index_p90", "index_median", "spearman"])
def test_ranks_are_made_by_ranges(spark, data, name):
    """Every window over values is partitioned by a range of values too; the other one is over the ranges' sums."""
    p = plan(spark, data, name)
    windows = re.findall(r"Window \[.*?\], \[(.*?)\], \[(.*?)\]", p)
    assert windows
    for keys, order in windows:
        assert "_p#" in keys or "_p#" in order


def test_rules_share_one_grouping(spark, data):
    p = plan(spark, data, "accuracy_matrix")
    assert p.count("Union") == 0 and p.count("Scan parquet") <= 4


def test_python_sees_only_what_expressions_leave_open(spark, data):
    p = plan(spark, data, "value_grounding")
    assert "levenshtein" in p and "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
