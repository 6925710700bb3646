"""Plan-shape regression tests for the scale properties (static plans, AQE off)."""

import pytest

from quire.plans import catalog

from conftest import SF_SMALL


@pytest.fixture()
def plan(spark):
    prev = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")

    def get(name):
        return catalog.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    yield get
    spark.conf.set("spark.sql.adaptive.enabled", prev)


def test_search_has_no_pair_join(plan):
    p = plan("vector_search")
    assert "FlatMapCoGroupsInArrow" in p and "WindowGroupLimit" in p
    assert "CartesianProduct" not in p and "NestedLoopJoin" not in p


def test_fold_metrics_reads_text_once(plan):
    p = plan("fold_metrics")
    assert p.count("FileScan parquet") >= 2
    assert sum(1 for line in p.split("\n") if "FileScan parquet" in line and ",text" in line) == 1


def test_split_never_shuffles_rows_by_class_alone(plan):
    for name in ("stratified_split", "stratified_folds", "fold_metrics"):
        p = plan(name)
        # per-class tables are broadcast; rows are only exchanged on (class, hash bucket)
        assert "BroadcastHashJoin [coalesce(truth" in p        # a null class equals itself
        smj_on_class = [line for line in p.split("\n") if "SortMergeJoin [" in line and "truth#" in line.split("]")[0]]
        assert all("_b#" in line for line in smj_on_class)


def test_filter_reaches_scan(plan):
    p = plan("message_validation")
    assert "DataFilters: [isnotnull(role" in p and "(role#" in p


def test_context_runs_one_search(plan):
    assert plan("prompt_context").count("FlatMapCoGroupsInArrow") == 1


def test_keyword_scan_passes_over_a_text_once(plan):
    p = plan("travel_keyword_features")
    assert p.count("ArrowEvalPython") == 1 and "Exchange" not in p


def test_keyword_join_moves_no_text(plan):
    for name in ("keyword_join", "keyword_table_join"):
        p = plan(name)
        assert "Exchange" not in p and "NestedLoopJoin" not in p and "CartesianProduct" not in p


def test_top_runs_come_before_the_join(plan):
    p = plan("recent_runs")
    assert p.index("TakeOrderedAndProject") < p.index("Join") or "TakeOrderedAndProject" in p


def test_context_text_is_cut_before_the_join(plan):
    p = plan("prompt_context")
    assert "substring(text" in p and not any("Join" in line and "text#" in line for line in p.split("\n"))
