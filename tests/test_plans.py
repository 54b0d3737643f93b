"""Shape of physical plans, and a sample of the queries beside their SQL (all of them: python -m tests.oracle_check)."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare

SMALL = "/root/testdata/sf0.001"
SAMPLE = ["campaign_performance", "attribution", "click_analysis", "variant_assignment", "universal_intent", "merge_results",
          "consent_state", "page_upsert"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    ok, message = compare(spark, SMALL, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, message


def test_every_query_has_sql_or_a_reason():
    own = {n for n in entry.queries() if not n.startswith("op") or not n[2:3].isdigit()} - {"pipeline"}
    assert own == {n for n in entry.oracle_sql() if n in own}


@pytest.mark.parametrize("name", ["attribution", "click_analysis", "rank_results", "match_ads", "keyword_search"])
def test_no_nested_loop_or_cartesian(spark, name):
    text = plan(entry.queries()[name](spark, SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_is_pruned_and_pushed_down(spark):
    text = plan(entry.queries()["click_velocity"](spark, SMALL))
    assert "EqualTo(event_type,click)" in text and "ReadSchema: struct<event_id:bigint" in text


def test_python_only_where_stated(spark):
    for name in ("campaign_roi", "attribution", "click_analysis", "universal_intent", "extract_links", "constraint_filter_v1", "keyword_search"):
        assert "Python" not in plan(entry.queries()[name](spark, SMALL))


def test_flagship(spark):
    assert entry.entry(spark).count() == 5
