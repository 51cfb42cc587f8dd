"""Rows made from texts are joined by sorting: Spark's estimate of their size is too small for a size-checked broadcast."""

import pytest

from inkveil.plans import queries

#: Broadcasts of a query's last plan: only of lists of titles and of municipalities' aliases.
BROADCASTS = {
    "role_match": 1,
    "officials_match": 0,
    "classify_persons": 3,
    "custom_terms": 0,
    "occurrence_boxes": 0,
    "nth_occurrence": 0,
    "search_boxes": 0,
    "delivery_sessions": 1,
    "other_status": 0,
    "routed": 3,
    "decided_documents": 4,
    "box_texts": 0,
    "custom_merge": 0,
    "detect_all_boost": 0,
}


@pytest.mark.parametrize("name", BROADCASTS)
def test_broadcasts(spark, sf, name):
    plan = queries.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("BroadcastExchange"), "BuildLeft" in plan) == (BROADCASTS[name], False)


def test_spans_are_worked_out_once(spark, sf):
    """A test that Spark infers for an array that is exploded would hold the whole array's rules once more."""
    assert "Filter" not in queries.queries()["t2_all"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_decided_spans_are_found_once(spark, sf):
    """Contacts look at the spans that were written, so the letters' rows are in no part of the plan."""
    assert "c_custkey" not in queries.queries()["status_breakdown"](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_refreshed_spans_are_found_once(spark, sf):
    assert "c_custkey" not in queries.queries()["refreshed_decisions"](spark, sf)._jdf.queryExecution().executedPlan().toString()
