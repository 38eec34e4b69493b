"""Plan guards: no all-pairs joins anywhere; per-group top-k plans carry a WindowGroupLimit
(Partial before a shuffle when one is needed; a single one when the input is already partitioned)."""

import pytest

import __spark_entry__ as E

BASE = "/root/testdata/sf0.001"
TOPK = {"knn_batch", "knn_per_row_k", "text_search", "conversation_memory", "frame_cap", "chat_retrieval"}


@pytest.mark.parametrize("key", sorted(E.queries()))
def test_no_cartesian_or_nested_loop_join(spark, key):
    plan = E.queries()[key](spark, BASE)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if key in TOPK:
        assert "WindowGroupLimit" in plan
