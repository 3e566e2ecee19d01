"""What a hit needs of its row comes with the search: hits are never joined or shuffled for it."""

from __future__ import annotations

import pytest

from loam import catalog


@pytest.mark.parametrize("name", ["agent_boost", "contradiction_candidates", "failure_search", "importance_multiplier_blend"])
def test_hits_are_not_joined_after_the_search(spark, sf_dir, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the rows are too many
    try:
        plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    searched = plan.index("MapInArrow")
    assert "Join" not in plan[:searched] and "Exchange" not in plan[:searched]
