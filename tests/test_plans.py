"""Physical-plan checks: joins, no nested loops or Python nodes, top-k."""

from pyspark.sql import functions as F

from hydroframe.plans import queries as Q
from tests.conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_or_nested_loop_nodes(spark):
    for name in ["master_dataset", "monthly_window_grid", "ranking_scores", "flow_events", "lookback_windows",
                 "top_variable_names", "attention_smoothed"]:
        p = plan(Q.REGISTRY[name](spark, SF_SMALL))
        for bad in ["BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython",
                    "FlatMapGroupsInPandas"]:
            assert bad not in p, (name, bad)


def test_monthly_and_static_joins_broadcast(spark):
    p = plan(Q.master_dataset(spark, SF_SMALL))
    assert "BroadcastHashJoin" in p


def test_top_n_is_take_ordered(spark):
    from hydroframe.operators import ranking as K
    p = plan(K.top_candidates(Q.candidates(spark, SF_SMALL), 15))
    assert "TakeOrderedAndProject" in p


def test_gap_fill_partitions_by_station_and_block(spark):
    p = plan(Q.filled_flow(spark, SF_SMALL))
    assert "hashpartitioning(station_id" in p
    # no window partitioned by the station alone over the daily rows: the big exchange carries the block
    assert "_blk" in p


def test_filters_reach_the_scan(spark):
    from hydroframe.plans import bindings as B
    df = B.predictions(spark, SF_SMALL).filter(F.col("split") == "test")
    p = plan(df)
    assert "ReadSchema" in p and "l_comment" not in p  # column pruning
