"""Plan-shape checks: the properties the scale design relies on."""

import re

from conftest import SF_SMALL
from railyard.operators import joins as jn
from railyard.plans import bindings as b


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _final_plan(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan
    return plan.split("== Initial Plan ==")[0]


def test_fifo_scan_shuffles_events_once(spark):
    req, resp = b.view_click_channels(spark, SF_SMALL)
    plan = _final_plan(jn.fifo_scan(req, resp, "channel", "ts", "id"))
    lines = [l for l in plan.splitlines() if "Exchange hashpartitioning(channel" in l]
    big = [l for l in lines if "__blk" in l and "ReusedExchange" not in l]
    # the events are shuffled once by (channel, block); the block-table
    # consumer reuses that shuffle; only block rows move by channel
    assert len(big) == 1, plan
    assert any("ReusedExchange" in l for l in lines), plan


def test_projection_pushdown_and_pruning(spark):
    req, _ = b.view_click_channels(spark, SF_SMALL)
    plan = _plan(req)
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,view)]" in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan


def test_fifo_match_pairs_with_hash_aggregate(spark):
    req, resp = b.view_click_channels(spark, SF_SMALL)
    plan = _plan(jn.fifo_match(req, resp, "channel", "ts", "id"))
    assert "SortAggregate" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_block_paths_hash_a_name_once(spark):
    from railyard.operators import joins as jn
    req = spark.createDataFrame([("a", "1", "shuffle_0_1_2")], "app_id STRING, exec_id STRING, block_id STRING")
    reg = spark.createDataFrame([("a", "1", ["/x", "/y"], 7, jn.HASH_MANAGER)],
                                "app_id STRING, exec_id STRING, local_dirs ARRAY<STRING>, sub_dirs INT, manager STRING")
    man = spark.createDataFrame([("a", "1", 0, 1, 2, 0, 9)], "app_id STRING, exec_id STRING, shuffle_id INT, "
                                "map_id INT, reduce_id INT, offset BIGINT, next_offset BIGINT")
    out = jn.resolve_blocks(req.repartition(1), reg.repartition(1), man.repartition(1))
    assert _optimized(out).count("aggregate(") == 1
    assert [r["failure"] for r in out.collect()] == [None]


def test_a_task_of_the_retries_sorts_the_items_of_one_join(spark):
    from railyard.operators import windows as wn
    log = spark.createDataFrame([(1, 1, 0, 1, "io_error"), (1, 1, 1, 1, "ok"), (None, 2, 0, 1, "fatal")],
                                "request INT, item INT, attempt INT, seq INT, outcome STRING")
    out = wn.resolve_retries(log)
    assert _optimized(out).count("Join ") == 1
    assert {(r["request"], r["status"], r["retries"]) for r in out.collect()} == {(1, "ok", 1), (None, "failed", 0)}


def test_retry_log_is_dealt_out_by_its_rows(spark, tmp_path, monkeypatch):
    from railyard.plans import bindings as b
    rows = [(i // 3, i % 3) for i in range(900)]
    spark.createDataFrame(rows * 2, "l_orderkey BIGINT, l_linenumber INT").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(b, "RETRY_ROWS", 100)
    log = b.retry_log(spark, str(tmp_path))
    assert log.rdd.getNumPartitions() == 19
    assert log.count() == log.distinct().count() == 3600
