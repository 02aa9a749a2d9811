import datetime as dt
from collections import defaultdict, deque

from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from railyard.operators import joins as jn
from railyard.plans import bindings as b

T0 = dt.datetime(2024, 1, 1)


def t(s):
    return T0 + dt.timedelta(seconds=s)


def simulate_fifo(events):
    """Queue simulation: events = [(channel, ts, id, is_req)]."""
    queues = defaultdict(deque)
    out = {}
    for ch, ts, i, is_req in sorted(events, key=lambda e: (e[0], e[1], e[3], e[2])):
        if is_req:
            queues[ch].append((i, ts))
            out[("req", i)] = "outstanding"
        elif queues[ch]:
            rid, _ = queues[ch].popleft()
            out[("req", rid)] = ("matched", i)
        else:
            out[("resp", i)] = "orphan"
    return out


def test_fifo_match_equals_queue_simulation(spark):
    req, resp = b.view_click_channels(spark, SF_SMALL)
    ev = [(r["channel"], r["ts"], r["id"], True) for r in req.collect()] + \
         [(r["channel"], r["ts"], r["id"], False) for r in resp.collect()]
    expect = simulate_fifo(ev)
    got = {}
    for r in jn.fifo_match(req, resp, "channel", "ts", "id").collect():
        if r["status"] == "orphan":
            got[("resp", r["resp_id"])] = "orphan"
        elif r["status"] == "matched":
            got[("req", r["req_id"])] = ("matched", r["resp_id"])
        else:
            got[("req", r["req_id"])] = "outstanding"
    assert got == expect
    assert sum(1 for v in got.values() if v == "orphan") == 558


def test_fifo_match_drops_early_response(spark):
    req = spark.createDataFrame([(1, t(10), 1), (1, t(20), 2)], "channel INT, ts TIMESTAMP, id INT")
    resp = spark.createDataFrame([(1, t(5), 100), (1, t(30), 101), (1, t(31), 102), (1, t(32), 103)],
                                 "channel INT, ts TIMESTAMP, id INT")
    got = rows(jn.fifo_match(req, resp, block_unit=None), "req_id", "resp_id", "status")
    assert got == sorted([(1, 101, "matched"), (2, 102, "matched"), (None, 100, "orphan"),
                          (None, 103, "orphan")], key=repr)


def test_match_responses(spark):
    req = spark.createDataFrame([(0, t(1), 1), (123, t(2), 2), (456, t(3), 3), (789, t(50), 4)],
                                "rid INT, ts TIMESTAMP, id INT")
    resp = spark.createDataFrame(
        [(0, t(5), 10, "ok"), (0, t(6), 11, "failed"), (123, t(7), 12, "failed"),
         (789, t(40), 13, "ok"), (999, t(9), 14, "ok")],
        "rid INT, ts TIMESTAMP, id INT, outcome STRING")
    matched, disp = jn.match_responses(req, resp, ["rid"])
    assert rows(matched, "rid", "status") == [(0, "ok"), (123, "failed"), (456, "outstanding"),
                                              (789, "outstanding")]
    assert rows(disp, "resp_id", "disposition") == [(10, "consumed"), (11, "late"),
                                                    (12, "consumed"), (13, "early"),
                                                    (14, "unknown")]


def test_handshake(spark):
    conns = spark.createDataFrame([("s1", t(0), 1), ("s1", t(100), 2), ("s2", t(0), 3),
                                   ("s3", t(0), 4), ("s4", t(0), 5)],
                                  "secret STRING, ts TIMESTAMP, id INT")
    hellos = spark.createDataFrame([("s1", t(5), 10), ("s1", t(105), 11), ("s2", t(3), 12),
                                    ("s3", t(30), 13)], "secret STRING, ts TIMESTAMP, id INT")
    pending = spark.createDataFrame([("s1",), ("s3",), ("s4",)], "secret STRING")
    got = rows(jn.handshake(conns, hellos, pending, 10), "conn_id", "status")
    assert got == [(1, "connected"), (2, "duplicate"), (3, "unknown_secret"), (4, "timed_out"),
                   (5, "timed_out")]
    zero = rows(jn.handshake(conns, hellos, pending, 0), "status")
    assert set(zero) == {("timed_out",)}


def test_any_other_message_before_the_hello_is_an_error(spark):
    cols = "secret STRING, ts TIMESTAMP, id INT"
    conns = spark.createDataFrame([("s1", t(0), 1), ("s1", t(100), 2), ("s2", t(0), 3), ("s3", t(0), 4),
                                   (None, t(0), 5)], cols)
    hellos = spark.createDataFrame([("s1", t(5), 10), ("s1", t(105), 11), ("s2", t(3), 12), ("s3", t(4), 13)], cols)
    other = spark.createDataFrame([("s1", t(4), 20), ("s2", t(3), 21), ("s3", t(5), 22), (None, t(2), 23)], cols)
    pending = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "secret STRING")
    got = rows(jn.handshake(conns, hellos, pending, 10, messages=other), "conn_id", "status", "hello_id")
    # s1's first connection is refused, so its second is the one that consumes the secret;
    # of messages at one time the hello comes first
    assert got == [(1, "unexpected_message", None), (2, "connected", 11), (3, "connected", 12), (4, "connected", 13),
                   (5, "unexpected_message", None)]
    assert {r[0] for r in rows(jn.handshake(conns, hellos, pending, 0, messages=other), "status")} == {"timed_out"}


def test_requests_fail_with_the_cause_of_the_disconnect(spark):
    reqs = spark.createDataFrame(
        [(1, 1, t(0), t(50), "matched", "rpc"), (1, 2, t(30), None, "outstanding", "rpc"), (1, 3, t(60), None, "outstanding", "rpc"),
         (1, 4, t(0), t(10), "matched", "rpc")],
        "channel INT, req_id INT, req_ts TIMESTAMP, resp_ts TIMESTAMP, status STRING, kind STRING")
    disc = spark.createDataFrame([(1, t(20), 101, "reset"), (1, t(20), 100, None), (1, t(40), 102, "closed")],
                                 "channel INT, ts TIMESTAMP, id INT, cause STRING")
    got = rows(jn.fail_on_disconnect(reqs, disc), "req_id", "final_status", "disconnect_ts", "cause")
    assert got == [(1, "failed_disconnect", t(20), None), (2, "failed_disconnect", t(40), "closed"),
                   (3, "outstanding", None, None), (4, "matched", None, None)]


def test_connect_and_bootstrap_times(spark):
    from railyard.operators.aggregates import connection_summary
    c = spark.createDataFrame([("a", t(0), t(1), t(4)), ("a", t(0), t(3), None), ("a", t(0), None, None),
                               (None, t(0), t(2), t(2))],
                              "peer STRING, start_ts TIMESTAMP, connected_ts TIMESTAMP, ready_ts TIMESTAMP")
    for approx in (False, True):
        got = rows(connection_summary(c, approx=approx), "peer", "phase", "n", "total_us", "max_us", "min_us")
        assert got == sorted([("a", "connect", 2, 4_000_000, 3_000_000, 1_000_000),
                              ("a", "bootstrap", 1, 3_000_000, 3_000_000, 3_000_000),
                              (None, "connect", 1, 2_000_000, 2_000_000, 2_000_000),
                              (None, "bootstrap", 1, 0, 0, 0)], key=repr)
    assert ("a", "connect", 2_000_000.0) in rows(connection_summary(c), "peer", "phase", "p50_us")


def test_fail_on_disconnect(spark):
    reqs = spark.createDataFrame(
        [(1, 1, t(0), t(50), "matched", "rpc"), (1, 2, t(0), None, "outstanding", "rpc"),
         (1, 3, t(0), None, "outstanding", "stream"), (1, 4, t(30), t(35), "matched", "rpc"),
         (2, 5, t(0), None, "outstanding", "chunk")],
        "channel INT, req_id INT, req_ts TIMESTAMP, resp_ts TIMESTAMP, status STRING, kind STRING")
    disc = spark.createDataFrame([(1, t(20), 100), (1, t(40), 101)], "channel INT, ts TIMESTAMP, id INT")
    got = rows(jn.fail_on_disconnect(reqs, disc), "req_id", "final_status")
    assert got == [(1, "failed_disconnect"), (2, "failed_disconnect"), (3, "outstanding"),
                   (4, "matched"), (5, "outstanding")]
    got2 = rows(jn.fail_on_disconnect(reqs, disc, include_streams=True), "req_id", "final_status")
    assert (3, "failed_disconnect") in got2


def java_hash(s):
    h = 0
    for ch in s:
        h = (31 * h + ord(ch)) & 0xFFFFFFFF
    return abs(h - (1 << 32) if h >= 1 << 31 else h)


def test_resolve_blocks(spark):
    hash_m, sort_m = jn.HASH_MANAGER, jn.SORT_MANAGERS[0]
    reg = spark.createDataFrame(
        [("app0", "e-hash", ["/bippy", "/flippy"], 7, hash_m),
         ("app0", "e-sort", ["/bippy", "/flippy"], 7, sort_m),
         ("app0", "e-bogus", ["/x"], 7, "foobar")],
        "app_id STRING, exec_id STRING, local_dirs ARRAY<STRING>, sub_dirs INT, manager STRING")
    manifest = spark.createDataFrame(
        [("app0", e, 0, 0, r, 6 * r, 6 * r + 6) for e in ("e-sort", "e-hash") for r in (0, 1)]
        + [("app1", "e-sort", 0, 0, 1, 40, 90)],
        "app_id STRING, exec_id STRING, shuffle_id INT, map_id INT, reduce_id INT, offset BIGINT, next_offset BIGINT")
    req = spark.createDataFrame(
        [("app0", "e-sort", "shuffle_0_0_1"), ("app0", "e-sort", "shuffle_0_0_5"),
         ("app0", "e-hash", "shuffle_0_0_0"), ("app0", "e-bogus", "shuffle_0_0_0"),
         ("app0", "e-none", "shuffle_0_0_0"), ("app0", "e-sort", "rdd_0_0_0")],
        "app_id STRING, exec_id STRING, block_id STRING")
    got = {(r["exec_id"], r["block_id"]): (r["path"], r["offset"], r["length"], r["failure"])
           for r in jn.resolve_blocks(req, reg, manifest).collect()}
    h = java_hash("shuffle_0_0_0.data")
    data_path = ["/bippy", "/flippy"][h % 2] + "/%02x/" % ((h // 2) % 7) + "shuffle_0_0_0.data"
    assert got[("e-sort", "shuffle_0_0_1")] == (data_path, 6, 6, None)
    assert got[("e-sort", "shuffle_0_0_5")][3] == "missing_index"
    hh = java_hash("shuffle_0_0_0")
    assert got[("e-hash", "shuffle_0_0_0")] == (
        ["/bippy", "/flippy"][hh % 2] + "/%02x/" % ((hh // 2) % 7) + "shuffle_0_0_0", 0, 6, None)
    assert got[("e-bogus", "shuffle_0_0_0")][3] == "unsupported_manager"
    assert got[("e-none", "shuffle_0_0_0")][3] == "unregistered_executor"
    assert got[("e-sort", "rdd_0_0_0")][3] == "bad_shuffle_id"


def test_outstanding_items_keeps_first_position(spark):
    requested = spark.createDataFrame([("b2", 1), ("b0", 2), ("b2", 3), ("b1", 4)], "item STRING, pos INT")
    answered = spark.createDataFrame([("b0",)], "item STRING")
    got = sorted(((r["first_pos"], r["item"]) for r in
                  jn.outstanding_items(requested, answered, ["item"], ["pos"]).collect()))
    assert got == [(1, "b2"), (4, "b1")]


def test_latency_summary_exact_and_approx(spark):
    from railyard.operators import aggregates as ag
    m = spark.createDataFrame([(1, t(0), t(s)) for s in (1, 2, 3, 10)] + [(2, t(0), None)],
                              "channel INT, req_ts TIMESTAMP, resp_ts TIMESTAMP")
    ex = ag.latency_summary(m).collect()
    assert [(r["peer"], r["n"], r["p50_us"], r["max_us"]) for r in ex] == [(1, 4, 2_500_000.0, 10_000_000)]
    ap = ag.latency_summary(m, approx=True).collect()[0]
    assert ap["p50_us"] in (2_000_000.0, 3_000_000.0) and ap["n"] == 4


def test_latency_summary_median_vs_statistics(spark):
    import random
    import statistics
    from railyard.operators import aggregates as ag
    rnd = random.Random(5)
    lats = {p: [rnd.choice([0, 1, 2, 0.5, rnd.random() * 5]) for _ in range(n)]
            for p, n in ((None, 7), (1, 1), (2, 2), (3, 400), (4, 401))}
    m = spark.createDataFrame([(p, t(0), t(x)) for p, xs in lats.items() for x in xs],
                              "channel INT, req_ts TIMESTAMP, resp_ts TIMESTAMP")
    got = {r["peer"]: r for r in ag.latency_summary(m).collect()}
    assert set(got) == set(lats)
    for p, xs in lats.items():
        us = [(t(x) - t(0)) / dt.timedelta(microseconds=1) for x in xs]
        assert (got[p]["n"], got[p]["p50_us"], got[p]["total_us"]) == (len(us), statistics.median(us), sum(us))


def test_fifo_match_under_a_hot_channel(spark):
    from railyard.operators.scan import time_block
    req, resp = b.hot_channel_view_clicks(spark, SF_SMALL)
    both = req.unionByName(resp)
    hot = both.filter("channel = -1").count()
    assert hot >= both.count() // 4
    # the per-(channel, day) blocks the scan works on are a small part of it
    biggest = (both.groupBy("channel", time_block("ts", "day").alias("d")).count()
               .agg(F.max("count")).first()[0])
    assert biggest * 10 < hot
    ev = [(r["channel"], r["ts"], r["id"], True) for r in req.collect()] + \
         [(r["channel"], r["ts"], r["id"], False) for r in resp.collect()]
    expect = simulate_fifo(ev)
    got = {}
    for r in jn.fifo_match(req, resp, "channel", "ts", "id").collect():
        if r["status"] == "orphan":
            got[("resp", r["resp_id"])] = "orphan"
        elif r["status"] == "matched":
            got[("req", r["req_id"])] = ("matched", r["resp_id"])
        else:
            got[("req", r["req_id"])] = "outstanding"
    assert got == expect


def test_resolve_blocks_of_two_apps_with_the_same_block_ids(spark):
    reg = spark.createDataFrame([(a, "e", ["/d"], 7, jn.SORT_MANAGERS[0]) for a in ("a", "b")],
                                "app_id STRING, exec_id STRING, local_dirs ARRAY<STRING>, sub_dirs INT, manager STRING")
    manifest = spark.createDataFrame([("a", "e", 0, 1, 2, 0, 10), ("b", "e", 0, 1, 2, 5, 99)],
                                     "app_id STRING, exec_id STRING, shuffle_id INT, map_id INT, reduce_id INT, "
                                     "offset BIGINT, next_offset BIGINT")
    req = spark.createDataFrame([("a", "e", "shuffle_0_1_2"), ("b", "e", "shuffle_0_1_2")],
                                "app_id STRING, exec_id STRING, block_id STRING")
    got = sorted((r["app_id"], r["offset"], r["length"]) for r in jn.resolve_blocks(req, reg, manifest).collect())
    assert got == [("a", 0, 10), ("b", 5, 94)]


def test_fifo_orphan_with_a_negative_id(spark):
    import datetime as dt
    t = [dt.datetime(2024, 1, 1, 0, 0, k) for k in range(5)]
    req = spark.createDataFrame([(1, t[1], 10), (1, t[2], 11)], "channel LONG, ts TIMESTAMP, id LONG")
    resp = spark.createDataFrame([(1, t[0], -3), (1, t[3], 20)], "channel LONG, ts TIMESTAMP, id LONG")
    got = {(r["req_id"], r["resp_id"], r["status"]) for r in jn.fifo_match(req, resp).collect()}
    assert got == {(None, -3, "orphan"), (10, 20, "matched"), (11, None, "outstanding")}
