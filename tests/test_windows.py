import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_TINY, rows
from railyard.operators import windows as wn
from railyard.operators.scan import time_block
from railyard.plans import bindings as b

T0 = dt.datetime(2024, 1, 1)


def t(s):
    return T0 + dt.timedelta(seconds=s)


def test_offset_index(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 1, 0), (1, 2, 7), (2, 0, 3)], "m INT, r INT, size INT")
    got = rows(wn.offset_index(df, ["m"], ["r"], "size"), "m", "r", "idx", "offset", "next_offset")
    assert got == [(1, 0, 0, 0, 5), (1, 1, 1, 5, 5), (1, 2, 2, 5, 12), (2, 0, 0, 0, 3)]
    blocked = rows(wn.offset_index(df, ["m"], ["r"], "size", block=F.col("r")),
                   "m", "r", "idx", "offset", "next_offset")
    assert blocked == got


def simulate_in_order(idxs, n):
    e, out = 0, []
    for i in idxs:
        if e >= n:
            out.append("past_end")
        elif i == e:
            out.append("accepted")
            e += 1
        else:
            out.append("out_of_order")
    return out


def test_in_order_prefix_vectors(spark):
    idxs = [0, 1, 12345, 2, 1234, 3, 4, 0]
    df = spark.createDataFrame([(1, t(i), i, x) for i, x in enumerate(idxs)],
                               "s INT, ts TIMESTAMP, id INT, idx INT")
    for block in (None, F.col("id"), (F.col("id") / 3).cast("int")):
        got = [r["status"] for r in sorted(
            wn.in_order_prefix(df, "s", "ts", "id", "idx", 5, block=block).collect(),
            key=lambda r: r["id"])]
        assert got == ["accepted", "accepted", "out_of_order", "accepted", "out_of_order",
                       "accepted", "accepted", "past_end"]


def test_in_order_prefix_random_blocks(spark):
    rnd = random.Random(3)
    data = [(rnd.randint(0, 3), t(i), i, rnd.randint(0, 5)) for i in range(2000)]
    df = spark.createDataFrame(data, "s INT, ts TIMESTAMP, id INT, idx INT")
    out = {r["id"]: r["status"] for r in wn.in_order_prefix(
        df, "s", "ts", "id", "idx", 5, block=(F.col("id") / 37).cast("int")).collect()}
    for s in range(4):
        mine = [d for d in data if d[0] == s]
        exp = simulate_in_order([d[3] for d in mine], 5)
        assert [out[d[2]] for d in mine] == exp


def test_in_order_prefix_of_many_chunks_and_repeated_rows(spark):
    rnd = random.Random(8)
    seq = []
    for k in range(700):
        seq += [rnd.randint(0, 900) for _ in range(rnd.randint(0, 2))] + [k]
    data = [("a", i, i, x, 700) for i, x in enumerate(seq + [0, 699, 3])]
    data += [("b", i, i, x, 3) for i, x in enumerate([0, 2, 1, 1, 0])] + [("b", 9, 9, 2, 3)] * 2
    df = spark.createDataFrame(data, "`s.t` STRING, at INT, id INT, idx INT, n INT").withColumnRenamed("s.t", "s")
    got = wn.in_order_prefix(df, "s", "at", "id", "idx", "n").collect()
    out = {r["id"]: r["status"] for r in got if r["s"] == "a"}
    mine = [d for d in data if d[0] == "a"]
    assert [out[d[2]] for d in mine] == simulate_in_order([d[3] for d in mine], 700)
    assert sum(v == "accepted" for v in out.values()) == 700
    b_ = sorted((r["id"], r["status"]) for r in got if r["s"] == "b")
    assert b_ == [(0, "accepted"), (1, "out_of_order"), (2, "accepted"), (3, "out_of_order"), (4, "out_of_order"),
                  (9, "accepted"), (9, "past_end")]


def test_in_order_prefix_has_no_python_stage(spark):
    plan = wn.in_order_prefix(b.chunk_requests(spark, SF_TINY), "user_id", "ts", "event_id", "idx", 5)
    text = plan._jdf.queryExecution().toString()
    assert "MapInArrow" not in text and "Python" not in text


def test_in_order_prefix_nulls_large_ids_and_counts(spark):
    big = 1 << 60
    data = [(s, t(i), i, x, n, "p") for i, (s, x, n) in enumerate(
        [(None, 0, 2), (big, 0, 3), (big + 1, 0, 1), (None, None, 2), (big, 1, 3), (big + 1, 1, 1),
         (None, 1, 2), (big, None, 3), (None, 0, 2), (big, 2, 3), (7, 0, None)])]
    df = spark.createDataFrame(data, "s BIGINT, ts TIMESTAMP, id INT, idx INT, n INT, p STRING")
    exp = ["accepted", "accepted", "accepted", "out_of_order", "accepted", "past_end",
           "accepted", "out_of_order", "past_end", "accepted", "past_end"]
    for block in (None, (F.col("id") / 4).cast("int")):
        got = sorted(wn.in_order_prefix(df, "s", "ts", "id", "idx", "n", block=block).collect(),
                     key=lambda r: r["id"])
        assert [r["status"] for r in got] == exp
        assert [(r["s"], r["idx"], r["n"], r["p"]) for r in got] == [(d[0], d[3], d[4], d[5]) for d in data]


def walk_retries(answers, max_retries):
    """Settle one request's answers ``(item, attempt, seq, outcome)`` in order."""
    status, retries = {a[0]: "outstanding" for a in answers}, 0
    for attempt in range(max_retries + 1):
        again = False
        for item, _, _, outcome in sorted((a for a in answers if a[1] == attempt), key=lambda a: a[2]):
            if status[item] != "outstanding":
                continue
            if outcome == "io_error" and attempt < max_retries:
                again = True
                break
            status[item] = {"ok": "ok", "fatal": "failed", "io_error": "failed_io"}[outcome]
        if not again:
            break
        retries += 1
    return status, retries


def test_resolve_retries_vs_walk(spark):
    rnd = random.Random(11)
    data = []
    for req in [None, *range(60)]:
        for att in range(4):
            items = [i for i in range(rnd.randint(1, 6)) for _ in range(rnd.randint(0, 2))]
            rnd.shuffle(items)
            data += [(req, i, att, q, rnd.choice(["ok", "io_error", "fatal"])) for q, i in enumerate(items)]
    df = spark.createDataFrame(data, "request INT, item INT, attempt INT, seq BIGINT, outcome STRING")
    out = wn.resolve_retries(df, max_retries=3).collect()
    assert len(out) == len({d[:2] for d in data})
    for req in {d[0] for d in data}:
        status, retries = walk_retries([d[1:] for d in data if d[0] == req], 3)
        mine = [r for r in out if r["request"] == req]
        assert {r["item"]: r["status"] for r in mine} == status
        assert {r["retries"] for r in mine} == {retries}


# Retry scripts: per attempt, the answers in arrival order.
SCRIPTS = {
    "no_failure": ([[("b0", "ok"), ("b1", "ok")]], {"b0": "ok", "b1": "ok"}, 0),
    "unrecoverable": ([[("b0", "fatal"), ("b1", "ok")]], {"b0": "failed", "b1": "ok"}, 0),
    "io_on_first": ([[("b0", "io_error"), ("b1", "ok")], [("b0", "ok"), ("b1", "ok")]],
                    {"b0": "ok", "b1": "ok"}, 1),
    "io_on_second": ([[("b0", "ok"), ("b1", "io_error")], [("b1", "ok")]],
                     {"b0": "ok", "b1": "ok"}, 1),
    "two_io": ([[("b0", "io_error"), ("b1", "ok")], [("b0", "ok"), ("b1", "io_error")],
                [("b1", "ok")]], {"b0": "ok", "b1": "ok"}, 2),
    "three_io": ([[("b0", "io_error"), ("b1", "io_error")], [("b0", "ok"), ("b1", "io_error")],
                  [("b1", "io_error")], [("b1", "ok")]], {"b0": "ok", "b1": "ok"}, 3),
    "retry_and_unrecoverable": ([[("b0", "io_error"), ("b1", "fatal"), ("b2", "ok")],
                                 [("b0", "ok"), ("b1", "fatal"), ("b2", "io_error")],
                                 [("b2", "ok")]],
                                {"b0": "ok", "b1": "failed", "b2": "ok"}, 2),
    "budget_exhausted": ([[("b0", "io_error")], [("b0", "io_error")], [("b0", "io_error")],
                          [("b0", "io_error")]], {"b0": "failed_io"}, 3),
}


def test_resolve_retries_scripts(spark):
    data = []
    for name, (attempts, _, _) in SCRIPTS.items():
        for a, answers in enumerate(attempts):
            for seq, (item, outcome) in enumerate(answers):
                data.append((name, item, a, seq, outcome))
    df = spark.createDataFrame(data, "request STRING, item STRING, attempt INT, seq INT, outcome STRING")
    out = wn.resolve_retries(df, max_retries=3).collect()
    for name, (_, expect, retries) in SCRIPTS.items():
        got = {r["item"]: r["status"] for r in out if r["request"] == name}
        assert got == expect, name
        assert {r["retries"] for r in out if r["request"] == name} == {retries}, name


def test_idle_channels(spark):
    # channel 1: request then silence -> dead; channel 2: req+resp then silence;
    # channel 3: busy until the end -> alive
    g = spark.createDataFrame(
        [(1, t(0), 1, 1, 1), (2, t(0), 2, 1, 1), (2, t(10), 3, 0, 0),
         (3, t(0), 4, 1, 1), (3, t(20), 5, 0, 0), (3, t(40), 6, 1, 1), (3, t(60), 7, 0, 0),
         (3, t(80), 8, 1, 1), (3, t(95), 9, 0, 0)],
        "channel INT, ts TIMESTAMP, eid INT, is_req INT, outstanding INT")
    as_of = F.lit(t(100))
    got = rows(wn.idle_channels(g, 30, as_of), "channel", "status")
    assert got == [(1, "dead"), (2, "alive"), (3, "alive")]
    got = rows(wn.idle_channels(g, 30, as_of, close_idle=True), "channel", "status")
    assert got == [(1, "dead"), (2, "idle_closed"), (3, "alive")]
    # after a request only the second check (2 x timeout) can act
    got = rows(wn.idle_channels(g, 60, as_of), "channel", "status")
    assert got == [(1, "alive"), (2, "alive"), (3, "alive")]


def test_outstanding_gauge_and_peak(spark):
    req = spark.createDataFrame([(1, t(1), 1), (1, t(2), 2), (1, t(3), 3), (2, t(1), 4)],
                                "channel INT, ts TIMESTAMP, id INT")
    resp = spark.createDataFrame([(1, t(0), 10), (1, t(4), 11), (1, t(5), 12)],
                                 "channel INT, ts TIMESTAMP, id INT")
    g = wn.outstanding_gauge(req, resp)
    got = [(r["eid"], r["outstanding"]) for r in g.filter("channel = 1").orderBy("ts").collect()]
    # the early response finds nothing open and does not go below zero
    assert got == [(10, 0), (1, 1), (2, 2), (3, 3), (11, 2), (12, 1)]
    assert rows(wn.peak_outstanding(g), "channel", "n_events", "peak", "final") == [
        (1, 6, 3, 1), (2, 1, 1, 1)]


def test_gauge_counts_the_stream_being_received(spark):
    req = spark.createDataFrame([(1, t(0), 1), (1, t(5), 5)], "channel INT, ts TIMESTAMP, id INT")
    resp = spark.createDataFrame([(1, t(1), 2), (1, t(6), 6)], "channel INT, ts TIMESTAMP, id INT")
    marks = spark.createDataFrame([(1, t(1), 2, 1), (1, t(2), 3, 0), (2, t(1), 4, 1)],
                                  "channel INT, ts TIMESTAMP, id INT, active INT")
    got = sorted(((r["channel"], r["ts"], r["is_req"] is None, r["outstanding"])
                  for r in wn.gauge_with_streams(wn.outstanding_gauge(req, resp), marks).collect()))
    # the response leaves the queue, its stream keeps the channel busy to the end
    assert got == [(1, t(0), False, 1), (1, t(1), False, 0), (1, t(1), True, 1), (1, t(2), True, 0),
                   (1, t(5), False, 1), (1, t(6), False, 0), (2, t(1), True, 1)]


def test_in_order_prefix_hot_stream_query_vs_brute_force(spark):
    import __spark_entry__ as e
    from itertools import groupby
    out = {r["event_id"]: r["status"] for r in
           e.queries()["wn3_in_order_prefix_hot_stream"](spark, SF_TINY).collect()}
    src = sorted(b.chunk_requests_hot(spark, SF_TINY).collect(),
                 key=lambda r: (r["user_id"], r["ts"], r["event_id"]))
    assert len(out) == len(src)
    for _, grp in groupby(src, key=lambda r: r["user_id"]):
        g = list(grp)
        assert [out[r["event_id"]] for r in g] == simulate_in_order([r["idx"] for r in g], 5)
