import os
import time
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from conftest import SF_TINY, rows
from railyard import streaming as sm
from railyard.operators import state as stt
from railyard.operators import text as tx
from railyard.plans import bindings as b


DELAY = "11 days"           # more than a third of the events' time
DELAY_MS = 11 * 86_400_000


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    """State stores are opened per partition and micro-batch."""
    key = "spark.sql.shuffle.partitions"
    old = spark.conf.get(key)
    spark.conf.set(key, "3")
    yield
    spark.conf.set(key, old)


def _stream(spark, df, ts="ts", n=3, name="t", n_files=None, max_files=1):
    return sm.read_stream(spark, sm.stage_files(df, ts, n, name, n_files), df.schema, max_files)


def _due(df):
    """Rows that the final watermark has passed."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    top = df.agg(F.max(ms)).first()[0]
    return df.filter(ms < top - DELAY_MS)


@pytest.fixture(params=[(1, 1, 10_000), (4, 3, 7)], ids=["in-order", "shuffled"])
def cut(request, spark):
    """Files of a slice, files of a micro-batch, rows of an Arrow chunk."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, request.param[2])
    yield {"n_files": request.param[0], "max_files": request.param[1]}
    spark.conf.set(key, old)


def test_registry_stream_equals_batch(spark):
    ev = b.registry_events(spark, SF_TINY)
    batch = rows(stt.registry_state(ev), "app", "exec", "info")
    changes = sm.run_available(sm.stream_registry_state(_stream(spark, ev)), "t-reg")
    assert rows(sm.registry_from_changes(changes), "app", "exec", "info") == batch


def test_lifecycle_stream_equals_batch(spark, cut):
    ev = b.app_state_events(spark, SF_TINY)
    batch = rows(stt.lifecycle_state(_due(ev)), "app", "state", "is_final", "n_applied", "n_ignored")
    out = sm.lifecycle_from_changes(
        sm.run_available(sm.stream_lifecycle_state(_stream(spark, ev, **cut), DELAY), "t-life"))
    assert rows(out, "app", "state", "is_final", "n_applied", "n_ignored") == batch


def test_changes_told_to_a_listener(spark, cut):
    ev = b.app_events_with_info(spark, SF_TINY)
    out = sm.run_available(sm.stream_state_changes(_stream(spark, ev, **cut), DELAY), "t-told")
    got = sorted((r["app"], r["eid"], r["state"], r["change"]) for r in out.collect())
    want, state = [], defaultdict(lambda: "UNKNOWN")
    for r in sorted(_due(ev).collect(), key=lambda r: (r["ts"], r["eid"])):
        if r["info"] is not None:
            want.append((r["app"], r["eid"], state[r["app"]], "info_changed"))
        elif state[r["app"]] not in ("FINISHED", "FAILED", "KILLED"):
            state[r["app"]] = r["state"]
            want.append((r["app"], r["eid"], r["state"], "state_changed"))
    assert got == sorted(want)
    assert any(c == "info_changed" and s in ("FINISHED", "FAILED") for _, _, s, c in want)


def simulate_timed_fifo(events, timeout_us):
    q = defaultdict(deque)
    out = set()
    for ch, ts, eid, is_req in sorted(events, key=lambda e: (e[0], e[1], e[3], e[2])):
        while q[ch] and q[ch][0][0] + timeout_us < ts:
            out.add((ch, q[ch].popleft()[1], None, "timed_out"))
        if is_req:
            q[ch].append((ts, eid))
        elif q[ch]:
            out.add((ch, q[ch].popleft()[1], eid, "matched"))
        else:
            out.add((ch, None, eid, "orphan"))
    pending = {(ch, e[1]) for ch, qq in q.items() for e in qq}
    return out, pending


@pytest.mark.parametrize("keys", [("channel",), ("channel", "corr")])
def test_stream_match_responses_vs_simulation(spark, cut, keys):
    e = b.signup_purchase_events(spark, SF_TINY)
    timeout = 3 * 86400
    out = sm.run_available(sm.stream_match_responses(_stream(spark, e, **cut), timeout, DELAY, keys), "t-rpc")
    got = {(tuple(r[k] for k in keys), r["req_id"], r["resp_id"], r["status"]) for r in out.collect()}
    evs = [(tuple(r[k] for k in keys), round(r["ts"].timestamp() * 1e6), r["eid"], r["is_req"])
           for r in _due(e).collect()]
    expect, pending = simulate_timed_fifo(evs, timeout * 1_000_000)
    # requests still pending at the end are given up if the final watermark
    # has passed their deadline
    top = max(round(r["ts"].timestamp() * 1e6) for r in e.collect())
    at = {(k, eid): us for k, us, eid, _ in evs}
    wm = (top // 1000 - DELAY_MS) * 1000
    expect |= {(k, eid, None, "timed_out") for k, eid in pending if at[k, eid] + timeout * 1_000_000 < wm}
    assert got == expect and len(got) > len(evs) // 2


def test_stream_match_keeps_large_ids(spark):
    big = 2**60 + 1
    e = spark.createDataFrame([(1, 1, big, 1), (1, 2, big + 2, 0), (1, 3, big + 4, 0), (2, 9_000_000, 5, 1)],
                              "channel long, s long, eid long, is_req int")
    e = e.select("channel", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "eid", "is_req")
    out = sm.run_available(sm.stream_match_responses(_stream(spark, e, n=1, max_files=None), 60, "1 hour"), "t-big")
    assert rows(out, "req_id", "resp_id", "status") == sorted(
        [(big, big + 2, "matched"), (None, big + 4, "orphan")], key=repr)


def test_late_events_are_given_back_and_not_applied(spark):
    rows_ = [(1, h, h, "RUNNING") for h in range(0, 100, 2)] + [(2, 50, 900, "CONNECTED")]
    late = [(1, 1, 901, "FAILED"), (2, None, 902, "FAILED")]
    schema = "app long, h int, eid long, state string"

    def at(data):
        return sm.with_end(spark.createDataFrame(data, schema).select(
            "app", F.timestamp_seconds(F.col("h") * 3600).cast("timestamp_ntz").alias("ts"), "eid", "state"))
    path = sm.stage_files(at(rows_), "ts", 4, "t-late")
    s = sm.read_stream(spark, path, at(rows_).schema)

    def end():
        at(late).write.mode("append").parquet(path)
        sm.run_available(s, "t-none")
    changes = sm.stream_lifecycle_state(s, "10 hours")
    out = sm.run_available(changes, "t-late", end=end)
    assert {(r.app, r.eid, r.state) for r in sm.late_events(out).collect()} == {(1, 901, "FAILED"), (2, 902, "FAILED")}
    assert not any(r.is_final for r in sm.lifecycle_from_changes(out).collect())


def test_order_does_not_depend_on_slots_or_nulls(spark):
    """A key with most of the events, over many turns of the ring, in one
    micro-batch and in no order; two events of one time and id."""
    n = 4000
    data = [(1, i, i, "FAILED" if i == n - 2 else "RUNNING", None) for i in range(n)]
    data += [(2, 5, 1, None, "a"), (2, 5, 1, "CONNECTED", None), (2, 5, 1, "CONNECTED", "b")]
    e = sm.with_end(spark.createDataFrame(data, "app long, m int, eid long, state string, info string").select(
        "app", F.timestamp_seconds(F.col("m") * 60).cast("timestamp_ntz").alias("ts"), "eid", "state", "info"))
    path = sm.stage_files(e.orderBy(F.rand(3)), None, 1, "t-ring", 3)
    s = sm.read_stream(spark, path, e.schema)
    out = sm.run_available(sm.stream_lifecycle_state(s, "1 hour"), "t-ring",
                           end=lambda: sm.stage_end(e, path, 3_700_000))
    got = {r.app: (r.state, r.n_applied, r.n_ignored) for r in sm.lifecycle_from_changes(out).collect()}
    assert got == {1: ("FAILED", n - 1, 1), 2: ("CONNECTED", 2, 0)}


def test_registry_tells_changed_executors_only_and_resumes(spark):
    def reg(rows_):
        return spark.createDataFrame(rows_, "app long, exec long, s int, eid long, kind string, info int").select(
            "app", "exec", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "eid", "kind", "info",
            F.when(F.col("info").isNotNull(), F.array(F.concat(F.lit("/d"), "info"))).alias("local_dirs"))
    first = [(1, x, 10, x, "register", x) for x in range(50)] + [(2, None, 10, 99, "register", 1)]
    schema = reg(first).schema
    from railyard.session import scratch_path
    path, out, ckpt = (scratch_path(spark, n) for n in ("reg-in", "reg-out", "reg-ckpt"))

    def step(rows_):
        reg(rows_).repartition(2).write.mode("append").parquet(path)
        changes = sm.stream_registry_state(sm.read_stream(spark, path, schema))
        q = (changes.writeStream.format("parquet").option("checkpointLocation", ckpt).option("path", out)
             .trigger(availableNow=True).start())
        q.awaitTermination()
        return spark.read.schema(changes.schema).parquet(out)
    before = step(first).count()
    assert before == 51
    # a newer and an older registration of one, another app's removal, a late registration from before it
    after = step([(1, 7, 20, 200, "register", 70), (1, 8, 5, 201, "register", 80), (2, None, 30, 202, "remove", None),
                  (2, 4, 25, 203, "register", 4)])
    assert after.count() == before + 2
    live = {(r.app, r.exec): r.info for r in sm.registry_from_changes(after).collect()}
    assert live == {(1, x): x if x != 7 else 70 for x in range(50)}
    again = step([(2, 4, 40, 204, "register", 5), (2, 4, 35, 205, "register", 6)])
    assert again.count() == before + 3
    assert {r.exec: r.info for r in sm.registry_from_changes(again).collect() if r.app == 2} == {4: 5}


@pytest.mark.parametrize("close", [True, False])
def test_idle_verdicts_equal_batch(spark, cut, close):
    from railyard.operators import windows as wn
    e = sm.with_end(b.view_click_events(spark, SF_TINY))
    path = sm.stage_files(e, "ts", 3, "t-idle", cut["n_files"])
    s = sm.read_stream(spark, path, e.schema, cut["max_files"])
    days = 3
    out = sm.run_available(sm.stream_idle_verdicts(s, days * 86_400, DELAY, close), "t-idle",
                           end=lambda: sm.stage_end(e, path, DELAY_MS + 2 * days * 86_400_000 + 1000))
    req, resp = b.view_click_channels(spark, SF_TINY)
    batch = wn.idle_channels(wn.outstanding_gauge(req, resp, "channel", "ts", "id"), days * 86_400,
                             F.lit("2100-01-01").cast("timestamp_ntz"), close_idle=close).filter("status <> 'alive'")
    cols = "channel", "status", "closed_at", "outstanding"
    got = rows(out.withColumn("closed_at", F.col("closed_at").cast("timestamp_ntz")), *cols)
    assert got == rows(batch, *cols) and got


def test_idle_verdict_comes_when_the_timer_fires(spark):
    def ev(rows_):
        return spark.createDataFrame(rows_, "channel string, s int, eid long, is_req int").select(
            "channel", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "eid", "is_req")
    path = sm.stage_files(ev([("a", 0, 1, 1), ("b", 0, 2, 0), (None, 0, 3, 1)]), name="t-fire")
    s = sm.read_stream(spark, path, ev([]).schema)
    seen = []

    def later():
        seen.append(1)
        ev([("c", 1000, 4, 0)]).write.mode("append").parquet(path)
    out = sm.run_available(sm.stream_idle_verdicts(s, 60, "1 minute", True), "t-fire", end=later)
    got = {r.channel: (r.status, r.closed_at.timestamp(), r.outstanding) for r in out.collect()}
    assert got == {"a": ("dead", 120.0, 1), "b": ("idle_closed", 60.0, 0), None: ("dead", 120.0, 1)}


def test_timed_join_equals_batch_join(spark):
    req, resp = b.orders_and_shipments(spark, SF_TINY)
    got = rows(_whole(spark, "st3_stream_timed_join"), "id", "req_ts", "resp_ts", "status")
    j = req.withColumnRenamed("id", "q").join(resp.withColumnRenamed("id", "p"), F.expr(
        "q = p AND resp_ts >= req_ts AND resp_ts <= req_ts + INTERVAL 365 DAYS"), "full_outer")
    status = F.expr("CASE WHEN resp_ts IS NULL THEN 'timed_out' WHEN req_ts IS NULL THEN 'orphan' ELSE 'matched' END")
    want = rows(j.select(F.coalesce("q", "p").alias("id"), "req_ts", "resp_ts", status.alias("status")))
    assert got == want and len({r[3] for r in got}) == 3


def test_rows_that_spark_drops_are_counted(spark):
    def at(hours):
        return spark.createDataFrame([(1, h) for h in hours], "channel long, h int").select(
            "channel", F.timestamp_seconds(F.col("h") * 3600).cast("timestamp_ntz").alias("ts"))
    path, dropped = sm.stage_files(at([0, 100]), name="t-drop"), []
    s = sm.read_stream(spark, path, at([0]).schema)

    def end():
        at([1, 2, 200]).write.mode("append").parquet(path)
    sm.run_available(sm.stream_idle_sessions(s), "t-drop", end=end, ended=lambda q: dropped.append(sm.rows_dropped(q)))
    assert dropped == [0, 2]


def test_each_item_is_reported_once_and_at_once(spark):
    log = b.timed_answers(spark, SF_TINY)
    s = sm.read_stream(spark, sm.stage_files(log, "ts", 4, "t-once", 2), log.schema, max_files=2)
    out = sm.run_available(sm.stream_report_once(s, ("request", "item"), "ts", "30 days"), "t-once")
    keys = [(r.request, r.item) for r in out.collect()]
    assert sorted(keys) == sorted((r.request, r.item) for r in log.select("request", "item").distinct().collect())
    assert out.columns == log.columns


def test_reassembly_ends_by_event_time(spark):
    def pieces(rows_):
        return sm.with_end(spark.createDataFrame(rows_, "stream_id long, chunk_idx long, body string, s int").select(
            "stream_id", "chunk_idx", "body", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts")))
    ann = spark.createDataFrame([(1, 4), (2, 9), (3, 2), (4, 4), (5, 6)], "stream_id long, expected_bytes long")
    rows_ = [(1, 1, "cd", 1), (1, 0, "ab", 2), (2, 0, "ab", 3), (2, 2, "z", 4), (3, 0, "abc", 5), (4, 0, "ab", 6),
             (4, 0, "ab", 7), (5, 0, None, 8), (5, 1, "", 9)]
    path = sm.stage_files(pieces(rows_), name="t-end6", n_files=3)
    s = sm.read_stream(spark, path, pieces(rows_).schema, max_files=1)

    def end():
        pieces([(4, 1, "cd", 50), (9, 0, "a", 5000)]).coalesce(1).write.mode("append").parquet(path)
    joined = s.join(ann, "stream_id", "left")
    out = sm.run_available(sm.stream_reassemble(joined, "10 minutes", "10 seconds"), "t-end6", end=end)
    got = sorted((r.stream_id, r.event, r.bytes_read, r.chunk_idx) for r in out.collect() if r.event != "data")
    assert got == [(1, "complete", 4, None), (2, "incomplete", 2, None), (3, "overrun", 3, None),
                   (4, "complete", 4, None), (5, "incomplete", 0, None)]
    data = sorted((r.stream_id, r.chunk_idx, r.bytes_read) for r in out.filter("event = 'data'").collect())
    assert data == [(1, 0, 2), (1, 1, 4), (2, 0, 2), (3, 0, 3), (4, 0, 2), (4, 1, 4), (5, 0, 0), (5, 1, 0), (9, 0, 1)]


def test_stream_reassembly_matches_batch(spark):
    chunks, ann = b.conversation_streams(spark, SF_TINY)
    s = sm.read_stream(spark, sm.stage_files(chunks, None, 1, "t-conv", 5), chunks.schema, max_files=2)
    out = sm.run_available(sm.stream_reassemble(s.join(ann, "stream_id")), "t-reasm")
    final = {r["stream_id"]: r["event"] for r in out.filter("event <> 'data'").collect()}
    batch = {r["stream_id"]: r["status"] for r in tx.reassemble_chunks(chunks, ann).collect()}
    assert final == {k: v for k, v in batch.items() if v != "incomplete"}


def test_first_answer(spark):
    log = b.timed_answers(spark, SF_TINY)
    s = sm.read_stream(spark, sm.stage_files(log, name="t-dd", n_files=6), log.schema)
    out = sm.run_available(sm.stream_first_answer(s, ("request", "item"), "ts", "3 hours", "2 hours",
                                                  ("attempt",)), "t-dd")
    got = {(r["request"], r["item"]): (r["attempt"], r["outcome"], r["n_answers"]) for r in out.collect()}
    log = log.collect()
    top = max(r["ts"] for r in log)
    want, last = {}, {}
    for r in sorted(log, key=lambda r: r["ts"], reverse=True):
        key = r["request"], r["item"]
        last.setdefault(key, r["ts"])
        want[key] = (r["attempt"], r["outcome"], 4)
    # not flushed: requests whose last answer the watermark has passed by the lifetime
    assert got == {k: v for k, v in want.items() if (top - last[k]).total_seconds() >= 5 * 3600}
    assert len(got) > len(want) // 2
    whole = {(r["request"], r["item"]): (r["attempt"], r["outcome"], r["n_answers"])
             for r in _whole(spark, "st5_stream_first_answer").collect()}
    assert whole == want


def test_sessions(spark):
    ev = b.table(spark, SF_TINY, "events").select(F.col("user_id").alias("channel"), "ts")
    ses = sm.run_available(sm.stream_idle_sessions(_stream(spark, ev)), "t-ses")
    assert ses.count() > 0
    assert ses.filter(F.col("session_end") != F.col("last_ts") + F.expr("INTERVAL 30 MINUTES")).count() == 0


def test_stream_sessions_equal_batch_sessions(spark):
    from railyard.operators import windows as wn
    ev = b.table(spark, SF_TINY, "events").select(F.col("user_id").alias("channel"), "ts",
                                                  F.col("event_id").alias("eid"))
    batch = {(r["channel"], r["first_ts"], r["last_ts"], r["n_events"])
             for r in wn.activity_sessions(ev, "channel", "ts", "eid", 1800).collect()}
    st = sm.run_available(sm.stream_idle_sessions(_stream(spark, ev.drop("eid"))), "t-ses2")
    closed = {(r["channel"], r["first_ts"].replace(tzinfo=None), r["last_ts"].replace(tzinfo=None),
               r["n_events"]) for r in st.select(
                   "channel", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"),
                   F.col("last_ts").cast("timestamp_ntz").alias("last_ts"), "n_events").collect()}
    assert closed and closed <= batch


# ---- registered streams take the whole finite input

def _whole(spark, name):
    from railyard.plans import catalog
    catalog.load_all()
    return catalog.QUERIES[name](spark, SF_TINY)


def test_lifecycle_query_takes_every_event(spark):
    cols = "app", "state", "is_final", "n_applied", "n_ignored"
    batch = rows(stt.lifecycle_state(b.app_state_events(spark, SF_TINY)), *cols)
    assert rows(_whole(spark, "st2_stream_lifecycle_state"), *cols) == batch


def test_listener_query_is_told_every_change(spark):
    got = rows(_whole(spark, "st7_listener_sink"), "app", "eid", "state", "change")
    want, state = [], defaultdict(lambda: "UNKNOWN")
    for r in sorted(b.app_events_with_info(spark, SF_TINY).collect(), key=lambda r: (r["ts"], r["eid"])):
        if r["info"] is not None:
            want.append((r["app"], r["eid"], state[r["app"]], "info_changed"))
        if r["state"] is not None and state[r["app"]] not in ("FINISHED", "FAILED", "KILLED"):
            state[r["app"]] = r["state"]
            want.append((r["app"], r["eid"], r["state"], "state_changed"))
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("name,keys", [("st3_stream_match_responses", ("channel",)),
                                       ("st3_stream_match_by_id", ("channel", "corr"))])
def test_match_queries_settle_every_event(spark, name, keys):
    out = _whole(spark, name).collect()
    got = {(tuple(r[k] for k in keys), r["req_id"], r["resp_id"], r["status"]) for r in out}
    evs = [(tuple(r[k] for k in keys), round(r["ts"].timestamp() * 1e6), r["eid"], r["is_req"])
           for r in b.signup_purchase_events(spark, SF_TINY).collect()]
    expect, pending = simulate_timed_fifo(evs, 86400 * 1_000_000)
    assert got == expect | {(k, eid, None, "timed_out") for k, eid in pending} and len(out) == len(got)
    assert {x for r in out for x in (r["req_id"], r["resp_id"])} - {None} == {e[2] for e in evs}


def test_session_query_closes_every_session(spark):
    from railyard.operators import windows as wn
    ev = b.table(spark, SF_TINY, "events").filter("event_type IN ('view', 'click')").select(
        F.col("user_id").alias("channel"), "ts", F.col("event_id").alias("eid"))
    cols = "channel", "first_ts", "last_ts", "n_events"
    assert rows(_whole(spark, "st4_stream_idle_sessions"), *cols) == \
        rows(wn.activity_sessions(ev, "channel", "ts", "eid", 1800), *cols)


def test_end_row_is_in_no_result_and_empty_input_has_none(spark):
    e = sm.with_end(b.app_state_events(spark, SF_TINY).filter("false"))
    path = sm.stage_files(e, "ts", 4, "t-end")
    s = sm.read_stream(spark, path, e.schema)
    out = sm.run_available(sm.stream_lifecycle_state(s, DELAY), "t-end",
                           end=lambda: sm.stage_end(e, path, DELAY_MS))
    assert out.count() == 0


def test_staged_files_grow_with_the_rows(spark, monkeypatch):
    from railyard.streaming import runner
    monkeypatch.setattr(runner, "FILE_ROWS", 10)
    log = spark.range(400).select("id", F.timestamp_seconds(F.col("id")).alias("ts"))
    path = sm.stage_files(log, "ts", 4, "t-grow", n_files=3)
    staged = spark.read.schema(log.schema).parquet(path)
    assert len(staged.inputFiles()) == 40 and sm.share_of_files(spark, path, 3) == 14
    assert sorted(r.id for r in staged.collect()) == list(range(400))
    whole = sm.stage_files(log, name="t-grow1", n_files=6)
    assert len(spark.read.parquet(whole).inputFiles()) == 40


def test_staging_and_draining_leave_no_copy_behind(spark):
    from railyard.session import checkpoint_root
    root = checkpoint_root(spark).removeprefix("file:")
    local = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
                 .localDirsString())

    def shuffled():
        return {f for top in local for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}

    def left(before):
        """Files are deleted behind the job, so a moment later."""
        until = time.time() + 10
        while (new := shuffled() - before) and time.time() < until:
            time.sleep(0.2)
        return new

    log = sm.with_end(b.timed_answers(spark, SF_TINY))
    n, before, known = log.count(), shuffled(), set(os.listdir(root))
    path = sm.stage_files(log, "ts", 4, "t-copy", n_files=3)
    assert not left(before)
    assert not [f for f in set(os.listdir(root)) - known if f.startswith("t-copy-all")]
    assert spark.read.parquet(path).count() == n
    s = sm.read_stream(spark, path, log.schema, max_files=sm.files_of_a_slice(spark, path))
    before = shuffled()
    out = sm.run_available(sm.stream_first_answer(s, ("request", "item"), "ts", "3 hours", "2 hours", ("attempt",)),
                           "t-copy")
    assert not left(before) and out.count() > 0


def test_slices_of_uneven_size_lose_no_row(spark, monkeypatch):
    """All but one row in the first slice, whose files go to two micro-batches
    at most: none of its rows is late."""
    from railyard.streaming import runner
    monkeypatch.setattr(runner, "FILE_ROWS", 10)
    data = [(i, k, 60 * i + 1800 * k) for i in range(300) for k in range(2)] + [(-1, 0, 10 ** 8)]
    log = sm.with_end(spark.createDataFrame(data, "request INT, attempt INT, s INT").select(
        "request", "attempt", F.timestamp_seconds("s").alias("ts")))
    path = sm.stage_files(log, "ts", 4, "t-skew", n_files=3, slice_rows=50)
    assert sm.files_of_a_slice(spark, path) == 5      # 13 slices of 5 files
    s, dropped = sm.read_stream(spark, path, log.schema, max_files=5), []
    out = sm.run_available(sm.stream_first_answer(s, ("request",), "ts", "10 minutes", "1 hour", ("attempt",)), "t-skew",
                           end=lambda: sm.stage_end(log, path, 4_300_000), ended=lambda q: dropped.append(sm.rows_dropped(q)))
    assert sorted((r.request, r.attempt, r.n_answers) for r in out.collect()) == \
        [(-1, 0, 1), *((i, 0, 2) for i in range(300))]
    assert not any(dropped)


def test_keys_that_share_a_bucket(spark, monkeypatch):
    import random

    from railyard.streaming import ordered
    rnd = random.Random(5)
    data = [(rnd.choice([*range(20), None]), rnd.randint(0, 5000), i, rnd.randint(0, 1)) for i in range(900)]
    e = spark.createDataFrame(data, "channel BIGINT, s INT, eid BIGINT, is_req INT").select(
        "channel", F.timestamp_seconds(F.col("s")).alias("ts"), "eid", "is_req")
    got = []
    for buckets in (1, 1024):                         # all events of a bucket in slots; in its value
        monkeypatch.setattr(ordered, "BUCKETS", buckets)
        log = sm.with_end(e)
        path = sm.stage_files(log, "ts", 4, "t-bucket", n_files=2)
        s = sm.read_stream(spark, path, log.schema, max_files=3)
        out = sm.run_available(sm.stream_match_responses(s, 60, "1 hour"), "t-bucket",
                               end=lambda: sm.stage_end(log, path, 3_700_000))
        got.append(sorted((tuple(r) for r in out.collect()), key=repr))
    waits, expect = {}, []
    for ch, at, eid, is_req in sorted(data, key=lambda r: (r[1], r[3], r[2])):
        queue = waits.setdefault(ch, [])
        while queue and queue[0][0] + 60 < at:
            expect.append((ch, queue.pop(0)[1], None, "timed_out"))
        if is_req:
            queue.append((at, eid))
        else:
            expect.append((ch, queue.pop(0)[1], eid, "matched") if queue else (ch, None, eid, "orphan"))
    expect += [(ch, eid, None, "timed_out") for ch, queue in waits.items() for _, eid in queue]
    assert got[0] == got[1]
    assert sorted(((r[0], r[1], r[3], r[5]) for r in got[0]), key=repr) == sorted(expect, key=repr)
