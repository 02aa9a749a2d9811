"""Property tests: the two-level (block-split) operators against direct
simulations on random inputs with ties, a hot key and many blocks."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from railyard.operators import joins as jn
from railyard.operators import windows as wn
from test_joins import simulate_fifo
from test_windows import simulate_in_order

T0 = dt.datetime(2024, 1, 1)

events_st = st.lists(
    st.tuples(st.sampled_from([0, 0, 0, 1, 2]),          # channel 0 is hot
              st.integers(0, 10 * 24 * 6),               # 10-minute slots over 10 days
              st.booleans()),
    min_size=1, max_size=120)

SETTINGS = settings(max_examples=12, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(events_st)
def test_fifo_match_matches_queue(spark, evs):
    rows = [(ch, T0 + dt.timedelta(minutes=10 * slot), i, is_req)
            for i, (ch, slot, is_req) in enumerate(evs)]
    schema = "channel INT, ts TIMESTAMP_NTZ, id INT"
    req = spark.createDataFrame([(c, t, i) for c, t, i, r in rows if r] or [], schema)
    resp = spark.createDataFrame([(c, t, i) for c, t, i, r in rows if not r] or [], schema)
    got = {}
    for r in jn.fifo_match(req, resp, "channel", "ts", "id").collect():
        if r["status"] == "orphan":
            got[("resp", r["resp_id"])] = "orphan"
        elif r["status"] == "matched":
            got[("req", r["req_id"])] = ("matched", r["resp_id"])
        else:
            got[("req", r["req_id"])] = "outstanding"
    assert got == simulate_fifo(rows)


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from([0, 0, 1]), st.integers(0, 6)), min_size=1,
                max_size=150), st.integers(1, 6))
def test_in_order_prefix_matches_fold(spark, reqs, n_chunks):
    rows = [(s, T0 + dt.timedelta(hours=5 * i), i, idx) for i, (s, idx) in enumerate(reqs)]
    df = spark.createDataFrame(rows, "s INT, ts TIMESTAMP_NTZ, id INT, idx INT")
    from railyard.operators.scan import time_block
    out = {r["id"]: r["status"] for r in
           wn.in_order_prefix(df, "s", "ts", "id", "idx", n_chunks,
                              block=time_block("ts", "day")).collect()}
    for s in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == s]
        assert [out[r[2]] for r in mine] == simulate_in_order([r[3] for r in mine], n_chunks)
