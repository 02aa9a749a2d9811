import datetime as dt

from conftest import rows
from railyard.operators import arrays as ar
from railyard.operators import state as stt

T0 = dt.datetime(2024, 1, 1)


def t(s):
    return T0 + dt.timedelta(seconds=s)


SCHEMA = ("app INT, exec INT, ts TIMESTAMP, eid INT, kind STRING, info INT, "
          "local_dirs ARRAY<STRING>, cleanup BOOLEAN")


def reg(app, ex, s, eid, info):
    return (app, ex, t(s), eid, "register", info, [f"/d{info}", f"/e{info}"], None)


def rm(app, s, eid, cleanup):
    return (app, None, t(s), eid, "remove", None, None, cleanup)


def test_registry_state_last_write_wins_and_app_removal(spark):
    ev = spark.createDataFrame([
        reg(1, 10, 0, 1, 1), reg(1, 10, 5, 2, 2),      # upsert: info 2 wins
        reg(1, 11, 6, 3, 3), rm(1, 7, 4, True),         # removal drops both
        reg(1, 11, 8, 5, 4),                            # re-register revives 11 only
        reg(2, 20, 1, 6, 5), rm(3, 2, 7, True),         # other apps untouched
    ], SCHEMA)
    got = rows(stt.registry_state(ev), "app", "exec", "info")
    assert got == [(1, 11, 4), (2, 20, 5)]


def test_removed_dirs(spark):
    ev = spark.createDataFrame([
        reg(1, 10, 0, 1, 1), reg(1, 11, 1, 2, 2), rm(1, 2, 3, True),
        rm(1, 3, 4, True),                              # repeated removal lists nothing
        reg(1, 10, 4, 5, 3), rm(1, 5, 6, False),        # cleanup off lists nothing
        reg(1, 12, 6, 7, 4), reg(1, 12, 7, 8, 5), rm(1, 9, 9, True),
    ], SCHEMA)
    got = rows(ar.removed_dirs(ev), "removal_id", "exec", "dir")
    assert got == [(3, 10, "/d1"), (3, 10, "/e1"), (3, 11, "/d2"), (3, 11, "/e2"),
                   (9, 12, "/d5"), (9, 12, "/e5")]


def test_lifecycle_final_states_absorb(spark):
    ev = spark.createDataFrame([
        (1, t(0), 1, "SUBMITTED"), (1, t(1), 2, "RUNNING"), (1, t(2), 3, "RUNNING"),
        (1, t(3), 4, "FINISHED"), (1, t(4), 5, "RUNNING"), (1, t(5), 6, "FAILED"),
        (2, t(0), 7, "CONNECTED"), (2, t(1), 8, "RUNNING"),
    ], "app INT, ts TIMESTAMP, eid INT, state STRING")
    got = rows(stt.lifecycle_state(ev), "app", "state", "is_final", "n_applied", "n_ignored")
    assert got == [(1, "FINISHED", True, 4, 2), (2, "RUNNING", False, 2, 0)]
    tr = rows(stt.lifecycle_transitions(ev), "eid", "disposition")
    assert [d for _, d in tr] == ["applied"] * 4 + ["ignored"] * 2 + ["applied"] * 2
