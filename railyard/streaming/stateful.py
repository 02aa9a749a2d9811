"""Structured Streaming forms of the keyed-state rules.

Custom state goes through ``transformWithState``: list, map and value states
in RocksDB, event-time timers, one entry read or written at a time.  Rules that
depend on the order of events derive from ``InTimeOrder``.  Rows that come
after the watermark are part of the output (see ``late_events``).
"""

from __future__ import annotations

import datetime as dt
from collections import deque

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from railyard.operators.state import FINAL_STATES
from railyard.session import ship_package
from railyard.streaming.ordered import InTimeOrder, delay_ms, in_time_order
from railyard.streaming.runner import use_rocksdb_state

_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def _ts(us: int | None):
    return None if us is None else _EPOCH + dt.timedelta(microseconds=us)


# --------------------------------------------------------------------------- ST1
REGISTRY_OUT = ("app BIGINT, exec BIGINT, info INT, local_dirs ARRAY<STRING>, reg_ts TIMESTAMP, "
                "live BOOLEAN, version BIGINT")


class _Registry(StatefulProcessor):
    """Map state: an entry per live executor of the app; the app's latest
    removal and a counter of changes beside it."""

    def init(self, handle) -> None:
        self._execs = handle.getMapState("execs", "exec STRING", "us BIGINT, eid BIGINT, info INT, "
                                         "local_dirs ARRAY<STRING>")
        self._app = handle.getValueState("app", "us BIGINT, eid BIGINT, version BIGINT")

    def handleInputRows(self, key, rows, timerValues):
        app = self._app.get()
        mark, version = ((app[0], app[1]) if app and app[0] is not None else None, app[2] if app else 0)
        newest: dict = {}                             # per executor of this batch
        removal = mark
        for r in rows:
            at = (r.us, r.eid)
            if r.kind != "register":
                removal = at if removal is None else max(removal, at)
            elif r.exec not in newest or at > newest[r.exec][0]:
                newest[r.exec] = (at, r.info, r.local_dirs)
        changed: dict = {}
        if removal != mark:                           # the app's executors up to the removal go
            gone = [(k[0], v) for k, v in self._execs.iterator() if (v[0], v[1]) <= removal]
            for name, v in gone:
                self._execs.removeKey((name,))
                changed[int(name) if name else None] = ((v[0], v[1]), v[2], v[3], False)
        for exec_, (at, info, dirs) in newest.items():
            name = ("" if exec_ is None else str(exec_),)
            if removal is not None and at <= removal:
                continue
            old = self._execs.getValue(name) if self._execs.containsKey(name) else None
            if old is None or at > (old[0], old[1]):
                self._execs.updateValue(name, (*at, info, dirs))
                changed[exec_] = (at, info, dirs, True)
        if not changed and removal == mark:
            return
        version += 1
        self._app.update((*(removal or (None, None)), version))
        for exec_, (at, info, dirs, live) in changed.items():
            yield Row(app=key[0], exec=exec_, info=info, local_dirs=dirs, reg_ts=_ts(at[0]), live=live,
                      version=version)

    def close(self) -> None:
        pass


def stream_registry_state(events: DataFrame) -> DataFrame:
    """Registry changes: whenever a micro-batch changes an executor of an app,
    one row with its latest registration and whether it is live; a removal
    gives a row for each executor it ends.  Upserts and removals are merged by
    ``(ts, eid)``, so arrival order does not matter, and an executor that a
    removal has ended needs no state any more: whatever is older than the
    removal is dead.  Keyed by app because a removal ends all its executors."""
    spark = events.sparkSession
    ship_package(spark)
    use_rocksdb_state(spark)
    rows = events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).drop("ts").filter("us IS NOT NULL")
    return rows.groupBy("app").transformWithState(_Registry(), REGISTRY_OUT, "append", "none")


def registry_from_changes(changes: DataFrame) -> DataFrame:
    """Current registry from the change rows: the last change of each
    executor, if it left it live."""
    last = changes.groupBy("app", "exec").agg(F.max_by(F.struct("info", "local_dirs", "reg_ts", "live"),
                                                       "version").alias("c"))
    return last.filter("c.live").select("app", "exec", "c.info", "c.local_dirs", "c.reg_ts")


# --------------------------------------------------------------------------- ST2
LIFECYCLE_OUT = ("app BIGINT, state STRING, is_final BOOLEAN, n_applied BIGINT, n_ignored BIGINT, "
                 "version BIGINT, late_ts TIMESTAMP, late_eid BIGINT")
TRANSITION_OUT = "app BIGINT, ts TIMESTAMP, eid BIGINT, state STRING, change STRING"
LATE = "late"


class _Lifecycle(InTimeOrder):
    """Final states absorb.  ``own``: state, final, applied, ignored, version."""

    event_columns = ("us", "eid", "state", "info")
    event_schema = "us BIGINT, eid BIGINT, state STRING, info STRING"
    own_schema = "state STRING, final BOOLEAN, applied BIGINT, ignored BIGINT, version BIGINT"

    def load(self, saved):
        return list(saved) if saved else ["UNKNOWN", False, 0, 0, 0]

    def save(self, own):
        return tuple(own) if own[4] else None

    def apply(self, key, event, own):
        us, eid, new, info = event
        if info is not None:                          # told after a final state, too
            yield from self.told(key, us, eid, own[0], "info_changed")
        if new is None:
            return
        if own[1]:
            own[3] += 1
            return
        own[0], own[1] = new, new in FINAL_STATES
        own[2] += 1
        yield from self.told(key, us, eid, new, "state_changed")

    def settle(self, key, own, applied, wm_ms):
        if applied:
            own[4] += 1
        return self.current(key, own) if applied else (), None

    def told(self, key, us, eid, state, change):
        return ()

    def current(self, key, own):
        return [Row(app=key[0], state=own[0], is_final=own[1], n_applied=own[2], n_ignored=own[3], version=own[4],
                    late_ts=None, late_eid=None)]

    def late(self, key, event):
        return Row(app=key[0], state=event[2], is_final=None, n_applied=None, n_ignored=None, version=None,
                   late_ts=_ts(event[0]), late_eid=event[1])


class _Told(_Lifecycle):
    def told(self, key, us, eid, state, change):
        return [Row(app=key[0], ts=_ts(us), eid=eid, state=state, change=change)]

    def current(self, key, own):
        return ()

    def late(self, key, event):
        return Row(app=key[0], ts=_ts(event[0]), eid=event[1], state=event[2], change=LATE)


def _with_info(events: DataFrame) -> DataFrame:
    return events if "info" in events.columns else events.withColumn("info", F.lit(None).cast("string"))


def stream_lifecycle_state(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Per app, whenever events of it fall due: current state, whether it is
    final, applied and ignored changes.  Final states absorb.  An event is
    applied once the watermark (latest event time less ``watermark``) has
    passed it, in ``(ts, eid)`` order.  One that comes later than that is not
    applied but given back with ``late_eid`` (``late_events``)."""
    return in_time_order(_with_info(events), ["app"], "ts", watermark, _Lifecycle(delay_ms(events, watermark)),
                         LIFECYCLE_OUT)


def lifecycle_from_changes(changes: DataFrame) -> DataFrame:
    """Each app's last version."""
    now = changes.filter("version IS NOT NULL").drop("late_ts", "late_eid")
    last = now.groupBy("app").agg(F.max("version").alias("version"))
    return now.join(last, ["app", "version"], "inner").drop("version")


def stream_state_changes(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """What a state listener is told, one row per change: ``state_changed``
    for an applied transition (ignored ones are dropped), ``info_changed`` for
    an event whose ``info`` (if there is such a column) is not null, also
    after a final state; an event may be both.  Taken in ``(ts, eid)`` order
    as in ``stream_lifecycle_state``; ``late`` for events that came too late
    to be applied."""
    return in_time_order(_with_info(events), ["app"], "ts", watermark, _Told(delay_ms(events, watermark)),
                         TRANSITION_OUT)


# --------------------------------------------------------------------------- ST3
MATCH_OUT = ("req_id BIGINT, req_ts TIMESTAMP, resp_id BIGINT, resp_ts TIMESTAMP, status STRING")


class _Match(InTimeOrder):
    """``own``: the requests that wait, oldest first."""

    event_columns = ("us", "is_req", "eid")
    event_schema = "us BIGINT, is_req INT, eid BIGINT"
    own_schema = "queue ARRAY<STRUCT<us BIGINT, eid BIGINT>>"

    def __init__(self, wait_ms: int, keys: list[str], timeout_us: int):
        super().__init__(wait_ms)
        self._keys, self._timeout = keys, timeout_us

    def load(self, saved):
        return deque(map(tuple, saved[0])) if saved else deque()

    def save(self, own):
        return ([*own],) if own else None

    def _row(self, key, req, resp, status):
        return Row(**dict(zip(self._keys, key, strict=True)), req_id=req and req[1], req_ts=req and _ts(req[0]),
                   resp_id=resp and resp[1], resp_ts=resp and _ts(resp[0]), status=status)

    def _give_up(self, key, own, now_us):
        while own and own[0][0] + self._timeout < now_us:
            yield self._row(key, own.popleft(), None, "timed_out")

    def apply(self, key, event, own):
        us, is_req, eid = event
        yield from self._give_up(key, own, us)
        if is_req == 1:
            own.append((us, eid))
        elif own:
            yield self._row(key, own.popleft(), (us, eid), "matched")
        else:
            yield self._row(key, None, (us, eid), "orphan")

    def settle(self, key, own, applied, wm_ms):
        rows = list(self._give_up(key, own, wm_ms * 1000))
        return rows, own[0][0] + self._timeout if own else None

    def late(self, key, event):
        us, is_req, eid = event
        return self._row(key, (us, eid) if is_req == 1 else None, None if is_req == 1 else (us, eid), LATE)


def stream_match_responses(events: DataFrame, timeout_seconds: float, watermark: str = "1 day",
                           keys=("channel",)) -> DataFrame:
    """Response matching with a give-up time.

    ``events``: ``keys, ts, eid, is_req`` (1 request / 0 response).  A
    response answers the oldest request still waiting under its keys; a
    request not answered within ``timeout_seconds`` is given up
    (``timed_out``) and no longer waits; a response finding nothing waiting
    is an ``orphan``.  Keys ``(channel,)`` match first in, first out;
    ``(channel, correlation id)`` match by id.  Events are taken in ``(ts,
    is_req, eid)`` order once the watermark has passed them (``late``: they
    came after that, and are not matched); give-ups with no later traffic are
    emitted when it passes their deadline.  Keys that are null form one key of
    their own.
    """
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", " + MATCH_OUT
    rows = events.withColumn("is_req", F.col("is_req").cast("int"))
    return in_time_order(rows, keys, "ts", watermark,
                         _Match(delay_ms(events, watermark), keys, int(round(timeout_seconds * 1_000_000))), schema)


# --------------------------------------------------------------------------- ST4
VERDICT_OUT = "status STRING, closed_at TIMESTAMP, outstanding BIGINT"


class _Idle(InTimeOrder):
    """``own``: micros and kind of the last event, requests outstanding after
    it, whether the channel has ended."""

    event_columns = ("us", "is_req", "eid")
    event_schema = "us BIGINT, is_req INT, eid BIGINT"
    own_schema = "us BIGINT, is_req INT, outstanding BIGINT, ended BOOLEAN"

    def __init__(self, wait_ms: int, channel: str, timeout_us: int, close_idle: bool):
        super().__init__(wait_ms)
        self._channel, self._timeout, self._close_idle = channel, timeout_us, close_idle

    def load(self, saved):
        return list(saved) if saved else [None, None, 0, False]

    def save(self, own):
        return None if own[0] is None else tuple(own)

    def _deadline(self, own):
        """When the idle check acts on the last event; null if it never does."""
        us, is_req, outstanding, ended = own
        if us is None or ended or not (outstanding or self._close_idle):
            return None
        return us + self._timeout * (2 if is_req == 1 else 1)

    def _check(self, key, own, now_us):
        at = self._deadline(own)
        if at is not None and at < now_us:
            own[3] = True
            yield Row(**{self._channel: key[0]}, status="dead" if own[2] else "idle_closed", closed_at=_ts(at),
                      outstanding=own[2])

    def apply(self, key, event, own):
        us, is_req, _ = event
        yield from self._check(key, own, us)
        if not own[3]:
            own[0], own[1], own[2] = us, is_req, own[2] + 1 if is_req == 1 else max(0, own[2] - 1)

    def settle(self, key, own, applied, wm_ms):
        rows = list(self._check(key, own, wm_ms * 1000))
        return rows, self._deadline(own)

    def late(self, key, event):
        return Row(**{self._channel: key[0]}, status=LATE, closed_at=_ts(event[0]), outstanding=None)


def stream_idle_verdicts(events: DataFrame, timeout_seconds: float, watermark: str = "1 hour",
                         close_idle: bool = False, channel: str = "channel") -> DataFrame:
    """Idle-timeout verdicts as they fall: ``channel, status, closed_at,
    outstanding``.

    ``events``: ``channel, ts, eid, is_req`` (1 request / 0 response).  The
    check fires after every ``timeout_seconds`` of silence and acts if the
    last request is older than that: after a response on the first check,
    after a request on the second.  Then the channel is ``dead`` if requests
    are outstanding, else ``idle_closed`` if idle channels are closed.  The
    first verdict ends the channel.  An event-time timer per channel gives the
    verdict of a channel that has fallen silent; a channel without a row is
    alive.  ``late`` (``closed_at``: its time) for an event that came after
    the watermark had passed it.
    """
    types = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    rows = events.withColumn("is_req", F.col("is_req").cast("int"))
    return in_time_order(rows, [channel], "ts", watermark,
                         _Idle(delay_ms(events, watermark), channel, int(round(timeout_seconds * 1_000_000)), close_idle),
                         f"`{channel}` {types[channel]}, {VERDICT_OUT}")


# --------------------------------------------------------------------------- ST6
REASSEMBLY_OUT = "stream_id BIGINT, chunk_idx BIGINT, bytes_read BIGINT, event STRING"


class _Reassembly(StatefulProcessor):
    """Value state: what has been read, the next index, how the stream ended,
    how many pieces wait; map state: their sizes."""

    event_columns = ("us", "chunk_idx", "n_bytes", "expected_bytes")

    def __init__(self, idle_ms: int | None, first_idx: int):
        self._idle, self._first = idle_ms, first_idx

    def init(self, handle) -> None:
        self._handle = handle
        self._read = handle.getValueState("read", "n BIGINT, next BIGINT, ended STRING, waiting BIGINT, timer BIGINT")
        self._ahead = handle.getMapState("ahead", "idx BIGINT", "n BIGINT")

    def handleInputRows(self, key, rows, timerValues):
        wm = timerValues.getCurrentWatermarkInMs() if self._idle else 0
        held = self._read.get()
        read, turn, ended, waiting, timer = held if held else (0, self._first, None, 0, None)
        expected, last, sizes = None, None, {}
        for r in rows:
            if self._idle and (r.us is None or r.us // 1000 < wm):
                yield Row(stream_id=key[0], chunk_idx=r.chunk_idx, bytes_read=None, event=LATE)
                continue
            expected = r.expected_bytes
            last = r.us if last is None else max(last, r.us)
            if r.chunk_idx is not None and r.chunk_idx >= turn:
                sizes.setdefault(r.chunk_idx, r.n_bytes)
        if last is None:
            return
        while True:
            n = sizes.pop(turn, None)
            if waiting and self._ahead.containsKey((turn,)):
                n = self._ahead.getValue((turn,))[0]          # it came first
                self._ahead.removeKey((turn,))
                waiting -= 1
            if n is None:
                break
            read += n
            yield Row(stream_id=key[0], chunk_idx=turn, bytes_read=read, event="data")
            turn += 1
            now = ended
            if read == expected and ended is None:
                now = "complete"
            elif expected is not None and read > expected and ended != "overrun":
                now = "overrun"
            if now != ended:
                ended = now
                yield Row(stream_id=key[0], chunk_idx=None, bytes_read=read, event=ended)
        for idx, n in sizes.items():
            if not self._ahead.containsKey((idx,)):
                self._ahead.updateValue((idx,), (n,))
                waiting += 1
        if self._idle:
            due = max(timer or 0, last // 1000 + self._idle + 1)
            if due != timer:
                if timer is not None:
                    self._handle.deleteTimer(timer)
                self._handle.registerTimer(due)
                timer = due
        self._read.update((read, turn, ended, waiting, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self._read.get()
        if not held or held[4] != expiredTimerInfo.getExpiryTimeInMs():
            return                                            # pieces came in this batch
        self._read.clear()
        self._ahead.clear()
        if held[2] is None:
            yield Row(stream_id=key[0], chunk_idx=None, bytes_read=held[0], event="incomplete")

    def close(self) -> None:
        pass


def stream_reassemble(chunks: DataFrame, idle_timeout: str | None = None, watermark: str = "1 hour",
                      first_idx: int = 0) -> DataFrame:
    """Incremental reassembly: ``data`` per piece (with the running byte
    count), then ``complete`` once the announced byte count is reached,
    ``overrun`` if a piece goes past it, and ``incomplete`` when the watermark
    passes the stream's last piece by ``idle_timeout`` before it has ended.
    Then the stream's state is removed, whichever way it ended; a piece that
    is older than the watermark is given back as ``late``.  Without a time-out
    (no ``ts`` needed) state is kept for ever.

    ``chunks``: ``stream_id, chunk_idx, body, expected_bytes`` and ``ts`` (the
    announcement joined on, e.g. a stream-static join).  Pieces are numbered
    from ``first_idx`` and read in that order whatever order they arrive in:
    a piece that is ahead waits (its size is kept, not its body) until those
    before it are there; one that comes twice is read once.
    """
    sized = chunks.withColumn("n_bytes", F.coalesce(F.octet_length("body"), F.lit(0)).cast("bigint")).drop("body")
    if idle_timeout:
        return in_time_order(sized, ["stream_id"], "ts", watermark,
                             _Reassembly(delay_ms(chunks, idle_timeout), first_idx), REASSEMBLY_OUT)
    spark = chunks.sparkSession
    ship_package(spark)
    use_rocksdb_state(spark)
    return (sized.withColumn("us", F.lit(0).cast("bigint")).groupBy("stream_id")
            .transformWithState(_Reassembly(None, first_idx), REASSEMBLY_OUT, "append", "none"))


# --------------------------------------------------------------------------- late rows
def late_events(changes: DataFrame) -> DataFrame:
    """The rows of a stream's output that stand for events which came after
    the watermark had passed them; count them to see what was not applied."""
    if "late_eid" in changes.columns:
        return changes.filter("version IS NULL").select("app", F.col("late_ts").alias("ts"),
                                                        F.col("late_eid").alias("eid"), "state")
    kind = next(c for c in ("change", "status", "event") if c in changes.columns)
    return changes.filter(F.col(kind) == LATE)
