"""Events of a key in time order, behind the watermark.

``InTimeOrder`` is a stateful processor that holds a key's events until the
watermark has passed them and then applies them in time order, however the
input was cut into files, Arrow chunks and micro-batches.  An event that comes
after the watermark has passed its time is given to ``late``, so it shows up in
the output instead of vanishing.

Every call of a state is a round trip between the Python worker and the JVM,
which costs far more than an event.  So keys share states: all keys of a bucket
(``BUCKETS`` of them, by hash) are handled together, their own states lie in one
value, which a batch reads once and writes once, and so do their waiting events
if they are few (``INLINE``).  More events wait in list states, one for each of a
ring of time slots.  A batch appends to the slots of its events and reads the
slots that hold due events only, one at a time in order of time; what a task
holds in memory is a slot of one bucket and its keys' own states, not the
bucket's whole wait.  Event-time timers wake a bucket that has no new input.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from railyard.session import ship_package
from railyard.streaming.runner import use_rocksdb_state, watermarked

SLOTS = 4
INLINE = 256              # waiting events of a bucket that stay in its value
BUCKETS = 1024
_BUCKET = "__bucket"
_NONE = -(1 << 62)        # no event, no timer


def null_last(value) -> tuple:
    """Sorts values and nulls of any type."""
    return (value is None, 0 if value is None else value)


class InTimeOrder(StatefulProcessor):
    """Base of processors; events are tuples that start with epoch
    microseconds (column ``us`` of the input rows)."""

    event_columns: tuple[str, ...] = ("us",)      # of the input, as held
    event_schema = "us BIGINT"
    own_schema = "n BIGINT"                       # of the key's own state, as held

    def __init__(self, delay_ms: int):
        # the ring spans twice the watermark's delay
        self.width = max(1, 2 * delay_ms // SLOTS) * 1000
        self.key_types: list[str] = []            # of the key's columns (``in_time_order``)

    # ---- for subclasses

    def rank(self, event: tuple):
        """Order of events; total, so that results do not depend on arrival."""
        return tuple(map(null_last, event))

    def load(self, saved):
        """The key's own state, handed to ``apply`` and ``settle``; ``saved`` is
        what ``save`` gave (null: nothing is held)."""

    def save(self, own):
        """A tuple of ``own_schema``, or null if there is nothing to hold."""

    def apply(self, key: tuple, event: tuple, own) -> Iterable[Row]:
        raise NotImplementedError

    def settle(self, key: tuple, own, applied: bool, wm_ms: int) -> tuple[Iterable[Row], int | None]:
        """After the due events: rows, and the micros that the watermark must
        pass for the key to be woken without an event."""
        return (), None

    def late(self, key: tuple, event: tuple) -> Row:
        raise NotImplementedError

    # ---- the processor

    def init(self, handle: StatefulProcessorHandle) -> None:
        key = ", ".join(f"k{i} {t}" for i, t in enumerate(self.key_types))
        event = f"key STRUCT<{key}>, event STRUCT<{self.event_schema}>"
        self._handle = handle
        self._slots = [handle.getListState(f"slot{i}", event) for i in range(SLOTS)]
        self._held = handle.getValueState("held", f"first ARRAY<BIGINT>, timer BIGINT, waiting ARRAY<STRUCT<{event}>>, "
                                          f"own ARRAY<STRUCT<key STRUCT<{key}>, wake BIGINT, "
                                          f"own STRUCT<{self.own_schema}>>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        wm = timerValues.getCurrentWatermarkInMs()
        names = [key_column(i) for i in range(len(self.key_types))]
        fresh: list[tuple] = []
        for r in rows:
            of, event = tuple(r[c] for c in names), tuple(r[c] for c in self.event_columns)
            if event[0] is None or event[0] // 1000 < wm:
                yield self.late(of, event)
            else:
                fresh.append((of, event))
        yield from self._drain(wm, fresh)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._drain(timerValues.getCurrentWatermarkInMs(), [], expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass

    def _in_order(self, held: Iterable) -> list[tuple]:
        """Keys and events in the order of events; that of different keys' equal
        events does not matter."""
        return sorted(((tuple(k), tuple(e)) for k, e in held), key=lambda x: self.rank(x[1]))

    def _put_by(self, events: list[tuple], first: list[int]) -> None:
        """Events into the slots; ``first``: the earliest time in each."""
        of: dict[int, list[tuple]] = {}
        for x in events:
            of.setdefault(x[1][0] // self.width % SLOTS, []).append(x)
        for slot, some in of.items():
            self._slots[slot].appendList(some)
            least = min(e[0] for _, e in some)
            first[slot] = least if first[slot] == _NONE else min(least, first[slot])

    def _due(self, first: list[int], wm: int) -> Iterator[tuple]:
        """Takes the due events out of the slots, in order."""
        while True:
            slot = min(range(SLOTS), key=lambda i: (first[i] == _NONE, first[i]))
            if first[slot] == _NONE or first[slot] // 1000 >= wm:
                return
            events = self._in_order(self._slots[slot].get())
            turn = events[0][1][0] // self.width
            n = next((i for i, (_, e) in enumerate(events) if e[0] // self.width != turn or e[0] // 1000 >= wm),
                     len(events))
            if n < len(events):
                self._slots[slot].put(events[n:])
                first[slot] = events[n][1][0]
            else:
                self._slots[slot].clear()
                first[slot] = _NONE
            yield from events[:n]

    def _drain(self, wm: int, fresh: list[tuple], fired: int = _NONE) -> Iterator[Row]:
        held = self._held.get()
        first, timer, waiting, saved = ((list(held[0]), held[1], [*held[2]], held[3]) if held else
                                        ([_NONE] * SLOTS, _NONE, [], []))
        if timer == fired:
            timer = _NONE
        waiting = self._in_order([*waiting, *fresh])
        if len(waiting) > INLINE or any(f != _NONE for f in first):
            self._put_by(waiting, first)              # one order for all: that of the slots
            waiting, due = [], self._due(first, wm)
        else:
            n = next((i for i, (_, e) in enumerate(waiting) if e[0] // 1000 >= wm), len(waiting))
            due, waiting = waiting[:n], waiting[n:]

        known = {tuple(k): (wake, None if own is None else tuple(own)) for k, wake, own in saved}
        touched: dict[tuple, object] = {}             # own states of keys with due events
        for key, event in due:
            if key not in touched:
                touched[key] = self.load(known.get(key, (None, None))[1])
            yield from self.apply(key, event, touched[key])
        applied = set(touched)
        for key, (wake, own) in known.items():
            if key not in touched and wake is not None and wake // 1000 + 1 <= wm:
                touched[key] = self.load(own)
        for key, own in touched.items():
            rows, wake = self.settle(key, own, key in applied, wm)
            yield from rows
            known[key] = (wake, self.save(own))

        times = [*first, *(e[0] for _, e in waiting[:1]), *(wake for wake, _ in known.values())]
        wake_at = min((t // 1000 + 1 for t in times if t is not None and t != _NONE), default=_NONE)
        if wake_at != timer:
            if timer != _NONE:
                self._handle.deleteTimer(timer)
            if wake_at != _NONE:
                self._handle.registerTimer(wake_at)
        saved = [(k, wake, own) for k, (wake, own) in known.items() if wake is not None or own is not None]
        if wake_at == _NONE and not saved:
            self._held.clear()
        else:
            self._held.update((first, wake_at, waiting, saved))


def key_column(i: int) -> str:
    return f"__key{i}"


def delay_ms(events: DataFrame, delay: str) -> int:
    """Milliseconds of an interval text."""
    spark = events.sparkSession
    at = F.timestamp_seconds(F.lit(0))
    return int(spark.range(1).select(F.unix_millis(at + F.expr(f"INTERVAL {delay}"))).first()[0])


def in_time_order(events: DataFrame, keys: list[str], ts: str, delay: str, processor: StatefulProcessor,
                  schema: StructType | str) -> DataFrame:
    """Run a processor over ``events`` with a watermark.  The time goes in as
    ``us`` (epoch microseconds), a plain number: so late rows reach the
    processor, which tells them apart itself."""
    spark = events.sparkSession
    ship_package(spark)
    use_rocksdb_state(spark)
    rows = watermarked(events, ts, delay).withColumn("us", F.unix_micros(ts))
    if not isinstance(processor, InTimeOrder):
        rows = rows.select(*keys, *[c for c in processor.event_columns if c not in keys])
        return rows.groupBy(*keys).transformWithState(processor, schema, "append", "eventTime")
    types = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    processor.key_types = [types[k] for k in keys]
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    rows = rows.select(bucket.alias(_BUCKET), *[F.col(k).alias(key_column(i)) for i, k in enumerate(keys)],
                       *processor.event_columns)
    return rows.groupBy(_BUCKET).transformWithState(processor, schema, "append", "eventTime")
