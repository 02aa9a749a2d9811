"""Ordered per-key rules: offset indexes, outstanding gauges, in-order chunk
acceptance, idle channels and retry settlement.

Running values go through ``segmented_scan`` so a hot key is split into
blocks; folds that carry richer state run as higher-order functions inside
the JVM per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railyard.operators.joinback import join_back
from railyard.operators.joins import fifo_scan
from railyard.operators.scan import segmented_scan, time_block
from railyard.session import stored


# --------------------------------------------------------------------------- WN1
def offset_index(df: DataFrame, group: Sequence[str], order: Sequence[Column | str],
                 size: Column | str, block: Column | None = None) -> DataFrame:
    """Running byte offsets per group: ``offset`` (sum of earlier sizes, 0 for
    the first entry), ``next_offset = offset + size`` and ``idx`` (0-based
    position).  Entry r spans ``[offset, next_offset)``; zero sizes are legal.
    ``block``: a column non-decreasing along ``order`` that splits hot groups."""
    s = F.col(size) if isinstance(size, str) else size
    out = segmented_scan(df.withColumn("__size", s.cast("bigint")), list(group), list(order),
                         {"__before": ("sum", F.col("__size")), "__pos": ("sum", F.lit(1))},
                         block=block, inclusive=False)
    return (out.withColumn("offset", F.coalesce(F.col("__before"), F.lit(0).cast("bigint")))
            .withColumn("next_offset", F.col("offset") + F.col("__size"))
            .withColumn("idx", F.coalesce(F.col("__pos"), F.lit(0)).cast("int"))
            .drop("__before", "__pos", "__size"))


# --------------------------------------------------------------------------- WN2
def outstanding_gauge(requests: DataFrame, responses: DataFrame, channel: str = "channel",
                      ts: str = "ts", rid: str = "id") -> DataFrame:
    """Open requests after every event of a channel (FIFO queue semantics:
    responses with nothing waiting do not go below zero).  Output:
    ``channel, ts, eid, is_req, outstanding, next_ts`` (time of the channel's
    next event, which ``idle_channels`` uses instead of a scan of its own)."""
    ev = fifo_scan(requests, responses, channel, ts, rid)
    return ev.select("channel", "ts", "eid", "is_req", "outstanding", "next_ts")


def gauge_with_streams(gauge: DataFrame, marks: DataFrame, channel: str = "channel", ts: str = "ts",
                       mid: str = "id", active: str = "active", block_unit: str = "day") -> DataFrame:
    """The gauge of a channel that also counts the stream it is receiving:
    a stream's response leaves the queue of waiting requests, but the channel
    stays busy by one until the stream's last byte.  ``marks``: one row when
    a stream starts to arrive (``active`` 1) and one when it ends (0); they
    come after a request or response of the same time.  Output as the gauge,
    without ``next_ts``; a mark's row has a null ``is_req``."""
    after = F.col("is_req").isNull().cast("int")
    rows = (gauge.select("channel", "ts", "eid", "is_req", "outstanding", F.lit(None).cast("int").alias("__on"))
            .unionByName(marks.select(
                F.col(channel).alias("channel"), F.col(ts).alias("ts"), F.col(mid).alias("eid"),
                F.lit(None).cast("int").alias("is_req"), F.lit(None).cast("bigint").alias("outstanding"),
                F.col(active).cast("int").alias("__on"))))
    rows = rows.withColumn("__after", after)
    waiting = F.when(F.col("__after") == 0, F.struct("ts", "is_req", "eid", "outstanding"))
    mark = F.when(F.col("__after") == 1, F.struct("ts", "eid", "__on"))
    out = segmented_scan(rows, ["channel"], ["ts", "__after", "is_req", "eid"],
                         {"__waiting": ("max", waiting), "__mark": ("max", mark)},
                         block=time_block("ts", block_unit))
    busy = F.coalesce(F.col("__waiting.outstanding"), F.lit(0)) + F.coalesce(F.col("__mark.__on"), F.lit(0))
    return out.select("channel", "ts", "eid", "is_req", busy.cast("bigint").alias("outstanding"))


def peak_outstanding(gauge: DataFrame) -> DataFrame:
    """Per channel: events seen, peak and final number of open requests."""
    return gauge.groupBy("channel").agg(
        F.count("*").alias("n_events"),
        F.max("outstanding").alias("peak"),
        F.max_by("outstanding", F.struct("ts", "is_req", "eid")).alias("final"))


# --------------------------------------------------------------------------- WN3
BLOCK_ROWS = 4096         # arrivals of a block where they are numbered


def _arrival_block(df: DataFrame, arrival: str) -> Column:
    """Blocks of a stream's arrivals by day, or by their number."""
    kind = df.schema[arrival].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return time_block(F.col(arrival).cast("timestamp"))
    return F.floor(F.col(arrival) / BLOCK_ROWS)


def _reached(start: DataFrame, links: DataFrame) -> DataFrame:
    """``id`` of all rows that lead from ``start`` (``id``) over ``links``
    (``id, next``), by pointer jumping: in each round what has been reached
    jumps, and the jumps double, so a chain of n links takes log2(n) rounds.
    A round is a pair of joins on row ids, which no stream's size skews."""
    reached, jumps = start, links
    while True:
        ahead = reached.join(jumps, "id").select(F.col("next").alias("id"))
        more = stored(ahead, "reached")
        if not more.limit(1).count():
            return reached
        reached = reached.unionByName(more)
        on = jumps.select(F.col("id").alias("next"), F.col("next").alias("beyond"))
        jumps = stored(jumps.join(on, "next").select("id", F.col("beyond").alias("next")), "jumps")


def in_order_prefix(df: DataFrame, stream: str, arrival: str, tiebreak: str, idx: str,
                    n_chunks: int | str, block: Column | None = None) -> DataFrame:
    """In-order chunk acceptance per stream.

    A request succeeds only when its index equals the next expected one
    (``accepted``); a wrong or null index fails without advancing
    (``out_of_order``); once the last chunk is served the stream is gone
    (``past_end``).  ``n_chunks`` is the number of chunks of every stream, or
    the name of a column that gives it (the same on all rows of a stream; a
    null count serves nothing).  A null stream is a stream of its own.

    Chunk 0 is accepted at its first arrival, and each further one at its
    first arrival after the one before it was accepted.  So every arrival of
    an index is linked to the next arrival of the index after it (a backward
    running minimum per stream and index, split into blocks of arrivals;
    ``block``: a column that does not decrease along the arrivals, by default
    the day or a range of ``arrival``), and what is accepted is what the first
    arrival of chunk 0 leads to: pointer jumping finds it in the logarithm of
    the number of chunks.  No task holds a stream.
    """
    count = F.col(n_chunks) if isinstance(n_chunks, str) else F.lit(int(n_chunks))
    whole = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])
    rows = stored(df.select(
        whole.alias("row"), F.monotonically_increasing_id().alias("id"), F.col(stream).alias("stream"),
        F.col(arrival).alias("at"), F.col(tiebreak).alias("tie"),
        F.coalesce(F.col(idx).cast("bigint"), F.lit(-1).cast("bigint")).alias("i"),
        F.coalesce(count.cast("bigint"), F.lit(0).cast("bigint")).alias("n"),
        (block if block is not None else _arrival_block(df, arrival)).alias("blk")), "arrivals")
    order = ["at", "tie", "id"]
    wanted = rows.filter("i >= 0 AND i < n").select("stream", "i", "n", "blk", *order)
    arrives = F.when(F.col("target"), F.struct(*order))
    turns = (wanted.withColumn("target", F.lit(True))
             .unionByName(wanted.filter("i + 1 < n").withColumn("i", F.col("i") + 1).withColumn("target", F.lit(False))))
    turns = segmented_scan(turns, ["stream", "i"], order, {"next": ("min", arrives)}, block="blk",
                           direction="backward", inclusive=False)
    links = stored(turns.filter("NOT target AND next IS NOT NULL").select("id", F.col("next.id").alias("next")), "links")
    first = (wanted.filter("i = 0").groupBy("stream").agg(F.min(F.struct(*order)).alias("first"))
             .select(F.col("first.id").alias("id")))
    accepted = _reached(stored(first, "first"), links).withColumn("accepted", F.lit(True))

    marked = stored(rows.join(accepted, "id", "left"), "marked")
    ends = (marked.filter("accepted AND i = n - 1").groupBy("stream").agg(F.min(F.struct(*order)).alias("end")))
    out = join_back(marked, ends, ["stream"])
    status = (F.when(F.col("n") <= 0, "past_end").when(F.col("accepted"), "accepted")
              .when(F.struct(*order) > F.col("end"), "past_end").otherwise("out_of_order"))
    return out.select("row.*", status.alias("status"))


# --------------------------------------------------------------------------- WN4
def idle_channels(gauge: DataFrame, timeout_seconds: float, as_of: Column,
                  close_idle: bool = False, block_unit: str = "day") -> DataFrame:
    """Idle-timeout verdict per channel from its traffic (``outstanding_gauge``
    rows: ``channel, ts, eid, is_req, outstanding``).

    The idle check fires every ``timeout`` of silence; it acts only if the
    last request is older than ``timeout`` at that moment — so after a
    response the first check can act, after a request only the second.
    Acting means ``dead`` if requests are still outstanding, otherwise
    ``idle_closed`` when idle connections are closed; the first action ends
    the channel.  Channels never acted on are ``alive`` (as of ``as_of``).

    The next event per row is a backward running minimum (segmented scan);
    the first verdict per channel a partial aggregate.
    """
    order = [F.col("ts"), F.col("is_req"), F.col("eid")]
    if "next_ts" in gauge.columns:
        g = gauge  # the gauge's own scan already found each row's next event
    else:
        g = segmented_scan(gauge, ["channel"], order, {"next_ts": ("min", F.col("ts"))},
                           block=time_block("ts", block_unit), direction="backward",
                           inclusive=False)
    t_us = int(round(timeout_seconds * 1_000_000))
    from railyard.functions import micros_between
    gap = micros_between(F.col("ts"), F.coalesce(F.col("next_ts"), as_of))
    checks = F.when(F.col("is_req") == 1, 2).otherwise(1).cast("bigint")
    wait_us = checks * F.lit(t_us).cast("bigint")
    fires = gap > wait_us
    verdict = F.when(F.col("outstanding") > 0, "dead")
    if close_idle:
        verdict = verdict.otherwise("idle_closed")
    act = F.struct(F.timestamp_add("MICROSECOND", wait_us, F.col("ts")).alias("at"),
                   F.col("eid").alias("after_eid"), verdict.alias("verdict"),
                   F.col("outstanding").alias("outstanding"))
    return (g.groupBy("channel").agg(F.min(F.when(fires & verdict.isNotNull(), act)).alias("v"))
            .select("channel", F.coalesce(F.col("v.verdict"), F.lit("alive")).alias("status"),
                    F.col("v.at").alias("closed_at"), F.col("v.outstanding").alias("outstanding")))


def activity_sessions(events: DataFrame, channel: str = "channel", ts: str = "ts",
                      tiebreak: str = "eid", timeout_seconds: float = 1800,
                      block_unit: str = "day") -> DataFrame:
    """Per-session form of the idle rule (batch): a channel's session ends
    after ``timeout_seconds`` of silence, like ``session_window(ts, timeout)``
    (a gap of at least the time-out starts a new session).  Output:
    ``channel, session_start, session_end (= last event + time-out),
    n_events, first_ts, last_ts``.

    One two-level pass instead of a per-channel sort: inside each
    ``(channel, time block)`` the previous event and a running count of
    session starts; one row per block (first/last event, starts after its
    first event); small windows over a channel's blocks decide whether each
    block's first event starts a session and how many sessions came before;
    then one aggregate per session.  The events are shuffled once: the block
    table reuses the same shuffle.
    """
    from railyard.functions import micros_between
    t_us = F.lit(int(round(timeout_seconds * 1_000_000))).cast("bigint")
    ev = events.select(F.col(channel).alias("channel"), F.col(ts).alias("ts"),
                       F.col(tiebreak).alias("eid"), time_block(F.col(ts), block_unit).alias("__blk"))
    w = Window.partitionBy("channel", "__blk").orderBy("ts", "eid")
    local = ev.select("*", F.lag("ts").over(w).alias("l_prev"))
    local = local.withColumn(
        "l_start", (F.col("l_prev").isNotNull()
                    & (micros_between(F.col("l_prev"), F.col("ts")) >= t_us)).cast("int"))
    local = local.select("*", F.sum("l_start").over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("l_starts"))

    blocks = local.groupBy("channel", "__blk").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.sum("l_start").alias("n_local"))
    wb = Window.partitionBy("channel").orderBy("__blk")
    before = wb.rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select("*", F.max("last_ts").over(before).alias("c_last"))
    carry = carry.withColumn(
        "first_start", (F.col("c_last").isNull()
                        | (micros_between(F.col("c_last"), F.col("first_ts")) >= t_us)).cast("int"))
    carry = carry.select(F.col("channel").alias("__cch"), F.col("__blk").alias("__cblk"),
                         "first_start",
                         F.sum(F.col("n_local") + F.col("first_start")).over(before)
                         .alias("c_sessions"))
    j = local.join(carry, local["channel"].eqNullSafe(carry["__cch"])
                   & local["__blk"].eqNullSafe(carry["__cblk"]), "left")
    session_no = (F.coalesce(F.col("c_sessions"), F.lit(0)) + F.col("first_start")
                  + F.col("l_starts"))
    return (j.groupBy("channel", session_no.alias("session_no"))
            .agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
                 F.count("*").alias("n_events"))
            .select("channel", F.col("first_ts").alias("session_start"),
                    F.timestamp_add("MICROSECOND", t_us, F.col("last_ts")).alias("session_end"),
                    "n_events", "first_ts", "last_ts"))


# --------------------------------------------------------------------------- WN5
def resolve_retries(attempts: DataFrame, request: str = "request", item: str = "item",
                    attempt: str = "attempt", seq: str = "seq", outcome: str = "outcome",
                    max_retries: int = 3) -> DataFrame:
    """Settle a retried multi-item fetch.

    ``attempts``: one row per answer — ``request, item, attempt, seq, outcome``
    with outcome ``ok`` / ``io_error`` / ``fatal``.  The retry budget is per
    request (``max_retries``).  Within the live attempt, in ``seq`` order:
    ``ok`` / ``fatal`` of an unsettled item is final; the first ``io_error``
    of an unsettled item with budget left starts the next attempt and every
    later answer of the current attempt is ignored (even successes); an
    ``io_error`` with no budget left is final (``failed_io``).  Answers for
    already settled items and for attempts that never became live are
    skipped, as are answers without a ``seq``; their items are listed.

    Output per ``(request, item)``: ``status`` (``ok`` / ``failed`` /
    ``failed_io`` / ``outstanding``), ``attempt_used`` and ``retries`` (per
    request).

    The log is reduced once, by partial aggregation, to a row per item with
    each attempt's first final answer and first ``io_error``, and written.
    Attempt ``a`` then needs the moments at which a request's earlier attempts
    were given up: a table of one row per request that each step joins to the
    items' columns it needs and aggregates into the next, ``max_retries``
    times.  Each is written, so that a task sorts the items of one join only,
    not those of all steps at a time.
    """
    att, out = F.col(attempt).cast("int"), F.col(outcome)
    kinds = ("ok", "fatal", "io_error")
    firsts = [F.min(F.when((att == a) & (out == kind), F.col(seq))).alias(f"{kind}{a}")
              for a in range(max_retries + 1) for kind in kinds]
    items = stored(attempts.groupBy(F.col(request).alias("req"), F.col(item).alias("item")).agg(*firsts), "retry-items")

    def at(a: int, kind: str) -> Column:
        return F.col(f"{kind}{a}")

    def first(a: int) -> Column:
        return F.least(at(a, "ok"), at(a, "fatal"))

    def gave_up(a: int) -> Column:
        return F.col(f"t{a}")

    def live(a: int) -> Column:
        return gave_up(a - 1).isNotNull() if a else F.lit(True)

    def settled(a: int) -> Column:
        return (live(a) & first(a).isNotNull()
                & F.coalesce(first(a) < gave_up(a), F.lit(True)))

    def with_moments(rows: DataFrame, moments: DataFrame | None) -> DataFrame:
        if moments is None:
            return rows
        moments = moments.withColumnRenamed("req", "__req")
        return rows.join(moments, F.col("req").eqNullSafe(F.col("__req")), "left").drop("__req")

    moments = None
    for a in range(max_retries):
        io = at(a, "io_error")
        open_ = live(a)
        for earlier in range(a):
            open_ = open_ & ~settled(earlier)
        starts = open_ & io.isNotNull() & F.coalesce(first(a) > io, F.lit(True))
        needed = items.select("req", *[f"{kind}{b}" for b in range(a + 1) for kind in kinds[:2]], f"io_error{a}")
        moments = stored(with_moments(needed, moments).groupBy("req").agg(
            *[F.min(f"t{b}").alias(f"t{b}") for b in range(a)], F.min(F.when(starts, io)).alias(f"t{a}")), "retry-moments")

    last = max_retries
    answers = [at(last, kind) for kind in ("fatal", "io_error", "ok")]
    ends = [F.when(settled(a), F.struct(F.when(at(a, "fatal") == first(a), "failed").otherwise("ok").alias("status"),
                                        F.lit(a).alias("att"))) for a in range(last)]
    ended = F.least(*answers)
    ends.append(F.when(live(last) & ended.isNotNull(), F.struct(
        F.when(answers[0] == ended, "failed").when(answers[1] == ended, "failed_io").otherwise("ok").alias("status"),
        F.lit(last).alias("att"))))
    retries = F.lit(0)
    for a in range(last):
        retries = retries + gave_up(a).isNotNull().cast("int")
    return (with_moments(items, moments).select("req", "item", F.coalesce(*ends).alias("end"), retries.alias("retries"))
            .select(F.col("req").alias(request), F.col("item").alias(item),
                    F.coalesce(F.col("end.status"), F.lit("outstanding")).alias("status"),
                    F.col("end.att").alias("attempt_used"), "retries"))
