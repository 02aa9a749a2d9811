"""Matching rules: pairing responses with requests, handshakes, disconnect
fan-out, block resolution and outstanding-item difference.

None of these is a classic join kind; each is expressed with equi-joins,
aggregates and the skew-safe ``segmented_scan`` so no key ever has to fit one
task and no theta/cross join is emitted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railyard.operators.joinback import join_back
from railyard.operators.scan import segmented_scan, time_block


# --------------------------------------------------------------------------- JN2
def fifo_scan(requests: DataFrame, responses: DataFrame, channel: str, ts: str, rid: str,
              block_unit: str | None = "day") -> DataFrame:
    """Per-event FIFO queue walk shared by ``fifo_match``, ``outstanding_gauge``
    and ``idle_channels``.  One row per request (``is_req = 1``) or response
    with: ``s`` running (+1 request / -1 response) sum, ``prior_min`` the
    minimum of ``s`` before the row, ``orphan`` (a response that found the
    queue empty), ``outstanding`` (queue length after the row), ``k`` (the
    request's position, or the accepted response's position, per channel)
    and ``next_ts`` (time of the channel's next event).

    With ``S`` the running sum, a response is an orphan exactly when ``S``
    reaches a new minimum below zero, and the number of orphans so far is
    ``-min(0, min S)``.

    One two-level pass (see ``operators.scan``): the events are shuffled once
    by ``(channel, time block)``; a local stage computes the block-local
    running sums, the running minimum of the local sum and the next event
    inside the block; one row per block carries totals (sum, minimum of the
    local sum, first event time); three small windows over a channel's blocks
    give each block its carry-in, joined back on ``(channel, block)``.  Both
    consumers of the local stage share the same shuffle (window inputs are
    plain columns, so the subtrees below the exchange are identical).
    """
    cols = [F.col(channel).alias("channel"), F.col(ts).alias("ts"), F.col(rid).alias("eid")]
    ev = (requests.select(*cols, F.lit(1).alias("is_req"))
          .unionByName(responses.select(*cols, F.lit(0).alias("is_req"))))
    blk = time_block("ts", block_unit) if block_unit else F.lit(0).cast("timestamp")
    ev = ev.select("*", (F.col("is_req") * 2 - 1).alias("step"), blk.alias("__blk"))
    order = [F.col("ts"), F.col("is_req"), F.col("eid")]
    w = Window.partitionBy("channel", "__blk").orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ev.select("*", F.sum("step").over(run).alias("l_s"),
                      F.sum("is_req").over(run).alias("l_req"),
                      F.count(F.lit(1)).over(run).alias("l_cnt"),
                      F.lead("ts").over(w).alias("l_next"))
    local = local.select("*", F.min("l_s").over(
        w.rowsBetween(Window.unboundedPreceding, -1)).alias("l_min"))

    blocks = local.groupBy("channel", "__blk").agg(
        F.sum("step").alias("t_s"),
        F.max("l_req").alias("t_req"), F.max("l_cnt").alias("t_cnt"),
        F.min("l_s").alias("m_b"), F.min("ts").alias("first_ts"))
    wb = Window.partitionBy("channel").orderBy("__blk")
    before = wb.rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select("channel", "__blk", "m_b",
                          F.sum("t_s").over(before).alias("c_s"),
                          F.sum("t_req").over(before).alias("c_req"),
                          F.sum("t_cnt").over(before).alias("c_cnt"),
                          F.lead("first_ts").over(wb).alias("c_next"))
    carry = carry.select("channel", "__blk", "c_s", "c_req", "c_cnt", "c_next",
                         F.min(F.coalesce(F.col("c_s"), F.lit(0)) + F.col("m_b"))
                         .over(before).alias("c_min"))

    # null-safe keys: no filter is inferred on either side, so the subtree
    # under the events shuffle is identical for both consumers and AQE
    # reuses that one shuffle (null channels also stay as their own group)
    carry = carry.withColumnRenamed("channel", "__cch").withColumnRenamed("__blk", "__cblk")
    j = local.join(carry, (local["channel"].eqNullSafe(carry["__cch"]))
                   & (local["__blk"].eqNullSafe(carry["__cblk"])), "left")
    c_s = F.coalesce(F.col("c_s"), F.lit(0))
    s_ = c_s + F.col("l_s")
    n_req = F.coalesce(F.col("c_req"), F.lit(0)) + F.col("l_req")
    n_all = F.coalesce(F.col("c_cnt"), F.lit(0)) + F.col("l_cnt")
    prior_min = F.least(F.col("c_min"), c_s + F.col("l_min"))
    ev = j.select("channel", "ts", "eid", "is_req", s_.alias("s"), n_req.alias("n_req"),
                  (n_all - n_req).alias("n_resp"), prior_min.alias("prior_min"),
                  F.coalesce(F.col("l_next"), F.col("c_next")).alias("next_ts"))
    low = F.least(F.lit(0), F.col("prior_min"))
    depth = F.least(F.lit(0), F.col("s"), F.col("prior_min"))
    return (ev.withColumn("orphan", (F.col("is_req") == 0) & (F.col("s") < low))
            .withColumn("outstanding", F.col("s") - depth)
            .withColumn("k", F.when(F.col("is_req") == 1, F.col("n_req"))
                        .when(~F.col("orphan"), F.col("n_resp") + depth)))


def fifo_match(requests: DataFrame, responses: DataFrame, channel: str = "channel",
               ts: str = "ts", rid: str = "id", block_unit: str | None = "day") -> DataFrame:
    """First-in-first-out matching of keyless responses to requests.

    On each channel, every response takes the oldest request still waiting; a
    response that finds no waiting request is dropped (``orphan``).  Requests
    never answered stay ``outstanding``.

    Both inputs need columns ``channel``, ``ts`` and a unique tie-breaker ``rid``.
    Output: ``channel, req_id, req_ts, resp_id, resp_ts, status``.

    The k-th accepted response pairs with the k-th request (``fifo_scan``),
    so pairing is one aggregation over ``(channel, k)``: every group holds at
    most one request and one response; orphans form groups of their own.
    """
    ev = fifo_scan(requests, responses, channel, ts, rid, block_unit)
    req, resp = F.col("is_req") == 1, F.col("is_req") == 0
    # at most one request and one response per group, so per-field max is
    # exact and keeps this a hash aggregate (no struct buffers)
    g = (ev.groupBy("channel", F.when(F.col("orphan"), F.col("eid")).alias("__orphan"),
                    F.when(~F.col("orphan"), F.col("k")).alias("__k"))
         .agg(F.max(F.when(req, F.col("eid"))).alias("req_id"),
              F.max(F.when(req, F.col("ts"))).alias("req_ts"),
              F.max(F.when(resp, F.col("eid"))).alias("resp_id"),
              F.max(F.when(resp, F.col("ts"))).alias("resp_ts")))
    status = (F.when(F.col("req_id").isNull(), "orphan")
              .when(F.col("resp_id").isNull(), "outstanding").otherwise("matched"))
    return g.select("channel", "req_id", "req_ts", "resp_id", "resp_ts", status.alias("status"))


# --------------------------------------------------------------------------- JN1
def match_responses(requests: DataFrame, responses: DataFrame, keys: Sequence[str],
                    ts: str = "ts", rid: str = "id", outcome: str = "outcome") -> tuple[DataFrame, DataFrame]:
    """Pair keyed responses with requests (request keys unique).

    The first response at or after the request (by ``ts`` then ``rid``)
    consumes it; its ``outcome`` becomes the request status (e.g. ``ok`` /
    ``failed``); requests with none stay ``outstanding``.  Every other
    response is reported: ``early`` (before the request), ``late`` (after
    the consuming one) or ``unknown`` (no such request).

    Returns ``(requests_with_status, responses_with_disposition)``.  The
    "first response" is a partial aggregate (``min`` of a struct), so a hot
    key is combined on every task before the shuffle.
    """
    keys = list(keys)
    req = requests.select(*keys, F.col(ts).alias("req_ts"), F.col(rid).alias("req_id"))
    resp = responses.select(*keys, F.col(ts).alias("resp_ts"), F.col(rid).alias("resp_id"),
                            F.col(outcome).alias("outcome"))
    cand = resp.join(req, keys, "inner").filter(F.col("resp_ts") >= F.col("req_ts"))
    first = cand.groupBy(*keys).agg(
        F.min(F.struct("resp_ts", "resp_id", "outcome")).alias("first"))
    matched = (join_back(req, first, keys)
               .select(*keys, "req_id", "req_ts",
                       F.col("first.resp_id").alias("resp_id"),
                       F.col("first.resp_ts").alias("resp_ts"),
                       F.coalesce(F.col("first.outcome"), F.lit("outstanding")).alias("status")))
    disp = (resp.join(req, keys, "left")
            .join(first.select(*keys, F.col("first.resp_id").alias("__won")), keys, "left")
            .select(*keys, "resp_id", "resp_ts", "outcome",
                    F.when(F.col("req_id").isNull(), "unknown")
                    .when(F.col("resp_ts") < F.col("req_ts"), "early")
                    .when(F.col("resp_id") == F.col("__won"), "consumed")
                    .otherwise("late").alias("disposition")))
    return matched, disp


# --------------------------------------------------------------------------- JN3
def handshake(connections: DataFrame, hellos: DataFrame, pending: DataFrame,
              timeout_seconds: float, who: str = "secret", ts: str = "ts",
              rid: str = "id", block_unit: str = "day", messages: DataFrame | None = None) -> DataFrame:
    """Launcher handshake: each connection must receive a hello carrying a
    pending secret within ``timeout_seconds``; the first connection to do so
    consumes the secret.

    ``connections`` and ``hellos``: ``(who, ts, rid)``; ``pending``: one
    column ``who``; ``messages``: all other messages, as ``hellos``.  Status:
    ``timed_out`` (no message within the time-out, or a time-out <= 0),
    ``unexpected_message`` (the first message is no hello: an error that ends
    the connection and consumes nothing), ``unknown_secret``, ``duplicate``
    (secret already consumed by an earlier connection) or ``connected``.

    The next message after each connection is a backward running minimum
    (segmented scan, split by day) — no interval join, so no pairs are ever
    emitted; the per-secret "first" is a partial aggregate.
    """
    ev = (connections.select(F.col(who).alias("who"), F.col(ts).alias("ts"),
                             F.col(rid).alias("eid"), F.lit(0).alias("kind")))
    for kind, sent in ((1, hellos), (2, messages)):
        if sent is not None:
            ev = ev.unionByName(sent.select(F.col(who).alias("who"), F.col(ts).alias("ts"),
                                            F.col(rid).alias("eid"), F.lit(kind).alias("kind")))
    order = [F.col("ts"), F.col("kind"), F.col("eid")]
    message = F.when(F.col("kind") > 0, F.struct(F.col("ts").alias("h_ts"), F.col("kind").alias("h_kind"),
                                                 F.col("eid").alias("h_id")))
    ev = segmented_scan(ev, ["who"], order, {"nxt": ("min", message)},
                        block=time_block("ts", block_unit), direction="backward", inclusive=False)
    conns = ev.filter("kind = 0").select(
        "who", F.col("ts").alias("conn_ts"), F.col("eid").alias("conn_id"), F.col("nxt.h_ts").alias("hello_ts"),
        F.col("nxt.h_id").alias("hello_id"), F.col("nxt.h_kind").alias("__kind"))
    if timeout_seconds <= 0:
        in_time = F.lit(False)
    else:
        in_time = (F.col("hello_ts").isNotNull() &
                   (F.col("hello_ts") <= F.col("conn_ts") + F.make_interval(
                       secs=F.lit(float(timeout_seconds)))))
    is_hello = in_time & (F.col("__kind") == 1)
    conns = conns.withColumn("__other", in_time & (F.col("__kind") == 2)) \
                 .withColumn("hello_id", F.when(is_hello, F.col("hello_id"))) \
                 .withColumn("hello_ts", F.when(is_hello, F.col("hello_ts")))
    pend = pending.select(F.col(who).alias("who")).distinct().withColumn("__pending", F.lit(True))
    conns = conns.join(pend, "who", "left")
    eligible = conns.filter(F.col("hello_ts").isNotNull() & F.col("__pending"))
    winner = eligible.groupBy("who").agg(
        F.min(F.struct("hello_ts", "hello_id", "conn_ts", "conn_id")).alias("w"))
    out = join_back(conns, winner.select("who", F.col("w.conn_id").alias("__win")), ["who"])
    status = (F.when(F.col("__other"), "unexpected_message").when(F.col("hello_ts").isNull(), "timed_out")
              .when(F.col("__pending").isNull(), "unknown_secret")
              .when(F.col("conn_id") == F.col("__win"), "connected")
              .otherwise("duplicate"))
    return out.select("who", "conn_id", "conn_ts", "hello_id", "hello_ts", status.alias("status"))


# --------------------------------------------------------------------------- JN4
def fail_on_disconnect(requests: DataFrame, disconnects: DataFrame, channel: str = "channel",
                       include_streams: bool = False, block_unit: str = "day") -> DataFrame:
    """Fail requests that were still open when their channel disconnected.

    ``requests``: ``channel, req_id, req_ts, resp_ts, status, kind`` (kind in
    ``rpc``/``chunk``/``stream``); ``disconnects``: ``channel, ts, id`` and
    maybe ``cause``, which every request that it fails is given.
    A request fails with the first disconnect (by ``(ts, id)``) strictly after
    ``req_ts`` and before its response (or ever, if unanswered).  Queued ``stream`` requests
    survive a disconnect unless ``include_streams``.

    The "next disconnect" lookup is a backward running minimum over the union
    of both inputs per channel (segmented scan) — an as-of join without pairs.
    """
    r = requests.select("*", F.col(channel).alias("__ch"), F.col("req_ts").alias("__ts"),
                        F.col("req_id").alias("__id"), F.lit(1).alias("__is_req"))
    cause = F.col("cause") if "cause" in disconnects.columns else F.lit(None).cast("string")
    d = disconnects.select(F.col(channel).alias("__ch"), F.col("ts").alias("__ts"),
                           F.col("id").alias("__id"), F.lit(0).alias("__is_req"), cause.alias("__cause"))
    u = r.unionByName(d, allowMissingColumns=True)
    order = [F.col("__ts"), F.col("__is_req"), F.col("__id")]
    u = segmented_scan(u, ["__ch"], order,
                       {"__next": ("min", F.when(F.col("__is_req") == 0, F.struct("__ts", "__id", "__cause")))},
                       block=time_block("__ts", block_unit), direction="backward", inclusive=False)
    u = u.filter("__is_req = 1").withColumn("__nd", F.col("__next.__ts"))
    eligible = F.lit(True) if include_streams else (F.col("kind") != "stream")
    hit = (eligible & F.col("__nd").isNotNull() & (F.col("__nd") > F.col("req_ts")) &
           (F.col("resp_ts").isNull() | (F.col("__nd") < F.col("resp_ts"))))
    return u.select(*requests.columns,
                    F.when(hit, F.col("__nd")).alias("disconnect_ts"),
                    F.when(hit, F.col("__next.__cause")).alias("cause"),
                    F.when(hit, F.lit("failed_disconnect")).otherwise(F.col("status"))
                    .alias("final_status"))


# --------------------------------------------------------------------------- JN5
# Shuffle manager class names and how each lays out its files.
HASH_MANAGER = "org.apache.spark.shuffle.hash.HashShuffleManager"
SORT_MANAGERS = ("org.apache.spark.shuffle.sort.SortShuffleManager",
                 "org.apache.spark.shuffle.unsafe.UnsafeShuffleManager")


def _placed_path(dirs: Column, sub_dirs: Column, name: Column) -> Column:
    from railyard.functions import nonneg_hash
    from railyard.functions.exprs import once
    n = F.size(dirs)

    def placed(h: Column) -> Column:
        sub = F.floor(h / n) % sub_dirs
        return F.concat_ws("/", F.get(dirs, (h % n).cast("int")), F.lpad(F.lower(F.hex(sub)), 2, "0"), name)
    return once(nonneg_hash(name), placed)


def resolve_blocks(requests: DataFrame, registry: DataFrame, manifest: DataFrame) -> DataFrame:
    """Resolve block ids to ``(path, offset, length)``.

    ``requests``: ``app_id, exec_id, block_id`` (+ any columns, kept);
    ``registry``: ``app_id, exec_id, local_dirs, sub_dirs, manager`` (one row
    per executor); ``manifest``: ``app_id, exec_id, shuffle_id, map_id,
    reduce_id, offset, next_offset`` (from ``offset_index``): block ids repeat
    between applications, so the executor is part of the key.

    Hash layout: the block is its own file (offset 0, whole length); sort /
    unsafe layout: ``[offset[r], offset[r+1])`` of the map's data file.
    ``failure``: the block-id reason, ``unregistered_executor``,
    ``unsupported_manager`` or ``missing_index``.
    """
    from railyard.operators.projections import parse_block_ids
    p = parse_block_ids(requests, "block_id")
    reg = registry.select("app_id", "exec_id", "local_dirs", "sub_dirs", "manager",
                          F.lit(True).alias("__reg"))
    j = p.join(reg, ["app_id", "exec_id"], "left")
    man = manifest.select("app_id", "exec_id", "shuffle_id", "map_id", "reduce_id", "offset", "next_offset")
    # rejected ids (null parts) find nothing.  The numbers come first: rows are
    # sorted by a prefix of the first key, which is the same for all of an app
    j = j.join(man, ["map_id", "reduce_id", "shuffle_id", "exec_id", "app_id"], "left")
    is_hash = F.col("manager") == HASH_MANAGER
    is_sort = F.col("manager").isin(*SORT_MANAGERS)
    failure = (F.when(F.col("reject_reason").isNotNull(), F.col("reject_reason"))
               .when(F.col("__reg").isNull(), "unregistered_executor")
               .when(~(is_hash | is_sort), "unsupported_manager")
               .when(is_sort & F.col("offset").isNull(), "missing_index"))
    data_name = F.concat(F.lit("shuffle_"), F.col("shuffle_id").cast("string"), F.lit("_"),
                         F.col("map_id").cast("string"), F.lit("_0.data"))
    # one hash per row: hash layouts place the block's own file, sort layouts
    # the map's data file
    file_name = F.when(is_hash, F.col("block_id")).otherwise(data_name)
    path = _placed_path(F.col("local_dirs"), F.col("sub_dirs"), file_name)
    ok = failure.isNull()
    size = F.col("next_offset") - F.col("offset")
    return j.select(*requests.columns, "shuffle_id", "map_id", "reduce_id",
                    F.when(ok, path).alias("path"),
                    F.when(ok, F.when(is_hash, F.lit(0).cast("bigint")).otherwise(F.col("offset")))
                    .alias("offset"),
                    F.when(ok, size).alias("length"),
                    failure.alias("failure"))


# --------------------------------------------------------------------------- JN6
def outstanding_items(requested: DataFrame, answered: DataFrame, item: Sequence[str],
                      pos: Sequence[str]) -> DataFrame:
    """Requested items minus answered items, duplicates removed, first request
    position kept (``first_pos`` struct of the ``pos`` columns) so callers can
    order by it.  Dedup is a partial aggregate; the difference a left-anti
    join."""
    item = list(item)
    firsts = requested.groupBy(*item).agg(F.min(F.struct(*pos)).alias("first_pos"))
    return firsts.join(answered.select(*item).distinct(), item, "left_anti") \
                 .select(*item, *[F.col("first_pos." + p).alias("first_" + p) for p in pos])
