"""Aggregations: all-or-nothing groups, latency summaries, message census,
layered and typed settings.  All are ``groupBy().agg()`` with map-side partial
aggregation, so a hot group is pre-combined on every task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railyard.functions import micros_between


# --------------------------------------------------------------------------- AG2
def latency_summary(matched: DataFrame, peer: str = "channel", start: str = "req_ts",
                    end: str = "resp_ts", approx: bool = False,
                    accuracy: int = 10_000, blocks_per_doubling: int = 16) -> DataFrame:
    """Per peer: number of completed exchanges and their latency in
    microseconds (total, mean, median, min, max).  Rows without an ``end``
    are not completed and are skipped.

    The median is exact by default: exchanges are counted per peer and
    latency, the counts summed up along the latencies (a scan in blocks on a
    logarithmic scale, ``blocks_per_doubling`` each time the latency doubles,
    so a hot peer is spread over many tasks) and the middle one or two
    latencies picked.  ``approx=True`` uses ``percentile_approx``
    instead, a fixed-size sketch per peer and task.
    """
    from railyard.operators.joinback import join_back
    from railyard.operators.scan import segmented_scan
    lat = (matched.filter(F.col(end).isNotNull() & F.col(start).isNotNull())
           .select(F.col(peer).alias("peer"), micros_between(start, end).alias("lat_us")))
    c = F.lit(1) if approx else F.col("c")
    sums = [F.sum(c).cast("bigint").alias("n"), F.sum(c * F.col("lat_us")).alias("total_us"),
            F.max("lat_us").alias("max_us"), F.min("lat_us").alias("min_us")]
    if approx:
        out = lat.groupBy("peer").agg(*sums, F.percentile_approx("lat_us", 0.5, accuracy).cast("double").alias("p50_us"))
        return out.withColumn("avg_us", F.col("total_us") / F.col("n"))
    hist = lat.groupBy("peer", "lat_us").agg(F.count("*").alias("c"))
    counts = segmented_scan(hist, ["peer"], ["lat_us"], {"upto": ("sum", F.col("c"))},
                            block=F.floor(F.log2(F.greatest(F.col("lat_us"), F.lit(0)) + 1) * blocks_per_doubling))
    totals = hist.groupBy("peer").agg(*sums)
    keep = ["n", "total_us", "max_us", "min_us"]
    both = join_back(counts.select("peer", "lat_us", "upto"), totals, ["peer"])
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    out = both.groupBy("peer").agg(
        *[F.max(k).alias(k) for k in keep],
        F.min(F.when(F.col("upto") >= low, F.col("lat_us"))).alias("__low"),
        F.min(F.when(F.col("upto") >= high, F.col("lat_us"))).alias("__high"))
    return out.select("peer", *keep, ((F.col("__low") + F.col("__high")) / 2).alias("p50_us"),
                      (F.col("total_us") / F.col("n")).alias("avg_us"))


def connection_summary(connections: DataFrame, peer: str = "peer", start: str = "start_ts",
                       connected: str = "connected_ts", ready: str = "ready_ts", approx: bool = False) -> DataFrame:
    """Where the time to a usable connection goes: ``latency_summary`` per
    peer and ``phase``, ``connect`` (``start`` to ``connected``) and
    ``bootstrap`` (``connected`` to ``ready``).  A phase without an end is not
    counted: a connection whose bootstrap failed counts as a connect only."""
    def phase(name: str, begin: str, end: str) -> Column:
        return F.struct(F.lit(name).alias("phase"), F.col(begin).alias("begin"), F.col(end).alias("end"))
    rows = connections.select(F.col(peer).alias("peer"), F.explode(F.array(
        phase("connect", start, connected), phase("bootstrap", connected, ready))).alias("p"))
    out = latency_summary(rows.select(F.struct("peer", "p.phase").alias("of"), "p.begin", "p.end"),
                          "of", "begin", "end", approx)
    return out.select("peer.peer", "peer.phase", *[c for c in out.columns if c != "peer"])


# --------------------------------------------------------------------------- AG1
def all_or_nothing(items: DataFrame, group: Sequence[str], valid: Column | str, store: bool = False) -> DataFrame:
    """One bad item fails its whole group: adds ``group_ok`` (every item of the
    group valid) and ``status`` (``ok`` / ``failed``).  The group verdict is a
    partial aggregate joined back on the group key (AQE splits a hot group's
    join partition; the verdict side has one row per group).  ``store``: the
    items are costly to compute; they are written once, and the verdict reads
    the group and validity of the written table."""
    group = list(group)
    v = F.col(valid) if isinstance(valid, str) else valid
    tagged = items.withColumn("__valid", F.coalesce(v, F.lit(False)))
    if store:
        from railyard.session import stored
        tagged = stored(tagged, "items")
    verdict = tagged.groupBy(*group).agg(F.bool_and("__valid").alias("group_ok"))
    from railyard.operators.joinback import join_back
    return (join_back(tagged, verdict, group).drop("__valid")
            .withColumn("status", F.when(F.col("group_ok"), "ok").otherwise("failed")))


# --------------------------------------------------------------------------- AG3
# Per message type, the type-specific header bytes beyond the
# 8-byte frame length and 1-byte type, which strings it carries, and whether
# its body travels inside the frame.
#   type            fixed  strings            body
#   ChunkFetchRequest   12  -                  none
#   ChunkFetchSuccess   12  -                  in frame
#   ChunkFetchFailure   12  error              none
#   RpcRequest          12  -                  in frame
#   RpcResponse         12  -                  in frame
#   RpcFailure           8  error              none
#   StreamRequest        0  stream id          none
#   StreamResponse       8  stream id          outside frame
#   StreamFailure        0  stream id, error   none
#   OneWayMessage        4  -                  in frame
# Each string costs 4 bytes of length plus its UTF-8 bytes.
MESSAGE_LAYOUT = {
    "ChunkFetchRequest": (12, False, False, "none"),
    "ChunkFetchSuccess": (12, False, False, "in_frame"),
    "ChunkFetchFailure": (12, False, True, "none"),
    "RpcRequest": (12, False, False, "in_frame"),
    "RpcResponse": (12, False, False, "in_frame"),
    "RpcFailure": (8, False, True, "none"),
    "StreamRequest": (0, True, False, "none"),
    "StreamResponse": (8, True, False, "outside_frame"),
    "StreamFailure": (0, True, True, "none"),
    "OneWayMessage": (4, False, False, "in_frame"),
}
FRAME_PREFIX_BYTES = 8 + 1


def message_census(messages: DataFrame, spark=None) -> DataFrame:
    """Per decoded message type: count, header bytes, body bytes and frame
    bytes.  ``messages``: ``type_name, stream_id, body`` where ``body`` is the
    payload (or, for failure types, the error text).  Header = 8 + 1 + the
    type's fields; a frame carries the body only when it is "in frame"."""
    m = messages.filter(F.col("type_name").isin(*MESSAGE_LAYOUT))
    # the fixed layout is looked up in literal maps: lengths are taken where
    # the rows are read and nothing wide is joined
    for k, name in enumerate(["fixed", "has_sid", "has_err", "body_mode"]):
        m = m.withColumn(name, F.create_map(*[F.lit(x) for t, v in MESSAGE_LAYOUT.items()
                                              for x in (t, v[k])])[F.col("type_name")])
    # a null field is an empty one
    blen = F.coalesce(F.octet_length("body"), F.lit(0)).cast("bigint")
    hdr = (F.lit(FRAME_PREFIX_BYTES) + F.col("fixed")
           + F.when(F.col("has_sid"), 4 + F.coalesce(F.octet_length("stream_id"), F.lit(0))).otherwise(0)
           + F.when(F.col("has_err"), 4 + blen).otherwise(0)).cast("bigint")
    body = F.when(F.col("body_mode") != "none", blen).otherwise(F.lit(0).cast("bigint"))
    frame = hdr + F.when(F.col("body_mode") == "in_frame", blen).otherwise(F.lit(0).cast("bigint"))
    return (m.select("type_name", hdr.alias("h"), body.alias("b"), frame.alias("f"))
            .groupBy("type_name")
            .agg(F.count("*").alias("n"), F.sum("h").alias("header_bytes"),
                 F.sum("b").alias("body_bytes"), F.sum("f").alias("frame_bytes")))


# --------------------------------------------------------------------------- AG4
def layered_settings(layers: DataFrame, mode: str = "present", key: str = "key",
                     value: str = "value", layer: str = "layer", rank: str = "rank") -> DataFrame:
    """Effective setting per key from layered sources: the layer with the
    lowest ``rank`` that has the key wins.  ``mode='present'``: a key counts
    as present even with an empty value (map merge); ``mode='non_empty'``:
    null and empty values are skipped (first-non-empty chain).  Keys with no
    qualifying layer are absent.  ``min_by`` is a partial aggregate."""
    if mode == "present":
        cand = layers.filter(F.col(value).isNotNull())
    elif mode == "non_empty":
        cand = layers.filter(F.col(value).isNotNull() & (F.col(value) != ""))
    else:
        raise ValueError("mode must be 'present' or 'non_empty'")
    win = cand.groupBy(key).agg(
        F.min_by(F.struct(F.col(value).alias("value"), F.col(layer).alias("layer")),
                 F.col(rank)).alias("w"))
    return win.select(key, F.col("w.value").alias("value"), F.col("w.layer").alias("layer"))


# Fixed grammar of numbers in settings: sign and digits; decimals may have
# a fraction, an exponent, a type letter, or be a named value.
_WHOLE = r"^[+-]?[0-9]+$"
_DECIMAL = r"^[+-]?(?:NaN|Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)[dDfF]?$"


def typed_settings(settings: DataFrame, kind: str, default=None, key: str = "key",
                   value: str = "value") -> DataFrame:
    """Settings read as ``kind`` (``boolean``, ``int``, ``bigint`` or
    ``double``): ``typed`` beside the other columns, and ``reject_reason``.

    A null value (a key that no layer sets) takes ``default``.  A boolean is
    true if it spells ``true`` in any case, otherwise false.  A number that is
    malformed or out of range is an error (``bad_<kind>``, ``typed`` null),
    never the default; white space is allowed around a double only."""
    if kind not in ("boolean", "int", "bigint", "double"):
        raise ValueError("kind must be 'boolean', 'int', 'bigint' or 'double'")
    v = F.col(value)
    if kind == "boolean":
        parsed = F.lower(v) == "true"
    elif kind == "double":
        v = F.regexp_replace(v, r"^[\x00-\x20]+|[\x00-\x20]+\z", "")
        parsed = F.when(v.rlike(_DECIMAL), F.regexp_replace(v, r"(?<=[0-9.])[dDfF]$|(?<=NaN|ity)[dDfF]$", "")).try_cast("double")
    else:
        parsed = F.when(v.rlike(_WHOLE), v).try_cast(kind)
    bad = v.isNotNull() & parsed.isNull()
    return settings.select(
        "*", F.when(v.isNull(), F.lit(default).cast(kind)).otherwise(parsed).alias("typed"),
        F.when(bad, F.lit(f"bad_{kind}")).alias("reject_reason"))
