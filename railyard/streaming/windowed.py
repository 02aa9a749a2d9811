"""Streaming forms built from Spark's own stateful operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railyard.streaming.runner import END, watermarked


# --------------------------------------------------------------------------- ST3
def stream_timed_join(requests: DataFrame, responses: DataFrame, keys=("id",), timeout: str = "1 day",
                      delay: str = "1 hour") -> DataFrame:
    """Responses matched to requests by unique keys, as a stream-stream full
    outer join.

    ``requests``: ``keys, req_ts``; ``responses``: ``keys, resp_ts``; other
    columns are kept.  A response answers its request if it comes at or after
    it and within ``timeout``.  Both sides carry a watermark, so the time
    range bounds the state: once the watermark has passed what a row could
    still match, the row goes out with nulls on the other side, a request as
    ``timed_out``, a response as ``orphan``.  Null keys match nothing.
    """
    keys = list(keys)
    left = watermarked(requests, "req_ts", delay)
    right = watermarked(responses, "resp_ts", delay).withColumnsRenamed({k: f"__{k}" for k in keys})
    cond = F.expr(f"resp_ts >= req_ts AND resp_ts <= req_ts + INTERVAL {timeout}")
    for k in keys:
        cond = cond & (left[k] == right[f"__{k}"])
    status = (F.when(F.col("resp_ts").isNull(), "timed_out").when(F.col("req_ts").isNull(), "orphan")
              .otherwise("matched"))
    out = left.join(right, cond, "full_outer")
    rest = [c for c in out.columns if c not in keys and c not in {f"__{k}" for k in keys}]
    return out.select(*[F.coalesce(F.col(k), F.col(f"__{k}")).alias(k) for k in keys], *rest, status.alias("status"))


# --------------------------------------------------------------------------- ST4
def stream_idle_sessions(events: DataFrame, channel: str = "channel", ts: str = "ts",
                         timeout: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Activity sessions per channel: a session closes after ``timeout`` of
    silence (the live form of the idle check).  Append mode emits a session
    once the watermark (max event time − ``delay``) passes its end."""
    return (watermarked(events, ts, delay)
            .groupBy(F.col(channel).alias("channel"), F.session_window(ts, timeout).alias("session"))
            .agg(F.count("*").alias("n_events"), F.min(ts).alias("first_ts"),
                 F.max(ts).alias("last_ts"))
            .select("channel", F.col("session.start").alias("session_start"),
                    F.col("session.end").alias("session_end"), "n_events", "first_ts", "last_ts"))


# --------------------------------------------------------------------------- ST5
def stream_first_answer(answers: DataFrame, keys=("request", "item"), ts: str = "ts",
                        delay: str = "1 hour", lifetime: str = "1 hour", order=()) -> DataFrame:
    """The first answer of each ``(request, item)`` by ``(ts, *order)`` (then
    by all other columns), with the number of answers ``n_answers``.  Answers
    no further apart than ``lifetime`` are of one request; it is reported
    once the watermark has passed the last of them by ``lifetime``, so the
    result does not depend on the order of arrival."""
    keys, order = list(keys), list(order)
    rest = [c for c in answers.columns if c not in (*keys, ts, *order, END)]
    return (watermarked(answers, ts, delay).groupBy(*keys, F.session_window(ts, lifetime).alias("__w"))
            .agg(F.min(F.struct(ts, *order, *rest)).alias("__first"), F.count("*").alias("n_answers"))
            .select(*keys, "__first.*", "n_answers"))


def stream_report_once(answers: DataFrame, keys=("request", "item"), ts: str = "ts",
                       within: str = "1 hour") -> DataFrame:
    """Each ``(request, item)`` reported at once, by the answer that arrives
    first; later answers are dropped.  A key is remembered until the watermark
    (latest event time less ``within``) has passed its first answer, so
    answers up to ``within`` apart count as one report."""
    return watermarked(answers, ts, within).dropDuplicatesWithinWatermark(list(keys))


# --------------------------------------------------------------------------- ST7
def listener_sink(changes: DataFrame, fn, checkpoint: str):
    """Deliver every micro-batch of state changes to a user callback
    ``fn(batch_df, batch_id)`` (``foreachBatch``).  Returns the running
    query; the callback is the listener."""
    from railyard.streaming.runner import use_rocksdb_state
    use_rocksdb_state(changes.sparkSession)
    return (changes.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
