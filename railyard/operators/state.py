"""Keyed state driven by an event sequence — batch forms.

* ``registry_state``: last-write-wins executor registry where removing an app
  drops every executor of that app.
* ``lifecycle_state``: app state machine where final states absorb.

Both are partial aggregates plus equi-joins on the key, so no key's history
has to sit in one task.  Streaming forms live in ``railyard.streaming``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railyard.operators.joinback import join_back

# Application states; the last three are final.
APP_STATES = ["UNKNOWN", "CONNECTED", "SUBMITTED", "RUNNING", "FINISHED", "FAILED", "KILLED"]
FINAL_STATES = ["FINISHED", "FAILED", "KILLED"]


# --------------------------------------------------------------------------- ST1
def registry_state(events: DataFrame) -> DataFrame:
    """Live registry after all events.

    ``events``: ``app, exec, ts, eid, kind`` (``register`` / ``remove``) and
    ``info, local_dirs`` for registrations.  A registration upserts
    ``(app, exec)`` (last write wins); a removal deletes every executor of the
    app registered before it; a later registration revives the key.
    Output: ``app, exec, info, local_dirs, reg_ts``.
    """
    regs = (events.filter(F.col("kind") == "register")
            .groupBy("app", "exec")
            .agg(F.max(F.struct("ts", "eid", "info", "local_dirs")).alias("r")))
    rms = (events.filter(F.col("kind") == "remove").groupBy("app")
           .agg(F.max(F.struct("ts", "eid")).alias("rm")))
    live = join_back(regs, rms, ["app"]).filter(
        F.col("rm").isNull() | (F.struct(F.col("r.ts"), F.col("r.eid")) > F.col("rm")))
    return live.select("app", "exec", F.col("r.info").alias("info"),
                       F.col("r.local_dirs").alias("local_dirs"), F.col("r.ts").alias("reg_ts"))


# --------------------------------------------------------------------------- ST2
def lifecycle_transitions(events: DataFrame) -> DataFrame:
    """Per state-change event (``app, ts, eid, state``): ``applied`` or
    ``ignored`` — every change after the app's first final state is ignored
    (same-state updates before that still apply)."""
    ff = (events.filter(F.col("state").isin(*FINAL_STATES)).groupBy("app")
          .agg(F.min(F.struct("ts", "eid")).alias("ff")))
    j = join_back(events, ff, ["app"])
    ignored = F.col("ff").isNotNull() & (F.struct("ts", "eid") > F.col("ff"))
    return j.select(*events.columns,
                    F.when(ignored, "ignored").otherwise("applied").alias("disposition"))


def lifecycle_state(events: DataFrame) -> DataFrame:
    """Current state per app: the first final state if one was reached,
    otherwise the last state; plus counts of applied and ignored changes."""
    t = lifecycle_transitions(events)
    return (t.groupBy("app")
            .agg(F.max_by("state", F.when(F.col("disposition") == "applied",
                                          F.struct("ts", "eid"))).alias("state"),
                 F.sum(F.when(F.col("disposition") == "applied", 1).otherwise(0))
                 .cast("bigint").alias("n_applied"),
                 F.sum(F.when(F.col("disposition") == "ignored", 1).otherwise(0))
                 .cast("bigint").alias("n_ignored"))
            .withColumn("is_final", F.col("state").isin(*FINAL_STATES)))
