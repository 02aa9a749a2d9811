"""Array-valued rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railyard.operators.scan import segmented_scan, time_block


# --------------------------------------------------------------------------- ARR1
def removed_dirs(events: DataFrame, block_unit: str = "day") -> DataFrame:
    """Directories to clean when apps are removed (listed, never deleted).

    ``events`` as for ``registry_state`` plus a boolean ``cleanup`` on
    removals.  A removal lists every local dir of every executor of the app
    that is live at that moment (registered after the previous removal), and
    only when ``cleanup`` is on; a repeated removal lists nothing.

    Each registration finds the next removal of its app with a backward
    running minimum (segmented scan per app), so the pairing never emits
    pairs; the dirs of the executor's latest registration before that
    removal come from a partial aggregate.
    Output: ``app, exec, removal_id, removal_ts, dir``.
    """
    u = events.select("app", "exec", "ts", "eid", "kind", "local_dirs", "cleanup",
                      F.when(F.col("kind") == "register", 0).otherwise(1).alias("__k"))
    rm = F.when(F.col("kind") == "remove",
                F.struct(F.col("ts").alias("ts"), F.col("eid").alias("eid"),
                         F.col("cleanup").alias("cleanup")))
    u = segmented_scan(u, ["app"], [F.col("ts"), F.col("__k"), F.col("eid")],
                       {"next_rm": ("min", rm)}, block=time_block("ts", block_unit),
                       direction="backward", inclusive=False)
    regs = u.filter((F.col("kind") == "register") & F.col("next_rm").isNotNull()
                    & F.col("next_rm.cleanup"))
    last = (regs.groupBy("app", "exec", F.col("next_rm.eid").alias("removal_id"),
                         F.col("next_rm.ts").alias("removal_ts"))
            .agg(F.max_by("local_dirs", F.struct("ts", "eid")).alias("dirs")))
    return last.select("app", "exec", "removal_id", "removal_ts", F.explode("dirs").alias("dir"))
