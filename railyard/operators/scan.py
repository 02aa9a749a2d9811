"""Skew-safe ordered scans per key.

Many rules in this library are order-dependent per key (a channel, a stream, an
order): running sums, running minima, "next occurrence after this row".  The
plain form is ``agg(...).over(Window.partitionBy(key).orderBy(...))``, which
sends every row of a key to one task — a key holding a third of all rows would
make one task hold a third of the data.

``segmented_scan`` computes the same values in two levels:

1. a local window per ``(key, block)``, where ``block`` is any column that is
   non-decreasing along the ordering inside a key (typically a time bucket), so
   a hot key is spread over as many tasks as it has blocks;
2. one aggregate row per ``(key, block)`` of the same values — Catalyst
   computes it straight from the input with map-side partial aggregation, so
   only partial results move — then a small window over the blocks of a key
   gives each block the carry-in of everything before (or after) it;
3. a null-safe equi-join on ``(key, block)`` adds the carry-in back.  The big
   side is already hash-partitioned on ``(key, block)`` by step 1, so only the
   small block table moves; AQE may broadcast it once its measured size is
   small.

Chained scans that pass the *name* of an existing block column reuse the first
scan's ``(key, block)`` partitioning for their windows.  Operators whose
chained quantities depend on each other in order (the FIFO walk, activity
sessions) use a dedicated single pass instead, so the rows are shuffled once.

Supported monoids: ``sum``, ``min``, ``max`` (``min``/``max`` also work on
structs, which gives "first/last row with a property" lookups).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def _towards(direction: str, order: Sequence[Column | str]) -> list[Column | str]:
    """The order a scan walks in.  A backward scan walks the reversed order with
    a frame that grows, as Spark computes a frame that ends at the last row anew
    for every row, which is quadratic in the rows of a window."""
    if direction == "forward":
        return list(order)
    if direction == "backward":
        return [(F.col(o) if isinstance(o, str) else o).desc() for o in order]
    raise ValueError(f"direction must be 'forward' or 'backward', got {direction!r}")


def _combine(kind: str, carry: Column, local: Column) -> Column:
    if kind == "sum":
        return F.when(carry.isNull() & local.isNull(), F.lit(None)).otherwise(
            F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0)))
    # least / greatest skip nulls
    return F.least(carry, local) if kind == "min" else F.greatest(carry, local)


def segmented_scan(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                   aggs: dict[str, tuple[str, Column]], block: Column | str | None = None,
                   direction: str = "forward", inclusive: bool = True) -> DataFrame:
    """Add one column per entry of ``aggs`` = ``{name: (kind, expr)}`` holding
    ``kind(expr)`` over the rows of the same key that come before (forward) or
    after (backward) each row in ``order``; ``inclusive`` adds the row itself.

    ``order`` must be a total order inside a key (add a tie-breaker column) of
    plain columns, which sort upwards with nulls first.
    ``block`` must be non-decreasing along ``order`` inside a key; ``None``
    falls back to one window per key (fine for keys known to be small).  Pass
    the *name* of a block column already in ``df`` to chain scans: the rows
    stay hash-partitioned by ``(keys, block)`` from the first scan, so later
    scans' windows over the same keys and block need no new shuffle.
    """
    keys = list(keys)
    walk = _towards(direction, order)
    lo, hi = Window.unboundedPreceding, Window.currentRow if inclusive else -1
    if block is None:
        w = Window.partitionBy(*keys).orderBy(*walk).rowsBetween(lo, hi)
        return df.select("*", *[_AGG[k](e).over(w).alias(n) for n, (k, e) in aggs.items()])

    if isinstance(block, str):
        blk, tagged = block, df
    else:
        blk, tagged = "__blk", df.withColumn("__blk", block)
    w_local = Window.partitionBy(*keys, blk).orderBy(*walk).rowsBetween(lo, hi)
    local = tagged.select("*", *[_AGG[k](e).over(w_local).alias("__l_" + n)
                                 for n, (k, e) in aggs.items()])

    # Block totals come from the windowed rows, which are already clustered
    # by (keys, block): a plain aggregate, no second shuffle of the input.
    totals = local.groupBy(*keys, blk).agg(*[_AGG[k](e).alias("__t_" + n)
                                             for n, (k, e) in aggs.items()])
    w_blk = Window.partitionBy(*keys).orderBy(*_towards(direction, [blk])).rowsBetween(
        Window.unboundedPreceding, -1)
    carry = totals.select(*[F.col(k).alias("__ck_" + k) for k in keys],
                          F.col(blk).alias("__ck_blk"),
                          *[_AGG[k](F.col("__t_" + n)).over(w_blk).alias("__c_" + n)
                            for n, (k, _) in aggs.items()])

    # null-safe keys: no not-null filter is inferred into either input, so
    # identical subtrees (and their shuffles) stay reusable across consumers
    cond = local[blk].eqNullSafe(carry["__ck_blk"])
    for k in keys:
        cond = cond & local[k].eqNullSafe(carry["__ck_" + k])
    joined = local.join(carry, cond, how="left")
    return joined.select(
        *[F.col(c) for c in tagged.columns if c != "__blk"],
        *[_combine(k, F.col("__c_" + n), F.col("__l_" + n)).alias(n) for n, (k, _) in aggs.items()])


def time_block(ts: Column | str, unit: str = "day") -> Column:
    """Block column for ``segmented_scan`` when the order starts with a timestamp."""
    return F.date_trunc(unit, F.col(ts) if isinstance(ts, str) else ts)
