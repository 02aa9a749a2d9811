"""Joining an aggregate back onto the rows it was computed from."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_back(rows: DataFrame, agg: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """``rows`` joined with ``agg`` on ``keys`` using null-safe equality.

    When ``agg`` is derived from ``rows`` (a per-key verdict, first event,
    winner …), a plain equi-join makes Catalyst infer ``IS NOT NULL`` filters
    into one side only, so the two copies of the shared input stop being
    identical and none of its shuffles can be reused.  Null-safe keys infer
    nothing, the shared subtree stays identical, and AQE serves the second
    consumer from the first one's shuffle.  (Rows with a null key also meet
    their own group's aggregate, which is what a ``groupBy`` produced.)
    """
    keys = list(keys)
    r = agg.select(*[F.col(k).alias("__jb_" + k) for k in keys],
                   *[c for c in agg.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(r["__jb_" + k]) for k in keys])
    return rows.join(r, cond, how).drop(*["__jb_" + k for k in keys])
