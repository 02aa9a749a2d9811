"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_32 = 4294967296


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def java_string_hash(c: Column | str) -> Column:
    """Java's ``String.hashCode``: fold ``h = 31*h + unit`` over the UTF-16
    units (a character beyond the BMP is two) with 32-bit wrap, returned as a
    signed 32-bit value (BIGINT column)."""
    def step(h, x):
        over = x - 0x10000
        pair = (h * 31 + F.shiftright(over, 10) + 0xD800) * 31 + over.bitwiseAND(F.lit(0x3FF)) + 0xDC00
        return F.when(x < 0x10000, h * 31 + x).otherwise(pair).bitwiseAND(F.lit(_TWO_32 - 1))

    unsigned = F.aggregate(
        F.transform(F.split(_c(c), ""), lambda ch: F.ascii(ch).cast("bigint")),
        F.lit(0).cast("bigint"), step)
    return once(unsigned, lambda u: F.when(u >= 2**31, u - _TWO_32).otherwise(u))


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, not at each mention."""
    return F.transform(F.array(value), use)[0]


def nonneg_hash(c: Column | str) -> Column:
    """Absolute value of ``java_string_hash`` in 64 bits (so the one value
    whose 32-bit absolute value overflows stays non-negative)."""
    return F.abs(java_string_hash(c))


def json_int(c: Column | str, field: str) -> Column:
    """Integer field of a JSON object held in a string column (null if absent
    or not an integer)."""
    return F.get_json_object(_c(c), f"$.{field}").try_cast("int")


def join_nonempty(sep: str, *cols: Column | str) -> Column:
    """Concatenate the parts that are neither null nor empty, separated by
    ``sep`` (no leading, trailing or doubled separator)."""
    return F.concat_ws(sep, *[F.nullif(_c(c), F.lit("")) for c in cols])


def to_ts(c: Column | str) -> Column:
    """``TIMESTAMP_NTZ`` → ``TIMESTAMP`` (session time zone is UTC)."""
    return _c(c).cast("timestamp")


def micros_between(start: Column | str, end: Column | str) -> Column:
    """``end - start`` in whole microseconds (BIGINT), for NTZ or LTZ input
    (no time-zone conversion, so DST changes cannot shift it)."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end))
