"""Column-expression builders (pure JVM-side expressions, no Python UDFs)."""

from railyard.functions.exprs import (
    java_string_hash,
    join_nonempty,
    json_int,
    micros_between,
    nonneg_hash,
    to_ts,
)

__all__ = [
    "java_string_hash",
    "join_nonempty",
    "json_int",
    "micros_between",
    "nonneg_hash",
    "to_ts",
]
