"""Row-local rules: block-id parsing, hash placement, non-empty joins, message
type decoding, tenant isolation and frame-size guards.

All are projections/filters over built-in expressions (whole-stage codegen),
except the join against a type dictionary and the one against the owner table,
both plain equi-joins whose strategy the planner/AQE picks from sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from railyard.functions import java_string_hash

# ---------------------------------------------------------------- fixed values
# Transport message types: id -> name.  -1 ("User") exists but cannot be decoded.
MESSAGE_TYPES = [
    (0, "ChunkFetchRequest"), (1, "ChunkFetchSuccess"), (2, "ChunkFetchFailure"),
    (3, "RpcRequest"), (4, "RpcResponse"), (5, "RpcFailure"),
    (6, "StreamRequest"), (7, "StreamResponse"), (8, "StreamFailure"),
    (9, "OneWayMessage"),
]
USER_MESSAGE_TYPE = -1
# Shuffle-service (block transfer) message types: id -> name.
BLOCK_TRANSFER_TYPES = [
    (0, "OPEN_BLOCK"), (1, "UPLOAD_BLOCK"), (2, "REGISTER_EXECUTOR"),
    (3, "STREAM_HANDLE"), (4, "REGISTER_DRIVER"),
]
# Frame length field: 8 bytes, counted in the declared length; the payload must
# be positive and below 2^31 - 1.
FRAME_LENGTH_SIZE = 8
MAX_FRAME_SIZE = 2**31 - 1


def dictionary(spark: SparkSession, which: str = "message") -> DataFrame:
    """The fixed id -> name dictionary as a tiny DataFrame."""
    rows = MESSAGE_TYPES if which == "message" else BLOCK_TRANSFER_TYPES
    return spark.createDataFrame(rows, "type_id INT, type_name STRING")


# --------------------------------------------------------------------------- PRJ1
_INT_RE = r"^[+-]?[0-9]+$"


def parse_block_ids(df: DataFrame, col: str = "block_id") -> DataFrame:
    """Parse ``shuffle_{shuffle}_{map}_{reduce}`` ids.

    Adds ``shuffle_id, map_id, reduce_id`` (INT) and ``reject_reason``:
    ``bad_block_id`` (fewer than four parts), ``bad_shuffle_id`` (first part
    is not ``shuffle``), ``non_int`` (a numeric part is not a 32-bit integer),
    null when valid.  Parts after the fourth are ignored; trailing empty parts
    do not count (split semantics of the original rule).
    """
    parts = F.split(F.regexp_replace(F.col(col), "_+$", ""), "_")
    raw = [F.get(parts, i) for i in (1, 2, 3)]
    nums = [F.when(p.rlike(_INT_RE), p.try_cast("int")) for p in raw]
    reason = (F.when(F.size(parts) < 4, "bad_block_id")
              .when(F.get(parts, 0) != "shuffle", "bad_shuffle_id")
              .when(nums[0].isNull() | nums[1].isNull() | nums[2].isNull(), "non_int"))
    ok = reason.isNull()
    return df.select("*",
                     F.when(ok, nums[0]).alias("shuffle_id"),
                     F.when(ok, nums[1]).alias("map_id"),
                     F.when(ok, nums[2]).alias("reduce_id"),
                     reason.alias("reject_reason"))


# --------------------------------------------------------------------------- PRJ2
def place_by_hash(df: DataFrame, key: str, n_dirs: int, n_sub: int) -> DataFrame:
    """Directory placement of a file name: ``h`` = non-negative string hash,
    ``dir_id = h % n_dirs``, ``sub_id = (h / n_dirs) % n_sub`` and the
    sub-directory name as two lower-case hex digits."""
    h = F.abs(java_string_hash(key))
    return (df.withColumn("h", h)
            .withColumn("dir_id", (F.col("h") % n_dirs).cast("int"))
            .withColumn("sub_id", ((F.col("h") / F.lit(n_dirs)).cast("bigint") % n_sub).cast("int"))
            .withColumn("sub_dir", F.lpad(F.lower(F.hex("sub_id")), 2, "0")))


# --------------------------------------------------------------------------- PRJ4
def decode_message_type(df: DataFrame, id_col: str, dictionary: DataFrame | str = "message") -> DataFrame:
    """Map type ids to names.  Unknown ids get ``reject_reason =
    'unknown_type'``; ``-1`` gets ``'user_type'`` (it exists but cannot be
    decoded).  ``dictionary``: ``'message'`` or ``'block'`` for the fixed ones,
    looked up in a literal map, so the rows are neither joined nor shuffled;
    or a table ``type_id, type_name``, left-joined as the planner sees fit."""
    if isinstance(dictionary, str):
        names = MESSAGE_TYPES if dictionary == "message" else BLOCK_TRANSFER_TYPES
        known = F.create_map(*[F.lit(x) for pair in names for x in pair])
        out = df.withColumn("type_name", F.try_element_at(known, F.col(id_col).cast("int")))
    else:
        d = dictionary.select(F.col("type_id").alias("__tid"), "type_name")
        out = df.join(d, F.col(id_col) == F.col("__tid"), "left").drop("__tid")
    return out.withColumn(
        "reject_reason",
        F.when(F.col("type_name").isNotNull(), F.lit(None).cast("string"))
        .when(F.col(id_col) == USER_MESSAGE_TYPE, "user_type")
        .otherwise("unknown_type"))


# --------------------------------------------------------------------------- FLT1
def tenant_isolation(requests: DataFrame, owners: DataFrame, stream: str = "stream_id",
                     client: str = "client_id", owner: str = "owner_app") -> DataFrame:
    """Authorise each request for a stream: ``authorized`` when the client id
    is null or empty (no check is made, the stream may be unknown) or equals
    the owner app; ``unknown_stream`` when the stream has no owner row;
    otherwise ``denied``.  ``owners`` must hold one row per stream."""
    o = owners.select(F.col(stream).alias("__sid"), F.col(owner).alias(owner))
    j = requests.join(o, F.col(stream) == F.col("__sid"), "left")
    status = (F.when(F.col(client).isNull() | (F.col(client) == ""), "authorized")
              .when(F.col("__sid").isNull(), "unknown_stream")
              .when(F.col(client) == F.col(owner), "authorized")
              .otherwise("denied"))
    return j.withColumn("status", status).drop("__sid")


def rpc_isolation(requests: DataFrame, client: str = "client_id", app: str = "app_id") -> DataFrame:
    """RPC form: a null client is let through; any other, the empty one too,
    must equal the app that the request names."""
    same = F.col(client).isNull() | F.col(client).eqNullSafe(F.col(app))
    return requests.withColumn("status", F.when(same, "authorized").otherwise("denied"))


def authorized(requests: DataFrame, owners: DataFrame, **kw) -> DataFrame:
    return tenant_isolation(requests, owners, **kw).filter("status = 'authorized'")


def denied(requests: DataFrame, owners: DataFrame, **kw) -> DataFrame:
    return tenant_isolation(requests, owners, **kw).filter("status <> 'authorized'")


# --------------------------------------------------------------------------- FLT2
def frame_size_guard(df: DataFrame, len_col: str = "declared_len") -> DataFrame:
    """Check declared frame lengths (which include the 8-byte length field):
    adds ``payload_len`` and ``reject_reason`` in (``negative``, ``empty``,
    ``too_large``), null for an acceptable frame."""
    payload = F.col(len_col) - FRAME_LENGTH_SIZE
    reason = (F.when(payload < 0, "negative").when(payload == 0, "empty")
              .when(payload >= MAX_FRAME_SIZE, "too_large"))
    return df.withColumn("payload_len", payload).withColumn("reject_reason", reason)


def accepted_frames(df: DataFrame, len_col: str = "declared_len") -> DataFrame:
    return frame_size_guard(df, len_col).filter(F.col("reject_reason").isNull())
