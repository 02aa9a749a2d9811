"""Operator 1, exact dedup: a minimal perfect hash over historical digests.

History is kept as an index of bounded shards.  A shard holds a minimal
perfect hash over its distinct SHA-256 digests; slot ``i`` holds the full
digest, the locator of the row that stays and the number of copies.  A new
batch is reduced to distinct digests, dealt to the shards and looked up: a
member's slot is compared byte for byte, so a hash hit is never trusted alone.
Members are repeats of history; nonmembers form groups among themselves.

Defined results.  Null text is the empty text.  A null id is the smallest id;
a group of null ids only has a null ``keep_id``.  Of rows with the same id and
text (repeated rows) exactly one stays.  Very long texts are hashed and compared
whole.  An empty table gives no rows.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, mix64, python_ready, tagged, written

SHARD_KEYS = 65_536       # expected digests in a shard
GAMMA = 2.0               # bits per key in each level of the hash

INDEX_SCHEMA = ("shard int, n int, level_bits array<int>, bits binary, digests binary, "
                "keep_id binary, keep_null binary, keep_tag binary, copies binary")
LOOKUP_SCHEMA = ("digest binary, doc_id bigint, tag bigint, copies bigint, member boolean, "
                 "old_id bigint, old_tag bigint, old_copies bigint")


# ---- minimal perfect hash -------------------------------------------------

def _positions(words: np.ndarray, level: int, size: int) -> np.ndarray:
    h = np.full(len(words), np.uint64(level + 1))
    for i in range(words.shape[1]):
        h = mix64(h ^ words[:, i])
    return (h % np.uint64(size)).astype(np.int64)


def build_mph(words: np.ndarray) -> list[np.ndarray]:
    """Levels of bits over distinct rows of ``words``: a key that is alone on
    its place in a level gets the bit, the others go on to the next level."""
    levels, left = [], words
    while len(left):
        size = max(64, int(GAMMA * len(left)) // 8 * 8)
        pos = _positions(left, len(levels), size)
        bits = np.bincount(pos, minlength=size) == 1
        levels.append(bits)
        left = left[~bits[pos]]
    return levels


def slots(levels: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    """Slot 0..n-1 of each key; -1 where no level has a bit (no member)."""
    out = np.full(len(words), -1, np.int64)
    open_, before = np.arange(len(words)), 0
    for i, bits in enumerate(levels):
        if not len(open_):
            break
        pos = _positions(words[open_], i, len(bits))
        hit = bits[pos]
        rank = np.cumsum(bits)
        out[open_[hit]] = before + rank[pos[hit]] - 1
        before += int(rank[-1])
        open_ = open_[~hit]
    return out


# ---- shards ---------------------------------------------------------------

def _words(digests: pa.Array) -> np.ndarray:
    raw = b"".join(digests.to_pylist())
    return np.frombuffer(raw, np.uint64).reshape(-1, 4)


def _ints(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    null = np.asarray(arr.is_null())
    return np.asarray(arr.fill_null(0)).astype(np.int64), null


def _build(table: pa.Table) -> pa.Table:
    words = _words(column(table, "digest"))
    levels = build_mph(words)
    order = np.argsort(slots(levels, words))
    ids, null = _ints(column(table, "doc_id"))
    tags, _ = _ints(column(table, "tag"))
    copies, _ = _ints(column(table, "copies"))
    row = {
        "shard": column(table, "shard")[0].as_py(), "n": len(words),
        "level_bits": [len(b) for b in levels],
        "bits": np.packbits(np.concatenate(levels)).tobytes(),
        "digests": words[order].tobytes(),
        "keep_id": ids[order].tobytes(), "keep_null": null[order].tobytes(),
        "keep_tag": tags[order].tobytes(), "copies": copies[order].tobytes(),
    }
    schema = pa.schema([("shard", pa.int32()), ("n", pa.int32()), ("level_bits", pa.list_(pa.int32()))]
                       + [(c, pa.binary()) for c in ("bits", "digests", "keep_id", "keep_null",
                                                     "keep_tag", "copies")])
    return pa.Table.from_pylist([row], schema=schema)


def _lookup(batch: pa.Table, index: pa.Table) -> pa.Table:
    n = batch.num_rows
    member, found = np.zeros(n, bool), np.zeros(n, np.int64)
    old = [np.zeros(n, np.int64)] * 3
    nulls = np.zeros(n, bool)
    if n and index.num_rows:
        row = index.to_pylist()[0]
        flat = np.unpackbits(np.frombuffer(row["bits"], np.uint8)).astype(bool)
        cuts = np.cumsum([0, *row["level_bits"]])
        levels = [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        kept = np.frombuffer(row["digests"], np.uint64).reshape(-1, 4)
        words = _words(column(batch, "digest"))
        at = slots(levels, words)
        found = np.where(at >= 0, at, 0)
        member = (at >= 0) & (kept[found] == words).all(axis=1)
        old = [np.frombuffer(row[c], np.int64)[found] for c in ("keep_id", "keep_tag", "copies")]
        nulls = np.frombuffer(row["keep_null"], bool)[found]
    out = [column(batch, c) for c in ("digest", "doc_id", "tag", "copies")]
    out += [pa.array(member), pa.array(old[0], pa.int64(), mask=~member | nulls),
            pa.array(old[1], pa.int64(), mask=~member), pa.array(old[2], pa.int64(), mask=~member)]
    return pa.Table.from_arrays(out, names=["digest", "doc_id", "tag", "copies", "member",
                                            "old_id", "old_tag", "old_copies"])


def _shard(n: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int")


def distinct_digests(rows: DataFrame) -> DataFrame:
    """One row per digest: the locator (id, tag) that stays and the copies.
    Combined before the shuffle, so a text held by a third of all rows is
    one row from each task."""
    return (rows.groupBy("digest")
            .agg(F.max(F.struct("doc_id", "tag")).alias("top"), F.count(F.lit(1)).alias("copies"))
            .select("digest", F.col("top.doc_id").alias("doc_id"),
                    F.col("top.tag").alias("tag"), "copies"))


def build_index(history: DataFrame, n_shards: int) -> DataFrame:
    """Index of distinct historical digests (``distinct_digests`` rows), one
    row per shard; a table to be written and looked up by later batches."""
    python_ready(history.sparkSession)
    return (history.withColumn("shard", _shard(n_shards))
            .groupBy("shard").applyInArrow(_build, INDEX_SCHEMA))


def lookup(batch: DataFrame, index: DataFrame, n_shards: int) -> DataFrame:
    """Distinct digests of a batch with what the index holds for each."""
    python_ready(batch.sparkSession)
    return (batch.withColumn("shard", _shard(n_shards)).groupBy("shard")
            .cogroup(index.groupBy("shard")).applyInArrow(_lookup, LOOKUP_SCHEMA))


def exact_dedup(docs: DataFrame, historical: Column, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Groups of equal texts over history and a new batch.

    ``historical`` says of each row (by its columns ``doc_id`` and ``text``)
    whether it is history.  Returns ``doc_id, tag, keep_id, group_size, kept,
    text_sha256`` for every row of both; the largest id stays.
    """
    rows = written(tagged(docs, id_col, text_col)
                   .select("doc_id", "tag", F.unhex(F.sha2("text", 256)).alias("digest"),
                           F.coalesce(historical, F.lit(False)).alias("historical")), "digests")
    old = written(distinct_digests(rows.filter("historical")), "history")
    new = distinct_digests(rows.filter("NOT historical"))
    n_shards = max(1, math.ceil(rows.count() / SHARD_KEYS))
    index = written(build_index(old, n_shards), "mph-index")
    seen = written(lookup(new, index, n_shards), "lookup")

    best = F.greatest(F.struct("doc_id", "tag"), F.struct(F.col("old_id").alias("doc_id"), F.col("old_tag").alias("tag")))
    repeats = seen.filter("member").select("digest", best.alias("top"),
                                           (F.col("copies") + F.col("old_copies")).alias("size"))
    others = seen.filter("NOT member").select("digest", F.struct("doc_id", "tag").alias("top"),
                                              F.col("copies").alias("size"))
    untouched = (old.join(repeats.select("digest"), "digest", "left_anti")
                 .select("digest", F.struct("doc_id", "tag").alias("top"),
                         F.col("copies").alias("size")))
    groups = repeats.unionByName(others).unionByName(untouched)
    return (rows.join(groups, "digest")
            .select("doc_id", "tag", F.col("top.doc_id").alias("keep_id"),
                    F.col("size").cast("bigint").alias("group_size"),
                    (F.col("tag") == F.col("top.tag")).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256")))


def older_half(docs: DataFrame, id_col: str = "doc_id") -> Column:
    """Rows up to the middle of the id range are history, later ones the new
    batch (rows without an id belong to the batch)."""
    lo, hi = docs.agg(F.min(id_col).cast("bigint"), F.max(id_col).cast("bigint")).first()
    return F.lit(False) if lo is None else F.col("doc_id") <= F.lit((lo + hi) // 2)
