"""Operator 9, SimHash near-dedup: exact pairs by vantage-point trees.

Fingerprints within ``max_bits`` bits of each other are linked; documents are
grouped by linked fingerprints.  The search has two levels:

* Shards.  64 bits are cut into ``max_bits + 1`` blocks; two fingerprints
  within ``max_bits`` bits agree on a block, so each is dealt to one shard per
  block.  The rows of a shard beyond ``SHARD_MAX`` are dealt once more, by as
  many blocks of the bits that the shard leaves open.  What is still larger is
  split into rings of Hamming distance around two vantage points; a row near
  the inner edge of its ring is also sent to the ring inside, so
  boundary-overlapping shards lose no pair.
* Trees.  Within a shard, points are halved by distance from a vantage point.
  By the triangle bound, a pair across the halves has its outer point within
  ``max_bits`` of the boundary, so only those points go into both halves.
  Leaves compare all points.

A shard sends out a spanning forest, not its pairs; components are found by
joins (``graph.components``).

Defined results.  Null or word-less text has fingerprint zero and is linked
like any other.  A null id is never a component's name unless all ids of the
component are null.  Repeated rows share fingerprint and component.  A bit set
in exactly half of the hashes is 0.  Very long texts are read whole.  An empty
table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, python_ready, small_join, tagged, tasks, written
from .graph import components, forest

SEED = 42
LEAF = 64                 # points a leaf compares directly
BLOCK = 512               # points compared with 8 times as many at a time
SHARD_MAX = 20_000        # rows of a shard before it is split
TASK_ROWS = 2_000_000     # rows of all shards of a task, about 50 bytes each
RING = 8                  # width of a ring, more than max_bits
_SHINGLES = 65_536        # shingles held as bits at a time


# ---- fingerprints ---------------------------------------------------------

def _hashes(text: str, size: int) -> list[int]:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:len(words) - size + 1]
    digest, seed = xxhash.xxh64_intdigest, SEED
    return [digest(joined[a:b], seed)
            for a, b in zip(starts.tolist(), (ends[size - 1:] - 1).tolist(), strict=True)]


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprint of each document from its run of ``counts`` hashes."""
    ones = np.zeros((len(counts), 64), np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    for a in range(0, len(hashes), _SHINGLES):
        part, own = hashes[a:a + _SHINGLES], owner[a:a + _SHINGLES]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        at = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        ones[own[at]] += np.add.reduceat(bits, at, axis=0, dtype=np.int32)
    chosen = 2 * ones > counts[:, None]
    return np.packbits(chosen, axis=1).view(">u8").astype(np.uint64).ravel()


def _fingerprints(size: int):
    def run(batches):
        for batch in batches:
            texts = column(batch, "text")
            out, lists, held, first = [], [], 0, 0
            counts: list[int] = []

            def flush():
                if counts:
                    flat = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
                    out.append(_majority(flat, np.array(counts, np.int64)))
            for i in range(len(texts)):
                h = np.array(_hashes(texts[i].as_py(), size), np.uint64)
                lists.append(h)
                counts.append(len(h))
                held += len(h)
                if held >= 4 * _SHINGLES:
                    flush()
                    lists, counts, held = [], [], 0
            flush()
            fp = np.concatenate(out) if out else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "tag"), pa.array(fp.view(np.int64))],
                names=["doc_id", "tag", "fp"])
    return run


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id, tag, fp`` (64 bits as a bigint) of every whole text."""
    python_ready(docs.sparkSession)
    return tagged(docs, id_col, text_col).mapInArrow(
        _fingerprints(shingle), "doc_id bigint, tag bigint, fp bigint")


# ---- links ----------------------------------------------------------------

def _bits(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def vp_forest(points: np.ndarray, radius: int) -> np.ndarray:
    """Smallest index reachable from each of ``points`` over pairs within
    ``radius`` bits.  Pairs are united block by block, so what is held is a
    block of distances, however many points are close to each other."""
    root = np.arange(len(points))
    todo = [np.arange(len(points))]
    while todo:
        own = todo.pop()
        if len(own) > LEAF:
            # the vantage point farthest from the first one spreads distances
            d = _bits(points[own], points[own[0]])
            d = _bits(points[own], points[own[np.argmax(d)]]).astype(np.int64)
            edge = np.median(d)
            inner, outer = own[d <= edge + radius], own[d > edge]
            if 0 < len(outer) and len(inner) < len(own):
                todo += [inner, outer]
                continue
        for k in range(0, len(own), BLOCK):
            rows = own[k:k + BLOCK]
            for m in range(k, len(own), 8 * BLOCK):
                others = own[m:m + 8 * BLOCK]
                # points of one component need no link any more
                known = root[rows][:, None] == root[others][None, :]
                if known.all():
                    continue
                i, j = np.nonzero((_bits(points[rows][:, None], points[others][None, :]) <= radius) & ~known)
                if len(i):
                    root = forest(len(points), root[rows[i]], root[others[j]], root)
    return root


def _shard_links(radius: int):
    def run(batches):
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        t = pa.Table.from_batches(tables)
        shard = np.asarray(column(t, "shard"))
        fp = np.asarray(column(t, "fp")).view(np.uint64)
        order = np.lexsort((fp, shard))
        shard, fp = shard[order], fp[order]
        cut = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True])))
        size = np.diff(cut)
        here = np.repeat(size, size)
        a, b = [], []
        # small shards are leaves: compared at every distance in the sorted order
        for step in range(1, int(min(LEAF, size.max()))):
            i = np.flatnonzero((shard[step:] == shard[:-step]) & (here[step:] <= LEAF))
            i = i[_bits(fp[i], fp[i + step]) <= radius]
            a.append(i)
            b.append(i + step)
        for k in np.flatnonzero(size > LEAF):
            top = vp_forest(fp[cut[k]:cut[k + 1]], radius)
            i = np.flatnonzero(top != np.arange(len(top)))
            a.append(i + cut[k])
            b.append(top[i] + cut[k])
        none = np.zeros(0, np.int64)
        root = forest(len(fp), np.concatenate(a or [none]), np.concatenate(b or [none]))
        linked = np.flatnonzero(root != np.arange(len(fp)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(fp[linked].view(np.int64)), pa.array(fp[root[linked]].view(np.int64))],
            names=["a", "b"])
    return run


def _ring(vantage: str, bits: int) -> F.Column:
    d = F.bit_count(F.col("fp").bitwiseXOR(F.col(vantage)))
    home = F.floor(d / RING).cast("int")
    return F.when(F.col(vantage).isNull(), F.array(F.lit(0))).otherwise(
        F.when((F.pmod(d, F.lit(RING)) < bits) & (home > 0), F.array(home, home - 1)).otherwise(F.array(home)))


def _masks(free: int, blocks: int) -> list[int]:
    """The set bits of ``free``, from the lowest, cut into equal blocks."""
    bits = [b for b in range(64) if free >> b & 1]
    cuts = [len(bits) * k // blocks for k in range(blocks + 1)]
    return [sum(1 << b for b in bits[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]


def _block(mask: int, *names) -> F.Column:
    """Shard of the fingerprints that agree on ``mask``."""
    signed = mask - (1 << 64) if mask >> 63 else mask
    return F.xxhash64(*map(F.lit, names), F.col("fp").bitwiseAND(F.lit(signed).cast("bigint")))


def _oversized(dealt: DataFrame) -> DataFrame:
    return (dealt.groupBy("block")
            .agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("v1"), F.max("fp").alias("v2"))
            .filter(F.col("n") > SHARD_MAX).select("block", "v1", "v2"))


def links(points: DataFrame, max_bits: int = 4) -> DataFrame:
    """Links ``a, b`` that connect all distinct fingerprints ``fp`` within
    ``max_bits`` of each other (a spanning forest of each shard)."""
    spark = points.sparkSession
    python_ready(spark)
    blocks, whole = max_bits + 1, (1 << 64) - 1
    dealt = points.select("fp", F.posexplode(F.array(
        *[_block(m, k) for k, m in enumerate(_masks(whole, blocks))])).alias("k", "block"))
    # a pair of one shard differs in the other bits only: cut those likewise
    finer = F.array(F.col("block"))
    for k, mask in enumerate(_masks(whole, blocks)):
        cut = F.array(*[_block(mask | m, k, j) for j, m in enumerate(_masks(whole & ~mask, blocks))])
        finer = F.when(F.col("v1").isNotNull() & (F.col("k") == k), cut).otherwise(finer)
    dealt = small_join(dealt, _oversized(dealt), "block").select("fp", F.explode(finer).alias("block"))
    dealt = small_join(dealt, _oversized(dealt), "block")
    rings = (dealt.withColumn("r1", F.explode(_ring("v1", max_bits)))
             .withColumn("r2", F.explode(_ring("v2", max_bits))))
    shards = rings.select("fp", F.xxhash64("block", "r1", "r2").alias("shard"))
    n = tasks(spark, points.count() * blocks, TASK_ROWS)
    return shards.repartition(n, "shard").mapInArrow(
        _shard_links(max_bits), "a bigint, b bigint")


def near_dedup(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """``doc_id, tag, fingerprint, component_id, kept`` of every row; in each
    component the row with the smallest id (then tag) is ``kept``."""
    rows = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    # nulls last: ids first, then the tag decides
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag"))
    points = written(rows.groupBy("fp").agg(least.alias("top")), "points")
    classes = written(components(links(points.select("fp"), max_bits)), "classes")
    member = points.join(classes, points["fp"] == classes["node"], "left").select(
        points["fp"], "top", F.coalesce("root", points["fp"]).alias("root"))
    tops = member.groupBy("root").agg(F.min("top").alias("best"))
    named = member.select("fp", "root").join(tops, "root").select("fp", "best")
    return (rows.join(named, "fp")
            .select("doc_id", "tag",
                    F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    F.col("best.doc_id").alias("component_id"),
                    (F.col("tag") == F.col("best.tag")).alias("kept")))
