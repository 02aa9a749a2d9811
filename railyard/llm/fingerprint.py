"""Operator 10, document fingerprints: a homomorphic multiset hash.

A text is a multiset of short paragraphs (sentences, cut after line breaks and
full stops, long ones every ``UNIT`` characters from their start).  Each
paragraph is hashed to a wide vector: ``SIGNS`` lanes of +1 or -1 and four
64-bit lanes.  The fingerprint is the sum over all paragraphs, lanes modulo
2**16 and 2**64.  Sums do not depend on order, and a paragraph is inserted or
deleted by adding or subtracting its vector: ``edited`` fingerprints are made
that way, from the paragraphs that an edit takes out and puts in.  The signed
lanes also estimate likeness: their cosine is close to the share of common
paragraphs, within about 1 / sqrt(SIGNS).

Defined results.  Null text is empty; its fingerprint is all zero, like
another empty one (1) and unlike all others (0).  Rows without an id stand
outside the order: their next text is the empty one, as for a table of one
row the row itself.  Rows with one id follow each other by text.  Very long
texts are read whole, their paragraphs in blocks.  An empty
table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, python_ready, tasks, text_of

UNIT = 64
TASK_BYTES = 128 << 20    # text of a task
MAX_RANGES = 4096         # ranges of ids, at most
SIGNS = 256
_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*|[.!?\n]+")
_HELD = 16_384            # paragraph vectors held as bits at a time

RESULT = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
          "edited_fingerprint string, near_edited double, near_next double")


# ---- vectors --------------------------------------------------------------

def sentences(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _SENTENCE.finditer(text)]


def units(text: str, spans: list[tuple[int, int]]) -> list[str]:
    out = []
    for a, b in spans:
        if b - a <= UNIT:
            out.append(text[a:b])
        else:
            out += [text[k:min(k + UNIT, b)] for k in range(a, b, UNIT)]
    return out


def edit(text: str, spans: list[tuple[int, int]], own: list[str], following: str):
    """The edited text, and the paragraphs deleted and inserted by the edit."""
    half = len(text) // 2
    edited = text[:len(text) - half] + following[:half]
    keep = len(text) - half
    first = next((k for k, (_, b) in enumerate(spans) if b >= keep), len(spans))
    at = spans[first][0] if first < len(spans) else len(text)
    tail = edited[at:]
    return edited, units(text, spans[first:]), units(tail, sentences(tail))


class Sums:
    """Adds up paragraph vectors of numbered multisets."""

    def __init__(self, n: int):
        self.signs = np.zeros((n, SIGNS), np.int64)
        self.wide = np.zeros((n, 4), np.uint64)
        self.raw: list[bytes] = []
        self.owner: list[int] = []
        self.weight: list[int] = []

    def add(self, k: int, paragraphs: list[str], weight: int = 1) -> None:
        self.raw += [hashlib.blake2b(p.encode("utf-8", "surrogatepass")).digest() for p in paragraphs]
        self.owner += [k] * len(paragraphs)
        self.weight += [weight] * len(paragraphs)
        if len(self.raw) >= _HELD:
            self.flush()

    def flush(self) -> None:
        if not self.raw:
            return
        raw = np.frombuffer(b"".join(self.raw), np.uint8).reshape(-1, 64)
        owner, weight = np.array(self.owner), np.array(self.weight)
        cut = np.flatnonzero((np.diff(owner) != 0) | (np.diff(weight) != 0)) + 1
        at = np.concatenate(([0], cut))
        ones = np.add.reduceat(np.unpackbits(raw[:, :32], axis=1), at, axis=0, dtype=np.int32)
        size = np.diff(np.append(at, len(owner)))
        w = weight[at]
        np.add.at(self.signs, owner[at], (2 * ones.astype(np.int64) - size[:, None]) * w[:, None])
        with np.errstate(over="ignore"):
            wide = np.add.reduceat(np.ascontiguousarray(raw[:, 32:]).view("<u8"), at, axis=0)
            np.add.at(self.wide, owner[at], wide * w.astype(np.uint64)[:, None])
        self.raw, self.owner, self.weight = [], [], []


def shown(signs: np.ndarray, wide: np.ndarray) -> list[str]:
    """Lanes modulo 2**16 and 2**64, as text."""
    low = (signs & 0xFFFF).astype("<u2")
    return [base64.b64encode(a.tobytes() + b.astype("<u8").tobytes()).decode()
            for a, b in zip(low, wide, strict=True)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of signed lanes, 0 to 1; 1 where both are equal."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    size = np.sqrt((a * a).sum(1) * (b * b).sum(1))
    out = np.divide((a * b).sum(1), size, out=np.zeros(len(a)), where=size > 0)
    return np.where((a == b).all(1), 1.0, np.clip(out, 0.0, 1.0))


# ---- rows in order --------------------------------------------------------

def _walk(batches):
    """Rows sorted by bucket and id; the last row of a bucket is a guard, the
    copy of the row that follows it in the order."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
             "near_edited", "near_next"]
    held = []                                # one row: (bucket, guard, doc_id, text)

    def result(rows):
        n = len(rows) - 1
        sums, edits = Sums(len(rows)), Sums(n)
        texts, real = [], []
        for i, (bucket, guard, _, text) in enumerate(rows):
            spans = sentences(text)
            own = units(text, spans)
            sums.add(i, own)
            if i == n:
                break
            if guard:
                texts.append("")
                continue
            if bucket == rows[i + 1][0]:
                following = rows[i + 1][3]
            else:                            # rows without an id have no guard
                following = ""
            real.append(i)
            edited, gone, come = edit(text, spans, own, following)
            texts.append(edited)
            edits.add(i, gone, -1)
            edits.add(i, come, 1)
        sums.flush()
        edits.flush()
        pick = np.array(real, np.int64)
        signs, wide = sums.signs, sums.wide
        with np.errstate(over="ignore"):
            e_signs, e_wide = signs[pick] + edits.signs[pick], wide[pick] + edits.wide[pick]
        same = np.array([rows[i][0] == rows[i + 1][0] for i in real], bool)
        nxt = np.where(same[:, None], signs[pick + 1], 0) if len(pick) else signs[:0]
        return pa.RecordBatch.from_arrays([
            pa.array([rows[i][2] for i in real], pa.int64()),
            pa.array([len(rows[i][3]) for i in real], pa.int64()),
            pa.array([hashlib.sha256(texts[i].encode("utf-8", "surrogatepass")).hexdigest() for i in real],
                     pa.string()),
            pa.array(shown(signs[pick], wide[pick]), pa.string()),
            pa.array(shown(e_signs, e_wide), pa.string()),
            pa.array(likeness(signs[pick], e_signs)), pa.array(likeness(signs[pick], nxt))], names=names)

    for batch in batches:
        cols = [column(batch, c) for c in ("bucket", "guard", "doc_id", "text")]
        for a in range(0, batch.num_rows, 1024):
            part = [c.slice(a, 1024).to_pylist() for c in cols]
            rows = held + list(zip(*part, strict=True))
            yield result(rows)
            held = rows[-1:]
    if held and not held[0][1]:
        yield result([*held, (None, True, None, "")])


def _bucket(bounds: list[int]) -> Column:
    """How many bounds are at most the id: found by every 64th, then within."""
    every = F.array(*[F.lit(b).cast("bigint") for b in bounds[::64]])
    rough = F.size(F.filter(every, lambda b: b <= F.col("doc_id"))) - 1
    near = F.slice(F.array(*[F.lit(b).cast("bigint") for b in bounds]), rough * 64 + 1, F.lit(64))
    return (rough * 64 + F.size(F.filter(near, lambda b: b <= F.col("doc_id"))) - 1).cast("bigint")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its fingerprint, that of its edited text (the
    last half replaced by the beginning of the next document) and likenesses.

    Ids are cut into ranges of about equal numbers of rows; the first row of
    each range is also sent to the range before it (of the first range, to
    the last) as a guard, so ranges are walked independently.
    """
    spark = docs.sparkSession
    python_ready(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    parts = tasks(spark, size, TASK_BYTES)
    n = min(4 * parts, MAX_RANGES)
    got = rows.agg(F.min("doc_id"), F.percentile_approx("doc_id", [k / n for k in range(1, n)], 100 * n)).first()
    nameless = (rows.filter("doc_id IS NULL")
                .select((-1 - F.monotonically_increasing_id()).alias("bucket"),
                        F.lit(0).alias("turn"), F.lit(False).alias("guard"), "doc_id", "text"))
    if got[0] is None:
        placed = nameless
    else:
        bounds = sorted({got[0], *(got[1] or [])})
        bucket = _bucket(bounds)
        first = F.array(*[F.lit(b).cast("bigint") for b in bounds])
        named = rows.filter("doc_id IS NOT NULL").withColumn("home", bucket)
        here = F.struct(F.col("home").alias("bucket"), F.lit(0).alias("turn"), F.lit(False).alias("guard"))
        back = F.struct(F.when(F.col("home") > 0, F.col("home") - 1).otherwise(F.lit(len(bounds) - 1).cast("bigint")).alias("bucket"),
                        F.when(F.col("home") > 0, 0).otherwise(1).alias("turn"), F.lit(True).alias("guard"))
        opens = F.get(first, F.col("home").cast("int")) == F.col("doc_id")
        placed = (named.withColumn("p", F.explode(F.when(opens, F.array(here, back)).otherwise(F.array(here))))
                  .select("p.bucket", "p.turn", "p.guard", "doc_id", "text")).unionByName(nameless)
    return (placed.repartition(parts, "bucket")
            .sortWithinPartitions("bucket", "turn", "doc_id", "text", "guard")
            .drop("turn").mapInArrow(_walk, RESULT))
