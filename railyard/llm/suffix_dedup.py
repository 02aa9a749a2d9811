"""Operator 8, suffix-array dedup with a logarithmic family of indexes.

Every byte covered by a ``length``-byte string that also starts elsewhere is
removed.  The indexed suffixes are sampled by content: of the ``ANCHOR``-byte
strings inside each ``length``-byte window the one of least hash (the first of
equals) is the window's anchor, so equal windows have equal anchors wherever
they stand and nothing is lost.  Consecutive windows with one anchor are a
run; a run's suffix is known by the hash of its anchor and that of its bytes.

1. Equal runs are counted (combined before the shuffle, so a passage in a
   third of all texts is one row of each task) and dealt to shards by anchor.
   A shard takes them batch by batch.  A batch is sorted into a suffix array;
   it is merge-scanned against the arrays of all levels for equal anchors; then
   it joins the family, where arrays of one level merge into one of the next,
   so a suffix is moved once per level.  What was found is joined back to the
   runs, a join that Spark splits where a run is frequent.
2. Runs with equal bytes repeat whole: all their windows are found.  Runs that
   share only the anchor end or begin a match; of equal ones a single run, they
   are compared window by window, by two 64-bit hashes.  Equal windows have
   their anchor at the same distance, so a frequent anchor's runs are cut by
   that distance and dealt to many tasks.
3. Texts are joined to their runs once; those without a run to compare are
   finished there, the others when their windows are known.

Full suffix arrays of all bytes don't fit the limits on disk (README).

Defined results.  Null text is empty; texts shorter than ``length`` lose
nothing.  A null id stays null.  Repeated rows are copies: each loses what the
other holds.  Very long texts are read whole by one task.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, column, mix64, python_ready, stable, tagged, tasks, written

ANCHOR = 64
OFTEN = 20_000            # distinct runs of an anchor, before they are dealt out by distance
TASK_BYTES = 1 << 28      # bytes of text whose suffixes a task indexes, about 40 bytes in 57
NEAR = 8                  # distances that stay together then
_BLOCK = 1 << 19

RUNS = "tag bigint, start int, n int, anchor bigint, depth int, body bigint"
FLAGS = "anchor bigint, body bigint, tag bigint, start int, same boolean, compare boolean, often boolean"


def _odd(seed: int) -> int:
    return int(np.random.default_rng(seed).integers(1 << 62)) * 2 + 1


class Rolling:
    """Hashes of any stretch of a block of bytes, by one running sum."""

    def __init__(self, seed: int, most: int):
        base, inverse = _odd(seed), None
        inverse = pow(base, -1, 1 << 64)
        self.values = np.random.default_rng(seed + 1).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        with np.errstate(over="ignore"):
            self.up = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(most, base, np.uint64))))
            self.down = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(most, inverse, np.uint64))))

    def sums(self, data: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            terms = self.values[data] * self.up[:len(data)]
            return np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms)))

    def stretch(self, sums: np.ndarray, a, b) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((sums[b] - sums[a]) * self.down[a])


_ROLLING: dict = {}


def rolling(seed: int, most: int) -> Rolling:
    if (seed, most) not in _ROLLING:
        _ROLLING[seed, most] = Rolling(seed, most)
    return _ROLLING[seed, most]


# ---- runs -----------------------------------------------------------------

def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    extra = width - span
    return np.minimum(x[:len(x) - extra], x[extra:]) if extra else x


def runs(data: np.ndarray, valid: np.ndarray, length: int):
    """``(start, n, anchor, depth, body)`` of the runs of windows of a block; windows
    whose start isn't ``valid`` (they cross texts) are in no run.  The anchor stands ``depth`` bytes after the start."""
    roll = rolling(1, _BLOCK + 4 * length)
    sums = roll.sums(data)
    at = np.arange(len(data) - ANCHOR + 1)
    grams = roll.stretch(sums, at, at + ANCHOR)
    low = np.uint64((1 << 20) - 1)                       # a block has fewer places
    packed = (grams & ~low) | at.astype(np.uint64)
    place = (_least(packed, length - ANCHOR + 1) & low).astype(np.int64)
    ok = valid[:len(place)]
    place = np.where(ok, place, -1)
    first = np.flatnonzero(ok & np.concatenate(([True], place[1:] != place[:-1])))
    change = np.flatnonzero(np.concatenate((place[1:] != place[:-1], [True])))
    last = change[np.searchsorted(change, first)]
    body = roll.stretch(sums, first, last + length)
    with np.errstate(over="ignore"):
        body = mix64(body ^ (last - first + 1).astype(np.uint64) ^ ((place[first] - first).astype(np.uint64) << np.uint64(32)))
    return first, last - first + 1, grams[place[first]], place[first] - first, body


def _blocks(texts: pa.Array, length: int):
    """Blocks of whole texts, or overlapping pieces of a long one: ``(row of
    each byte, place of row 0 in its text, bytes, valid window starts)``."""
    offsets, data = buffers(texts)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + _BLOCK, "right")) - 1
        if j > i:
            a, b = int(offsets[i]), int(offsets[j])
            if b - a >= length:
                ends = offsets[i:j + 1] - a
                row = np.repeat(np.arange(i, j), np.diff(ends))
                starts = np.arange(b - a)
                yield row, starts - ends[row - i], data[a:b], starts + length <= ends[row - i + 1]
            i = j
            continue
        a, end = int(offsets[i]), int(offsets[i + 1])
        while True:
            b = min(a + _BLOCK, end)
            place = np.arange(a, b) - int(offsets[i])
            yield np.full(b - a, i), place, data[a:b], np.arange(a, b) + length <= b
            if b == end:
                break
            a = b - length + 1
        i += 1


def _find_runs(length: int):
    def run(batches):
        for batch in batches:
            tags = np.asarray(column(batch, "tag"))
            for row, place, data, valid in _blocks(column(batch, "text"), length):
                if not valid.any():
                    continue
                start, n, anchor, depth, body = runs(data, valid, length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tags[row[start]]), pa.array(place[start].astype(np.int32)),
                     pa.array(n.astype(np.int32)), pa.array(anchor.view(np.int64)),
                     pa.array(depth.astype(np.int32)), pa.array(body.view(np.int64))],
                    names=["tag", "start", "n", "anchor", "depth", "body"])
    return run


# ---- family of indexes ----------------------------------------------------

class Family:
    """Suffix arrays sorted by (anchor, body); level ``k`` holds 2**k batches."""

    def __init__(self):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, rows: np.ndarray, shared: np.ndarray) -> None:
        """Take a batch of ``rows`` with ``keys`` (anchor, body); rows whose
        anchor stands elsewhere are marked in ``shared``, on both sides."""
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        keys, rows = keys[order], rows[order]
        _mark(keys, rows, shared)
        for _, old_keys, old_rows in self.levels:
            _scan(keys, rows, old_keys, old_rows, shared)
        level = 0
        while self.levels and self.levels[-1][0] == level:
            _, old_keys, old_rows = self.levels.pop()
            keys, rows = np.concatenate((old_keys, keys)), np.concatenate((old_rows, rows))
            order = np.lexsort((keys[:, 1], keys[:, 0]))
            keys, rows = keys[order], rows[order]
            level += 1
        self.levels.append((level, keys, rows))


def _mark(keys, rows, shared) -> None:
    """Mark neighbours of a sorted array that share the anchor."""
    eq = keys[1:, 0] == keys[:-1, 0]
    shared[rows[1:][eq]] = True
    shared[rows[:-1][eq]] = True


def _scan(keys, rows, old_keys, old_rows, shared) -> None:
    """Merge-scan of a new array against an old one: mark both sides of
    anchors that stand in both."""
    lo, hi = (np.searchsorted(old_keys[:, 0], keys[:, 0], side) for side in ("left", "right"))
    new = hi > lo
    shared[rows[new]] = True
    edge = np.zeros(len(old_keys) + 1, np.int64)
    np.add.at(edge, lo[new], 1)
    np.add.at(edge, hi[new], -1)
    shared[old_rows[np.cumsum(edge[:-1]) > 0]] = True


def _index(batch_rows: int):
    """Of the distinct runs of a shard, those that stand twice (``same``) or
    share their anchor with others (``compare``)."""
    def run(batches):
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        table = pa.Table.from_batches(tables)
        count = table.num_rows
        keys = np.column_stack([np.asarray(column(table, c)).view(np.uint64) for c in ("anchor", "body")])
        same = np.asarray(column(table, "k")) > 1
        shared, family = np.zeros(count, bool), Family()
        for a in range(0, count, batch_rows):
            rows = np.arange(a, min(a + batch_rows, count))
            family.add(keys[rows], rows, shared)
        _, back, kinds = np.unique(keys[:, 0], return_inverse=True, return_counts=True)
        hit = np.flatnonzero(shared | same)
        out = table.take(pa.array(hit)).select(["anchor", "body", "tag", "start"])
        for name, mark in (("same", same), ("compare", shared), ("often", kinds[back] > OFTEN)):
            out = out.append_column(name, pa.array(mark[hit]))
        yield from out.to_batches(max_chunksize=100_000)
    return run


# ---- texts and windows ----------------------------------------------------

SPANS = "array<struct<start: bigint, stop: bigint>>"
CUT = ("doc_id bigint, tag bigint, n_bytes bigint, n_removed bigint, n_spans bigint, "
       f"kept_sha256 string, spans {SPANS}")
VISIT = CUT + ", text string, anchor bigint, salt int, start int, n int, depth int, bytes binary"

_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_CUT = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("n_bytes", pa.int64()),
                  ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
                  ("spans", _SPAN)])
_VISIT = pa.schema([*_CUT, ("text", pa.string()), ("anchor", pa.int64()), ("salt", pa.int32()),
                    ("start", pa.int32()), ("n", pa.int32()), ("depth", pa.int32()), ("bytes", pa.binary())])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of stretches, touching ones joined."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut(text: bytes, spans: list[tuple[int, int]]) -> dict:
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    left = b"".join([*kept, text[at:]])
    return {"n_bytes": len(text), "n_removed": len(text) - len(left), "n_spans": len(spans),
            "kept_sha256": hashlib.sha256(left).hexdigest(),
            "spans": [{"start": a, "stop": b} for a, b in spans]}


def _visit(length: int):
    """Finished rows; for texts with runs to compare, those runs' bytes; and
    the texts that wait for the comparison, with the spans known so far."""
    def run(batches):
        for batch in batches:
            ids, tags, texts, all_hits = (column(batch, c) for c in ("doc_id", "tag", "text", "hits"))
            rows = []
            for i in range(len(texts)):
                text, tag = texts[i].as_py(), tags[i].as_py()
                raw = text.encode("utf-8", "surrogatepass")
                base = {"doc_id": ids[i].as_py(), "tag": tag}
                hits = all_hits[i].as_py() or []
                spans = merged([(h["start"], h["start"] + h["n"] - 1 + length) for h in hits if h["same"]])
                for h in hits:
                    if not h["compare"]:
                        continue
                    for salt, start, n in _parts(h):
                        rows.append({"tag": tag, "anchor": h["anchor"], "salt": salt, "start": start, "n": n,
                                     "depth": h["depth"] - (start - h["start"]),
                                     "bytes": raw[start:start + n - 1 + length]})
                if all(h["same"] for h in hits):
                    rows.append(base | cut(raw, spans))
                else:
                    rows.append(base | {"text": text, "spans": [{"start": a, "stop": b} for a, b in spans]})
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_pylist(rows, schema=_VISIT)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_VISIT)
    return run


def _parts(h: dict):
    """A run whole, or cut by the distance of the anchor from the window."""
    if not h["often"]:
        return [(-1, h["start"], h["n"])]
    out, start, end = [], h["start"], h["start"] + h["n"]
    while start < end:
        depth = h["depth"] - (start - h["start"])
        n = min(depth % NEAR + 1, end - start)
        out.append((depth // NEAR, start, n))
        start += n
    return out


def _compare(length: int):
    """Windows that stand in two runs of the partition, as stretches."""
    def run(batches):
        one, two = rolling(11, 1 << 21), rolling(23, 1 << 21)
        tags, starts, h1, h2, depths = [], [], [], [], []
        for batch in batches:
            offsets, data = buffers(column(batch, "bytes"))
            tag, start, n, depth = (np.asarray(column(batch, c)).astype(np.int64)
                                    for c in ("tag", "start", "n", "depth"))
            for a in range(0, batch.num_rows, 2048):
                b = min(a + 2048, batch.num_rows)
                part, size = data[offsets[a]:offsets[b]], n[a:b]
                step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                at = np.repeat(offsets[a:b] - offsets[a], size) + step
                for roll, out in ((one, h1), (two, h2)):
                    out.append(roll.stretch(roll.sums(part), at, at + length))
                tags.append(np.repeat(tag[a:b], size))
                starts.append(np.repeat(start[a:b], size) + step)
        if not tags:
            return
        tag, start, a, b = map(np.concatenate, (tags, starts, h1, h2))
        order = np.lexsort((b, a))
        eq = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
        hit = np.zeros(len(a), bool)
        hit[order[1:][eq]] = True
        hit[order[:-1][eq]] = True
        tag, start = tag[hit], start[hit]
        order = np.lexsort((start, tag))
        tag, start = tag[order], start[order]
        first = np.flatnonzero(np.concatenate(([True], (tag[1:] != tag[:-1]) | (start[1:] != start[:-1] + 1)))
                               ) if len(tag) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(tag)))
        yield pa.RecordBatch.from_arrays([pa.array(tag[first]), pa.array(start[first]),
                                          pa.array(start[first] + n - 1 + length)],
                                         names=["tag", "start", "stop"])
    return run


def _finish(batches):
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            spans = merged([(x["start"], x["stop"]) for x in (r["spans"] or []) + (r["more"] or [])])
            rows.append({"doc_id": r["doc_id"], "tag": r["tag"]}
                        | cut(r["text"].encode("utf-8", "surrogatepass"), spans))
        yield pa.RecordBatch.from_pylist(rows, schema=_CUT)


def repeated_spans(docs: DataFrame, length: int = 200, batch_rows: int = 65_536, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, tag, n_bytes, n_removed, n_spans,
    kept_sha256, spans`` (maximal removed runs of bytes)."""
    if length <= ANCHOR:
        raise ValueError(f"length must be over {ANCHOR}")
    spark = docs.sparkSession
    python_ready(spark)
    texts = tagged(stable(docs), id_col, text_col)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = tasks(spark, size, TASK_BYTES)
    found = texts.select("tag", "text").mapInArrow(_find_runs(length), RUNS)
    first = F.min(F.struct("tag", "start")).alias("first")
    distinct = (found.groupBy("anchor", "body").agg(F.count(F.lit(1)).alias("k"), first)
                .select("anchor", "body", "k", "first.tag", "first.start"))
    flags = written(distinct.repartition(n, "anchor").mapInArrow(_index(batch_rows), FLAGS), "flags")
    flags = flags.select("anchor", "body", F.col("tag").alias("lead_tag"), F.col("start").alias("lead_start"),
                         "same", "compare", "often")
    lead = F.col("compare") & (F.col("tag") == F.col("lead_tag")) & (F.col("start") == F.col("lead_start"))
    hits = found.join(flags, ["anchor", "body"]).select("tag", "start", "n", "anchor", "depth", "same",
                                                        lead.alias("compare"), "often")
    per_text = hits.groupBy("tag").agg(F.collect_list(
        F.struct("start", "n", "anchor", "depth", "same", "compare", "often")).alias("hits"))
    visit = written(texts.join(per_text, "tag", "left").mapInArrow(_visit(length), VISIT), "visit")
    more = (visit.filter("bytes IS NOT NULL").select("tag", "anchor", "salt", "start", "n", "depth", "bytes")
            .repartition(n, "anchor", "salt")
            .mapInArrow(_compare(length), "tag bigint, start bigint, stop bigint"))
    more = more.groupBy("tag").agg(F.collect_list(F.struct("start", "stop")).alias("more"))
    done = visit.filter("kept_sha256 IS NOT NULL").select(*_CUT.names)
    late = (visit.filter("text IS NOT NULL").select("doc_id", "tag", "text", "spans")
            .join(more, "tag", "left").mapInArrow(_finish, CUT))
    return done.unionByName(late)
