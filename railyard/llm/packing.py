"""Operator 7, best-fit packing by swap-based local search.

Texts become token ids plus an end id; only longer ones are cut into pieces of
``capacity`` tokens, the first piece taking the remainder.  Full pieces are
sequences by themselves.  The others are dealt to bounded groups.  A group is
packed best-fit first; then the least filled bins are emptied: a piece moves
to a fuller bin, or is exchanged one-for-one or two-for-one, whenever that
increases the sum of squared fills, until a bin is empty or nothing improves.
Bins still underfull are dissolved and packed again together, until they fit
one group, so groups cost a few bins in all and no task sees all pieces.

Defined results.  Null text is empty: one piece with the end id only.  A null
id is kept.  Repeated rows are packed each for itself.  Very long texts take as
many full sequences as they need.  Of bins with equal room the last used is
filled first, of equal changes the first is made.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, python_ready, tagged, written
from .tokens import encoder, slices

GROUP = 16_384            # pieces that are packed together
UNDERFULL = 0.98          # bins filled less are packed again

PIECES = ("doc_id bigint, tag bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
PLACED = PIECES + ", bin int, offset bigint, fill bigint"


# ---- pieces ---------------------------------------------------------------

def _cut(ranks_path: str, pattern: str, end_id: int, capacity: int, added: dict[str, int] | None):
    def run(batches):
        enc = encoder(ranks_path, pattern, added)
        for batch in batches:
            for lo, hi in slices(column(batch, "text")):
                part = batch.slice(lo, hi - lo)
                ids, at = enc.encode_all(column(part, "text"), end_id)
                row, piece, start, length = cuts(np.diff(at), capacity)
                raw, begin = memoryview(ids.tobytes()), 4 * (at[row] + start)
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(begin.tolist(), (begin + 4 * length).tolist(),
                                                            strict=True)]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [column(part, "doc_id").take(take), column(part, "tag").take(take),
                     pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    names=["doc_id", "tag", "piece", "start", "length", "ids_crc32"])
    return run


def cuts(tokens: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, number, start and length of the pieces of texts of so many tokens
    (one at least): all pieces but a text's first are full."""
    n = -(-tokens // capacity)
    row = np.repeat(np.arange(len(tokens)), n)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    head = ((tokens - 1) % capacity + 1)[row]
    start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
    return row, piece, start, np.where(piece == 0, head, capacity)


def pieces(docs: DataFrame, ranks_path: str, pattern: str, end_id: int = 2, capacity: int = 1024,
           id_col: str = "doc_id", text_col: str = "text", added: dict[str, int] | None = None) -> DataFrame:
    """Pieces of all texts; ``added`` are tokens that the vocabulary's own
    library finds in any text (``tokens.added_tokens``)."""
    python_ready(docs.sparkSession)
    return tagged(docs, id_col, text_col).mapInArrow(
        _cut(ranks_path, pattern, end_id, capacity, added), PIECES)


# ---- one group ------------------------------------------------------------

def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece: longest first, into the fullest bin it fits."""
    where = np.zeros(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, bins
            bins += 1
        where[i] = b
        by_room[room - size].append(b)
        rooms |= 1 << (room - size)
    return where


def local_search(sizes: np.ndarray, where: np.ndarray, capacity: int) -> np.ndarray:
    """Moves and exchanges between underfull bins, each increasing the sum of
    squared fills; stops at the lower bound or when nothing improves."""
    where = where.copy()
    n_bins = int(where.max()) + 1
    fill = np.bincount(where, weights=sizes, minlength=n_bins).astype(np.int64)
    least = math.ceil(int(sizes.sum()) / capacity)
    used = n_bins
    improved = True
    while improved and used > least:
        improved = False
        under = np.flatnonzero((fill > 0) & (fill < capacity))
        item = np.flatnonzero(np.isin(where, under))
        size = sizes[item]
        for a in under[np.argsort(fill[under], kind="stable")].tolist():
            if used <= least:
                break
            while fill[a]:
                own = item[where[item] == a]
                room = np.where((np.arange(n_bins) != a) & (fill > 0), capacity - fill, -1)
                if not _step(a, own, item, size, sizes, where, fill, room):
                    break
                improved = True
            if not fill[a]:
                used -= 1
    return where


def _step(a, own, item, size, sizes, where, fill, room) -> bool:
    """One change that takes tokens out of bin ``a``; False if there is none."""
    for i in own[np.argsort(-sizes[own], kind="stable")].tolist():   # move
        left = room - sizes[i]
        ok = np.flatnonzero((left >= 0) & (fill + sizes[i] > fill[a]))
        if len(ok):
            b = int(ok[np.argmin(left[ok])])
            where[i] = b
            fill[a] -= sizes[i]
            fill[b] += sizes[i]
            return True
    there = where[item]
    fills, rooms = fill[there], room[there]
    singles = {int(sizes[i]): (i,) for i in own.tolist()}
    pairs = {}
    kinds = sorted(singles)
    many = np.unique(sizes[own], return_counts=True)
    often = dict(zip(many[0].tolist(), many[1].tolist(), strict=True))
    by_size: dict[int, list[int]] = {}
    for i in own.tolist():
        by_size.setdefault(int(sizes[i]), []).append(i)
    for x, s in enumerate(kinds):                                    # one or two for one
        for t in kinds[x:]:
            if s != t:
                pairs[s + t] = (by_size[s][0], by_size[t][0])
            elif often[s] > 1:
                pairs[s + t] = (by_size[s][0], by_size[s][1])
    for give in (singles, pairs):
        for total in sorted(give, reverse=True):
            gain = total - size
            ok = np.flatnonzero((gain > 0) & (gain <= rooms) & (fills + gain > fill[a]))
            if len(ok):
                k = int(ok[np.argmin(rooms[ok] - gain[ok])])
                b, j = int(there[k]), int(item[k])
                for i in give[total]:
                    where[i] = b
                where[j] = a
                fill[a] -= gain[k]
                fill[b] += gain[k]
                return True
    return False


def _pack(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        sizes = np.asarray(column(table, "length")).astype(np.int64)
        where = local_search(sizes, best_fit(sizes, capacity), capacity)
        order = np.argsort(where, kind="stable")
        bins, lengths = where[order], sizes[order]
        first = np.concatenate(([True], bins[1:] != bins[:-1]))
        before = np.cumsum(lengths) - lengths
        offset = before - np.repeat(before[first], np.diff(np.append(np.flatnonzero(first), len(bins))))
        fill = np.bincount(where, weights=sizes).astype(np.int64)[bins]
        out = table.take(pa.array(order))
        return pa.Table.from_arrays(
            [column(out, c) for c in ("doc_id", "tag", "piece", "start", "length", "ids_crc32")]
            + [pa.array(bins, pa.int32()), pa.array(offset), pa.array(fill)],
            names=["doc_id", "tag", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill"])
    return run


# ---- all groups -----------------------------------------------------------

def pack(parts: DataFrame, capacity: int = 1024) -> DataFrame:
    """Sequence and offset of each piece of a written ``pieces`` table."""
    python_ready(parts.sparkSession)
    cols = ["doc_id", "tag", "piece", "start", "length", "ids_crc32"]
    done = (parts.filter(F.col("length") >= capacity)
            .select(*cols, (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
                    F.lit(0).cast("bigint").alias("offset")))
    pool, turn = parts.filter(F.col("length") < capacity).select(*cols), 0
    left = pool.count()
    while left:
        groups = math.ceil(left / GROUP)
        packed = written(pool.withColumn("grp", F.pmod(F.xxhash64("tag", "piece", F.lit(turn)),
                                                       F.lit(groups)).cast("int"))
                         .groupBy("grp").applyInArrow(_with_group(capacity), PLACED + ", grp int"),
                         "packed")
        again = F.col("fill") < F.lit(int(UNDERFULL * capacity))
        loose = packed.filter(again).count() if groups > 1 else 0
        last = loose == 0 or loose >= left
        kept = packed if last else packed.filter(~again)
        number = (F.lit(turn).cast("bigint") * (1 << 56) + F.col("grp").cast("bigint") * (1 << 24)
                  + F.col("bin"))
        done = done.unionByName(kept.select(*cols, number.alias("sequence_id"), "offset"))
        if last:
            break
        pool, left, turn = packed.filter(again).select(*cols), loose, turn + 1
    return done


def _with_group(capacity: int):
    inner = _pack(capacity)

    def run(table: pa.Table) -> pa.Table:
        out = inner(table)
        grp = pa.array(np.full(out.num_rows, column(table, "grp")[0].as_py(), np.int32))
        return out.append_column("grp", grp)
    return run


def best_fit_packing(docs: DataFrame, ranks_path: str, pattern: str, end_id: int = 2, capacity: int = 1024,
                     id_col: str = "doc_id", text_col: str = "text",
                     added: dict[str, int] | None = None) -> DataFrame:
    """``doc_id, tag, piece, start, length, ids_crc32, sequence_id, offset``."""
    return pack(written(pieces(docs, ranks_path, pattern, end_id, capacity, id_col, text_col, added),
                        "pieces"), capacity)
