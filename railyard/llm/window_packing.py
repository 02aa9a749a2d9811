"""Operator 12, order-preserving packing by dynamic programming.

The texts of a partition, in row order, are one run of token ids, each text
ended by an end id.  The run is cut into windows of at most ``capacity``
tokens; a window becomes a sequence, padded to ``capacity`` unless its length
is a power of two.  Cuts lie at ends of documents (free), at ends of sentences
and lines, or, where none comes for long, on a grid (both truncate a document,
at a penalty in tokens).  The program finds the windows that minimise

    padding + truncation penalties + a small cost per window

With ``cost[j]`` the least cost of the run up to cut j, padded windows need
the minimum of ``cost[i] + at[i]`` over the cuts i within ``capacity`` tokens
of j: a monotone queue gives it in constant time.  Windows of a power of two
are looked up by their exact length.  The program runs over bounded stretches;
the last windows of a stretch are opened again with the next one, so only the
end of a partition can leave a short window, and that is split into powers of
two if their cuts cost less than the padding.

Defined results.  Null text is empty: the end id only.  A null id is kept.
Repeated rows are packed each for itself.  Very long texts take as many
windows as they need.  Of equally cheap windows the longest is taken.  An
empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, python_ready, untagged
from .tokens import encoder, slices

STRETCH = 1 << 20         # tokens that one program is run over
REOPENED = 8              # last windows of a stretch that the next one decides
NO_END = 256              # after so many tokens without a cut, cuts on a grid
GRID = 32

PACKED = ("doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, "
          "sequence_id bigint, offset bigint")


@dataclass(frozen=True)
class Costs:
    """In tokens of padding."""

    sentence: float = 1.0     # cut at the end of a sentence or line
    grid: float = 24.0        # cut inside a sentence
    window: float = 32.0      # each sequence


# ---- where to cut -----------------------------------------------------------

class SentenceEnds:
    """Ends of sentences and lines in ids, by tables over the vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.line = np.array([b"\n" in t for t in tokens])
        stripped = [t.rstrip("\"')]”’»".encode()) if t.isascii() else t for t in tokens]
        self.stop = np.array([t[-1:] in (b".", b"!", b"?") or t.endswith("…".encode()) for t in stripped])
        self.wide = np.array([t.endswith(("。".encode(), "！".encode(), "？".encode())) for t in tokens])
        self.close = np.array([bool(t) and not t.strip("\"')]”’»".encode()) for t in tokens])
        self.blank = np.array([t[:1].isspace() for t in tokens])

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        """Places behind the tokens that end one."""
        stop = self.stop[ids]
        stop[1:] |= self.close[ids[1:]] & stop[:-1]
        blank = np.append(self.blank[ids[1:]], False)
        return np.flatnonzero(self.line[ids] | self.wide[ids] | stop & blank) + 1


_ENDS: dict = {}


def candidates(ends: np.ndarray, inner: np.ndarray, costs: Costs, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of possible cuts behind 0, ascending, and their penalties, from
    document ends and sentence ends."""
    no_end, grid = min(NO_END, capacity), min(GRID, capacity)
    at = np.union1d(ends, inner)
    gap = np.diff(at, prepend=0)
    wide = np.flatnonzero(gap > no_end)
    n = (gap[wide] - 1) // grid
    steps = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + 1
    extra = np.repeat(at[wide] - gap[wide], n) + steps * grid
    penalty = np.concatenate((np.where(np.isin(at, ends, assume_unique=True), 0.0, costs.sentence),
                              np.full(len(extra), costs.grid)))
    at = np.concatenate((at, extra))
    order = np.argsort(at, kind="stable")
    return at[order], penalty[order]


def best_cuts(at: np.ndarray, penalty: np.ndarray, capacity: int, costs: Costs, last: bool = True) -> list[int]:
    """Window bounds, 0 and the last place included, of least cost; ``last``:
    what is left at the end may be split into powers of two."""
    place = np.concatenate(([0], at)).astype(np.int64)
    before, behind = [], []
    power = 1
    while power < capacity:                           # windows that need no padding
        i = np.searchsorted(place, place - power)
        hit = np.flatnonzero(place[np.minimum(i, len(place) - 1)] == place - power)
        before.append(i[hit])
        behind.append(hit)
        power *= 2
    before, behind = np.concatenate(before or [[]]), np.concatenate(behind or [[]])
    order = np.argsort(behind, kind="stable")
    exact = before[order].astype(np.int64).tolist()
    first = np.searchsorted(behind[order], np.arange(len(place) + 1)).tolist()

    place, fixed = place.tolist(), [0.0, *(penalty + costs.window).tolist()]
    cost, came, key = [0.0], [0], [0.0]               # key: cost + place
    queue, head, low = [0], 0, 0                      # keys ascend along the queue
    for j in range(1, len(place)):
        here = place[j]
        while here - place[low] > capacity:
            head += 1
            low = queue[head]
        i, best = low, key[low] + capacity - here
        k, stop = first[j], first[j + 1]
        while k < stop:
            if cost[exact[k]] < best:
                i = exact[k]
                best = cost[i]
            k += 1
        best += fixed[j]
        came.append(i)
        cost.append(best)
        best += here
        key.append(best)
        if key[low] > best:                           # all that wait are dearer
            queue, head, low = [j], 0, j
            continue
        while key[queue[-1]] > best:
            queue.pop()
        queue.append(j)

    j = len(place) - 1
    bounds = [place[j]]
    if last and j:
        total = place[j]
        least, i = cost[j], came[j]
        split = False
        for k in range(j - 1, -1, -1):
            if total - place[k] > capacity:
                break
            n = (total - place[k]).bit_count()
            c = cost[k] + n * costs.window + (n - 1) * costs.grid + fixed[j] - costs.window
            if n > 1 and c < least:
                least, i, split = c, k, True
        if split:
            rest = total - place[i]
            while rest & (rest - 1):                  # smallest power last
                rest &= rest - 1
                bounds.append(place[i] + rest)
        bounds.append(place[i])
        j = i
    while j:
        j = came[j]
        bounds.append(place[j])
    return bounds[::-1]


# ---- a partition ------------------------------------------------------------

class _Run:
    """Documents of a partition whose windows are not settled yet; places
    count from the first token still open."""

    def __init__(self, capacity: int, costs: Costs, sequence: int):
        self.capacity, self.costs, self.sequence = capacity, costs, sequence
        self.ids = np.zeros(0, "<u4")
        self.doc: list = []
        self.begin = np.zeros(0, np.int64)            # below 0: partly settled
        self.tokens = np.zeros(0, np.int64)
        self.inner = np.zeros(0, np.int64)

    def add(self, doc: list, ids: np.ndarray, at: np.ndarray, inner: np.ndarray) -> None:
        base = len(self.ids)
        self.ids = np.concatenate((self.ids, ids))
        self.doc += doc
        self.begin = np.concatenate((self.begin, at[:-1] + base))
        self.tokens = np.concatenate((self.tokens, np.diff(at)))
        self.inner = np.concatenate((self.inner, inner + base))

    def settle(self, last: bool) -> pa.RecordBatch | None:
        if not len(self.ids):
            return None
        ends = self.begin + self.tokens
        bounds = best_cuts(*candidates(ends, self.inner, self.costs, self.capacity), self.capacity, self.costs, last)
        if not last:
            bounds = bounds[:-REOPENED]
            if len(bounds) < 2:
                return None
        bounds = np.array(bounds, np.int64)
        stop = int(bounds[-1])
        edge = np.unique(np.concatenate((bounds, self.begin[(self.begin > 0) & (self.begin < stop)])))
        begin, length = edge[:-1], np.diff(edge)
        doc = np.searchsorted(self.begin, begin, "right") - 1
        window = np.searchsorted(bounds, begin, "right") - 1
        raw = pa.py_buffer(self.ids[:stop].tobytes())
        body = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer((4 * edge).astype(np.int32)), raw])
        out = pa.RecordBatch.from_arrays(
            [pa.array([self.doc[i] for i in doc.tolist()], pa.int64()), pa.array(begin - self.begin[doc]),
             pa.array(length), body, pa.array(self.tokens[doc]), pa.array(window + self.sequence),
             pa.array(begin - bounds[window])],
            names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
        self.sequence += len(bounds) - 1
        open_ = int(np.searchsorted(ends, stop, "right"))
        self.ids, self.doc = self.ids[stop:], self.doc[open_:]
        self.begin, self.tokens = self.begin[open_:] - stop, self.tokens[open_:]
        self.inner = self.inner[self.inner > stop] - stop
        return out


def _pack(ranks_path: str, pattern: str, added: dict[str, int] | None, end_id: int, capacity: int, costs: Costs):
    def run(batches):
        enc = encoder(ranks_path, pattern, added)
        sentence_ends = _ENDS.get(ranks_path) or SentenceEnds(enc.tokens)
        _ENDS[ranks_path] = sentence_ends             # one per Python worker
        task = TaskContext.get().partitionId()
        open_ = _Run(capacity, costs, task << 40)
        for batch in batches:
            for lo, hi in slices(column(batch, "text")):
                part = batch.slice(lo, hi - lo)
                ids, at = enc.encode_all(column(part, "text"), end_id)
                open_.add(column(part, "doc_id").to_pylist(), ids, at, sentence_ends(ids))
                if len(open_.ids) >= STRETCH:
                    settled = open_.settle(last=False)
                    if settled is not None:
                        yield settled
        settled = open_.settle(last=True)
        if settled is not None:
            yield settled
    return run


def pack_windows(docs: DataFrame, ranks_path: str, pattern: str, end_id: int = 1, capacity: int = 2048,
                 added: dict[str, int] | None = None, costs: Costs = Costs(), id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their ids (unsigned little-endian 32-bit)
    and place: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.
    Nothing is shuffled: a partition is packed in its row order."""
    python_ready(docs.sparkSession)
    return untagged(docs, id_col, text_col).mapInArrow(
        _pack(ranks_path, pattern, added, end_id, capacity, costs), PACKED)


def padding(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """``sequence_id, tokens, padding`` of each sequence."""
    n = F.col("tokens")
    return (packed.groupBy("sequence_id").agg(F.sum("length").alias("tokens"))
            .select("sequence_id", "tokens",
                    F.when(n.bitwiseAND(n - 1) == 0, F.lit(0)).otherwise(capacity - n).alias("padding")))
