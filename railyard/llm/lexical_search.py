"""Operator 13, ranked lexical search over a length-stratified index.

The score of a document is the sum, over the terms of an item, of

    weight(term) * ((1000000000 * tf) div (1000 * tf + 12 * m))

where ``m`` grows with the document's length.  The index is dealt into
segments of documents.  In a segment documents of equal ``m`` form a stratum;
a term's postings are ordered by stratum and, within it, by ``tf``, so the
quotient above is computed once per term, stratum and tf, not per posting.
For an item, the largest ``tf`` of each term in a stratum bounds the scores of
the stratum's documents.  Strata are visited from the highest bound down,
until the bound is below the k-th best score found by the task so far; what is
left can't enter the ranking.  Scores are exact 64-bit integers.

Items are read in bounded blocks, each joined to all segments; a task returns
its best k of each item, which are merged by two ranked windows.  A segment is
a large row, so the index holds about one in a row group, and one at a time
goes to Python: a task's memory goes by a segment and the postings it has of
the block's terms, not by how many segments its split holds.

Defined results.  Null text has no term and is never found; an item without
terms finds nothing.  Equal scores rank by ascending id, null ids last.
Repeated rows of documents are found each for itself, repeated items are
answered each for itself.  Very long texts count whole.  Empty tables give no
rows.  Other columns are not read.
"""

from __future__ import annotations

import collections
import contextlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, python_ready, small_join, text_of, untagged, written

SEGMENT_TOKENS = 1 << 21      # terms with repeats of a segment
SEGMENT_DOCS = 1 << 16
BLOCK_TERMS = 1 << 16         # distinct terms of a block of items
BUCKETS = 64                  # first of the two ranked windows
ROW_GROUP = 1 << 23           # bytes of the index that are read at once, or one segment

# Bytes of UTF-8 that belong to terms, A-Z lower-cased, all others blank.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

SIZES = "docs bigint, terms decimal(38,0)"
SEGMENT = ("slot int, n_docs int, doc_ids array<bigint>, strata array<int>, stratum_docs array<int>, terms array<binary>, "
           "df array<int>, runs array<int>, run_stratum binary, run_tf binary, run_docs binary, postings binary")
FOUND = "query bigint, bucket int, doc_id bigint, score bigint"


@dataclass(frozen=True)
class Index:
    """Written segments of all documents with a term, their number ``n`` and
    the number ``length`` of their terms with repeats."""

    segments: DataFrame
    n: int
    length: int


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of letters and digits of ASCII and of all else beyond it."""
    return text.translate(_LOWER).split()


def stratum_of(n_terms, n: int, length: int):
    """A document's ``m``: numbers, or whole arrays of them."""
    return 75 + (25 * n_terms * n) // length


# ---- the index --------------------------------------------------------------

def _measure(batches):
    """Documents with a term and their terms, per batch."""
    for batch in batches:
        texts = column(batch, "text").cast(pa.binary())
        sizes = [len(terms_of(t.as_py())) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [pa.array([sum(s > 0 for s in sizes)], pa.int64()), pa.array([sum(sizes)], pa.decimal128(38, 0))],
            names=["docs", "terms"])


class _Vocabulary(dict):
    """Number of each term, new ones numbered as they come."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def _segment(doc_ids: list, sizes: list[int], numbers: list[np.ndarray], vocabulary: _Vocabulary, n: int,
             length: int) -> dict:
    """Documents by stratum; postings by term, stratum and tf."""
    if n * max(sizes) < 1 << 57:
        m = stratum_of(np.array(sizes, np.int64), n, length)
    else:
        m = np.array([stratum_of(s, n, length) for s in sizes], np.int64)
    by_m = np.argsort(m, kind="stable")
    place = np.empty(len(by_m), np.int64)
    place[by_m] = np.arange(len(by_m))                # documents in order of strata
    strata, stratum_docs = np.unique(m, return_counts=True)

    pair, tf = np.unique(np.concatenate(numbers) * len(by_m) + np.repeat(place, sizes), return_counts=True)
    term, doc = pair // len(by_m), pair % len(by_m)
    stratum = np.repeat(np.arange(len(strata)), stratum_docs)[doc]
    order = np.lexsort((tf, stratum, term))
    term, doc, stratum, tf = term[order], doc[order], stratum[order], tf[order]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (stratum[1:] != stratum[:-1]) | (tf[1:] != tf[:-1])
    head = np.flatnonzero(new)
    return {"slot": 0, "n_docs": len(by_m), "doc_ids": [doc_ids[i] for i in by_m.tolist()], "strata": strata,
            "stratum_docs": stratum_docs, "terms": list(vocabulary),
            "df": np.bincount(term, minlength=len(vocabulary)),
            "runs": np.bincount(term[head], minlength=len(vocabulary)),
            "run_stratum": stratum[head].astype("<u2").tobytes(), "run_tf": tf[head].astype("<u4").tobytes(),
            "run_docs": np.diff(np.append(head, len(term))).astype("<u4").tobytes(),
            "postings": doc.astype("<u2").tobytes()}


_SEGMENT_TYPES = pa.schema(
    [("slot", pa.int32()), ("n_docs", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("strata", pa.list_(pa.int32())),
     ("stratum_docs", pa.list_(pa.int32())), ("terms", pa.list_(pa.binary())), ("df", pa.list_(pa.int32())),
     ("runs", pa.list_(pa.int32())), ("run_stratum", pa.binary()), ("run_tf", pa.binary()),
     ("run_docs", pa.binary()), ("postings", pa.binary())])


def _segments(n: int, length: int):
    def run(batches):
        ids, sizes, numbers, total, vocabulary = [], [], [], 0, _Vocabulary()

        def flush():
            row = _segment(ids, sizes, numbers, vocabulary, n, length)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in
                                               zip(row.values(), _SEGMENT_TYPES, strict=True)], schema=_SEGMENT_TYPES)
        for batch in batches:
            docs, texts = column(batch, "doc_id"), column(batch, "text").cast(pa.binary())
            for i in range(len(texts)):
                terms = terms_of(texts[i].as_py())
                if not terms:
                    continue
                if total and total + len(terms) > SEGMENT_TOKENS or len(ids) == SEGMENT_DOCS:
                    yield flush()
                    ids, sizes, numbers, total, vocabulary = [], [], [], 0, _Vocabulary()
                ids.append(docs[i].as_py())
                sizes.append(len(terms))
                numbers.append(np.fromiter(map(vocabulary.__getitem__, terms), np.int64, len(terms)))
                total += len(terms)
        if ids:
            yield flush()
    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Index every document; the segments are a written table."""
    python_ready(docs.sparkSession)
    rows = untagged(docs, id_col, text_col)
    size = rows.select("text").mapInArrow(_measure, SIZES).agg(F.sum("docs"), F.sum("terms")).first()
    n, length = int(size[0] or 0), int(size[1] or 0)
    # sizes are looked at after every row: a hundred segments would be held until the first look
    by_rows = {"parquet.block.size": ROW_GROUP, "parquet.page.size.row.check.min": 1}
    return Index(written(rows.mapInArrow(_segments(n, length), SEGMENT), "segments", by_rows), n, length)


# ---- items ------------------------------------------------------------------

def _item_terms(batches):
    for batch in batches:
        queries, texts = column(batch, "query"), column(batch, "text").cast(pa.binary())
        rows = [(q, t, c) for q, x in zip(queries.to_pylist(), texts, strict=True)
                for t, c in collections.Counter(terms_of(x.as_py())).items()]
        cols = list(zip(*rows, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()),
                                          pa.array(cols[2], pa.int64())], names=["query", "term", "times"])


def weighted_terms(index: Index, items: DataFrame) -> DataFrame:
    """``query, term, times, weight`` of ``items`` (``query, text``), only of
    terms that the index holds."""
    asked = written(items.mapInArrow(_item_terms, "query bigint, term binary, times bigint"), "asked")
    held = index.segments.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).select("t.terms", "t.df")
    wanted = asked.select(F.col("term").alias("terms")).distinct()
    df = small_join(held, wanted, "terms", "left_semi").groupBy("terms").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.n + 2.0) / (2.0 * F.col("df") + 1.0))).cast("bigint")
    return asked.join(df.select(F.col("terms").alias("term"), weight.alias("weight")), "term")


def blocks(terms: DataFrame) -> DataFrame:
    """Whole items in blocks of about ``BLOCK_TERMS`` distinct terms: ``block,
    queries, terms, times, weights``, one row each."""
    sizes = terms.groupBy("query").agg(F.count(F.lit(1)).alias("size"))
    n = max(1, math.ceil((sizes.agg(F.sum("size")).first()[0] or 0) / BLOCK_TERMS))
    block = F.pmod(F.xxhash64("query"), F.lit(n)).cast("int")
    return written(terms.groupBy(block.alias("block")).agg(F.collect_list(F.struct("query", "term", "times", "weight"))
                                                           .alias("asked")), "blocks")


# ---- search -----------------------------------------------------------------

def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Concatenated ``start[i] .. start[i] + size[i]``."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)


class _Best:
    """The k best of an item so far, as ``(score, id, no id)``."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def least(self) -> int:
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        rows = [(s, i) for s, i in zip(scores.tolist(), ids, strict=True) if s > 0]
        self.rows = sorted(self.rows + rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[:self.k]


def quotients(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Segment:
    """A segment's strata and the postings of some terms."""

    def __init__(self, row: dict, wanted: dict[bytes, int]):
        """``wanted``: weight of each term that any item holds."""
        self.doc_ids = row["doc_ids"]
        self.m = np.array(row["strata"], np.int64)
        self.first_doc = np.concatenate(([0], np.cumsum(row["stratum_docs"], dtype=np.int64)))
        size = np.frombuffer(row["run_docs"], "<u4")
        held = [(k, t) for k, t in enumerate(row["terms"]) if t in wanted]
        number = np.array([k for k, _ in held], np.int64)
        runs = np.array(row["runs"], np.int64)
        run = _ranges((np.cumsum(runs) - runs)[number], runs[number])
        self.place = {t: k for k, (_, t) in enumerate(held)}
        term = np.repeat(np.arange(len(held)), runs[number])
        weight = np.array([wanted[t] for _, t in held], np.int64)[term]
        first, size = (np.cumsum(size, dtype=np.int64) - size)[run], size[run].astype(np.int64)
        stratum = np.frombuffer(row["run_stratum"], "<u2")[run].astype(np.int64)
        tf = np.frombuffer(row["run_tf"], "<u4")[run].astype(np.int64)
        impact = weight * quotients(tf, self.m[stratum])                # once per term, stratum and tf
        self.docs = np.frombuffer(row["postings"], "<u2")[_ranges(first, size)]
        self.impact = np.repeat(impact, size)
        # bounds and first postings by term and stratum, of the pairs that have any
        new = np.ones(len(run), bool)
        new[1:] = (term[1:] != term[:-1]) | (stratum[1:] != stratum[:-1])
        head = np.flatnonzero(new)
        self.stratum = stratum[head]
        self.bound = np.maximum.reduceat(impact, head) if len(head) else impact
        self.count = np.add.reduceat(size, head) if len(head) else size
        self.first = np.cumsum(self.count) - self.count
        self.first_cell = np.concatenate(([0], np.cumsum(np.bincount(term[head], minlength=len(held)))))

    def search(self, terms: list[bytes], times: list[int], best: _Best, visit: int = 1024) -> int:
        """Rank an item's documents; the number of documents visited."""
        known = [(self.place[t], c) for t, c in zip(terms, times, strict=True) if t in self.place]
        if not known:
            return 0
        rows, times = np.array([r for r, _ in known]), np.array([c for _, c in known], np.int64)
        cells = self.first_cell[rows + 1] - self.first_cell[rows]
        cell, times = _ranges(self.first_cell[rows], cells), np.repeat(times, cells)
        stratum = self.stratum[cell]
        bound = np.zeros(len(self.m), np.int64)
        np.add.at(bound, stratum, times * self.bound[cell])
        order = np.argsort(-bound, kind="stable")
        n_docs = np.diff(self.first_doc)
        lo, seen = 0, 0
        while lo < len(order) and bound[order[lo]] >= best.least:
            hi, docs = lo, 0
            while hi < len(order) and docs < visit and bound[order[hi]] >= best.least:
                docs += int(n_docs[order[hi]])
                hi += 1
            strata = np.sort(order[lo:hi])
            picked = np.zeros(len(self.m), bool)
            picked[strata] = True
            picked = picked[stratum]
            count = self.count[cell[picked]]
            at = _ranges(self.first[cell[picked]], count)
            gain = self.impact[at] * np.repeat(times[picked], count)
            score = np.zeros(len(self.doc_ids), np.int64)
            np.add.at(score, self.docs[at], gain)
            found = _ranges(self.first_doc[strata], n_docs[strata])
            found = found[score[found] >= best.least]
            if len(found) > best.k:
                edge = np.partition(score[found], len(found) - best.k)[len(found) - best.k]
                found = found[score[found] >= edge]
            best.add(score[found], [self.doc_ids[i] for i in found.tolist()])
            lo, seen = hi, seen + docs
        return seen


def _search(k: int):
    def run(batches):
        best: dict[tuple[int, int], _Best] = {}
        asked = block = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: column(batch, name)[i] for name in batch.schema.names}
                if block != row["block"].as_py():
                    block = row["block"].as_py()
                    asked = collections.defaultdict(list)
                    weights = {}
                    for r in row["asked"].as_py():
                        asked[r["query"]].append((r["term"], r["times"]))
                        weights[r["term"]] = r["weight"]
                segment = Segment({n: row[n].as_py() for n in row if n not in ("slot", "block", "asked")}, weights)
                for query, terms in asked.items():
                    mine = best.setdefault(query, _Best(k))
                    segment.search(*map(list, zip(*terms, strict=True)), mine)
        rows = [(q, *r) for q, b in best.items() for r in b.rows]
        if rows:
            query, score, doc = map(list, zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(doc, pa.int64()),
                                              pa.array(score, pa.int64())], names=["query", "doc_id", "score"])
    return run


@contextlib.contextmanager
def _row_by_row(spark: SparkSession):
    """Rows go to Python one at a time in what is run inside: a batch would
    be filled with segments up to 64 MB, on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "1")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def search(index: Index, items: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of each item."""
    python_ready(items.sparkSession)
    asked = written(items.select(F.col(id_col).alias("item_id"), text_of(text_col).alias("text"),
                                 F.monotonically_increasing_id().alias("query")), "items")
    found = None
    packed = blocks(weighted_terms(index, asked.select("query", "text")))
    for (block,) in sorted(packed.select("block").collect()):
        # each segment waits at slot 0 for this block: BLOCK_TERMS at most, or one item
        one = packed.filter(F.col("block") == block).withColumn("slot", F.col("block") - block)
        with _row_by_row(items.sparkSession):
            part = written(index.segments.drop("n_docs", "df").join(F.broadcast(one), "slot")
                           .mapInArrow(_search(k), "query bigint, doc_id bigint, score bigint"), "found")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return asked.filter("false").select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("doc_id"),
                                            F.lit(0).cast("bigint").alias("score"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    bucket = F.pmod(F.xxhash64("doc_id", "score"), F.lit(BUCKETS))
    near = Window.partitionBy("query", "bucket").orderBy(*order)
    all_ = Window.partitionBy("query").orderBy(*order)
    top = (found.withColumn("bucket", bucket).withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= k)
           .withColumn("rank", F.row_number().over(all_)).filter(F.col("rank") <= k))
    return asked.select("query", "item_id").join(top, "query").select("item_id", "rank", "doc_id", "score")
