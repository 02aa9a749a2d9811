"""Operator 5, quality classifier by co-training.

Two views of a document: its text content (hashed byte 3-grams) and its page
metadata (language, source, stated length, and the page's shape: lines, line
and word lengths, shares of kinds of characters).  A classifier per view is
fit on labelled documents; over rounds each view's most confident unlabelled
documents, in the labels' proportion, are given to the other view with its
pseudo-label.  Both views are calibrated on labelled documents kept out of
training and combined there; the combination scores every whole document.

Fitting reads a bounded sample: ``labelled`` and ``pool`` documents of the
smallest id hashes.

Defined results.  Null text is empty.  Null language or source is a kind of
its own; a null stated length is zero.  Labels that are null, repeated with
both values, or name no document are ignored.  Without labels of both kinds
nothing is rejected: all scores are 1.  Texts of any length are read whole, in
blocks.  Of rows with one id the first teaches, all are scored.  An empty table gives no rows.  Other
columns are not read, and a row stays one row however often it is labelled.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, column, numbered, python_ready, text_of, written
from .linear import fit_dense, fit_sparse, mean_scores, sigmoid, sparse, spans

ROUNDS = 4
HASHED = 32               # places for the names of languages, and of sources
KINDS = 10

RESULT = "doc_id bigint, tag bigint, score double, text_score double, page_score double"


def _lut() -> np.ndarray:
    """Letters and marks as they are, digits alike."""
    lut = np.arange(256, dtype=np.uint8)
    lut[48:58] = 48
    return lut


def _kind_lut() -> np.ndarray:
    """Kind of each byte: 0 lower, 1 upper, 2 digit, 3 blank, 4 line break,
    5 sentence mark, 6 bar, 7 other ASCII mark, 8 other script, 9 control."""
    lut = np.full(256, 7, np.uint8)
    lut[97:123], lut[65:91], lut[48:58], lut[128:] = 0, 1, 2, 8
    lut[:32] = 9
    lut[[32, 9]], lut[[10, 13]], lut[[124]] = 3, 4, 6
    lut[[ord(c) for c in ".,;:?'\"()-"]] = 5
    return lut


LUT, KIND = _lut(), _kind_lut()


# ---- views ----------------------------------------------------------------

def shapes(texts: pa.Array) -> np.ndarray:
    """Page shape of each text: bytes by kind, words and longest word share."""
    offsets, data = buffers(texts)
    n = len(texts)
    counts, words = np.zeros((n, KINDS)), np.zeros(n)
    for i, j, a, b in spans(offsets):
        kind = KIND[data[a:b]]
        if j - i == 1:
            if a > offsets[i]:
                kind = kind[2:]                # blocks of a long text overlap
            row = np.full(len(kind), i)
        else:
            row = np.repeat(np.arange(i, j), np.diff(offsets[i:j + 1]))
        flat = np.bincount((row - i) * KINDS + kind, minlength=(j - i) * KINDS)
        counts[i:j] += flat.reshape(-1, KINDS)
        gap = (kind == 3) | (kind == 4)
        starts = ~gap & np.concatenate(([True], gap[:-1] | (row[1:] != row[:-1])))
        words[i:j] += np.bincount(row[starts] - i, minlength=j - i)
    size = np.maximum(counts.sum(1), 1)
    lines = counts[:, 4] + 1
    return np.column_stack([counts / size[:, None], np.log1p(size), np.log1p(words),
                            np.log1p(size / lines), np.log1p(size / np.maximum(words, 1)),
                            np.log1p(lines)])


def _hashed(names: list) -> np.ndarray:
    out = np.zeros((len(names), HASHED))
    for i, name in enumerate(names):
        out[i, 0 if name is None else 1 + zlib.crc32(name.encode("utf-8", "surrogatepass")) % (HASHED - 1)] = 1
    return out


def pages(batch) -> np.ndarray:
    stated = np.asarray(column(batch, "n_chars").fill_null(0)).astype(np.float64)
    return np.column_stack([shapes(column(batch, "text")), np.log1p(np.maximum(stated, 0)),
                            _hashed(column(batch, "lang").to_pylist()),
                            _hashed(column(batch, "source").to_pylist())])


# ---- fitting --------------------------------------------------------------

def _platt(score: np.ndarray, y: np.ndarray) -> np.ndarray:
    return fit_dense(score[:, None], y, ridge=1e-4)


def _subset(row, place, share, chosen):
    number = np.full(int(row.max()) + 1 if len(row) else 1, -1)
    number[chosen[chosen < len(number)]] = np.flatnonzero(chosen < len(number))
    keep = number[row] >= 0
    order = np.argsort(number[row[keep]], kind="stable")
    return number[row[keep]][order], place[keep][order], share[keep][order]


def cotrain(grams, page: np.ndarray, label: np.ndarray, held: np.ndarray, rounds: int = ROUNDS) -> dict:
    """Model of both views.  ``label`` is 0, 1 or -1 (unlabelled); ``held``
    marks labelled rows kept for calibration."""
    mean, spread = page.mean(0), page.std(0) + 1e-6
    x = (page - mean) / spread
    n = len(label)
    know = {v: np.where(held, -1, label).astype(np.int64) for v in ("text", "page")}
    sure = {v: (know[v] >= 0).astype(np.float64) for v in know}
    good = label[(label >= 0) & ~held].mean()
    pool = np.flatnonzero(label < 0)
    per_round = max(1, len(pool) // (2 * max(rounds, 1)))
    found = None
    for turn in range(rounds + 1):
        chosen = np.flatnonzero(know["text"] >= 0)
        found = fit_sparse(*_subset(*grams, chosen), know["text"][chosen, None].astype(float),
                           sure["text"][chosen], steps=60 if found is None else 20, start=found)
        weights, bias = found
        text = np.bincount(grams[0], weights=weights[grams[1], 0] * grams[2], minlength=n) + bias[0]
        chosen = np.flatnonzero(know["page"] >= 0)
        beta = fit_dense(x[chosen], know["page"][chosen].astype(float), sure["page"][chosen])
        by_page = x @ beta[:-1] + beta[-1]
        if turn == rounds:
            break
        for score, other in ((text, "page"), (by_page, "text")):
            open_ = pool[know[other][pool] < 0]
            order = open_[np.argsort(score[open_], kind="stable")]
            k = min(per_round, len(order))
            low, high = order[:round(k * (1 - good))], order[len(order) - round(k * good):]
            for rows, value in ((low[score[low] < 0], 0), (high[score[high] > 0], 1)):
                know[other][rows] = value
                sure[other][rows] = 0.5            # a pseudo-label counts half
    y = label[held].astype(float)
    a, b = _platt(text[held], y), _platt(by_page[held], y)
    views = np.column_stack([a[0] * text[held] + a[1], b[0] * by_page[held] + b[1]])
    both = fit_dense(views, y, ridge=1e-3)
    return {"weights": weights.astype(np.float32), "bias": float(bias[0]), "beta": beta, "mean": mean,
            "spread": spread, "text": a, "page": b, "both": both}


def scores(batch, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    text = mean_scores(column(batch, "text"), LUT, model["weights"])[:, 0] + model["bias"]
    page = (pages(batch) - model["mean"]) / model["spread"] @ model["beta"][:-1] + model["beta"][-1]
    a, b = (m[0] * s + m[1] for m, s in ((model["text"], text), (model["page"], page)))
    both = model["both"]
    return sigmoid(both[0] * a + both[1] * b + both[2]), sigmoid(a), sigmoid(b)


def _fit(rounds: int):
    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        label = np.asarray(column(table, "label")).astype(np.int64)
        known = np.flatnonzero(label >= 0)
        held = np.zeros(len(label), bool)
        for value in (0, 1):                       # every fourth of each kind
            held[known[label[known] == value][3::4]] = True
        if min((label[held] == v).sum() for v in (0, 1)) == 0:
            return
        model = cotrain(sparse(column(table, "text"), LUT), pages(table), label, held, rounds)
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})
    return run


def _views(docs: DataFrame, id_col, text_col, lang_col, source_col, length_col) -> DataFrame:
    return numbered(docs, "tag", F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"),
                    F.col(lang_col).cast("string").alias("lang"),
                    F.col(source_col).cast("string").alias("source"),
                    F.col(length_col).cast("bigint").alias("n_chars"))


def train(rows: DataFrame, labels: DataFrame, labelled: int = 2400, pool: int = 2400, rounds: int = ROUNDS,
          label_id: str = "doc_id", label_col: str = "quality"):
    """Model, or None without labels of both kinds.  ``rows`` are ``_views``."""
    python_ready(rows.sparkSession)
    named = (labels.select(F.col(label_id).cast("bigint").alias("doc_id"),
                           F.col(label_col).cast("int").alias("label"))
             .filter("doc_id IS NOT NULL AND label IN (0, 1)")
             .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most"))
             .filter("label = most").select("doc_id", "label"))
    by = F.xxhash64("doc_id", F.lit(5))
    ids = rows.select("doc_id").filter("doc_id IS NOT NULL").distinct()
    taught = ids.join(named, "doc_id").orderBy(by).limit(labelled)
    free = (ids.join(named, "doc_id", "left_anti").orderBy(by).limit(pool)
            .select("doc_id", F.lit(-1).alias("label")))
    chosen = taught.unionByName(free)                                # labelled + pool ids at most
    # the first row of each: its place is found without the texts
    first = (rows.select("doc_id", "tag").join(F.broadcast(chosen), "doc_id")
             .groupBy("doc_id").agg(F.min("tag").alias("tag"), F.min("label").alias("label")))
    sample = (rows.join(F.broadcast(written(first, "chosen")), ["doc_id", "tag"])
              .repartition(1).sortWithinPartitions(by))
    got = sample.mapInArrow(_fit(rounds), "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else None


def _score(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            n = batch.num_rows
            got = (np.ones(n),) * 3 if model is None or not n else scores(batch, model)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "tag"),
                                              *map(pa.array, got)],
                                             names=["doc_id", "tag", "score", "text_score", "page_score"])
    return run


def classify(docs: DataFrame, labels: DataFrame, labelled: int = 2400, pool: int = 2400, rounds: int = ROUNDS,
             id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             source_col: str = "source", length_col: str = "n_chars") -> DataFrame:
    """``doc_id, tag, score, text_score, page_score`` of every document: the
    probability that its quality is 1, by both views and by each."""
    spark = docs.sparkSession
    rows = _views(docs, id_col, text_col, lang_col, source_col, length_col)
    model = train(rows, labels, labelled, pool, rounds)
    shared = spark.sparkContext.broadcast(model)      # a fixed number of weights
    return rows.mapInArrow(_score(shared), RESULT)
