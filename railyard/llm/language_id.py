"""Operator 2, language identification by error-correcting output codes.

Every language gets a codeword.  One binary n-gram classifier per bit is fit
on a bounded sample of labelled texts (``per_language`` texts of each
language, chosen by a hash of the text).  A text is decoded to the codeword of
least loss: logistic losses of all bits, each weighted by how well its
classifier does on the sample's held-back part.  Texts whose best and second
codeword are close are flagged ``ambiguous``.

Defined results.  Null text, or text without a letter, gets ``und``, score 0
and no ambiguity.  Without any labelled text everything is ``und``; with one
language every text with a letter is that language.  Of equally near codewords
that of the first language by name wins (and is ambiguous).  Whole texts are
read, of any length; repeated rows are predicted each, and taught once.  An
empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, python_ready, small_join, text_of, untagged
from .linear import fit_sparse, mean_scores, sigmoid, sparse

UNKNOWN = "und"
MARGIN = 0.5              # a smaller lead of the best codeword is ambiguous

MODEL = "langs array<string>, code binary, weights binary, bias binary, trust binary"


def _lut() -> np.ndarray:
    """ASCII letters and all bytes of other scripts stay; the rest is a blank."""
    lut = np.arange(256, dtype=np.uint8)
    letter = ((lut >= 65) & (lut <= 90)) | ((lut >= 97) & (lut <= 122)) | (lut >= 128)
    return np.where(letter, lut, 32).astype(np.uint8)


LUT = _lut()


def _prepared(texts: pa.Array) -> pa.Array:
    texts = texts.cast(pa.large_string())
    blank = pa.scalar(" ", pa.large_string())
    return pc.binary_join_element_wise(blank, pc.utf8_lower(texts), blank, pa.scalar("", pa.large_string()))


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """``n`` codewords of 0/1: all splits of the languages up to seven
    (every two words then differ in half the bits), else the random code of
    10 log2(n) bits with the largest least distance of 64 drawn."""
    if n <= 7:
        splits = np.arange(1, 2 ** (n - 1))
        return np.array([[(s >> k) & 1 for s in splits] for k in range(n)], np.int8).reshape(n, -1)
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(64):
        code = rng.integers(0, 2, (n, int(np.ceil(10 * np.log2(n)))), dtype=np.int8)
        code = code[:, (code.min(0) == 0) & (code.max(0) == 1)]
        apart = min(int((code[i] != code[i + 1:]).sum(1).min()) for i in range(n - 1))
        if apart > far:
            best, far = code, apart
    return best


def losses(scores: np.ndarray, code: np.ndarray, trust: np.ndarray) -> np.ndarray:
    """Weighted logistic loss of every codeword for every row of scores."""
    out = np.zeros((len(scores), len(code)))
    for k, word in enumerate(code):
        margin = scores * (2.0 * word - 1)
        out[:, k] = (np.logaddexp(0, -margin) * trust).sum(1)
    return out


def _fit(batches):
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    names, y = np.unique(np.array(column(table, "lang").to_pylist(), object).astype(str), return_inverse=True)
    code = codewords(len(names))
    if code.shape[1]:
        row, place, share = sparse(_prepared(column(table, "text")), LUT)
        bits = code[y].astype(np.float64)
        held = np.arange(len(y)) % 5 == 4
        even = (1.0 / np.bincount(y))[y]          # languages count alike
        weights, bias = fit_sparse(row, place, share, bits, np.where(held, 0.0, even))
        f = np.tile(bias, (len(y), 1))
        for b in range(code.shape[1]):
            f[:, b] += np.bincount(row, weights=weights[place, b] * share, minlength=len(y))
        right = ((f > 0) == (bits > 0))[held if held.any() else slice(None)].mean(0)
        right = np.clip(right, 0.5, 0.995)
        trust = np.log(right / (1 - right)) / np.log(199)
    else:
        weights, bias, trust = np.zeros((1, 0)), np.zeros(0), np.zeros(0)
    yield pa.RecordBatch.from_pylist([{
        "langs": names.tolist(), "code": code.astype(np.int8).tobytes(),
        "weights": weights.astype(np.float32).tobytes(), "bias": bias.tobytes(), "trust": trust.tobytes()}],
        schema=pa.schema([("langs", pa.list_(pa.string()))]
                         + [(c, pa.binary()) for c in ("code", "weights", "bias", "trust")]))


def train(labelled: DataFrame, per_language: int = 400, text_col: str = "text", lang_col: str = "lang"):
    """Model fit on at most ``per_language`` different texts of each language
    (those of the smallest hashes); None without labelled texts."""
    python_ready(labelled.sparkSession)
    rows = (labelled.select(F.col(lang_col).cast("string").alias("lang"), text_of(text_col).alias("text"))
            .filter("lang IS NOT NULL").withColumn("h", F.xxhash64("text")))
    # copies count once, or a text with many would crowd out its language
    sizes = rows.select("lang", "h").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # only hashes small enough to be near the bound are ranked
    near = F.pmod("h", F.lit(1 << 30)) < F.lit(2.0 * per_language) / F.col("n") * (1 << 30) + 1
    few = small_join(rows, sizes, "lang", "inner").filter(near).select("lang", "text", "h").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "text"))
    sample = few.withColumn("k", rank).filter(F.col("k") <= per_language)
    got = (sample.select("lang", "text").repartition(1).sortWithinPartitions(F.xxhash64("text"), "lang")
           .mapInArrow(_fit, MODEL).collect())          # one row: the model
    if not got:
        return None
    m = got[0]
    langs = list(m["langs"])
    bias = np.frombuffer(m["bias"])
    code = np.frombuffer(m["code"], np.int8).reshape(len(langs), len(bias))
    weights = np.frombuffer(m["weights"], np.float32).reshape(-1, len(bias)) if len(bias) else np.zeros((1, 0))
    return langs, code, weights, bias, np.frombuffer(m["trust"])


def _predict(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            texts = column(batch, "text")
            n = len(texts)
            known = np.asarray(column(batch, "letters").cast(pa.uint8())).astype(bool)
            if model is None:
                known, best = np.zeros(n, bool), np.zeros(n, np.int64)
                score, lead, names = np.zeros(n), np.zeros(n), [UNKNOWN]
            else:
                names, code, weights, bias, trust = model
                f = mean_scores(_prepared(texts), LUT, weights) + bias if len(bias) else np.zeros((n, 0))
                loss = losses(f, code, trust)
                order = np.argsort(loss, axis=1, kind="stable")
                best = order[:, 0]
                at = np.arange(n)
                second = loss[at, order[:, 1]] if len(names) > 1 else np.full(n, np.inf)
                lead = second - loss[at, best]
                score = 1 / np.exp(loss[at, best][:, None] - loss).sum(1)
            lang = np.where(known, np.array(names, object)[best], UNKNOWN)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "held_out"), pa.array(lang.tolist(), pa.string()),
                 pa.array(np.where(known, np.clip(score, 0, 1), 0.0)),
                 pa.array(known & (lead < MARGIN))],
                names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])
    return run


def identify(docs: DataFrame, model, held_out: Column | None = None, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous`` of every whole text."""
    spark = docs.sparkSession
    python_ready(spark)
    shared = spark.sparkContext.broadcast(model)      # PLACES x bits floats at most
    rows = untagged(docs, id_col, text_col)
    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), F.col("text").rlike(r"\p{L}").alias("letters"), "text").mapInArrow(
        _predict(shared), "doc_id bigint, held_out boolean, lang_pred string, score double, ambiguous boolean")
