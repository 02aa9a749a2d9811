"""Operator 11, spelling variants by PartEnum signatures.

Words that differ by one inserted, deleted or replaced letter have letter
multisets that, as binary vectors (letter, how manieth), differ in one or two
places.  The vector's dimensions are dealt to ``PARTS`` parts of about equal
entropy; two vectors that differ in at most two places agree in all parts but
two.  So each vector is signed once for every two parts left out, by the
others; equal signatures are joined, and every pair of vectors with at most
two different parts meets.  Of the signatures a pair shares, one counts: the
one that leaves out the parts that differ (if it is only one, with the first
other part), so a pair is made once.  Pairs of vectors are joined to their
words, and pairs of words are verified by their edit distance.

Words of equal letters share a vector and are no variants of each other, so
vectors, not words, are signed.

Defined results.  Null and empty texts have no words.  Repeated rows count
each.  A null id is written as nothing when an error is put into a word.  Ties
for a word's form go to the smallest in code-point order.  Very long texts and
words count whole.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import collections
import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, mix64, python_ready, tasks, untagged, written

PARTS = 6
KEPT_WORDS = 300_000      # words that a task counts before it hands them on
PER_TASK = 500_000        # signatures of a task

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 192 else 32 for c in range(256))


# ---- words ------------------------------------------------------------------

def runs_of(text: str) -> list[bytes]:
    """Runs of letters in Latin-1, A-Z lower-cased; whatever is beyond Latin-1
    separates."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def with_errors(runs: list[bytes], doc_id: int | None, every: int) -> dict[bytes, int]:
    """Counts of a document's words: a run whose checksum with the id
    ``every`` divides loses a letter, the one that the checksum points to."""
    counts: dict[bytes, int] = collections.defaultdict(int)
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in collections.Counter(runs).items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        counts[run] += n
    return counts


def _count(every: int, shortest: int):
    def run(batches):
        counts: dict[bytes, int] = collections.defaultdict(int)

        def flush():
            words = [w.decode("latin-1") for w in counts]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())],
                                              names=["word", "n"])
        for batch in batches:
            ids, texts = column(batch, "doc_id").to_pylist(), column(batch, "text")
            for i, doc_id in enumerate(ids):
                for word, n in with_errors(runs_of(texts[i].as_py()), doc_id, every).items():
                    if len(word) >= shortest:
                        counts[word] += n
                if len(counts) >= KEPT_WORDS:
                    yield flush()
                    counts.clear()
        if counts:
            yield flush()
    return run


def count_words(docs: DataFrame, every: int = 97, shortest: int = 5, fewest: int = 3, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``word, n`` of words of at least ``shortest`` letters and ``fewest``
    occurrences."""
    python_ready(docs.sparkSession)
    part = untagged(docs, id_col, text_col).mapInArrow(_count(every, shortest), "word string, n bigint")
    return part.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= fewest)


# ---- signatures -------------------------------------------------------------

def parts_of_dimensions(counts: list[tuple[int, int]], vectors: int) -> dict[int, int]:
    """Part of each dimension by its frequency among the vectors: the one of
    most entropy first, always to the part that has least."""
    p = np.array([n / max(vectors, 1) for _, n in counts]).clip(1e-12, 1 - 1e-12)
    entropy = -(p * np.log(p) + (1 - p) * np.log(1 - p))
    load, part = [0.0] * PARTS, {}
    for k in np.argsort(-entropy, kind="stable").tolist():
        least = min(range(PARTS), key=lambda i: load[i])
        part[counts[k][0]] = least
        load[least] += float(entropy[k])
    return part


KNOWN_TIMES = 32          # dimensions beyond are dealt by hash; the table stays small


def _vectors(letters: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the vector and dimension of each of its places; a dimension
    is a letter's code over how manieth it is."""
    size = np.array([len(x) for x in letters], np.int64)
    flat = np.frombuffer("".join(letters).encode("utf-32-le"), "<u4").astype(np.int64)
    vector = np.repeat(np.arange(len(letters)), size)
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (vector[1:] != vector[:-1])
    head = np.flatnonzero(new)
    times = np.arange(len(flat)) - np.repeat(head, np.diff(np.append(head, len(flat))))
    return vector, flat << 32 | times


def _part_hashes(letters: list[str], known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One hash per vector and part."""
    vector, dim = _vectors(letters)
    mixed = mix64(dim.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    part = (mixed % np.uint64(PARTS)).astype(np.int64)
    if len(known[0]):
        at = np.minimum(np.searchsorted(known[0], dim), len(known[0]) - 1)
        part = np.where(known[0][at] == dim, known[1][at], part)
    out = np.zeros(len(letters) * PARTS, np.uint64)
    np.add.at(out, vector * PARTS + part, mix64(mixed))
    return out.reshape(-1, PARTS).view(np.int64)


PAIRS = list(itertools.combinations(range(PARTS), 2))
SIGNED = "letters string, signature bigint, leaves int, left1 bigint, left2 bigint"


def _sign(known: dict[int, int]):
    dims = np.array(sorted(known), np.int64)
    table = dims, np.array([known[int(d)] for d in dims], np.int64)

    def run(batches):
        for batch in batches:
            letters = column(batch, "letters")
            hashes = _part_hashes(letters.to_pylist(), table)
            for k, (p, q) in enumerate(PAIRS):
                signature = np.full(len(hashes), np.uint64(k + 1))
                for part in range(PARTS):
                    if part not in (p, q):
                        signature = mix64(signature + hashes[:, part].view(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [letters, pa.array(signature.view(np.int64)), pa.array(np.full(len(hashes), k, np.int32)),
                     pa.array(hashes[:, p]), pa.array(hashes[:, q])],
                    names=["letters", "signature", "leaves", "left1", "left2"])
    return run


def close_vectors(vectors: DataFrame) -> DataFrame:
    """``a, b`` of different multisets of letters (sorted strings, ``a < b``)
    that differ in at most two parts, each pair once."""
    spark = vectors.sparkSession
    code = F.ascii("c").cast("bigint")
    dims = (vectors.select("letters", F.explode(F.array_distinct(F.split("letters", ""))).alias("c"))
            .filter("c <> ''")
            .select(code.alias("c"), F.explode(F.sequence(F.lit(0), F.least(
                F.length("letters") - F.length(F.replace("letters", "c", F.lit(""))), F.lit(KNOWN_TIMES)) - 1)).alias("k"))
            .groupBy("c", "k").count())
    total = vectors.count()
    known = parts_of_dimensions(sorted((r.c << 32 | r.k, r["count"]) for r in dims.collect()), total)
    n = tasks(spark, total * len(PAIRS), PER_TASK)
    signed = written(vectors.repartition(n, "letters").mapInArrow(_sign(known), SIGNED), "signed")
    # of a pair (p, q) left out, where the other is the first part beside p, beside q
    only_first = [PAIRS.index((0, 1))]
    only_second = [k for k, (p, _) in enumerate(PAIRS) if p == 0]
    a, b = signed.alias("a"), signed.alias("b")
    first, second = F.col("a.left1") != F.col("b.left1"), F.col("a.left2") != F.col("b.left2")
    counts = (first & second | first & ~second & F.col("a.leaves").isin(only_first)
              | second & ~first & F.col("a.leaves").isin(only_second))
    near = F.abs(F.length("a.letters") - F.length("b.letters")) <= 1
    return (a.join(b, (F.col("a.signature") == F.col("b.signature")) & (F.col("a.leaves") == F.col("b.leaves"))
                   & (F.col("a.letters") < F.col("b.letters")) & near & counts)
            .select(F.col("a.letters").alias("a"), F.col("b.letters").alias("b")))


# ---- forms ------------------------------------------------------------------

def near_words(words: DataFrame) -> DataFrame:
    """``word1, n1, word2, n2``, pairs of words that one insertion, deletion
    or replacement tells apart, each once."""
    letters = F.array_join(F.array_sort(F.split("word", "")), "")
    words = written(words.withColumn("letters", letters), "words")
    pairs = written(close_vectors(words.select("letters").distinct()), "vector-pairs")
    a = words.select(F.col("letters").alias("a"), F.col("word").alias("word1"), F.col("n").alias("n1"))
    b = words.select(F.col("letters").alias("b"), F.col("word").alias("word2"), F.col("n").alias("n2"))
    n = tasks(words.sparkSession, pairs.count(), PER_TASK)
    one = pairs.join(a, "a").repartition(n, "b")
    return one.join(b, (one["b"] == b["b"]) & (F.levenshtein("word1", "word2", 1) == 1)).select(
        "word1", "n1", "word2", "n2")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word."""
    words = written(count_words(docs, id_col=id_col, text_col=text_col), "counted")
    pairs = written(near_words(words), "near")
    both = (pairs.select(F.col("word1").alias("word"), F.col("word2").alias("near"), F.col("n2").alias("near_n"))
            .unionByName(pairs.select(F.col("word2").alias("word"), F.col("word1").alias("near"),
                                      F.col("n1").alias("near_n"))))
    # the largest n, then the smallest word
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                    F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    forms = (words.join(best, "word", "left")
             .select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
                     F.when(-F.col("best.less") >= 2 * F.col("n"), F.col("best.near")).alias("form"),
                     F.when(-F.col("best.less") >= 2 * F.col("n"), -F.col("best.less")).alias("form_n")))
    forms = written(forms, "forms")
    return forms.join(roots(forms), "word").select("word", "form", "root", "n", "n_near", "form_n")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the last word that forms lead to.  A form's ``n`` is at
    least twice the word's, so there are no circles, and as each step joins
    what the steps before it found, it doubles the way."""
    now = forms.select("word", F.coalesce("form", "word").alias("root"))
    while True:
        now = written(now, "roots")
        up = now.filter("word <> root").select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = now.join(up, "root", "left")
        if not step.filter("next IS NOT NULL").limit(1).count():
            return now
        now = step.select("word", F.coalesce("next", "root").alias("root"))
