"""Operator 11 against edit distances of all pairs."""

import collections
import random
import re
import zlib

import pytest

from railyard.llm import queries, spelling
from railyard.llm.common import documents

TINY = "/root/testdata/sf0.001"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
AZ = {c: c + 32 for c in range(65, 91)}


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def brute_words(docs):
    counts = collections.Counter()
    for doc_id, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(AZ)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def brute(words):
    holes = collections.defaultdict(set)
    for w in words:
        for k in range(len(w) + 1):
            holes[w[:k] + "." + w[k + 1:]].add(w)      # a letter away, or replaced
            holes[w[:k] + "." + w[k:]].add(w)          # room for one
    near = {w: set() for w in words}
    for group in holes.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def found(df):
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]


def test_whole_table(spark):
    rows = found(queries.op11_spelling_variants(spark, TINY))
    want = brute(brute_words((r.doc_id, r.text) for r in documents(spark, TINY).collect()))
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert sum(r[1] is not None for r in rows) > 20 and any(r[1] != r[2] for r in rows if r[1])


def test_near_words_of_random_letters(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 8))) for _ in range(900)}
    words |= {"a" * k for k in (5, 6, 7, 40, 41, 90, 91)} | {"b" + "a" * 40, "×÷ÿÀÁ"}
    df = spark.createDataFrame([(w, 3) for w in sorted(words)], "word string, n long")
    got = [(r.word1, r.word2) for r in spelling.near_words(df).collect()]
    want = {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}
    assert len(got) == len(want) and {frozenset(p) for p in got} == want


def test_forms_ties_and_chains(spark):
    n = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 25, "ccccc": 3, "ccccd": 6, "cccce": 6, "ddddd": 4, "dddde": 7}
    docs = [(None, " ".join([w] * k)) for w, k in n.items()]
    assert not any(zlib.crc32(f":{w}".encode()) % 97 == 0 for w in n)
    df = spark.createDataFrame([*docs, (1, None), (2, "")], "doc_id long, text string")
    got = {r[0]: r[1:3] for r in found(spelling.spelling_variants(df))}
    assert got["aaaaa"] == ("aaaab", "aabbb") and got["aabbb"] == (None, "aabbb")
    assert got["ccccc"] == ("ccccd", "ccccd")        # a tie of n goes to the smaller word
    assert got["ddddd"] == (None, "ddddd")           # 7 < 2 * 4


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, ""), (2, "no, ...!")]])
def test_tables_without_words(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, word string, n string")
    assert spelling.spelling_variants(df).count() == 0


def test_repeated_rows_long_texts_and_separators(spark):
    text = "Wordone wordone—WORDONE wordtwo 一wordtwo丁 Éwordtwo"
    long = " ".join(["filling", "felling"] * 30_000) + " " + "z" * 5000
    rows = [(7, text, "a"), (7, text, "b"), (None, long, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, letters string")
    want = brute(brute_words((a, b) for a, b, _ in rows))
    assert set(found(spelling.spelling_variants(df))) == want and len(want) >= 3
