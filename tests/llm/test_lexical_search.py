"""Operator 13 against scores of all documents."""

import collections
import math
import re
import tracemalloc

import numpy as np
import pyarrow.parquet as pq
import pytest

from railyard.llm import lexical_search as ls
from railyard.llm import queries
from railyard.llm.common import documents

TINY = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
AZ = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(AZ))


def brute(docs, items, k=20):
    bags = [(i, collections.Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n, length = len(bags), sum(b[2] for b in bags)
    df = collections.Counter(t for _, b, _ in bags for t in b)
    weight = {t: math.floor(1000 * math.log((2.0 * n + 2) / (2.0 * c + 1))) for t, c in df.items()}
    out = []
    for item, text in items:
        scored = []
        for i, bag, size in bags:
            m = 100 - 25 + (25 * size * n) // length
            s = sum(weight[t] * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 12 * m)) for t in terms(text) if t in bag)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.mark.parametrize("segment,block", [(1 << 21, 1 << 16), (3000, 200)])
def test_whole_table(spark, monkeypatch, segment, block):
    monkeypatch.setattr(ls, "SEGMENT_TOKENS", segment)
    monkeypatch.setattr(ls, "BLOCK_TERMS", block)
    items = spark.read.parquet(f"{TINY}/benchmark.parquet")
    got = found(queries.op13_lexical_search(spark, TINY))
    assert got == brute([(r.doc_id, r.text) for r in documents(spark, TINY).collect()],
                        [(r.item_id, r.text) for r in items.collect()])


def test_defined_cases(spark):
    docs = [(None, "alpha beta"), (None, "alpha beta"), (3, "Alpha, BETA!"), (3, "alpha beta"), (2, "alpha beta"), (5, None),
            (6, ""), (7, "Älpha 一二 café"), (8, "alpha " * 40_000 + "rare"), (9, "-- !! ..")]
    items = [(1, "alpha beta beta"), (1, "alpha beta beta"), (None, "rare"), (2, None), (3, "absent"), (4, "ÄLPHA café"),
             (5, "一二")]
    d = spark.createDataFrame([(*r, "x", "y", "z") for r in docs], "doc_id long, text string, m string, query string, score string")
    q = spark.createDataFrame([(*r, "x", "y") for r in items], "item_id long, text string, query string, doc_id string")
    got = found(ls.search(ls.build_index(d.repartition(3)), q.repartition(2), 4))
    assert got == brute(docs, items, 4)
    none = d.filter("false")
    assert ls.search(ls.build_index(none), q).count() == 0
    assert ls.search(ls.build_index(d), q.filter("false")).columns == ["item_id", "rank", "doc_id", "score"]
    assert ls.search(ls.build_index(d), q.filter("item_id = 2")).count() == 0


def test_bounds_skip_strata_and_lose_nothing():
    rng = np.random.default_rng(1)
    words = [f"w{i}".encode() for i in range(400)]
    texts = [[words[min(399, int(x))] for x in rng.exponential(60, rng.integers(1, 400))] for _ in range(3000)]
    n, length = len(texts), sum(map(len, texts))
    vocabulary = ls._Vocabulary()
    numbers = [np.array([vocabulary[w] for w in t]) for t in texts]
    row = ls._segment(list(range(n)), [len(t) for t in texts], numbers, vocabulary, n, length)
    df = collections.Counter(w for t in texts for w in set(t))
    wanted = {w: math.floor(1000 * math.log((2 * n + 2) / (2 * c + 1))) for w, c in df.items()}
    segment, visited = ls.Segment(row, wanted), 0
    for _ in range(20):
        ask = dict(collections.Counter(words[i] for i in rng.integers(150, 400, 3)))
        best = ls._Best(2)
        visited += segment.search(list(ask), list(ask.values()), best, visit=64)
        scores = []
        for i, t in enumerate(texts):
            bag = collections.Counter(t)
            m = 75 + (25 * len(t) * n) // length
            scores.append((sum(c * wanted.get(w, 0) * ((1_000_000_000 * bag[w]) // (1000 * bag[w] + 12 * m))
                               for w, c in ask.items() if bag[w]), i))
        want = sorted(((s, i) for s, i in scores if s), key=lambda r: (-r[0], r[1]))[:2]
        assert best.rows == want
    assert visited < 0.9 * 20 * n


def test_a_segment_a_row_group_and_a_row_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(ls, "SEGMENT_TOKENS", 3000)
    monkeypatch.setattr(ls, "ROW_GROUP", 1)
    index = ls.build_index(documents(spark, TINY).coalesce(1))
    read = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in index.segments.inputFiles()]
    assert sum(f.num_rows for f in read) > 10
    assert all(f.row_group(i).num_rows == 1 for f in read for i in range(f.num_row_groups))

    def alone(run):
        def checked(batches):
            def each():
                for batch in batches:
                    assert batch.num_rows == 1
                    yield batch
            yield from run(each())
        return checked
    whole = ls._search
    monkeypatch.setattr(ls, "_search", lambda k: alone(whole(k)))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    assert ls.search(index, spark.read.parquet(f"{TINY}/benchmark.parquet")).count() > 0
    assert spark.conf.get(key) == before


def test_memory_goes_by_postings():
    """Many rare terms in a segment of many strata: no table of both."""
    n_docs, per_doc = 1000, 20
    vocabulary = ls._Vocabulary()
    words = [[f"t{d}x{i % (5 + d)}".encode() for i in range(max(per_doc, 5 + d))] for d in range(n_docs)]
    numbers = [np.array([vocabulary[w] for w in t]) for t in words]
    sizes = [len(t) for t in words]
    row = ls._segment(list(range(n_docs)), sizes, numbers, vocabulary, n_docs, n_docs)
    wanted = {t: 1000 for i, t in enumerate(vocabulary) if i % 25 == 0}
    assert len(row["strata"]) > 900 and len(wanted) > 15_000
    tracemalloc.start()
    segment = ls.Segment(row, wanted)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20                            # a table of 8 bytes has over 110 MB, and there were three
    best, term = ls._Best(3), next(iter(wanted))
    segment.search([term], [1], best)
    assert [r[1] for r in best.rows] == [0]
