"""Operator 12: round trips, and cuts against a plain program over all pairs."""

import collections
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from railyard.llm import queries, tokens, window_packing as wp
from railyard.llm.common import documents

TINY = "/root/testdata/sf0.001"
MARKED = ["a <|endoftext|> b", "<|endoftext|>", None, "", "no end " * 4000, "One. Two! “Three?”\nFour"]


def ids_of(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return t.encode(text or "", add_special_tokens=False).ids


def packed(df, **more):
    return wp.pack_windows(df, queries.VOCABULARY, public_tokenizers.PATTERN, added=tokens.added_tokens(queries.ADDED),
                           **more)


def check(rows, capacity):
    """Sequences without gaps; the padding of all, in tokens."""
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    pad = 0
    for part in by.values():
        at = 0
        for r in sorted(part, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity
        pad += 0 if at & (at - 1) == 0 else capacity - at
    return pad


def check_whole(rows, texts):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert set(by) == set(texts)
    for k, text in texts.items():
        ids, at = np.array([*ids_of(text), 1], "<u4"), 0
        for r in sorted(by[k], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_whole_table(spark, tmp_path):
    more = spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(MARKED)], "doc_id long, text string")
    docs = documents(spark, TINY).unionByName(more, allowMissingColumns=True)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op12_window_packing(spark, str(tmp_path)).collect()
    check_whole(rows, {r.doc_id: r.text for r in docs.collect()})
    assert check(rows, 2048) <= 0.02 * sum(r.length for r in rows)


def plain_cost(at, penalty, capacity, costs):
    place, cost = [0, *at], [0.0]
    for j in range(1, len(place)):
        best = min(cost[i] + (0 if (n & (n - 1)) == 0 else capacity - n)
                   for i in range(j) if (n := place[j] - place[i]) <= capacity)
        cost.append(best + penalty[j - 1] + costs.window)
    return cost[-1]


@pytest.mark.parametrize("capacity", [1, 8, 50, 64, 100])
def test_cuts_are_the_cheapest(capacity):
    rng, costs = np.random.default_rng(capacity), wp.Costs(sentence=1.5, grid=6.0, window=2.0)
    for _ in range(40):
        ends = np.cumsum(rng.integers(1, 3 * capacity, rng.integers(1, 12)))
        inner = np.unique(rng.integers(1, ends[-1] + 1, rng.integers(0, 30)))
        at, penalty = wp.candidates(ends, np.setdiff1d(inner, ends), costs, capacity)
        assert np.all(np.diff(at, prepend=0) > 0) and np.diff(at, prepend=0).max() <= capacity
        bounds = wp.best_cuts(at, penalty, capacity, costs, last=False)
        size, of = np.diff(bounds), dict(zip(at.tolist(), penalty.tolist(), strict=True))
        assert bounds[0] == 0 and bounds[-1] == ends[-1] and size.min() > 0 and size.max() <= capacity
        got = sum((0 if n & (n - 1) == 0 else capacity - n) + of[b] + costs.window
                  for n, b in zip(size.tolist(), bounds[1:], strict=True))
        assert got == pytest.approx(plain_cost(at.tolist(), penalty.tolist(), capacity, costs))
        split = wp.best_cuts(at, penalty, capacity, costs, last=True)
        assert split[0] == 0 and split[-1] == ends[-1] and 0 < np.diff(split).max() <= capacity


def test_rest_is_split_into_powers_of_two():
    costs = wp.Costs()
    bounds = wp.best_cuts(np.array([2048 + 1536]), np.array([0.0]), 4096, costs)
    assert bounds == [0, 2048, 3072, 3584] or bounds == [0, 3584]
    assert wp.best_cuts(np.array([1536]), np.array([0.0]), 2048, costs) == [0, 1024, 1536]


def test_sentence_ends_in_ids():
    enc = tokens.Encoder(queries.VOCABULARY, public_tokenizers.PATTERN)
    ends, text = wp.SentenceEnds(enc.tokens), 'One two. Three 3.5 "four!" Five\nsix'
    ids = np.array(enc.encode(text))
    cut = [b"".join(enc.tokens[i] for i in ids[a:b]).decode() for a, b in
           zip([0, *ends(ids)], [*ends(ids), len(ids)], strict=True)]
    assert cut == ["One two.", ' Three 3.5 "four!"', " Five\n", "six"]


@pytest.mark.parametrize("stretch", [100, 5000])
def test_stretches_and_order(spark, stretch, monkeypatch):
    monkeypatch.setattr(wp, "STRETCH", stretch)
    docs = documents(spark, TINY).coalesce(1)
    rows = packed(docs, capacity=256).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_whole(rows, {r.doc_id: r.text for r in docs.collect()})
    assert check(rows, 256) <= 0.1 * sum(r.length for r in rows)
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset))]
    assert list(dict.fromkeys(order)) == [r.doc_id for r in docs.collect()]
    total = sum(r.tokens for r in wp.padding(packed(docs, capacity=256), 256).collect())
    assert total == sum(r.length for r in rows)


def test_defined_cases(spark):
    rows = [(None, None), (None, ""), (1, "same text"), (1, "same text"), (2, "x" * 50_000), (3, "a. " * 30_000)]
    df = spark.createDataFrame([(*r, "q", "q") for r in rows], "doc_id long, text string, ids string, tag string")
    got = packed(df.repartition(2)).collect()
    check(got, 2048)
    assert sum(r.length for r in got) == sum(len(ids_of(t)) + 1 for _, t in rows)
    assert sum(r.doc_id is None for r in got) == 2
    assert packed(df.filter("false")).count() == 0
