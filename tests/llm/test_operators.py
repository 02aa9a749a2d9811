"""Operators against brute force on small tables, and the cases that their
docstrings define: nulls, empty and long texts, ties, repeated rows, empty
tables, extra columns with clashing names."""

import collections
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from railyard.llm import (common, exact_dedup, fingerprint, graph, language_id, license_scan, mixing, packing, quality,
                          queries, simhash_dedup, suffix_dedup, token_counts, tokens)
from railyard.llm.common import documents

TINY = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "digest string, tag string, fp string, kept string, bucket string, mix_rate string, src string")
LONG = " ".join(f"w{i % 977} and{i % 13}" for i in range(60_000))


def odd_rows():
    texts = [(1, None), (2, ""), (3, "a"), (None, "a"), (None, None), (4, "same text here"), (4, "same text here"),
             (5, "same text here"), (6, LONG), (7, LONG + " x"), (8, "é! ñ... “q” <|endoftext|>\t\n two  blanks "),
             (9, "Released under the MIT License.\nplain"), (10, "12 34 %% --")]
    return [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "s1", None, "x", "x", "x", "x", "x", "x", "x")
            for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tiny(spark):
    return documents(spark, TINY)


@pytest.fixture(scope="module")
def texts(tiny):
    return {r.doc_id: r.text or "" for r in tiny.collect()}


def reference_encode(plain=False):
    """Ids by the public library as it is; ``plain``: the strings of added
    tokens are ordinary text."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    if plain:
        t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


MARKED = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> y ", "<|endoftext|>\n a", "<|endoftext|",
          "<|endoftext|> a"]


@pytest.mark.parametrize("plain", [True, False])
def test_token_ids_equal_the_public_tokenizer(texts, plain):
    added = {} if plain else tokens.added_tokens(queries.ADDED)
    enc, want = tokens.Encoder(queries.VOCABULARY, public_tokenizers.PATTERN, added), reference_encode(plain)
    some = [*list(texts.values())[:60], "", " ", "a  b", "don't we'll 'x", "x² ½ a_b a__ _a", "é! ñ...", "\n a \n",
            "foo.\nbar, baz\t q", "12,3 4", "it's.", "a'", "é. x", "“q” t", "é. b", "a b c", "日本 語", *MARKED]
    for text in some:
        assert enc.encode(text) == want(text), text[:40]
    ids, at = enc.encode_all(pa.array(some), 7)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [[*want(t), 7] for t in some]


def test_slices_cover_all_rows():
    for texts, limit in (([], 4), (["abc", "", "abcdefgh", "a", "b", "c"], 4), (["é" * 5, None][:1], 1)):
        arr = pa.array(texts, pa.string()).slice(0)
        got = list(tokens.slices(arr, limit))
        assert [i for lo, hi in got for i in range(lo, hi)] == list(range(len(texts)))
        assert all(sum(len(t.encode()) for t in texts[lo:hi]) <= limit or hi - lo == 1 for lo, hi in got)


# ---- 1 exact dedup

def test_mph_is_minimal_and_rejects_strangers():
    words = np.random.default_rng(1).integers(0, 1 << 62, (5000, 4)).astype(np.uint64)
    levels = exact_dedup.build_mph(words)
    assert sorted(exact_dedup.slots(levels, words).tolist()) == list(range(5000))


def test_exact_dedup_groups(odd, none):
    got = exact_dedup.exact_dedup(odd, exact_dedup.older_half(odd)).collect()
    groups = collections.defaultdict(list)
    for r in odd_rows():
        groups[hashlib.sha256((r[1] or "").encode()).hexdigest()].append(r[0])
    assert len(got) == len(odd_rows())
    for sha, ids in groups.items():
        rows = [r for r in got if r.text_sha256 == sha]
        assert len(rows) == len(ids) and {r.group_size for r in rows} == {len(ids)}
        assert {r.keep_id for r in rows} == {max((i for i in ids if i is not None), default=None)}
        assert sum(r.kept for r in rows) == 1
    assert exact_dedup.exact_dedup(none, exact_dedup.older_half(none)).count() == 0


@pytest.mark.parametrize("history", ["true", "false", "doc_id % 2 = 0"])
def test_exact_dedup_is_the_same_for_any_history(tiny, history):
    a = exact_dedup.exact_dedup(tiny, F.expr(history)).drop("tag").collect()
    b = exact_dedup.exact_dedup(tiny, F.lit(False)).drop("tag").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


# ---- 2 language

def test_language_id_on_held_out_documents(spark):
    got = queries.op2_language_id(spark, "/root/testdata/sf0.01").join(
        documents(spark, "/root/testdata/sf0.01").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 200 and sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_id_defined_cases(odd, none):
    model = language_id.train(odd)
    got = language_id.identify(odd, model).collect()
    assert {r.lang_pred for r in got if r.doc_id in (1, 2)} == {"und"}
    assert {r.lang_pred for r in got if r.doc_id == 10} == {"und"}
    assert {r.lang_pred for r in got if r.doc_id in (3, 6)} == {"en"}
    assert language_id.train(none) is None
    assert {r.lang_pred for r in language_id.identify(odd, None).collect()} == {"und"}
    assert language_id.identify(none, model).count() == 0


def test_codewords_are_apart():
    for n in (2, 3, 5, 9, 20):
        code = language_id.codewords(n)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= max(1, code.shape[1] // 4)


# ---- 3 token counts

def test_token_counts_against_the_tokenizer(spark, texts, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_BYTES", 1000)
    want = reference_encode(plain=True)
    got = {r.doc_id: r.n_tokens for r in queries.op3_token_counts(spark, TINY).collect()}
    assert got == {k: len(want(t)) for k, t in texts.items()}


def test_separator_scan_of_any_cut(spark):
    rng = np.random.default_rng(3)
    ids = np.where(rng.random(4000) < 0.03, 9, rng.integers(10, 20, 4000)).astype("<u2")
    raw, cuts = ids.tobytes(), [0, 2, 500, 502, 504, 3000, 7990, 8000]
    rows = [(1, k, raw[a:b]) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    rows += [(2, 0, None), (3, 0, np.array([9, 9], "<u2").tobytes())]
    got = token_counts.separator_scan(spark.createDataFrame(rows, "file int, block long, body binary"), 9).collect()
    at, want = 0, []
    for k, end in enumerate(np.flatnonzero(ids == 9).tolist()):
        want.append((1, k, at, end - at, True))
        at = end + 1
    if at < 4000:
        want.append((1, len(want), at, 4000 - at, False))
    want += [(3, 0, 0, 0, True), (3, 1, 1, 0, True)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_raw_token_files(spark, tmp_path):
    rng, want = np.random.default_rng(6), []
    for f, n in enumerate((5000, 1, 777)):
        ids = np.where(rng.random(n) < 0.02, 9, rng.integers(10, 60_000, n)).astype("<u2")
        raw = ids.tobytes() + (b"\1" if f == 2 else b"")          # the last id is torn
        (tmp_path / f"part-{f}.bin").write_bytes(raw)
        (tmp_path / f"part-{f}-empty.bin").write_bytes(b"")
        at = 0
        for k, end in enumerate([*np.flatnonzero(ids == 9).tolist(), n]):
            if end < n or at < n:
                want.append((f, k, at, end - at, end < n))
            at = end + 1
    blocks = token_counts.file_blocks(spark, str(tmp_path), 256)
    assert {len(r.body) for r in blocks.collect()} <= {256, *range(257)} and blocks.count() > 40
    got = token_counts.separator_scan(blocks, 9).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_token_counts_defined_cases(odd, none):
    got = token_counts.token_counts(odd, queries.VOCABULARY, public_tokenizers.PATTERN, queries.END_OF_TEXT)
    assert got.count() == len(odd_rows())
    assert {r.n_tokens for r in got.collect() if r.doc_id in (1, 2)} == {0}
    assert token_counts.token_counts(none, queries.VOCABULARY, public_tokenizers.PATTERN,
                                     queries.END_OF_TEXT).count() == 0


# ---- 4 mixing

def test_mixing_rates_and_cases(spark, tiny, odd, none):
    got = mixing.poisson_mix(tiny, weights={"src0": 1.0, "src1": 3.0}, epochs=40.0).groupBy("source").agg(
        F.sum(F.length("text")).alias("n")).collect()
    size = {r.source: r.n for r in got}
    assert set(size) <= {"src0", "src1"} and 2.0 < size["src1"] / size["src0"] < 4.5
    out = mixing.poisson_mix(odd)
    assert set(odd.columns) - {"mix_rate"} <= set(out.columns)
    rows = out.collect()
    twins = [r for r in rows if r.text == "same text here" and r.doc_id == 4]
    assert len(twins) % 2 == 0
    assert mixing.poisson_mix(none).count() == 0


# ---- 5 quality

def test_quality_scores_labelled_documents(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = queries.op5_quality(spark, d).join(labels, "doc_id").collect()
    assert sum(r.kept == bool(r.quality) for r in got) >= 0.95 * len(got)


def test_quality_defined_cases(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    got = quality.classify(odd, labels).collect()
    assert len(got) == len(odd_rows()) and {r.score for r in got} == {1.0}
    assert quality.classify(none, labels).count() == 0


# ---- 6 licences

def test_license_scan(spark, tiny, odd, none, texts):
    got = license_scan.license_scan(tiny).collect()
    want = sum(1 for t in texts.values() for p in t.split("\n")
               if any(p.strip() == f.format(n) for ns in license_scan.FAMILIES.values() for n in ns
                      for f in license_scan.FRAMES))
    assert sum(r.confirmed for r in got) >= want > 0
    found = license_scan.license_scan(odd).collect()
    assert [(r.doc_id, r.paragraph, r.family, r.confirmed) for r in found] == [(9, 0, "MIT", True)]
    assert license_scan.license_scan(none).count() == 0


def test_license_paragraphs_that_are_no_training_notice(spark, tiny, texts):
    t = license_scan.TEXTS
    lines = [
        ("All-rights-reserved", "Copyright 1998-2004 Jane Roe and others. All rights reserved."),
        ("All-rights-reserved", "(c) Acme Widgets Ltd, all rights reserved worldwide"),
        ("MIT", "[MIT text] " + t["MIT"][0]), ("MIT", t["MIT"][1].replace("the Software", "the Library")),
        ("BSD", "* " + t["BSD"][1][3:]), ("BSD", t["BSD"][3].replace("the copyright holder", "Acme Widgets")),
        ("Apache", "// Example. " + t["Apache"][0]), ("Apache", "Note: " + t["Apache"][1]),
        ("GPL", t["GPL"][0].replace("This program", "Frobnicate")), ("GPL", t["GPL"][2].replace("This program", "It")),
        ("LGPL", t["LGPL"][0].replace("This library", "Frobnicate")),
        ("AGPL", t["AGPL"][0].replace("This program", "Frobnicate")),
    ]
    assert not {body for _, body in lines} & {r.body for r in license_scan.notices(spark).collect()}
    new = [(10**9 + i, body) for i, (_, body) in enumerate(lines)]
    plain = (2 * 10**9, "The rights of the tenants were reserved in all earlier contracts of the town.")
    docs = tiny.select("doc_id", "text").unionByName(spark.createDataFrame([*new, plain], "doc_id long, text string"))
    got = license_scan.license_scan(docs).collect()
    families = {r.doc_id: r.family for r in got if r.confirmed}
    assert {b: families.get(i) for i, b in new} == {b: f for f, b in lines}
    assert plain[0] not in families
    held = {(i, k) for i, text in texts.items() for k, p in enumerate(text.split("\n"))
            if p.strip() == "All rights reserved."}
    assert held <= {(r.doc_id, r.paragraph) for r in got if r.confirmed and r.family == license_scan.RIGHTS}


def _wrapped(paragraphs, mark=""):
    import textwrap
    return "\n".join(mark + line for p in paragraphs for line in textwrap.wrap(p, 76))


def test_wrapped_texts_and_two_licences(spark, tiny, texts):
    t = license_scan.TEXTS
    cases = [
        ("MIT", _wrapped(t["MIT"])), ("MIT", _wrapped(t["MIT"][:1], " * ")), ("BSD", _wrapped(t["BSD"][:5], "# ")),
        ("BSD", _wrapped(t["BSD"][1:2])), ("Apache", _wrapped(t["Apache"], "// ")), ("Apache", _wrapped(t["Apache"][:1])),
        ("GPL", _wrapped(t["GPL"][:1], " * ")), ("GPL", _wrapped(t["GPL"][2:4])), ("LGPL", _wrapped(t["LGPL"][:1])),
        ("ISC", _wrapped(t["ISC"])), ("MPL", _wrapped(t["MPL"], "; ")), ("Zlib", _wrapped(t["Zlib"])),
        ("Unlicense", _wrapped(t["Unlicense"], "-- ")), ("MIT", "Published under the MIT License"),
        ("MIT|Apache", "Licensed under the MIT License or the Apache License 2.0."),
        ("GPL|MPL", "This project may be used under the GNU GPL or the MPL-2.0."),
        ("BSD|MIT", "Dual licensed under the BSD License and the MIT License."),
        ("AGPL|Apache", "You can choose between AGPL-3.0 and Apache-2.0."),
        ("MIT|EPL", "Covered by the MIT licence and, in parts,\nby the Eclipse Public License, version 2.0"),
    ]
    new = [(10**9 + i, f"Words before.\n\n{body}\n \nwords behind") for i, (_, body) in enumerate(cases)]
    docs = tiny.select("doc_id", "text").unionByName(spark.createDataFrame(new, "doc_id long, text string"))
    got = license_scan.license_scan(docs).collect()
    right = total = 0
    for i, (family, body) in enumerate(cases):
        rows = [r for r in got if r.doc_id == 10**9 + i and r.confirmed]
        want = set(family.split("|"))
        assert {r.family for r in rows} <= want, body
        right, total = right + len(want & {r.family for r in rows}), total + len(want)
        assert all(2 <= r.paragraph <= r["last"] <= 1 + len(body.split("\n")) for r in rows), body
    assert right >= 0.9 * total
    plain = license_scan.license_scan(tiny).collect()
    assert sorted((r.doc_id, r.paragraph, r.family) for r in plain) == sorted(
        (r.doc_id, r.paragraph, r.family) for r in got if r.doc_id < 10**9)


def test_any_of_matches_the_words_and_no_others():
    import itertools
    import re
    words = ["1", "1.0", "2020", "2021", "a", "ab", "abc", "b+", "gpl-3.0", "gpl"]
    for n in (1, 2, len(words)):
        for some in itertools.combinations(words, n):
            pattern = re.compile(license_scan.any_of(list(some)))
            assert [w for w in [*words, "", "202", "abcd", "1-0"] if pattern.fullmatch(w)] == list(some)


def test_ordinary_sample_counts_copies_once(spark):
    body = ["the same line again and again"] * 5000 + [f"line {i} of many words" for i in range(300)]
    df = spark.createDataFrame([(b,) for b in body], "body string").repartition(3)
    got = [r.body for r in license_scan._ordinary(df, 200).collect()]
    assert len(got) == len(set(got)) == 200


def test_license_training_takes_every_ordinary_paragraph(spark):
    body = [f"story {i} tells of {'a gnu' if i % 150 == 0 else 'rain'}" for i in range(9000)]
    df = spark.createDataFrame([(b,) for b in body * 2], "body string").repartition(3)
    model = license_scan.train(df)
    half = df.distinct().filter("pmod(xxhash64(body, 3), 2) = 0")
    assert model.plain["gnu"] == half.filter("body LIKE '%gnu%'").count() > 20
    # calibrated on the other half: a few paragraphs of one kind out of many raise the threshold
    held = df.distinct().filter("pmod(xxhash64(body, 3), 2) = 1").count()
    some = spark.createDataFrame([([0], 3), ([1], held), ([], 5)], "x array<int>, n long")
    weights, bias = np.array([[4.0, 1.0], [0.0, 1.5]]), np.array([-2.0, -1.0])
    assert license_scan._high(some, weights, bias, 2 / held) == 1 / (1 + np.exp(-2.0))
    assert license_scan._high(some, weights, bias, 4 / held) == 0


def test_license_examples_are_the_words_and_pairs_of_paragraphs(spark):
    body = ["Licensed under the MIT License.", "The GNU, the gnu; GPL-3.0... and v. 2.0", "...", "under . the terms of", "ÀÉ the\u00a0of",
            "MIT", "free software\tfree.software or \"software\"", "x" * 50, "of the of the of the", "Apache-2.0 is named here."]
    df = spark.createDataFrame([(b,) for b in body * 3], "body string").repartition(2)
    grams = license_scan.grams(license_scan.words(F.col("body")))
    seen = sorted(r.g for r in license_scan.notices(spark).select(F.explode(grams).alias("g")).distinct().collect())
    known = {r.shingle for r in license_scan.template_shingles(spark).collect()}
    every = license_scan.all_shingles(license_scan.words(F.col("body")))
    want = {r.h: sorted(set(r.g) & set(seen))
            for r in df.select(F.xxhash64("body", F.lit(3)).alias("h"), grams.alias("g"), every.alias("s")).collect()
            if not known & set(r.s)}
    got = license_scan._ordinary_grams(df, seen).collect()
    assert {r.h: list(r.x) for r in got} == want and len(got) == len(want) == 7


# ---- 7 packing

def check_packing(rows, capacity):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    for part in by.values():
        at = 0
        for r in sorted(part, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by)


@pytest.fixture(scope="module")
def marked_dir(spark, tiny, tmp_path_factory):
    """The documents, some of them with the strings of added tokens."""
    path = str(tmp_path_factory.mktemp("marked"))
    more = spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(MARKED)], "doc_id long, text string")
    tiny.unionByName(more, allowMissingColumns=True).write.parquet(f"{path}/documents.parquet")
    return path


def test_packing_round_trip(spark, texts, marked_dir):
    rows = queries.op7_packing(spark, marked_dir).collect()
    want, total = reference_encode(), 0
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for k, text in [*texts.items(), *((10_000 + k, t) for k, t in enumerate(MARKED))]:
        ids = np.array([*want(text), queries.END_ID], "<u4")
        parts = sorted(by[k], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and parts[0].start == 0
        assert all(r.length == 1024 for r in parts[1:])
        for r in parts:
            assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
        assert sum(r.length for r in parts) == len(ids)
        total += len(ids)
    assert check_packing(rows, 1024) <= -(-total // 1024) + 1


def test_local_search_empties_bins():
    # best fit leaves three bins; an exchange makes two full ones
    sizes = np.array([5, 5, 4, 3, 3])
    where = packing.local_search(sizes, np.array([0, 0, 1, 1, 2]), 10)
    assert len(set(where.tolist())) == 2
    fill = np.bincount(where, weights=sizes)
    assert fill.max() <= 10


def test_packing_groups_and_cases(odd, none, tiny, monkeypatch):
    args = (queries.VOCABULARY, public_tokenizers.PATTERN)
    assert check_packing(packing.best_fit_packing(odd, *args).collect(), 1024) > 0
    assert packing.best_fit_packing(none, *args).count() == 0
    monkeypatch.setattr(packing, "GROUP", 40)
    rows = packing.best_fit_packing(tiny, *args).collect()
    assert check_packing(rows, 1024) <= 1.03 * sum(r.length for r in rows) / 1024 + 2


# ---- 8 suffix arrays

def brute_spans(rows, length=200):
    count = collections.Counter(t[i:i + length] for _, t in rows for i in range(len(t) - length + 1))
    out = []
    for k, t in rows:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                gone[i:i + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((k, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_repeated_spans_against_brute_force(spark, texts, none, monkeypatch):
    rng = np.random.default_rng(5)
    word = lambda n: " ".join(str(x) for x in rng.integers(0, 10**6, n))
    share = word(60)
    rows = [(k, t) for k, t in list(texts.items())[:40]]
    rows += [(1000 + i, word(20) + share[i:i + 195 + 3 * i] + word(20)) for i in range(12)]
    rows += [(2000, "ab" * 400), (2001, "x" * 199), (2002, "x" * 200), (2003, None), (2004, "é" * 150), (2004, "é" * 150),
             (None, "y" * 201)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_spans([(k, (t or "").encode()) for k, t in rows])
    for block, often in ((1 << 19, 20_000), (1000, 1)):
        monkeypatch.setattr(suffix_dedup, "_BLOCK", block)
        monkeypatch.setattr(suffix_dedup, "OFTEN", often)
        got = suffix_dedup.repeated_spans(df, 200, batch_rows=64).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=repr) == want
    assert suffix_dedup.repeated_spans(none).count() == 0


# ---- 9 SimHash

def brute_fingerprint(text, size=4):
    w = text.encode().lower().split()
    parts = [b" ".join(w[i:i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    hs = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def test_simhash_components(spark, texts, odd, none):
    got = {r.doc_id: r for r in queries.op9_simhash_dedup(spark, TINY).collect()}
    fp = {k: brute_fingerprint(t) for k, t in texts.items()}
    assert {k: int(r.fingerprint, 16) for k, r in got.items()} == fp
    ids = sorted(fp)
    a, b = zip(*[(i, j) for i in range(len(ids)) for j in range(i)
                 if bin(fp[ids[i]] ^ fp[ids[j]]).count("1") <= 4], strict=True)
    root = graph.forest(len(ids), np.array(a), np.array(b))
    assert {k: got[k].component_id for k in ids} == {ids[i]: ids[root[i]] for i in range(len(ids))}
    rows = simhash_dedup.near_dedup(odd).collect()
    assert len(rows) == len(odd_rows())
    assert {r.component_id for r in rows if r.doc_id in (1, 2)} == {1}
    assert simhash_dedup.near_dedup(none).count() == 0


@pytest.mark.parametrize("shard_max", [20_000, 200, 30])
def test_links_against_all_pairs(spark, shard_max, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "SHARD_MAX", shard_max)
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = [int(x) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False))
            for x in np.concatenate((base, np.repeat(base[:3], 150)))]
    fps = np.unique(np.array(near, np.uint64))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {r.node: r.root for r in graph.components(simhash_dedup.links(df)).collect()}
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    root = graph.forest(len(fps), i, j)
    want = collections.defaultdict(set)
    mine = collections.defaultdict(set)
    for k, x in enumerate(fps.view(np.int64).tolist()):
        want[int(root[k])].add(x)
        mine[got.get(x, x)].add(x)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, mine.values()))


# ---- 10 fingerprints

def one_fingerprint(text):
    sums = fingerprint.Sums(1)
    sums.add(0, fingerprint.units(text, fingerprint.sentences(text)))
    sums.flush()
    return fingerprint.shown(sums.signs, sums.wide)[0]


def test_fingerprints_against_direct_sums(spark, texts):
    got = {r.doc_id: r for r in queries.op10_fingerprints(spark, TINY).collect()}
    ids = sorted(texts)
    assert sorted(got) == ids
    for a, b in zip(ids, [*ids[1:], ids[0]], strict=True):
        n = len(texts[a])
        edited = texts[a][:n - n // 2] + texts[b][:n // 2]
        r = got[a]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (one_fingerprint(texts[a]), one_fingerprint(edited))
    long = [r for r in got.values() if r.n_chars > 1000]
    assert np.mean([r.near_edited for r in long]) > 0.4 > 0.2 > np.mean([r.near_next for r in long])


def test_fingerprint_is_a_homomorphism(odd, none):
    a, b = "one. two. three.", "three. one. two."
    assert one_fingerprint("one.\ntwo.\n") == one_fingerprint("two.\none.\n") and one_fingerprint(a) != one_fingerprint(b + "x")
    got = fingerprint.fingerprints(odd).collect()
    assert len(got) == len(odd_rows())
    by = collections.defaultdict(set)
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by[r.doc_id].add(r.fingerprint)
    assert len(by[4]) == 1 and by[4] == by[5] and by[1] == by[2]
    assert fingerprint.fingerprints(none).count() == 0


# ---- row tags

@pytest.fixture
def split(spark):
    """Sets the bytes of a scan's split, as executors that come and go do."""
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    yield lambda size: spark.conf.set(key, size)
    spark.conf.set(key, old)


@pytest.fixture(scope="module")
def many_files(spark, tiny, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tags") / "a b%20c")
    tiny.repartition(7).write.parquet(path)
    return spark.read.parquet(path)


def test_tags_do_not_depend_on_the_splits(many_files, split):
    seen = []
    for size in ("8k", "64k", "1g"):
        split(size)
        rows = common.tagged(many_files, "doc_id", "text").select("doc_id", "tag")
        seen.append((rows.rdd.getNumPartitions(), {r.doc_id: r.tag for r in rows.collect()}))
    assert len({n for n, _ in seen}) > 1
    assert seen[0][1] == seen[1][1] == seen[2][1]
    assert len(set(seen[0][1].values())) == len(seen[0][1]) == many_files.count()
    some = common.tagged(many_files.filter("doc_id % 3 = 0").select("text", "doc_id"), "doc_id", "text")
    assert {r.doc_id: r.tag for r in some.collect()} == {k: v for k, v in seen[0][1].items() if k % 3 == 0}


def test_tags_of_frames_without_a_place_in_a_file(spark, odd, none, tmp_path):
    assert len({r.tag for r in common.tagged(odd, "doc_id", "text").collect()}) == len(odd_rows())
    assert common.tagged(none, "doc_id", "text").count() == 0
    odd.write.json(str(tmp_path / "j"))
    rows = common.tagged(spark.read.schema(SCHEMA).json(str(tmp_path / "j")), "doc_id", "text").collect()
    assert len({r.tag for r in rows}) == len(odd_rows())


@pytest.mark.parametrize("stage", ["keep_quality", "drop_copies", "drop_near_copies"])
def test_stages_drop_the_same_rows_when_the_splits_change(spark, many_files, split, monkeypatch, stage):
    run = getattr(corpus_pipeline, stage)
    want = sorted(r.doc_id for r in run(spark, many_files, TINY).collect())
    real = corpus_pipeline.written

    def then_other_splits(df, name):
        out = real(df, name)
        split("8k")
        return out

    monkeypatch.setattr(corpus_pipeline, "written", then_other_splits)
    split("1g")
    got = sorted(r.doc_id for r in run(spark, many_files, TINY).collect())
    assert got == want and 0 < len(got) < many_files.count()


# ---- pipeline

CLASHES = ["__copies", "__order", "__src", "__rate", "__pipeline_tag", "a.b", "a b", "c0", "src", "rate", "copies",
           "place", "tag", "__tag_file", "MIX_copy", "we`ird"]


@pytest.mark.parametrize("files", [1, 3])
def test_columns_of_any_name_stay_as_they_are(spark, tiny, tmp_path, files):
    wide = tiny.limit(60).repartition(files)
    for k, name in enumerate(CLASHES):
        wide = wide.withColumn(name, F.concat(F.lit(f"{k}:"), F.col("doc_id").cast("string")))
    wide.write.parquet(str(tmp_path / "w"))
    docs = spark.read.parquet(str(tmp_path / "w"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, TINY)
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert rows
        for r in rows:
            assert [r[c] for c in CLASHES] == [f"{k}:{r['doc_id']}" for k in range(len(CLASHES))], name
    assert corpus_pipeline.pack_sequences(spark, docs, TINY).count() >= 60
    mixed = mixing.poisson_mix(docs, **queries.MIX)
    assert mixed.columns == [*docs.columns, "mix_rate", "mix_copies", "mix_order"]


def test_mixing_stage_draws_what_the_rule_says(spark, tiny):
    """Brute force of the draws in plain Python."""
    import math
    rows = tiny.collect()
    size = collections.Counter()
    for r in rows:
        size[r.source] += len(r.text or "")
    want_all, size_all = sum(math.sqrt(v) for v in size.values()), sum(size.values())
    rate = {s: round(math.sqrt(v) / want_all * size_all / v, 9) if v else 1.0 for s, v in size.items()}
    want = collections.Counter()
    for r in rows:
        draws = max(1, math.ceil(rate[r.source] / 30))
        mean, n = rate[r.source] / draws, 0
        for i in range(1, draws + 1):
            u = int(hashlib.md5(f"7:{r.doc_id}:{i}".encode()).hexdigest()[:13], 16) / (1 << 52)
            p = c = math.exp(-mean)
            k = 0
            while c <= u and k < 127:
                k += 1
                p *= mean / k
                c += p
                n += 1
        want[r.doc_id] = n
    got = collections.Counter(r.doc_id for r in corpus_pipeline.mix_sources(spark, tiny, TINY).collect())
    assert got == +want


def test_packing_stage_keeps_every_token(spark, tiny, texts):
    rows, want = corpus_pipeline.pack_sequences(spark, tiny, TINY).collect(), reference_encode()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for k, text in texts.items():
        ids, at = np.array([*want(text), queries.END_ID], "<u4"), 0
        for r in sorted(by[k], key=lambda r: r.piece):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    check_packing(rows, queries.CAPACITY)


# ---- samples that copies can't spoil

def test_language_sample_counts_copies_once(spark, tmp_path):
    rows = [("fr", f"une phrase {i} bonne et belle")for i in range(200)] + [("fr", "la même ligne")] * 20_000
    rows += [("en", f"some good line {i} of words") for i in range(200)]
    df = spark.createDataFrame(rows, "lang string, text string")
    seen = []
    real = language_id._fit

    def spy(batches):
        import pyarrow as pa
        held = list(batches)
        path = str(tmp_path / "sample")
        with open(path, "a") as f:
            for b in held:
                f.writelines(f"{x}\n" for x in b.column("lang").to_pylist())
        yield from real(iter(held))
    language_id._fit = spy
    try:
        assert language_id.train(df, per_language=400) is not None
    finally:
        language_id._fit = real
    seen = collections.Counter(open(tmp_path / "sample").read().split())
    assert seen == {"fr": 201, "en": 200}


def test_quality_sample_has_one_row_of_an_id(spark, tmp_path):
    rows = [(7, f"copy {i}", "en", "s", 5) for i in range(5000)] + [(i, f"text {i} here", "en", "s", 9) for i in range(100, 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    labels = spark.createDataFrame([(7, 1)] * 50 + [(i, i % 2) for i in range(100, 400)], "doc_id long, quality int")
    seen, real = str(tmp_path / "ids"), quality._fit

    def spy(rounds):
        inner = real(rounds)

        def run(batches):
            held = list(batches)
            with open(seen, "a") as f:
                for b in held:
                    f.writelines(f"{x}\n" for x in b.column("doc_id").to_pylist())
            yield from inner(iter(held))
        return run
    quality._fit = spy
    try:
        views = quality._views(docs, "doc_id", "text", "lang", "source", "n_chars")
        assert quality.train(views, labels, labelled=200, pool=300) is not None
    finally:
        quality._fit = real
    ids = open(seen).read().split()
    assert len(ids) == len(set(ids)) == 500


def test_near_copies_in_one_ball_take_little_memory():
    import tracemalloc
    rng = np.random.default_rng(0)
    flips = np.zeros(100_000, np.uint64)
    for _ in range(4):
        flips ^= np.uint64(1) << rng.integers(0, 64, 100_000).astype(np.uint64)
    points = np.unique(flips ^ np.uint64(0x123456789ABCDEF))
    tracemalloc.start()
    root = simhash_dedup.vp_forest(points, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(np.unique(root)) == 1 and peak < 1 << 29
    few = points[:1500] ^ (rng.integers(0, 2, 1500).astype(np.uint64) << np.uint64(63))
    got = simhash_dedup.vp_forest(few, 3)
    i, j = np.nonzero(np.bitwise_count(few[:, None] ^ few[None, :]) <= 3)
    assert np.array_equal(got, graph.forest(len(few), i, j))


def test_pipeline_stages(spark, tiny, odd, none):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "simhash_dedup", "mixing", "packing"]
    docs = corpus_pipeline.keep_quality(spark, tiny, TINY)
    assert docs.columns == tiny.columns and 0 < docs.count() < tiny.count()
    rejected = {r.doc_id for r in queries.op5_quality(spark, TINY).collect() if not r.kept}
    assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in tiny.collect()} - rejected
    unique = corpus_pipeline.drop_copies(spark, tiny, TINY)
    want = {}
    for r in tiny.collect():
        want[r.text] = max(want.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in unique.collect()) == sorted(want.values())
    near = corpus_pipeline.drop_near_copies(spark, tiny, TINY)
    heads = {r.component_id for r in queries.op9_simhash_dedup(spark, TINY).collect()}
    assert {r.doc_id for r in near.collect()} == heads
    mixed = corpus_pipeline.mix_sources(spark, tiny, TINY)
    assert mixed.columns == tiny.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, TINY).count() == 0
        assert stage(spark, odd, TINY).count() > 0
