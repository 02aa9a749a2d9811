import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_TINY, rows
from railyard.operators import text as tx
from railyard.plans import bindings as b

SPLIT_CASES = [
    ("a b  c", ["a", "b", "c"]),
    ("\"ab cd\" efgh 'i \" j'", ["ab cd", "efgh", 'i " j']),
    ("a\\ b", ["a b"]),
    ("''", [""]),
    ("x '' y", ["x", "", "y"]),
    ('"a\\"b"', ['a"b']),
    ("'a\\b'", ["a\\b"]),
    ("\"'d'\"", ["'d'"]),
    ("x\"\"y", ["xy"]),
    ("pre'mid dle'post", ["premid dlepost"]),
    ("   ", []),
    ("--conf \"spark.x=a b\" -v", ["--conf", "spark.x=a b", "-v"]),
    ("'unbalanced", None),
    ("also \"unbalanced", None),
    ("dangling\\", None),
]


def test_shell_split(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(SPLIT_CASES)], "i INT, line STRING")
    got = {r["i"]: r["t"] for r in df.select("i", tx.shell_split("line").alias("t")).collect()}
    for i, (line, expect) in enumerate(SPLIT_CASES):
        assert got[i] == expect, line


def test_parse_submit_lines(spark):
    lines = [
        "--master local --conf a=b -v app.jar x y",
        "--master=local -c k=v=w --help app.jar",
        "--name n --unknown-opt app.jar z",
        "--master",
        "--verbose=1 app.jar",
    ]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i INT, line STRING")
    got = {r["i"]: r for r in tx.parse_command_lines(df).collect()}
    opts = lambda r: [(o["name"], o["value"]) for o in r["options"]]
    assert opts(got[0]) == [("--master", "local"), ("--conf", "a=b"), ("--verbose", None)]
    assert (got[0]["resource"], got[0]["extras"]) == ("app.jar", ["x", "y"])
    assert opts(got[1]) == [("--master", "local"), ("--conf", "k=v=w"), ("--help", None)]
    assert opts(got[2]) == [("--name", "n")]
    assert (got[2]["resource"], got[2]["extras"]) == ("--unknown-opt", ["app.jar", "z"])
    assert got[3]["reject_reason"] == "missing_value"
    assert opts(got[4]) == [("--verbose", None)]


def test_chunk_split_round_trip(spark):
    docs = b.table(spark, SF_TINY, "documents").select("doc_id", "text")
    chunks = tx.chunk_split(docs, "doc_id", "text", 97)
    assert chunks.filter(F.length("body") > 97).count() == 0
    ann = docs.select(F.col("doc_id").alias("stream_id"),
                      F.octet_length("text").cast("bigint").alias("expected_bytes"))
    back = tx.reassemble_chunks(chunks.withColumnRenamed("doc_id", "stream_id"), ann,
                                "stream_id", "chunk_idx", "body")
    orig = docs.select("doc_id", F.col("text").alias("orig"))
    joined = back.join(orig, back.stream_id == orig.doc_id)
    assert joined.count() == docs.count()
    assert joined.filter(F.col("text") != F.col("orig")).count() == 0
    assert {r[0] for r in back.select("status").distinct().collect()} == {"complete"}


def test_chunk_split_empty_and_binary(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "abcdefg")], "id INT, t STRING")
    got = rows(tx.chunk_split(df, "id", "t", 3), "id", "chunk_idx", "offset", "length", "body")
    assert got == [(3, 0, 0, 3, "abc"), (3, 1, 3, 3, "def"), (3, 2, 6, 1, "g")]
    bdf = spark.createDataFrame([(1, bytes(range(10)))], "id INT, t BINARY")
    got = tx.chunk_split(bdf, "id", "t", 4).orderBy("chunk_idx").collect()
    assert [bytes(r["body"]) for r in got] == [bytes(range(4)), bytes(range(4, 8)), bytes([8, 9])]


def test_slice_range(spark):
    df = spark.createDataFrame([(1, "hello world", 6, 5), (2, "short", 2, 10), (3, "x", -1, 1)],
                               "id INT, body STRING, o INT, n INT")
    got = rows(tx.slice_range(df, "body", "o", "n"), "id", "slice", "reject_reason")
    assert got == [(1, "world", None), (2, None, "eof"), (3, None, "bad_range")]


def test_reassemble_statuses(spark):
    chunks = spark.createDataFrame([(1, 1, "lo"), (1, 0, "hel"), (2, 0, "abc")],
                                   "stream_id INT, chunk_idx INT, body STRING")
    ann = spark.createDataFrame([(1, 5), (2, 5), (3, 0), (4, 2)], "stream_id INT, expected_bytes BIGINT")
    got = rows(tx.reassemble_chunks(chunks, ann), "stream_id", "text", "status")
    assert got == [(1, "hello", "complete"), (2, "abc", "incomplete"), (3, "", "complete"),
                   (4, "", "incomplete")]


def _frames_and_packets(seed, n_frames=100):
    rnd = random.Random(seed)
    frames = [bytes(rnd.getrandbits(8) for _ in range(rnd.randint(1, 31 * 1024)))
              for _ in range(n_frames)]
    stream = b"".join((len(f) + 8).to_bytes(8, "big") + f for f in frames)
    packets, pos = [], 0
    while pos < len(stream):
        cut = rnd.randint(256, 4351)
        packets.append(stream[pos:pos + cut])
        pos += cut
    return frames, packets


def test_reassemble_frames_random_cuts(spark):
    data, expect = [], {}
    for conn in range(3):
        frames, packets = _frames_and_packets(conn, 40)
        expect[conn] = frames
        data += [(conn, i, p) for i, p in enumerate(packets)]
    # a connection whose last frame is cut short, and one with a bad length
    data.append((7, 0, (20).to_bytes(8, "big") + b"abc"))
    data.append((8, 0, (8).to_bytes(8, "big") + b"rest"))
    data.append((9, 0, (-1).to_bytes(8, "big", signed=True)))
    df = spark.createDataFrame(data, "conn INT, seq INT, payload BINARY")
    out = tx.reassemble_frames(df, "conn", "seq", "payload", num_partitions=3).collect()
    for conn, frames in expect.items():
        got = sorted((r["frame_idx"], bytes(r["payload"])) for r in out
                     if r["conn"] == conn and r["status"] == "frame")
        assert [f for _, f in got] == frames
        assert not [r for r in out if r["conn"] == conn and r["status"] != "frame"]
    tail = [r for r in out if r["conn"] == 7]
    assert [(r["status"], r["length"]) for r in tail] == [("incomplete_tail", 11)]
    assert [(r["status"], r["length"]) for r in out if r["conn"] == 8] == [("bad_length", 0)]
    assert [(r["status"], r["length"]) for r in out if r["conn"] == 9] == [("bad_length", -9)]


def test_reassemble_binary_keeps_bytes(spark):
    chunks = spark.createDataFrame([(1, 1, b"\x00a"), (1, 0, b"\xff\xfe"), (2, 0, None)],
                                   "stream_id INT, chunk_idx INT, body BINARY")
    ann = spark.createDataFrame([(1, 4), (2, 0), (3, 0)], "stream_id INT, expected_bytes BIGINT")
    got = {r["stream_id"]: (bytes(r["text"]), r["status"])
           for r in tx.reassemble_chunks(chunks, ann).collect()}
    assert got == {1: (b"\xff\xfe\x00a", "complete"), 2: (b"", "complete"), 3: (b"", "complete")}


def test_long_streams_come_in_parts(spark):
    import random
    rng = random.Random(2)
    data = [(s, i, bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 7, 40]))) if rng.random() < 0.95 else None)
            for s in (1, 2, None) for i in range(300)]
    df = spark.createDataFrame(rng.sample(data, len(data)), "stream_id long, chunk_idx long, body binary")
    got = tx.reassemble_parts(df, part_bytes=100, block_chunks=16).orderBy("part").collect()
    for s in (1, 2, None):
        mine, at = [r for r in got if r["stream_id"] == s], 0
        for r in mine:
            assert r["offset"] == at and r["offset"] // 100 == r["part"] and r["n_bytes"] == len(r["body"]) < 140
            at += r["n_bytes"]
        assert b"".join(bytes(r["body"]) for r in mine) == b"".join(x[2] or b"" for x in data if x[0] == s)
        assert sum(r["n_chunks"] for r in mine) == 300


def test_a_stream_over_the_cell_limit_has_no_text(spark):
    df = spark.createDataFrame([(1, 0, "ab"), (1, 1, "cd"), (2, 1, "é"), (2, 0, "x"), (3, 0, None)],
                               "stream_id long, chunk_idx long, body string")
    ann = spark.createDataFrame([(1, 4), (2, 3), (3, 0), (4, 0), (5, 1)], "stream_id long, expected_bytes long")
    got = {r["stream_id"]: (r["text"], r["bytes_read"], r["n_chunks"], r["status"])
           for r in tx.reassemble_chunks(df, ann, cell_bytes=3).collect()}
    assert got == {1: (None, 4, 2, "complete"), 2: ("xé", 3, 2, "complete"), 3: ("", 0, 1, "complete"),
                   4: ("", 0, 0, "complete"), 5: ("", 0, 0, "incomplete")}
