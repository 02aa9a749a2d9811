import os

from pyspark.sql import functions as F

from conftest import SF_TINY, rows
from railyard import sources as src
from railyard.plans import bindings as b


def _write(path, text, mode="w"):
    with open(path, mode) as f:
        f.write(text)
    return path


def test_scan_delimited_and_json(spark, tmp_path):
    p = _write(tmp_path / "people.txt", "Ann, 29\nBo, 30\nCy, 19\n")
    assert rows(src.scan_delimited(spark, str(p), "name STRING, age INT")) == [
        ("Ann", 29), ("Bo", 30), ("Cy", 19)]
    j = _write(tmp_path / "people.json", '{"name":"Ann"}\n{"name":"Bo", "age":30}\n')
    assert rows(src.scan_json_lines(spark, str(j))) == sorted([(None, "Ann"), (30, "Bo")], key=repr)
    assert rows(src.scan_json_lines(spark, str(j), "name STRING, age BIGINT")) == [
        ("Ann", None), ("Bo", 30)]


def test_scan_ctrl_a_kv_keeps_duplicates(spark, tmp_path):
    p = _write(tmp_path / "kv.txt", "1\x01one\n2\x01two\n1\x01uno\n3\x01x,\"y\"\n")
    assert rows(src.scan_ctrl_a_kv(spark, str(p))) == [(1, "one"), (1, "uno"), (2, "two"),
                                                       (3, 'x,"y"')]


def test_scan_rejects(spark, tmp_path):
    p = _write(tmp_path / "people.txt", "Ann, 29\nBo, many\nCy, 19, 7\n")
    assert rows(src.scan_delimited(spark, str(p), "name STRING, age INT", reject_col="bad")) == [
        ("Ann", 29, None), ("Bo", None, "Bo, many"), ("Cy", 19, "Cy, 19, 7")]
    k = _write(tmp_path / "kv.txt", "9007199254740993\x01a\nx\x01b\n")
    got = {r["value"]: (r["key"], r["bad"]) for r in src.scan_ctrl_a_kv(spark, str(k), reject_col="bad").collect()}
    assert got == {"a": (9007199254740993, None), "b": (None, "x\x01b")}


def test_scan_properties(spark, tmp_path):
    p = _write(tmp_path / "defaults.conf",
               "# comment\\\n! also comment\n\n spark.a = first \nspark.b=x=y\nnovalue\nspark.c 3\nspark.d:4\n"
               "\tspark.e\t=\t5\t\n\t# c=1\ntwo\\\n   .lines = a\\\n  b\nwith\\ blank\\=key = v\\tw\\\\\n"
               "uni = \\u00e9\\ud83d\\ude00\nbad = \\u12\nspark.a : 1\nend = x\\")
    got = {r["key"]: r["value"] for r in src.scan_properties(spark, str(p), "file").collect()
           if r["reject_reason"] is None}
    assert got == {"spark.a": "1", "spark.b": "x=y", "novalue": "", "spark.c": "3", "spark.d": "4",
                   "spark.e": "5", "two.lines": "ab", "with blank=key": "v\tw\\",
                   "uni": "\u00e9\U0001F600", "end": "x"}
    bad = src.scan_properties(spark, str(p), "file").filter("reject_reason IS NOT NULL").collect()
    assert [tuple(r) for r in bad] == [("file", None, "bad = \\u12", "malformed_escape")]


def test_properties_do_not_depend_on_the_splits(spark, tmp_path):
    import random
    rng = random.Random(4)
    pieces = ["a", "b=", " ", "\\", "\\\\", "#", "!", "\t", ":", "\\u00e9", "key", "é", "\\u12", "x\\"]
    ends = ["\n", "\n", "\r\n", "\r"]
    for k in range(3):
        text = "".join("".join(rng.choices(pieces, k=rng.randint(0, 6))) + rng.choice(ends) for _ in range(400))
        (tmp_path / "p").mkdir(exist_ok=True)
        with open(tmp_path / "p" / f"{k}.conf", "w", newline="") as f:
            f.write("one\\\n  two\\\n\\\n# three\nlast = 1\n" + text)
    old, seen = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}, []
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for size in ("48", "333", "1g"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df = src.scan_properties(spark, str(tmp_path / "p"), "x")
            seen.append(rows(df))
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) > 300
    assert sum(r[1] == "onetwo#" and r[2] == "three" for r in seen[0]) == 3


def test_segments_of_a_file_larger_than_a_cell(spark, tmp_path):
    size = 3 << 30                                    # no bytes on disk: a hole
    with open(tmp_path / "big.bin", "wb") as f:
        f.write(b"head")
        f.seek(size - 4)
        f.write(b"tail")
    path = "file:" + str(tmp_path / "big.bin")
    segs = spark.createDataFrame([(path, 0, 6, "x"), (path, size - 6, 6, "x"), (path, 1 << 31, 2, None),
                                  (path, size - 1, 2, "x"), (path, None, 2, "x"), (path, -1, 2, "x"), (None, 0, 1, "x"),
                                  (path, size, 0, "x")], "path string, offset long, length long, data string")
    got = {(r["path"] is None, r["offset"]): r for r in src.scan_segments(
        spark, str(tmp_path), segs.withColumnRenamed("data", "__path")).collect()}
    assert bytes(got[False, 0]["data"]) == b"head\0\0" and bytes(got[False, size - 6]["data"]) == b"\0\0tail"
    assert bytes(got[False, 1 << 31]["data"]) == b"\0\0" and bytes(got[False, size]["data"]) == b""
    assert {k[1]: r["reject_reason"] for k, r in got.items() if r["reject_reason"]} == {
        size - 1: "eof", None: "bad_range", -1: "bad_range", 0: "missing_file"} or got[True, 0]["reject_reason"] == "missing_file"
    assert got[False, 0]["file_size"] == size and got[False, 0]["__path"] == "x"


def test_scan_segments(spark, tmp_path):
    d = tmp_path / "files"
    d.mkdir()
    _write(d / "a.bin", "0123456789")
    _write(d / "b.bin", "abc")
    listing = spark.read.format("binaryFile").load(str(d)).select("path")
    pa = [r[0] for r in listing.collect() if r[0].endswith("a.bin")][0]
    pb = [r[0] for r in listing.collect() if r[0].endswith("b.bin")][0]
    segs = spark.createDataFrame([(pa, 2, 5), (pa, 8, 2), (pa, 8, 3), (pb, 0, 3), ("file:/nope", 0, 1)],
                                 "path STRING, offset BIGINT, length BIGINT")
    got = {(r["path"], r["offset"], r["length"]): (bytes(r["data"]) if r["data"] else None,
                                                   r["reject_reason"])
           for r in src.scan_segments(spark, str(d), segs).collect()}
    assert got[(pa, 2, 5)] == (b"23456", None)
    assert got[(pa, 8, 2)] == (b"89", None)
    assert got[(pa, 8, 3)] == (None, "eof")
    assert got[(pb, 0, 3)] == (b"abc", None)
    assert got[("file:/nope", 0, 1)] == (None, "missing_file")


def test_sinks_round_trip(spark, tmp_path):
    names = b.shuffle_file_names(spark, SF_TINY)
    out = str(tmp_path / "hashed")
    src.write_hashed_layout(names, "key", 3, 5, out)
    back = src.read_hashed_layout(spark, out, "l_orderkey BIGINT, l_linenumber INT, key STRING, "
                                  + src.sinks.HASHED_SCHEMA_EXTRA)
    assert back.count() == names.count()
    dirs = sorted(os.listdir(out))
    assert [x for x in dirs if x.startswith("dir_id=")] == ["dir_id=0", "dir_id=1", "dir_id=2"]
    assert back.filter(F.col("sub_dir") != F.lpad(F.lower(F.hex("sub_id")), 2, "0")).count() == 0

    blocks = b.lineitem_blocks(spark, SF_TINY)
    man = src.write_sorted_blocks(blocks, "l_orderkey", ["l_shipdate", "l_partkey", "l_suppkey"],
                                  "size", str(tmp_path / "sorted"))
    firsts = man.filter("idx = 0")
    assert firsts.filter("offset <> 0").count() == 0
    tot = man.groupBy("l_orderkey").agg(F.max("next_offset").alias("t"))
    exp = blocks.groupBy("l_orderkey").agg(F.sum("size").alias("t"))
    assert rows(tot) == rows(exp)


def test_segments_over_bucketed_document_files(spark):
    path, segs = b.rendered_document_files(spark, SF_TINY, per_file=50)
    out = src.scan_segments(spark, path, segs).collect()
    docs = {r["doc_id"]: r["text"] for r in b.table(spark, SF_TINY, "documents").collect()}
    assert len(out) == len(docs)
    for r in out:
        if r["reject_reason"] == "eof":
            assert r["offset"] + r["length"] > r["file_size"]
            continue
        own = (docs[r["doc_id"]] + "\n").encode()[r["doc_id"] % 50:][:100]
        assert bytes(r["data"])[:len(own)] == own
