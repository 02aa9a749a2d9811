from pyspark.sql import functions as F

from conftest import rows
from railyard.functions import java_string_hash, join_nonempty, nonneg_hash
from railyard.operators import projections as pj


def java_hash(s: str) -> int:
    h = 0
    units = s.encode("utf-16-be")
    for i in range(0, len(units), 2):
        h = (31 * h + int.from_bytes(units[i:i + 2])) & 0xFFFFFFFF
    return h - (1 << 32) if h >= 1 << 31 else h


def test_java_string_hash(spark):
    keys = ["", "a", "shuffle_1_0_0.data", "shuffle_0_1_0.index", "polygenelubricants",
            "Aa", "BB", "x" * 200, "é\U0001F600z\U00010000\U0010FFFF\uffff"]
    df = spark.createDataFrame([(k,) for k in keys], "k STRING")
    got = {r["k"]: (r["h"], r["n"]) for r in
           df.select("k", java_string_hash("k").alias("h"), nonneg_hash("k").alias("n")).collect()}
    for k in keys:
        assert got[k][0] == java_hash(k), k
        assert got[k][1] == abs(java_hash(k))
    assert got["shuffle_1_0_0.data"][0] == 385298155
    # the one value whose 32-bit absolute value overflows stays non-negative here
    assert got["polygenelubricants"] == (-(2**31), 2**31)


def test_parse_block_ids(spark):
    cases = {
        "shuffle_1_2_3": (1, 2, 3, None),
        "shuffle_1_2_3_extra": (1, 2, 3, None),
        "shuffle_1_2_3__": (1, 2, 3, None),
        "shuffle_+1_-2_3": (1, -2, 3, None),
        "shuffle_1_2": (None, None, None, "bad_block_id"),
        "": (None, None, None, "bad_block_id"),
        "rdd_1_2_3": (None, None, None, "bad_shuffle_id"),
        "shuffle_a_2_3": (None, None, None, "non_int"),
        "shuffle__2_3": (None, None, None, "non_int"),
        "shuffle_99999999999_1_1": (None, None, None, "non_int"),
        "shuffle_1_2_3.5": (None, None, None, "non_int"),
    }
    df = spark.createDataFrame([(k,) for k in cases], "block_id STRING")
    out = pj.parse_block_ids(df, "block_id").collect()
    got = {r["block_id"]: (r["shuffle_id"], r["map_id"], r["reduce_id"], r["reject_reason"])
           for r in out}
    assert got == cases


def test_place_by_hash(spark):
    keys = ["shuffle_0_%d_0.data" % i for i in range(50)] + ["polygenelubricants"]
    df = spark.createDataFrame([(k,) for k in keys], "key STRING")
    out = pj.place_by_hash(df, "key", 3, 7).collect()
    for r in out:
        h = abs(java_hash(r["key"]))
        assert (r["h"], r["dir_id"], r["sub_id"]) == (h, h % 3, (h // 3) % 7)
        assert r["sub_dir"] == "%02x" % ((h // 3) % 7)


def test_decode_message_type(spark):
    df = spark.createDataFrame([(i,) for i in range(-1, 11)], "t INT")
    got = {r["t"]: (r["type_name"], r["reject_reason"]) for r in
           pj.decode_message_type(df, "t", pj.dictionary(spark, "message")).collect()}
    assert got[3] == ("RpcRequest", None)
    assert got[9] == ("OneWayMessage", None)
    assert got[-1] == (None, "user_type")
    assert got[10] == (None, "unknown_type")
    got2 = {r["t"]: r["type_name"] for r in
            pj.decode_message_type(df, "t", pj.dictionary(spark, "block")).collect()}
    assert got2[0] == "OPEN_BLOCK" and got2[4] == "REGISTER_DRIVER" and got2[5] is None


def test_tenant_isolation(spark):
    req = spark.createDataFrame([(1, None), (1, ""), (1, "app"), (1, "other"), (2, "app")],
                                "stream_id INT, client_id STRING")
    own = spark.createDataFrame([(1, "app")], "stream_id INT, owner_app STRING")
    got = rows(pj.tenant_isolation(req, own), "stream_id", "client_id", "status")
    assert got == sorted([(1, None, "authorized"), (1, "", "authorized"), (1, "app", "authorized"),
                          (1, "other", "denied"), (2, "app", "unknown_stream")], key=repr)
    assert pj.authorized(req, own).count() == 3
    assert pj.denied(req, own).count() == 2


def test_frame_size_guard(spark):
    vals = [-1, 8, 9, 2**31 - 1 + 9, 2**31 - 2 + 8, 2**31 - 1 + 8]
    df = spark.createDataFrame([(v,) for v in vals], "declared_len BIGINT")
    got = {r["declared_len"]: r["reject_reason"] for r in pj.frame_size_guard(df).collect()}
    assert got == {-1: "negative", 8: "empty", 9: None, 2**31 - 1 + 9: "too_large",
                   2**31 - 2 + 8: None, 2**31 - 1 + 8: "too_large"}
    assert pj.accepted_frames(df).count() == 2


def test_join_nonempty(spark):
    df = spark.createDataFrame([("a", "", "b", None), ("", "", "", None), ("a", "b", "", "c")],
                               "p STRING, q STRING, r STRING, s STRING")
    got = [r[0] for r in df.select(join_nonempty("/", "p", "q", "r", "s")).collect()]
    assert got == ["a/b", "", "a/b/c"]


def test_isolation_lets_unnamed_clients_through(spark):
    req = spark.createDataFrame([(1, None), (1, ""), (1, "a"), (2, "a"), (2, "b")], "stream_id INT, client_id STRING")
    own = spark.createDataFrame([(2, "a")], "stream_id INT, owner_app STRING")
    got = sorted((r["stream_id"], r["client_id"] or "-", r["status"]) for r in pj.tenant_isolation(req, own).collect())
    assert got == [(1, "-", "authorized"), (1, "-", "authorized"), (1, "a", "unknown_stream"),
                   (2, "a", "authorized"), (2, "b", "denied")]
    rpc = spark.createDataFrame([(None, "x"), ("", "x"), ("x", "x")], "client_id STRING, app_id STRING")
    assert [r["status"] for r in pj.rpc_isolation(rpc).collect()] == ["authorized", "denied", "authorized"]


def test_census_counts_null_fields_as_empty_and_joins_nothing(spark):
    from railyard.operators.aggregates import message_census
    m = spark.createDataFrame([(2, None, None), (8, None, "err")], "type_id INT, stream_id STRING, body STRING")
    out = message_census(pj.decode_message_type(m, "type_id", "message"))
    got = {r["type_name"]: (r["n"], r["header_bytes"]) for r in out.collect()}
    assert got == {"ChunkFetchFailure": (1, 25), "StreamFailure": (1, 20)}
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_typed_settings(spark):
    from railyard.operators.aggregates import typed_settings
    df = spark.createDataFrame([(i, v) for i, v in enumerate(
        [None, "", "TRUE", "yes", "-7", "+7", " 7", "2147483648", "1.5", " 1e3 ", "NaN", "2f", "0x1", "\u0663"])],
        "key int, value string")

    def got(kind, default):
        return {r["value"]: (r["typed"], r["reject_reason"]) for r in typed_settings(df, kind, default).collect()}

    as_int = got("int", 3)
    assert as_int[None] == (3, None) and as_int["-7"] == (-7, None) and as_int["+7"] == (7, None)
    for v in ("", " 7", "2147483648", "1.5", "TRUE", "\u0663"):
        assert as_int[v] == (None, "bad_int")
    assert got("bigint", None)["2147483648"] == (2147483648, None) and got("bigint", None)[None] == (None, None)
    as_bool = got("boolean", True)
    assert as_bool[None] == (True, None) and as_bool["TRUE"] == (True, None) and as_bool["yes"] == (False, None)
    as_double = got("double", 0.5)
    assert [as_double[v][0] for v in (None, "1.5", " 1e3 ", " 7", "2f")] == [0.5, 1.5, 1000.0, 7.0, 2.0]
    assert as_double["NaN"][0] != as_double["NaN"][0] and as_double["NaN"][1] is None
    assert as_double[""] == (None, "bad_double")
