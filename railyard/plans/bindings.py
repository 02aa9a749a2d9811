"""Bindings of the operators to the bundled test tables.

The driver's tables are TPC-H-like plus an ``events`` stream; each function
here shapes one of them into the input an operator expects (which event kinds
act as requests, responses, hellos, …).  Only column pruning and filters
happen here, so Catalyst pushes them into the parquet scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from railyard.functions import json_int


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` plus ``k`` = the integer in ``props``."""
    return table(spark, sf_dir, "events").withColumn("k", json_int("props", "k"))


def view_click_channels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """JN2/AG2/WN2/JN4: requests = ``view``, responses = ``click``, channel =
    ``user_id``, tie-breaker ``event_id``."""
    cols = [F.col("user_id").alias("channel"), "ts", F.col("event_id").alias("id")]
    ev = table(spark, sf_dir, "events")
    return (ev.filter("event_type = 'view'").select(*cols),
            ev.filter("event_type = 'click'").select(*cols))


def hot_channel_view_clicks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """JN2 under skew: as ``view_click_channels`` but every event with
    ``event_id % 3 = 0`` is moved to channel -1, so one channel carries a
    third of all requests and responses."""
    ch = F.when(F.col("event_id") % 3 == 0, F.lit(-1).cast("bigint")).otherwise(F.col("user_id"))
    cols = [ch.alias("channel"), "ts", F.col("event_id").alias("id")]
    ev = table(spark, sf_dir, "events")
    return (ev.filter("event_type = 'view'").select(*cols),
            ev.filter("event_type = 'click'").select(*cols))


def block_id_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ1: one block id per event; the event kind decides its shape
    (valid, wrong prefix, three parts, non-integer part, five parts)."""
    e = events(spark, sf_dir)
    u, k, i = (F.col("user_id").cast("string"), F.col("k").cast("string"),
               F.col("event_id").cast("string"))
    bid = (F.when(F.col("event_type") == "view", F.concat_ws("_", F.lit("shuffle"), u, k, i))
           .when(F.col("event_type") == "click", F.concat_ws("_", F.lit("rdd"), u, k, i))
           .when(F.col("event_type") == "error", F.concat_ws("_", F.lit("shuffle"), u, k))
           .when(F.col("event_type") == "purchase",
                 F.concat_ws("_", F.lit("shuffle"), u, F.concat(F.lit("x"), k), i))
           .otherwise(F.concat_ws("_", F.lit("shuffle"), u, k, i, F.lit("extra"))))
    return e.select("event_id", bid.alias("block_id"))


def shuffle_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ2/SNK1: data file name per lineitem row."""
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     F.concat(F.lit("shuffle_"), F.col("l_orderkey").cast("string"),
                              F.lit("_0_0.data")).alias("key"))


def typed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ4/AG3: documents as messages; type id = doc_id % 12 - 1 (so -1 and
    the unknown 10 occur), body = text, string id = source."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", (F.col("doc_id") % 12 - 1).cast("int").alias("type_id"),
                    F.col("source").alias("stream_id"), F.col("text").alias("body"))


def stream_requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """FLT1: stream = event_id, client = user_id % 7 (null when 0), owner =
    k % 7 for streams with event_id % 11 <> 0 (the rest are unknown)."""
    e = events(spark, sf_dir)
    req = e.select(F.col("event_id").alias("stream_id"),
                   F.nullif(F.col("user_id") % 7, F.lit(0)).cast("string").alias("client_id"))
    own = e.filter(F.col("event_id") % 11 != 0).select(
        F.col("event_id").alias("stream_id"), (F.col("k") % 7).cast("string").alias("owner_app"))
    return req, own


def declared_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT2: declared length = n_chars + 8, with -1, 8 and 2^31+8 planted for
    doc_id % 10 in (0, 1, 2)."""
    d = table(spark, sf_dir, "documents")
    m = F.col("doc_id") % 10
    dl = (F.when(m == 0, F.lit(-1)).when(m == 1, F.lit(8))
          .when(m == 2, F.lit(2147483656)).otherwise(F.col("n_chars") + 8)).cast("bigint")
    return d.select("doc_id", dl.alias("declared_len"))


def first_views_and_answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """JN1: request = first ``view`` per ``(user_id, k)``; answer = ``click``
    (ok) or ``error`` (failed) with the same key."""
    e = events(spark, sf_dir)
    req = (e.filter("event_type = 'view'").groupBy("user_id", "k")
           .agg(F.min(F.struct("ts", "event_id")).alias("f"))
           .select("user_id", "k", F.col("f.ts").alias("ts"), F.col("f.event_id").alias("id")))
    resp = e.filter("event_type IN ('click', 'error')").select(
        "user_id", "k", "ts", F.col("event_id").alias("id"),
        F.when(F.col("event_type") == "click", "ok").otherwise("failed").alias("outcome"))
    return req, resp


def launcher_handshakes(spark: SparkSession, sf_dir: str):
    """JN3: connection = ``signup`` (secret = user_id), hello = ``view``,
    pending secrets = users with ``user_id % 10 <> 0``."""
    ev = table(spark, sf_dir, "events")
    cols = [F.col("user_id").alias("secret"), "ts", F.col("event_id").alias("id")]
    conns = ev.filter("event_type = 'signup'").select(*cols)
    hellos = ev.filter("event_type = 'view'").select(*cols)
    pending = ev.filter(F.col("user_id") % 10 != 0).select(F.col("user_id").alias("secret"))
    return conns, hellos, pending


def other_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN3: an ``error`` is a message that is no hello."""
    return table(spark, sf_dir, "events").filter("event_type = 'error'").select(
        F.col("user_id").alias("secret"), "ts", F.col("event_id").alias("id"))


def timed_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG2: a connection per lineitem row to ``l_suppkey``, connected after
    ``l_quantity`` milliseconds; bootstrapped ``l_partkey % 977`` later, but
    never for ``l_partkey % 23 = 0``."""
    def later(ts: Column, millis: Column) -> Column:
        return F.timestamp_add("MILLISECOND", millis.cast("int"), ts)
    done = later(F.col("l_shipdate"), F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("peer"), F.col("l_shipdate").alias("start_ts"), done.alias("connected_ts"),
        F.when(F.col("l_partkey") % 23 != 0, later(done, F.col("l_partkey") % 977)).alias("ready_ts"))


def rpc_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT1: client = user_id % 7 (null when 0, empty when 1), app = k % 7."""
    e = events(spark, sf_dir)
    who = F.col("user_id") % 7
    return e.select(F.col("event_id").alias("request_id"),
                    F.when(who == 1, "").when(who > 1, who.cast("string")).alias("client_id"),
                    (F.col("k") % 7).cast("string").alias("app_id"))


def disconnect_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN4: a ``signup`` on the channel is a disconnect, by error if its id
    is odd."""
    return table(spark, sf_dir, "events").filter("event_type = 'signup'").select(
        F.col("user_id").alias("channel"), "ts", F.col("event_id").alias("id"),
        F.when(F.col("event_id") % 2 == 1, "error").otherwise("closed").alias("cause"))


def lineitem_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN1/SNK2: one block per lineitem row; map = order, block order
    ``(l_shipdate, l_partkey, l_suppkey)``, size = quantity."""
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_shipdate", "l_partkey", "l_suppkey",
                     F.col("l_quantity").cast("bigint").alias("size"))


# Shuffle manager names by s_suppkey % 4 (the last one is not a
# real manager, so its executors are "unsupported").
MANAGER_BY_MOD4 = [
    "org.apache.spark.shuffle.hash.HashShuffleManager",
    "org.apache.spark.shuffle.sort.SortShuffleManager",
    "org.apache.spark.shuffle.unsafe.UnsafeShuffleManager",
    "org.apache.spark.shuffle.bogus.BogusShuffleManager",
]


def app_of(supplier: str) -> Column:
    """Two applications: the supplier's parity decides."""
    return F.concat(F.lit("app-"), (F.col(supplier) % 2 + 1).cast("string"))


def executor_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN5: suppliers are executors of two apps (those with
    ``s_suppkey % 5 = 0`` never registered); manager by ``s_suppkey % 4``."""
    s = table(spark, sf_dir, "supplier").filter(F.col("s_suppkey") % 5 != 0)
    mgr = F.element_at(F.array(*[F.lit(m) for m in MANAGER_BY_MOD4]),
                       (F.col("s_suppkey") % 4 + 1).cast("int"))
    return s.select(app_of("s_suppkey").alias("app_id"),
                    F.col("s_suppkey").cast("string").alias("exec_id"),
                    F.array(F.concat(F.lit("/data"), (F.col("s_nationkey") % 3).cast("string")),
                            F.concat(F.lit("/spill"), (F.col("s_suppkey") % 2).cast("string")))
                    .alias("local_dirs"),
                    F.lit(7).alias("sub_dirs"), mgr.alias("manager"))


def block_requests(indexed: DataFrame) -> DataFrame:
    """JN5/AG1: each lineitem block is fetched from executor ``l_suppkey``;
    ``l_partkey % 13 = 0`` asks for a reduce id past the index, ``% 17 = 0``
    sends a three-part (bad) id.  Request group = order."""
    base = F.concat(F.lit("shuffle_0_"), F.col("l_orderkey").cast("string"))
    bid = (F.when(F.col("l_partkey") % 17 == 0, base)
           .when(F.col("l_partkey") % 13 == 0,
                 F.concat(base, F.lit("_"), (F.col("idx") + 1000).cast("string")))
           .otherwise(F.concat(base, F.lit("_"), F.col("idx").cast("string"))))
    return indexed.select("l_orderkey", "l_partkey", app_of("l_suppkey").alias("app_id"),
                          F.col("l_suppkey").cast("string").alias("exec_id"),
                          bid.alias("block_id"))


def layered_customer_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG4: key = c_custkey; explicit layer = priority of the customer's last
    order (emptied for ``c_custkey % 3 = 0``), file layer = market segment for
    even keys, default ``'none'``."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    last = (o.groupBy("o_custkey")
            .agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("p")))
    explicit = last.select(F.col("o_custkey").alias("key"),
                           F.when(F.col("o_custkey") % 3 == 0, F.lit("")).otherwise(F.col("p"))
                           .alias("value"), F.lit("explicit").alias("layer"), F.lit(0).alias("rank"))
    file_ = c.filter(F.col("c_custkey") % 2 == 0).select(
        F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"),
        F.lit("file").alias("layer"), F.lit(1).alias("rank"))
    default = c.select(F.col("c_custkey").alias("key"), F.lit("none").alias("value"),
                       F.lit("default").alias("layer"), F.lit(2).alias("rank"))
    return explicit.unionByName(file_).unionByName(default)


def typed_customer_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG4: a setting per customer; by ``c_custkey % 5`` a whole number, a
    spelling of a boolean, a decimal, a malformed number, or not set."""
    c = table(spark, sf_dir, "customer")
    k, m = F.col("c_custkey").cast("string"), F.col("c_custkey") % 5
    value = (F.when(m == 0, F.concat(F.lit("-"), k)).when(m == 1, F.lit("TRUE"))
             .when(m == 2, F.concat(k, F.lit(".5"))).when(m == 3, F.concat(k, F.lit("x"))))
    return c.select(F.col("c_custkey").alias("key"), value.alias("value"))


def chunk_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN3: stream = user_id, arrival = ts, chunk index = k % 5 (5 chunks)."""
    e = events(spark, sf_dir)
    return e.select("user_id", "ts", "event_id", (F.col("k") % 5).cast("int").alias("idx"))


def stream_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN2: a purchase starts a stream on its user's channel, an error ends it."""
    e = events(spark, sf_dir).filter("event_type IN ('purchase', 'error')")
    return e.select(F.col("user_id").alias("channel"), "ts", F.col("event_id").alias("id"),
                    (F.col("event_type") == "purchase").cast("int").alias("active"))


def chunk_requests_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN3 under skew: as ``chunk_requests`` but events with
    ``event_id % 3 = 0`` all belong to stream -1 (a third of all requests)."""
    e = events(spark, sf_dir)
    stream = F.when(F.col("event_id") % 3 == 0, F.lit(-1).cast("bigint")).otherwise(F.col("user_id"))
    return e.select(stream.alias("user_id"), "ts", "event_id",
                    (F.col("k") % 5).cast("int").alias("idx"))


RETRY_ROWS = 500_000       # lineitem rows of a task


def retry_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN5/ST5: request = order, items = its distinct line numbers, attempts
    0-3 for every item, seq = item, outcome from
    ``(l_orderkey*31 + item*7 + attempt*13) % 5``: 0, 1 io_error; 2 fatal;
    else ok.  The keys are small, but a row is made of each for every attempt:
    the shuffle is sized by the rows, not by its bytes."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), li.count() // RETRY_ROWS + 1)
    li = li.repartition(parts, "l_orderkey", "l_linenumber").distinct()
    a = li.select("l_orderkey", "l_linenumber", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("attempt"))
    code = (F.col("l_orderkey") * 31 + F.col("l_linenumber") * 7 + F.col("attempt") * 13) % 5
    return a.select(F.col("l_orderkey").alias("request"), F.col("l_linenumber").alias("item"),
                    "attempt", F.col("l_linenumber").alias("seq"),
                    F.when(code <= 1, "io_error").when(code == 2, "fatal").otherwise("ok")
                    .alias("outcome"))


def registry_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1/ARR1: app = user_id % 20, exec = user_id; ``signup`` and ``view``
    register (info k, dirs ``/d{k}``, ``/e{k}``); ``error`` removes the app,
    with cleanup when k is even."""
    e = events(spark, sf_dir).filter("event_type IN ('signup', 'view', 'error')")
    reg = F.col("event_type") != "error"
    ks = F.col("k").cast("string")
    return e.select((F.col("user_id") % 20).alias("app"), F.col("user_id").alias("exec"),
                    "ts", F.col("event_id").alias("eid"),
                    F.when(reg, "register").otherwise("remove").alias("kind"),
                    F.when(reg, F.col("k")).alias("info"),
                    F.when(reg, F.array(F.concat(F.lit("/d"), ks), F.concat(F.lit("/e"), ks)))
                    .alias("local_dirs"),
                    F.when(~reg, F.col("k") % 2 == 0).alias("cleanup"))


def app_state_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2/ST7: app = user_id; signup SUBMITTED, view CONNECTED, click
    RUNNING, error with k < 5 FAILED, purchase with k < 5 FINISHED; other
    events carry no state change."""
    e = events(spark, sf_dir)
    st = (F.when(F.col("event_type") == "signup", "SUBMITTED")
          .when(F.col("event_type") == "view", "CONNECTED")
          .when(F.col("event_type") == "click", "RUNNING")
          .when((F.col("event_type") == "error") & (F.col("k") < 5), "FAILED")
          .when((F.col("event_type") == "purchase") & (F.col("k") < 5), "FINISHED"))
    return e.select(F.col("user_id").alias("app"), "ts", F.col("event_id").alias("eid"),
                    st.alias("state")).filter(F.col("state").isNotNull())


def app_events_with_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST7: the events of ``app_state_events``, and purchases with k >= 5,
    which set the app's id to ``app-<k>``."""
    e = events(spark, sf_dir).filter("event_type = 'purchase' AND k >= 5")
    return app_state_events(spark, sf_dir).withColumn("info", F.lit(None).cast("string")).unionByName(
        e.select(F.col("user_id").alias("app"), "ts", F.col("event_id").alias("eid"),
                 F.lit(None).cast("string").alias("state"),
                 F.concat(F.lit("app-"), F.col("k").cast("string")).alias("info")))


def signup_purchase_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST3: requests = ``signup``, responses = ``purchase``, channel =
    ``user_id``, correlation id = ``k`` modulo 4."""
    return events(spark, sf_dir).filter("event_type IN ('signup', 'purchase')").select(
        F.col("user_id").alias("channel"), (F.col("k") % 4).alias("corr"), "ts",
        F.col("event_id").alias("eid"),
        F.when(F.col("event_type") == "signup", 1).otherwise(0).alias("is_req"))


def timed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5: the retry log, a request a minute, its attempts an hour apart."""
    at = F.lit(1704067200) + F.col("request") * 60 + F.col("attempt") * 3600 + F.col("seq")
    return retry_log(spark, sf_dir).withColumn("ts", F.timestamp_seconds(at).cast("timestamp_ntz"))


def conversation_streams(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """TXT3/ST6: stream = conv_id, index = turn, body = text; announced bytes
    = the true total, +1 for ``conv_id % 7 = 0`` and -1 for ``% 7 = 1``."""
    c = table(spark, sf_dir, "conversations")
    chunks = c.select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("chunk_idx"),
                      F.col("text").alias("body"))
    tot = c.groupBy("conv_id").agg(F.sum(F.octet_length("text")).cast("bigint").alias("t"))
    adj = F.when(F.col("conv_id") % 7 == 0, 1).when(F.col("conv_id") % 7 == 1, -1).otherwise(0)
    ann = tot.select(F.col("conv_id").alias("stream_id"), (F.col("t") + adj).alias("expected_bytes"))
    return chunks, ann


def timed_conversation_streams(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """ST6: as ``conversation_streams``, a conversation begins at some minute
    of four weeks and has a turn a minute."""
    chunks, ann = conversation_streams(spark, sf_dir)
    minute = F.col("stream_id") * 97 % 40_000 + F.col("chunk_idx")
    return chunks.withColumn("ts", F.timestamp_seconds(1704067200 + 60 * minute).cast("timestamp_ntz")), ann


def view_click_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST4: requests = ``view``, responses = ``click``, channel = ``user_id``."""
    return table(spark, sf_dir, "events").filter("event_type IN ('view', 'click')").select(
        F.col("user_id").alias("channel"), "ts", F.col("event_id").alias("eid"),
        F.when(F.col("event_type") == "view", 1).otherwise(0).alias("is_req"))


def orders_and_shipments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """ST3: request = order, at a second of its date; response = its first
    shipment; those of ``l_orderkey % 11 = 0`` answer an unknown id."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")

    def at(day: str, key: Column) -> Column:
        return (F.col(day).cast("timestamp") + F.make_dt_interval(secs=key % 86_400)).cast("timestamp_ntz")
    key = F.col("l_orderkey")
    first = items.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("day"))
    return (orders.select(F.col("o_orderkey").alias("id"), at("o_orderdate", F.col("o_orderkey")).alias("req_ts")),
            first.select(F.when(key % 11 == 0, -key).otherwise(key).alias("id"), at("day", key * 7).alias("resp_ts")))


# ----------------------------------------------------------- rendered files
# The source operators read files; these helpers render a driver table into
# such files under the shared checkpoint folder (never a machine-local path
# on a cluster) and return where they went.

def _scratch(spark: SparkSession, name: str) -> str:
    from railyard.session import scratch_path
    return scratch_path(spark, name)


def rendered_customer_csv(spark: SparkSession, sf_dir: str) -> str:
    """SRC1: ``c_name, c_custkey`` lines (blank after the comma)."""
    path = _scratch(spark, "customer-csv")
    c = table(spark, sf_dir, "customer")
    c.select(F.concat_ws(", ", "c_name", F.col("c_custkey").cast("string")).alias("value")) \
        .write.text(path)
    return path


def rendered_customer_json(spark: SparkSession, sf_dir: str) -> str:
    """SRC2: JSON lines; the key is left out when ``c_custkey % 5 = 0``."""
    path = _scratch(spark, "customer-json")
    c = table(spark, sf_dir, "customer")
    key = F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey"))
    c.select(F.to_json(F.struct("c_name", key.alias("c_custkey"))).alias("value")).write.text(path)
    return path


def rendered_customer_kv(spark: SparkSession, sf_dir: str) -> str:
    """SRC3: ``c_custkey^Ac_name`` lines."""
    path = _scratch(spark, "customer-kv")
    c = table(spark, sf_dir, "customer")
    c.select(F.concat_ws("\x01", F.col("c_custkey").cast("string"), "c_name").alias("value")) \
        .write.text(path)
    return path


def rendered_customer_properties(spark: SparkSession, sf_dir: str) -> str:
    """SRC4: per customer a comment, a blank line and ``cust.<key>`` set to
    the name, by ``c_custkey % 4`` with a padded ``=``, a ``:`` and an escape
    in the key, white space, or on two lines; ``c_custkey % 7 = 0`` adds a
    line with a malformed escape."""
    path = _scratch(spark, "customer-props")
    c = table(spark, sf_dir, "customer")
    k, m = F.col("c_custkey").cast("string"), F.col("c_custkey") % 4
    kv = (F.when(m == 0, F.concat(F.lit("  cust."), k, F.lit(" = "), "c_name", F.lit("  ")))
          .when(m == 1, F.concat(F.lit("cust\\u002e"), k, F.lit(":"), "c_name"))
          .when(m == 2, F.concat(F.lit("cust."), k, F.lit("\t"), "c_name"))
          .otherwise(F.concat(F.lit("cust\\\n   ."), k, F.lit("="), "c_name")))
    bad = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("bad."), k, F.lit(" = \\u12")))
    lines = F.array(F.concat(F.lit("# customer "), k, F.lit("\\")), kv, F.lit(""), F.lit("! end"), bad)
    c.select(F.explode(lines).alias("value")).filter("value IS NOT NULL").write.text(path)
    return path


def rendered_document_files(spark: SparkSession, sf_dir: str, per_file: int = 200
                            ) -> tuple[str, DataFrame]:
    """SRC5: documents written like map-output data files: a file for every
    ``per_file`` ids (``bucket``), holding its documents' text in
    doc_id order (one line each), plus their byte offsets from
    ``offset_index``.  Segment per document: ``length`` 100 at
    ``doc offset + doc_id % 50`` of its file, so segments that run past the
    end of a file are ``eof``."""
    from railyard.operators.windows import offset_index
    path = _scratch(spark, "doc-files")
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.floor(F.col("doc_id") / per_file).alias("bucket"), "text")
    (d.repartition("bucket").sortWithinPartitions("bucket", "doc_id")
     .select("bucket", F.col("text").alias("value"))
     .write.partitionBy("bucket").text(path))
    sized = d.select("doc_id", "bucket",
                     (F.octet_length("text") + 1).cast("bigint").alias("size"))
    idx = offset_index(sized, ["bucket"], ["doc_id"], "size",
                       block=(F.col("doc_id") / 4096).cast("bigint"))
    listing = spark.read.format("binaryFile").load(path).select("path", "bucket")
    segs = idx.join(listing, "bucket").select(
        "doc_id", "path", (F.col("offset") + F.col("doc_id") % 50).alias("offset"),
        F.lit(100).cast("bigint").alias("length"))
    return path, segs


def submit_command_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT4: one submit command line per order.  ``o_orderkey % 10``: 0 uses
    the ``--k=v`` form, a short alias and a trailing app argument; 1 ends
    with a valued option and no value; 2 single-quotes the conf value; 3 has
    an unbalanced double quote; the rest is
    ``--name o<key> --conf p=<status> -v app.jar``."""
    o = table(spark, sf_dir, "orders")
    k, st = F.col("o_orderkey").cast("string"), F.col("o_orderstatus")
    m = F.col("o_orderkey") % 10
    line = (F.when(m == 0, F.concat(F.lit("--name=o"), k, F.lit(" -c p="), st,
                                    F.lit(" --verbose app.jar extra"), k))
            .when(m == 1, F.concat(F.lit("--name o"), k, F.lit(" --conf")))
            .when(m == 2, F.concat(F.lit("--name o"), k, F.lit(" --conf 'p="), st, F.lit("' -v app.jar")))
            .when(m == 3, F.concat(F.lit('--name "o'), k, F.lit(" -v app.jar")))
            .otherwise(F.concat(F.lit("--name o"), k, F.lit(" --conf p="), st, F.lit(" -v app.jar"))))
    return o.select("o_orderkey", line.alias("line"))


PACKET_BYTES = 1000


def framed_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT5: documents as frames (8-byte big-endian self-inclusive length +
    UTF-8 text) on connection ``doc_id % 8`` in doc_id order, the byte
    stream cut into 1000-byte packets (frames and length fields straddle
    packets).  Connection 6 ends with a frame declaring length 8 (empty, an
    error); connection 7 ends with 4 stray bytes (an incomplete tail)."""
    from railyard.operators.windows import offset_index
    d = table(spark, sf_dir, "documents")
    body = F.encode("text", "UTF-8")
    frames = d.select((F.col("doc_id") % 8).alias("conn"), "doc_id",
                      (F.octet_length(body) + 8).cast("bigint").alias("flen"),
                      body.alias("body"))
    frames = frames.withColumn(
        "frame", F.concat(F.unhex(F.lpad(F.hex("flen"), 16, "0")), F.col("body")))
    idx = offset_index(frames, ["conn"], ["doc_id"], "flen",
                       block=(F.col("doc_id") / 1024).cast("bigint"))
    P = PACKET_BYTES
    first = (F.col("offset") / P).cast("bigint")
    last = ((F.col("next_offset") - 1) / P).cast("bigint")
    pieces = idx.select("conn", "doc_id", "frame", "offset", "next_offset",
                        F.explode(F.sequence(first, last)).alias("p"))
    start = F.greatest(F.col("offset"), F.col("p") * P)
    end = F.least(F.col("next_offset"), (F.col("p") + 1) * P)
    pieces = pieces.select("conn", "p", "doc_id", F.substring(
        "frame", (start - F.col("offset") + 1).cast("int"), (end - start).cast("int")).alias("piece"))
    packets = (pieces.groupBy("conn", "p")
               .agg(F.array_sort(F.collect_list(F.struct("doc_id", "piece"))).alias("parts"))
               .select("conn", F.col("p").alias("seq"),
                       F.aggregate("parts", F.unhex(F.lit("")),
                                   lambda acc, x: F.concat(acc, x["piece"])).alias("payload")))
    tail = spark.createDataFrame(
        [(6, 1 << 40, bytes.fromhex("0000000000000008")), (7, 1 << 40, bytes.fromhex("00000000"))],
        "conn BIGINT, seq BIGINT, payload BINARY")
    return packets.unionByName(tail)
