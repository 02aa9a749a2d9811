"""Registered queries (one per operator binding) with DuckDB oracles.

Oracle SQL conventions: tables are the driver's views; ``k`` is
``CAST(json_extract_string(props, '$.k') AS INTEGER)``; integer outputs are
cast to BIGINT so both engines agree on types.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from railyard import functions as fn
from railyard.operators import aggregates as ag
from railyard.operators import joins as jn
from railyard.operators import projections as pj
from railyard.plans import bindings as b
from railyard.plans.catalog import register

# ---------------------------------------------------------------- shared SQL
def queue_walk_sql(events: str, give_up_us: int = 1 << 60) -> str:
    """FIFO matching by walking every channel's queue event by event:
    ``walk`` holds the queue after each event, ``done`` what was decided.
    ``events`` selects ``channel, ts, eid, is_req``."""
    return f"""
WITH RECURSIVE ev AS ({events}),
num AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY channel ORDER BY ts, is_req, eid) AS n
        FROM ev),
walk AS (
  SELECT DISTINCT channel, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(us BIGINT, id BIGINT)[]) AS q,
         CAST([] AS STRUCT(us BIGINT, id BIGINT)[]) AS gone, CAST(NULL AS STRUCT(us BIGINT, id BIGINT)) AS hit,
         CAST(NULL AS BIGINT) AS resp, CAST(NULL AS TIMESTAMP) AS came
  FROM num
  UNION ALL
  SELECT channel, n, CASE WHEN is_req = 1 THEN list_append(alive, {{'us': us, 'id': eid}}) ELSE alive[2:] END,
         gone, CASE WHEN is_req = 0 THEN alive[1] END, CASE WHEN is_req = 0 THEN eid END, ts
  FROM (SELECT e.*, [x for x in w.q if x.us + {give_up_us} >= e.us] AS alive,
               [x for x in w.q if x.us + {give_up_us} < e.us] AS gone
        FROM walk w JOIN num e ON e.channel = w.channel AND e.n = w.n + 1) t
),
done AS (
  SELECT channel, hit.id AS req_id, make_timestamp(hit.us) AS req_ts, resp AS resp_id, came AS resp_ts,
         CASE WHEN hit IS NULL THEN 'orphan' ELSE 'matched' END AS status
  FROM walk WHERE resp IS NOT NULL
  UNION ALL
  SELECT channel, g.id, make_timestamp(g.us), NULL, NULL, 'timed_out'
  FROM (SELECT channel, unnest(gone) AS g FROM walk) t
),
waiting AS (
  SELECT channel, g.id AS req_id, g.us AS us
  FROM (SELECT channel, unnest(arg_max(q, n)) AS g FROM walk GROUP BY channel) t
)"""


VIEW_CLICKS_SQL = """
  SELECT user_id AS channel, ts, event_id AS eid, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS is_req
  FROM events WHERE event_type IN ('view', 'click')"""
QUEUE_FIFO_SQL = queue_walk_sql(VIEW_CLICKS_SQL) + """,
fifo AS (SELECT * FROM done UNION ALL
         SELECT channel, req_id, make_timestamp(us), NULL, NULL, 'outstanding' FROM waiting)
"""

# JN2 in SQL: the same running-sum characterisation with plain windows over
# whole channels (the Spark side splits channels into day blocks).
FIFO_SQL = """
WITH ev AS (
  SELECT user_id AS channel, ts, event_id AS eid,
         CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS is_req
  FROM events WHERE event_type IN ('view', 'click')
), s1 AS (
  SELECT *, SUM(CASE WHEN is_req = 1 THEN 1 ELSE -1 END) OVER w AS s,
            SUM(is_req) OVER w AS n_req, SUM(1 - is_req) OVER w AS n_resp
  FROM ev
  WINDOW w AS (PARTITION BY channel ORDER BY ts, is_req, eid
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), s2 AS (
  SELECT *, MIN(s) OVER (PARTITION BY channel ORDER BY ts, is_req, eid
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_min
  FROM s1
), s3 AS (
  SELECT *, (is_req = 0 AND s < LEAST(0, COALESCE(prior_min, 0))) AS orphan,
         LEAST(0, s, COALESCE(prior_min, 0)) AS low
  FROM s2
), s4 AS (
  SELECT *, CASE WHEN is_req = 1 THEN n_req
                 WHEN NOT orphan THEN n_resp + low END AS k
  FROM s3
), fifo AS (
  SELECT r.channel, r.eid AS req_id, r.ts AS req_ts, a.eid AS resp_id, a.ts AS resp_ts,
         CASE WHEN a.eid IS NULL THEN 'outstanding' ELSE 'matched' END AS status
  FROM (SELECT * FROM s4 WHERE is_req = 1) r
  LEFT JOIN (SELECT * FROM s4 WHERE is_req = 0 AND NOT orphan) a
    ON r.channel = a.channel AND r.k = a.k
  UNION ALL
  SELECT channel, CAST(NULL AS BIGINT), CAST(NULL AS TIMESTAMP), eid, ts, 'orphan'
  FROM s4 WHERE orphan
)
"""


def _fifo(spark, sf):
    req, resp = b.view_click_channels(spark, sf)
    return jn.fifo_match(req, resp, "channel", "ts", "id")


@register("jn2_fifo_match", QUEUE_FIFO_SQL + "SELECT * FROM fifo")
def q_fifo_match(spark, sf):
    return _fifo(spark, sf)


@register("ag2_latency_summary", QUEUE_FIFO_SQL + """
SELECT channel AS peer, COUNT(*) AS n, CAST(SUM(lat_us) AS BIGINT) AS total_us,
       MAX(lat_us) AS max_us, MIN(lat_us) AS min_us,
       quantile_cont(lat_us, 0.5) AS p50_us,
       CAST(SUM(lat_us) AS DOUBLE) / COUNT(*) AS avg_us
FROM (SELECT channel, epoch_us(resp_ts) - epoch_us(req_ts) AS lat_us
      FROM fifo WHERE status = 'matched') t
GROUP BY channel
""")
def q_latency_summary(spark, sf):
    return ag.latency_summary(_fifo(spark, sf), "channel", "req_ts", "resp_ts")


@register("ag2_connection_summary", """
WITH c AS (SELECT l_suppkey AS peer, CAST(l_quantity AS BIGINT) * 1000 AS connect_us,
                  CASE WHEN l_partkey % 23 <> 0 THEN l_partkey % 977 * 1000 END AS bootstrap_us FROM lineitem),
p AS (SELECT peer, 'connect' AS phase, connect_us AS us FROM c
      UNION ALL SELECT peer, 'bootstrap', bootstrap_us FROM c WHERE bootstrap_us IS NOT NULL)
SELECT peer, phase, count(*) AS n, CAST(sum(us) AS BIGINT) AS total_us, max(us) AS max_us, min(us) AS min_us,
       quantile_cont(us, 0.5) AS p50_us, CAST(sum(us) AS DOUBLE) / count(*) AS avg_us
FROM p GROUP BY ALL
""")
def q_connection_summary(spark, sf):
    return ag.connection_summary(b.timed_connections(spark, sf))


@register("jn2_fifo_match_hot_channel", queue_walk_sql(VIEW_CLICKS_SQL.replace(
    "user_id AS channel", "CASE WHEN event_id % 3 = 0 THEN CAST(-1 AS BIGINT) ELSE user_id END AS channel"))
    + """
SELECT * FROM done
UNION ALL
SELECT channel, req_id, make_timestamp(us), NULL, NULL, 'outstanding' FROM waiting
""")
def q_fifo_match_hot_channel(spark, sf):
    req, resp = b.hot_channel_view_clicks(spark, sf)
    return jn.fifo_match(req, resp, "channel", "ts", "id")


# ======================================================== projections/filters
EVENTS_K = """
e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
"""

BLOCK_IDS_SQL = "WITH " + EVENTS_K + """,
ids AS (
  SELECT event_id, CASE event_type
    WHEN 'view' THEN 'shuffle_' || user_id || '_' || k || '_' || event_id
    WHEN 'click' THEN 'rdd_' || user_id || '_' || k || '_' || event_id
    WHEN 'error' THEN 'shuffle_' || user_id || '_' || k
    WHEN 'purchase' THEN 'shuffle_' || user_id || '_x' || k || '_' || event_id
    ELSE 'shuffle_' || user_id || '_' || k || '_' || event_id || '_extra' END AS block_id
  FROM e
), p AS (
  SELECT *, string_split(regexp_replace(block_id, '_+$', ''), '_') AS parts FROM ids
), n AS (
  SELECT *,
    CASE WHEN regexp_full_match(parts[2], '[+-]?[0-9]+') THEN TRY_CAST(parts[2] AS INTEGER) END AS a,
    CASE WHEN regexp_full_match(parts[3], '[+-]?[0-9]+') THEN TRY_CAST(parts[3] AS INTEGER) END AS b,
    CASE WHEN regexp_full_match(parts[4], '[+-]?[0-9]+') THEN TRY_CAST(parts[4] AS INTEGER) END AS c
  FROM p
), r AS (
  SELECT *, CASE WHEN len(parts) < 4 THEN 'bad_block_id'
                 WHEN parts[1] <> 'shuffle' THEN 'bad_shuffle_id'
                 WHEN a IS NULL OR b IS NULL OR c IS NULL THEN 'non_int' END AS reject_reason
  FROM n
)
SELECT event_id, block_id,
       CASE WHEN reject_reason IS NULL THEN a END AS shuffle_id,
       CASE WHEN reject_reason IS NULL THEN b END AS map_id,
       CASE WHEN reject_reason IS NULL THEN c END AS reduce_id,
       reject_reason
FROM r
"""


@register("prj1_parse_block_ids", BLOCK_IDS_SQL)
def q_parse_block_ids(spark, sf):
    return pj.parse_block_ids(b.block_id_strings(spark, sf), "block_id")


JAVA_HASH_SQL = """list_reduce(list_transform(string_split({c}, ''), lambda ch: ascii(ch)::BIGINT),
                   lambda h, x: (h * 31 + x) % 4294967296, 0::BIGINT)"""


@register("prj2_place_by_hash", """
WITH f AS (SELECT l_orderkey, l_linenumber, 'shuffle_' || l_orderkey || '_0_0.data' AS key
           FROM lineitem),
u AS (SELECT *, """ + JAVA_HASH_SQL.format(c="key") + """ AS u FROM f),
h AS (SELECT l_orderkey, l_linenumber, key,
             abs(CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END) AS h FROM u)
SELECT *, CAST(h % 3 AS INTEGER) AS dir_id, CAST((h // 3) % 5 AS INTEGER) AS sub_id,
       printf('%02x', (h // 3) % 5) AS sub_dir
FROM h
""")
def q_place_by_hash(spark, sf):
    return pj.place_by_hash(b.shuffle_file_names(spark, sf), "key", 3, 5)


@register("prj3_join_nonempty", "WITH " + EVENTS_K + """
SELECT event_id,
       concat_ws('|', NULLIF(event_type, ''),
                 NULLIF(CASE WHEN k % 3 = 0 THEN '' ELSE props END, ''),
                 NULLIF('', ''),
                 NULLIF(CASE WHEN k % 2 = 0 THEN NULL ELSE 'x' END, '')) AS joined
FROM e
""")
def q_join_nonempty(spark, sf):
    e = b.events(spark, sf)
    return e.select("event_id", fn.join_nonempty(
        "|", "event_type",
        F.when(F.col("k") % 3 == 0, F.lit("")).otherwise(F.col("props")),
        F.lit(""),
        F.when(F.col("k") % 2 == 0, F.lit(None)).otherwise(F.lit("x"))).alias("joined"))


MESSAGE_DICT_SQL = """
d(type_id, type_name) AS (VALUES (0, 'ChunkFetchRequest'), (1, 'ChunkFetchSuccess'),
  (2, 'ChunkFetchFailure'), (3, 'RpcRequest'), (4, 'RpcResponse'), (5, 'RpcFailure'),
  (6, 'StreamRequest'), (7, 'StreamResponse'), (8, 'StreamFailure'), (9, 'OneWayMessage')),
m AS (SELECT doc_id, CAST(doc_id % 12 - 1 AS INTEGER) AS type_id, source AS stream_id,
             text AS body FROM documents),
dm AS (SELECT m.*, d.type_name,
              CASE WHEN d.type_name IS NOT NULL THEN NULL
                   WHEN m.type_id = -1 THEN 'user_type' ELSE 'unknown_type' END AS reject_reason
       FROM m LEFT JOIN d ON m.type_id = d.type_id)
"""


@register("prj4_decode_message_type", "WITH " + MESSAGE_DICT_SQL + """
SELECT doc_id, type_id, type_name, reject_reason FROM dm
""")
def q_decode_message_type(spark, sf):
    m = b.typed_messages(spark, sf)
    out = pj.decode_message_type(m, "type_id", "message")
    return out.select("doc_id", "type_id", "type_name", "reject_reason")


@register("flt1_tenant_isolation", "WITH " + EVENTS_K + """,
req AS (SELECT event_id AS stream_id, CAST(NULLIF(user_id % 7, 0) AS VARCHAR) AS client_id FROM e),
own AS (SELECT event_id AS sid, CAST(k % 7 AS VARCHAR) AS owner_app FROM e WHERE event_id % 11 <> 0)
SELECT stream_id, client_id, owner_app,
       CASE WHEN client_id IS NULL OR client_id = '' THEN 'authorized'
            WHEN sid IS NULL THEN 'unknown_stream'
            WHEN client_id = owner_app THEN 'authorized' ELSE 'denied' END AS status
FROM req LEFT JOIN own ON req.stream_id = own.sid
""")
def q_tenant_isolation(spark, sf):
    req, own = b.stream_requests(spark, sf)
    return pj.tenant_isolation(req, own)


@register("flt1_rpc_isolation", "WITH " + EVENTS_K + """
SELECT event_id AS request_id, client_id, app_id,
       CASE WHEN client_id IS NULL OR client_id IS NOT DISTINCT FROM app_id THEN 'authorized' ELSE 'denied' END AS status
FROM (SELECT event_id, CASE user_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE CAST(user_id % 7 AS VARCHAR) END AS client_id,
             CAST(k % 7 AS VARCHAR) AS app_id FROM e) t
""")
def q_rpc_isolation(spark, sf):
    return pj.rpc_isolation(b.rpc_requests(spark, sf))


@register("flt2_frame_size_guard", """
WITH f AS (SELECT doc_id, CAST(CASE doc_id % 10 WHEN 0 THEN -1 WHEN 1 THEN 8
                                  WHEN 2 THEN 2147483656 ELSE n_chars + 8 END AS BIGINT) AS declared_len
           FROM documents)
SELECT doc_id, declared_len, declared_len - 8 AS payload_len,
       CASE WHEN declared_len - 8 < 0 THEN 'negative' WHEN declared_len - 8 = 0 THEN 'empty'
            WHEN declared_len - 8 >= 2147483647 THEN 'too_large' END AS reject_reason
FROM f
""")
def q_frame_size_guard(spark, sf):
    return pj.frame_size_guard(b.declared_frames(spark, sf), "declared_len")


# ===================================================================== joins
JN1_SQL = "WITH " + EVENTS_K + """,
req AS (
  SELECT user_id, k, ts AS req_ts, event_id AS req_id FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) AS rn
    FROM e WHERE event_type = 'view') t WHERE rn = 1
), resp AS (
  SELECT user_id, k, ts AS resp_ts, event_id AS resp_id,
         CASE WHEN event_type = 'click' THEN 'ok' ELSE 'failed' END AS outcome
  FROM e WHERE event_type IN ('click', 'error')
), first_resp AS (
  SELECT user_id, k, resp_id, resp_ts, outcome FROM (
    SELECT resp.*, row_number() OVER (PARTITION BY resp.user_id, resp.k
                                      ORDER BY resp_ts, resp_id) AS rn
    FROM resp JOIN req ON resp.user_id = req.user_id AND resp.k = req.k
    WHERE resp_ts >= req_ts) t WHERE rn = 1
)
"""


@register("jn1_match_responses", JN1_SQL + """
SELECT req.user_id, req.k, req.req_id, req.req_ts, f.resp_id, f.resp_ts,
       COALESCE(f.outcome, 'outstanding') AS status
FROM req LEFT JOIN first_resp f ON req.user_id = f.user_id AND req.k = f.k
""")
def q_match_responses(spark, sf):
    req, resp = b.first_views_and_answers(spark, sf)
    return jn.match_responses(req, resp, ["user_id", "k"])[0]


@register("jn1_response_disposition", JN1_SQL + """
SELECT resp.user_id, resp.k, resp.resp_id, resp.resp_ts, resp.outcome,
       CASE WHEN req.req_id IS NULL THEN 'unknown'
            WHEN resp.resp_ts < req.req_ts THEN 'early'
            WHEN resp.resp_id = f.resp_id THEN 'consumed' ELSE 'late' END AS disposition
FROM resp LEFT JOIN req ON resp.user_id = req.user_id AND resp.k = req.k
LEFT JOIN first_resp f ON resp.user_id = f.user_id AND resp.k = f.k
""")
def q_response_disposition(spark, sf):
    req, resp = b.first_views_and_answers(spark, sf)
    return jn.match_responses(req, resp, ["user_id", "k"])[1]


HANDSHAKE_SQL = """
WITH c AS (SELECT user_id AS who, ts AS conn_ts, event_id AS conn_id FROM events
           WHERE event_type = 'signup'),
h AS (SELECT user_id AS who, ts AS h_ts, event_id AS h_id, event_type = 'view' AS hello
      FROM events WHERE event_type IN ({messages})),
nx AS (SELECT c.who, c.conn_ts, c.conn_id, h.h_ts, h.h_id, h.hello
       FROM c ASOF LEFT JOIN h ON c.who = h.who AND h.h_ts >= c.conn_ts),
it AS (SELECT who, conn_ts, conn_id,
              CASE WHEN hello AND h_ts <= conn_ts + INTERVAL 1 HOUR THEN h_id END AS hello_id,
              CASE WHEN hello AND h_ts <= conn_ts + INTERVAL 1 HOUR THEN h_ts END AS hello_ts,
              coalesce(NOT hello AND h_ts <= conn_ts + INTERVAL 1 HOUR, false) AS other
       FROM nx),
pend AS (SELECT DISTINCT user_id AS who FROM events WHERE user_id % 10 <> 0),
j AS (SELECT it.*, pend.who IS NOT NULL AS pending FROM it LEFT JOIN pend ON it.who = pend.who),
w AS (SELECT who, conn_id AS win FROM (
        SELECT *, row_number() OVER (PARTITION BY who ORDER BY hello_ts, hello_id, conn_ts, conn_id) rn
        FROM j WHERE hello_ts IS NOT NULL AND pending) t WHERE rn = 1)
SELECT j.who, j.conn_id, j.conn_ts, j.hello_id, j.hello_ts,
       CASE WHEN j.other THEN 'unexpected_message' WHEN j.hello_ts IS NULL THEN 'timed_out' WHEN NOT j.pending THEN 'unknown_secret'
            WHEN j.conn_id = w.win THEN 'connected' ELSE 'duplicate' END AS status
FROM j LEFT JOIN w ON j.who = w.who
"""


@register("jn3_handshake", HANDSHAKE_SQL.format(messages="'view'"))
def q_handshake(spark, sf):
    conns, hellos, pending = b.launcher_handshakes(spark, sf)
    return jn.handshake(conns, hellos, pending, 3600, who="secret")


@register("jn3_handshake_messages", HANDSHAKE_SQL.format(messages="'view', 'error'"))
def q_handshake_messages(spark, sf):
    conns, hellos, pending = b.launcher_handshakes(spark, sf)
    return jn.handshake(conns, hellos, pending, 3600, who="secret", messages=b.other_messages(spark, sf))


@register("jn4_fail_on_disconnect", QUEUE_FIFO_SQL + """,
r AS (SELECT channel, req_id, req_ts, resp_ts, status,
             CASE WHEN req_id % 3 = 0 THEN 'stream' ELSE 'rpc' END AS kind
      FROM fifo WHERE status <> 'orphan'),
d AS (SELECT user_id AS channel, ts AS d_ts, CASE WHEN event_id % 2 = 1 THEN 'error' ELSE 'closed' END AS cause
      FROM events WHERE event_type = 'signup'),
x AS (SELECT r.*, d.d_ts, d.cause FROM r ASOF LEFT JOIN d ON r.channel = d.channel AND d.d_ts > r.req_ts),
y AS (SELECT *, kind <> 'stream' AND d_ts IS NOT NULL
                AND (resp_ts IS NULL OR d_ts < resp_ts) AS hit FROM x)
SELECT channel, req_id, req_ts, resp_ts, status, kind,
       CASE WHEN hit THEN d_ts END AS disconnect_ts, CASE WHEN hit THEN cause END AS cause,
       CASE WHEN hit THEN 'failed_disconnect' ELSE status END AS final_status
FROM y
""")
def q_fail_on_disconnect(spark, sf):
    pairs = _fifo(spark, sf).filter("status <> 'orphan'").select(
        "channel", "req_id", "req_ts", "resp_ts", "status",
        F.when(F.col("req_id") % 3 == 0, "stream").otherwise("rpc").alias("kind"))
    return jn.fail_on_disconnect(pairs, b.disconnect_events(spark, sf), "channel")


OFFSET_SQL = """
oi AS (
  SELECT l_orderkey, l_shipdate, l_partkey, l_suppkey, size,
         CAST(COALESCE(SUM(size) OVER w, 0) AS BIGINT) AS "offset",
         CAST(COALESCE(SUM(size) OVER w, 0) + size AS BIGINT) AS next_offset,
         CAST(COALESCE(COUNT(*) OVER w, 0) AS INTEGER) AS idx
  FROM (SELECT l_orderkey, l_shipdate, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS size
        FROM lineitem) t
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
"""


def _offset_index(spark, sf):
    from railyard.operators import windows as wn
    from railyard.operators.scan import time_block
    return wn.offset_index(b.lineitem_blocks(spark, sf), ["l_orderkey"],
                           ["l_shipdate", "l_partkey", "l_suppkey"], "size",
                           block=time_block("l_shipdate", "month"))


RESOLVE_SQL = "WITH " + OFFSET_SQL + """,
reg AS (
  SELECT 'app-' || CAST(s_suppkey % 2 + 1 AS VARCHAR) AS app_id, CAST(s_suppkey AS VARCHAR) AS exec_id,
         ['/data' || (s_nationkey % 3), '/spill' || (s_suppkey % 2)] AS local_dirs, 7 AS sub_dirs,
         ['org.apache.spark.shuffle.hash.HashShuffleManager',
          'org.apache.spark.shuffle.sort.SortShuffleManager',
          'org.apache.spark.shuffle.unsafe.UnsafeShuffleManager',
          'org.apache.spark.shuffle.bogus.BogusShuffleManager'][s_suppkey % 4 + 1] AS manager
  FROM supplier WHERE s_suppkey % 5 <> 0
), rq AS (
  SELECT l_orderkey, l_partkey, 'app-' || CAST(l_suppkey % 2 + 1 AS VARCHAR) AS app_id, CAST(l_suppkey AS VARCHAR) AS exec_id,
         CASE WHEN l_partkey % 17 = 0 THEN 'shuffle_0_' || l_orderkey
              WHEN l_partkey % 13 = 0 THEN 'shuffle_0_' || l_orderkey || '_' || (idx + 1000)
              ELSE 'shuffle_0_' || l_orderkey || '_' || idx END AS block_id
  FROM oi
), p AS (
  SELECT *, string_split(regexp_replace(block_id, '_+$', ''), '_') AS parts FROM rq
), n AS (
  SELECT *,
    CASE WHEN regexp_full_match(parts[2], '[+-]?[0-9]+') THEN TRY_CAST(parts[2] AS INTEGER) END AS a,
    CASE WHEN regexp_full_match(parts[3], '[+-]?[0-9]+') THEN TRY_CAST(parts[3] AS INTEGER) END AS b,
    CASE WHEN regexp_full_match(parts[4], '[+-]?[0-9]+') THEN TRY_CAST(parts[4] AS INTEGER) END AS c
  FROM p
), pr AS (
  SELECT *, CASE WHEN len(parts) < 4 THEN 'bad_block_id'
                 WHEN parts[1] <> 'shuffle' THEN 'bad_shuffle_id'
                 WHEN a IS NULL OR b IS NULL OR c IS NULL THEN 'non_int' END AS reject_reason
  FROM n
), j AS (
  SELECT pr.*, CASE WHEN reject_reason IS NULL THEN a END AS shuffle_id,
         CASE WHEN reject_reason IS NULL THEN b END AS map_id,
         CASE WHEN reject_reason IS NULL THEN c END AS reduce_id,
         reg.local_dirs, reg.sub_dirs, reg.manager, reg.exec_id IS NOT NULL AS registered
  FROM pr LEFT JOIN reg ON pr.app_id = reg.app_id AND pr.exec_id = reg.exec_id
), jm AS (
  SELECT j.*, oi."offset", oi.next_offset,
         CASE WHEN manager = 'org.apache.spark.shuffle.hash.HashShuffleManager'
              THEN block_id ELSE 'shuffle_' || shuffle_id || '_' || map_id || '_0.data' END AS fname
  FROM j LEFT JOIN oi ON j.shuffle_id = 0 AND j.map_id = oi.l_orderkey AND j.reduce_id = oi.idx
                 AND j.exec_id = CAST(oi.l_suppkey AS VARCHAR)
                 AND j.app_id = 'app-' || CAST(oi.l_suppkey % 2 + 1 AS VARCHAR)
), hs AS (
  SELECT *, """ + JAVA_HASH_SQL.format(c="fname") + """ AS u FROM jm
), hh AS (
  SELECT *, abs(CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END) AS h FROM hs
), f AS (
  SELECT *, CASE WHEN reject_reason IS NOT NULL THEN reject_reason
                 WHEN NOT registered THEN 'unregistered_executor'
                 WHEN manager NOT IN ('org.apache.spark.shuffle.hash.HashShuffleManager',
                                      'org.apache.spark.shuffle.sort.SortShuffleManager',
                                      'org.apache.spark.shuffle.unsafe.UnsafeShuffleManager')
                   THEN 'unsupported_manager'
                 WHEN manager <> 'org.apache.spark.shuffle.hash.HashShuffleManager'
                      AND "offset" IS NULL THEN 'missing_index' END AS failure
  FROM hh
), resolved AS (
SELECT l_orderkey, l_partkey, app_id, exec_id, block_id, shuffle_id, map_id, reduce_id,
       CASE WHEN failure IS NULL THEN local_dirs[h % len(local_dirs) + 1] || '/' ||
            printf('%02x', (h // len(local_dirs)) % sub_dirs) || '/' || fname END AS path,
       CASE WHEN failure IS NULL THEN
            CASE WHEN manager = 'org.apache.spark.shuffle.hash.HashShuffleManager'
                 THEN CAST(0 AS BIGINT) ELSE "offset" END END AS "offset",
       CASE WHEN failure IS NULL THEN next_offset - "offset" END AS length,
       failure
FROM f
)
"""


def _resolved(spark, sf):
    # the index is a stored table that both the requests and the manifest read
    from railyard.session import stored
    idx = stored(_offset_index(spark, sf), "offset-index")
    manifest = idx.select(b.app_of("l_suppkey").alias("app_id"), F.col("l_suppkey").cast("string").alias("exec_id"),
                          F.lit(0).alias("shuffle_id"), F.col("l_orderkey").try_cast("int").alias("map_id"),
                          F.col("idx").alias("reduce_id"), "offset", "next_offset")
    return jn.resolve_blocks(b.block_requests(idx), b.executor_registry(spark, sf), manifest)


@register("jn5_resolve_blocks", RESOLVE_SQL + "SELECT * FROM resolved")
def q_resolve_blocks(spark, sf):
    return _resolved(spark, sf)


@register("jn6_outstanding_items", "WITH " + EVENTS_K + """,
rq AS (SELECT user_id, k, min(ts) AS first_ts FROM e WHERE event_type = 'view' GROUP BY 1, 2),
fr AS (SELECT user_id, k, ts, event_id FROM e WHERE event_type = 'view'),
firsts AS (SELECT rq.user_id, rq.k, rq.first_ts, min(fr.event_id) AS first_event_id
           FROM rq JOIN fr ON rq.user_id = fr.user_id AND rq.k = fr.k AND fr.ts = rq.first_ts
           GROUP BY 1, 2, 3)
SELECT * FROM firsts
WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.event_type = 'click'
                  AND e.user_id = firsts.user_id AND e.k = firsts.k)
""")
def q_outstanding_items(spark, sf):
    e = b.events(spark, sf)
    return jn.outstanding_items(e.filter("event_type = 'view'"), e.filter("event_type = 'click'"),
                                ["user_id", "k"], ["ts", "event_id"])


# ================================================================ aggregates
@register("ag1_all_or_nothing", RESOLVE_SQL + """,
v AS (SELECT l_orderkey, bool_and(failure IS NULL) AS group_ok FROM resolved GROUP BY l_orderkey)
SELECT r.l_orderkey, r.block_id, r.failure, v.group_ok,
       CASE WHEN v.group_ok THEN 'ok' ELSE 'failed' END AS status
FROM resolved r JOIN v ON r.l_orderkey = v.l_orderkey
""")
def q_all_or_nothing(spark, sf):
    items = _resolved(spark, sf).select("l_orderkey", "block_id", "failure")
    out = ag.all_or_nothing(items, ["l_orderkey"], F.col("failure").isNull(), store=True)
    return out.select("l_orderkey", "block_id", "failure", "group_ok", "status")


@register("ag3_message_census", "WITH " + MESSAGE_DICT_SQL + """,
lay(type_name, fixed, has_sid, has_err, body_mode) AS (VALUES
  ('ChunkFetchRequest', 12, false, false, 'none'), ('ChunkFetchSuccess', 12, false, false, 'in_frame'),
  ('ChunkFetchFailure', 12, false, true, 'none'), ('RpcRequest', 12, false, false, 'in_frame'),
  ('RpcResponse', 12, false, false, 'in_frame'), ('RpcFailure', 8, false, true, 'none'),
  ('StreamRequest', 0, true, false, 'none'), ('StreamResponse', 8, true, false, 'outside_frame'),
  ('StreamFailure', 0, true, true, 'none'), ('OneWayMessage', 4, false, false, 'in_frame')),
x AS (SELECT dm.type_name, coalesce(strlen(body), 0) AS blen,
             9 + fixed + CASE WHEN has_sid THEN 4 + coalesce(strlen(stream_id), 0) ELSE 0 END
               + CASE WHEN has_err THEN 4 + coalesce(strlen(body), 0) ELSE 0 END AS h, body_mode
      FROM dm JOIN lay ON dm.type_name = lay.type_name)
SELECT type_name, COUNT(*) AS n, CAST(SUM(h) AS BIGINT) AS header_bytes,
       CAST(SUM(CASE WHEN body_mode <> 'none' THEN blen ELSE 0 END) AS BIGINT) AS body_bytes,
       CAST(SUM(h + CASE WHEN body_mode = 'in_frame' THEN blen ELSE 0 END) AS BIGINT) AS frame_bytes
FROM x GROUP BY type_name
""")
def q_message_census(spark, sf):
    m = pj.decode_message_type(b.typed_messages(spark, sf), "type_id", "message")
    return ag.message_census(m, spark)


LAYERS_SQL = """
WITH lo AS (
  SELECT o_custkey, o_orderpriority FROM (
    SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) rn
    FROM orders) t WHERE rn = 1
), layers AS (
  SELECT o_custkey AS key, CASE WHEN o_custkey % 3 = 0 THEN '' ELSE o_orderpriority END AS value,
         'explicit' AS layer, 0 AS rank FROM lo
  UNION ALL
  SELECT c_custkey, c_mktsegment, 'file', 1 FROM customer WHERE c_custkey % 2 = 0
  UNION ALL
  SELECT c_custkey, 'none', 'default', 2 FROM customer
)
SELECT key, arg_min(value, rank) AS value, arg_min(layer, rank) AS layer
FROM layers WHERE value IS NOT NULL {extra} GROUP BY key
"""


@register("ag4_layered_settings_present", LAYERS_SQL.format(extra=""))
def q_layered_present(spark, sf):
    return ag.layered_settings(b.layered_customer_settings(spark, sf), "present")


@register("ag4_layered_settings_non_empty", LAYERS_SQL.format(extra="AND value <> ''"))
def q_layered_non_empty(spark, sf):
    return ag.layered_settings(b.layered_customer_settings(spark, sf), "non_empty")


@register("ag4_typed_settings", """
WITH t AS (
  SELECT c_custkey AS key, [0 - c_custkey, 0, 0, 0, -1][c_custkey % 5 + 1] AS whole,
         [0 - c_custkey, 0, c_custkey + 0.5, 0, 0.25][c_custkey % 5 + 1] AS decimal, c_custkey % 5 AS m
  FROM customer)
SELECT key, 'boolean' AS kind, CASE WHEN m IN (1, 4) THEN 'true' ELSE 'false' END AS typed,
       CAST(NULL AS VARCHAR) AS reject_reason FROM t
UNION ALL
SELECT key, 'bigint', CASE WHEN m IN (0, 4) THEN CAST(CAST(whole AS BIGINT) AS VARCHAR) END,
       CASE WHEN m IN (1, 2, 3) THEN 'bad_bigint' END FROM t
UNION ALL
SELECT key, 'double', CASE WHEN m IN (0, 2, 4) THEN CAST(CAST(decimal * 4 AS BIGINT) AS VARCHAR) END,
       CASE WHEN m IN (1, 3) THEN 'bad_double' END FROM t
""")
def q_typed_settings(spark, sf):
    s = b.typed_customer_settings(spark, sf)
    # doubles are shown in quarters, which print alike everywhere
    parts = [ag.typed_settings(s, kind, default).select(
        "key", F.lit(kind).alias("kind"),
        (F.col("typed") * 4).cast("bigint").cast("string").alias("typed") if kind == "double"
        else F.col("typed").cast("string"), "reject_reason")
        for kind, default in (("boolean", True), ("bigint", -1), ("double", 0.25))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# =================================================================== windows
@register("wn1_offset_index", "WITH " + OFFSET_SQL + "SELECT * FROM oi")
def q_offset_index(spark, sf):
    return _offset_index(spark, sf)


GAUGE_SQL = FIFO_SQL + """,
g AS (SELECT channel, ts, eid, is_req,
             CAST(s - LEAST(0, s, COALESCE(prior_min, 0)) AS BIGINT) AS outstanding,
             LEAD(ts) OVER (PARTITION BY channel ORDER BY ts, is_req, eid) AS next_ts FROM s4)
"""


@register("wn2_outstanding_gauge", GAUGE_SQL + "SELECT * FROM g")
def q_outstanding_gauge(spark, sf):
    from railyard.operators import windows as wn
    req, resp = b.view_click_channels(spark, sf)
    return wn.outstanding_gauge(req, resp, "channel", "ts", "id")


@register("wn2_peak_outstanding", GAUGE_SQL + """
SELECT channel, COUNT(*) AS n_events, MAX(outstanding) AS peak,
       arg_max(outstanding, epoch_us(ts) * 10 + is_req) AS final
FROM g GROUP BY channel
""")
def q_peak_outstanding(spark, sf):
    from railyard.operators import windows as wn
    req, resp = b.view_click_channels(spark, sf)
    return wn.peak_outstanding(wn.outstanding_gauge(req, resp, "channel", "ts", "id"))


@register("wn2_gauge_with_streams", """
WITH ev AS (
  SELECT user_id AS channel, ts, event_id AS eid, event_type,
         CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 0 END AS is_req
  FROM events WHERE event_type IN ('view', 'click', 'purchase', 'error')
), walk AS (
  SELECT channel, list({'ts': ts, 'eid': eid, 'is_req': is_req, 'event_type': event_type}
                       ORDER BY ts, is_req NULLS LAST, eid) AS l FROM ev GROUP BY channel
), steps AS (
  SELECT channel, unnest(l) AS e,
         unnest(list_transform(l, lambda x, i: i)) AS i, l FROM walk
), queued AS (
  SELECT channel, e, i, unnest(list_transform([l], lambda x: list_reduce(
    list_prepend(0, list_transform(x[1:i], lambda y: CASE y.is_req WHEN 1 THEN 1 WHEN 0 THEN -1 ELSE 0 END)),
    lambda q, d: greatest(q + d, 0)))) AS q,
    list_filter(l[1:i], lambda y: y.is_req IS NULL)[-1].event_type AS mark
  FROM steps
)
SELECT channel, e.ts AS ts, e.eid AS eid, e.is_req AS is_req,
       CAST(q + CASE WHEN mark = 'purchase' THEN 1 ELSE 0 END AS BIGINT) AS outstanding
FROM queued
""")
def q_gauge_with_streams(spark, sf):
    from railyard.operators import windows as wn
    req, resp = b.view_click_channels(spark, sf)
    return wn.gauge_with_streams(wn.outstanding_gauge(req, resp, "channel", "ts", "id"),
                                 b.stream_marks(spark, sf))


@register("wn3_in_order_prefix", """
WITH RECURSIVE r0 AS (
  SELECT user_id, ts, event_id,
         CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 AS INTEGER) AS idx,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events
), walk(user_id, rn, e_after, status) AS (
  SELECT user_id, rn, CASE WHEN idx = 0 THEN 1 ELSE 0 END,
         CASE WHEN idx = 0 THEN 'accepted' ELSE 'out_of_order' END
  FROM r0 WHERE rn = 1
  UNION ALL
  SELECT r0.user_id, r0.rn,
         CASE WHEN w.e_after < 5 AND r0.idx = w.e_after THEN w.e_after + 1 ELSE w.e_after END,
         CASE WHEN w.e_after >= 5 THEN 'past_end'
              WHEN r0.idx = w.e_after THEN 'accepted' ELSE 'out_of_order' END
  FROM walk w JOIN r0 ON r0.user_id = w.user_id AND r0.rn = w.rn + 1
)
SELECT r0.user_id, r0.ts, r0.event_id, r0.idx, walk.status
FROM walk JOIN r0 ON walk.user_id = r0.user_id AND walk.rn = r0.rn
""")
def q_in_order_prefix(spark, sf):
    from railyard.operators import windows as wn
    from railyard.operators.scan import time_block
    return wn.in_order_prefix(b.chunk_requests(spark, sf), "user_id", "ts", "event_id", "idx",
                              5, block=time_block("ts", "day"))


# The recursive walk above takes one step per row, too many on the hot stream;
# with five chunks, each chunk is served by its first request after the last one's.
@register("wn3_in_order_prefix_hot_stream", """
WITH r0 AS (
  SELECT CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS user_id, ts, event_id,
         CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 AS INTEGER) AS idx
  FROM events
), r AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM r0
), a0 AS (SELECT user_id, min(rn) AS at FROM r WHERE idx = 0 GROUP BY user_id)
""" + "".join(f""", a{i} AS (SELECT r.user_id, min(rn) AS at FROM r JOIN a{i - 1} p ON p.user_id = r.user_id
               WHERE r.idx = {i} AND rn > p.at GROUP BY r.user_id)
""" for i in range(1, 5)) + """
SELECT r.user_id, r.ts, r.event_id, r.idx,
       CASE WHEN rn > a4.at THEN 'past_end' WHEN rn IN (a0.at, a1.at, a2.at, a3.at, a4.at) THEN 'accepted'
            ELSE 'out_of_order' END AS status
FROM r LEFT JOIN a0 ON a0.user_id = r.user_id LEFT JOIN a1 ON a1.user_id = r.user_id
LEFT JOIN a2 ON a2.user_id = r.user_id LEFT JOIN a3 ON a3.user_id = r.user_id
LEFT JOIN a4 ON a4.user_id = r.user_id
""")
def q_in_order_prefix_hot_stream(spark, sf):
    from railyard.operators import windows as wn
    from railyard.operators.scan import time_block
    return wn.in_order_prefix(b.chunk_requests_hot(spark, sf), "user_id", "ts", "event_id", "idx",
                              5, block=time_block("ts", "day"))


IDLE_SQL = GAUGE_SQL + """,
nx AS (SELECT * FROM g),
fz AS (SELECT nx.*, CAST(CASE WHEN is_req = 1 THEN 2 ELSE 1 END AS BIGINT) AS checks,
              epoch_us(COALESCE(next_ts, (SELECT max(ts) FROM events))) - epoch_us(ts) AS gap
       FROM nx),
acted AS (SELECT channel, ts + to_microseconds(checks * 1800000000) AS fire_at, eid,
                 CASE WHEN outstanding > 0 THEN 'dead' ELSE 'idle_closed' END AS verdict, outstanding
          FROM fz WHERE gap > checks * 1800000000 AND (outstanding > 0 OR {close})),
fa AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY fire_at, eid) AS rn
                      FROM acted) t WHERE rn = 1)
SELECT c.channel, COALESCE(fa.verdict, 'alive') AS status, fa.fire_at AS closed_at, fa.outstanding
FROM (SELECT DISTINCT channel FROM g) c LEFT JOIN fa ON c.channel = fa.channel
"""


def _idle(spark, sf, close_idle, timeout_seconds=1800):
    from railyard.operators import windows as wn
    req, resp = b.view_click_channels(spark, sf)
    gauge = wn.outstanding_gauge(req, resp, "channel", "ts", "id")
    as_of = b.table(spark, sf, "events").select(F.max("ts")).scalar()
    return wn.idle_channels(gauge, timeout_seconds, as_of, close_idle=close_idle)


@register("wn4_idle_channels", IDLE_SQL.format(close="false"))
def q_idle_channels(spark, sf):
    return _idle(spark, sf, False)


@register("wn4_idle_channels_close", IDLE_SQL.format(close="true"))
def q_idle_channels_close(spark, sf):
    return _idle(spark, sf, True)


# A time-out of four days: some channels die, some are closed, most stay alive.
FOUR_DAYS = 4 * 86_400


@register("wn4_idle_channels_four_days",
          IDLE_SQL.format(close="true").replace("1800000000", str(FOUR_DAYS * 1_000_000)))
def q_idle_channels_four_days(spark, sf):
    return _idle(spark, sf, True, FOUR_DAYS)


def _retry_sql(max_retries: int = 3) -> str:
    parts = ["""
WITH rows AS (
  SELECT l_orderkey AS request, l_linenumber AS item, att AS attempt, l_linenumber AS seq,
         CASE WHEN (l_orderkey * 31 + l_linenumber * 7 + att * 13) % 5 <= 1 THEN 'io_error'
              WHEN (l_orderkey * 31 + l_linenumber * 7 + att * 13) % 5 = 2 THEN 'fatal'
              ELSE 'ok' END AS outcome
  FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) li, range(0, 4) t(att)
)"""]
    for a in range(max_retries + 1):
        live = f"AND request IN (SELECT request FROM trig{a - 1})" if a > 0 else ""
        done = (f"AND NOT EXISTS (SELECT 1 FROM settled{a - 1} s WHERE s.request = rows.request "
                f"AND s.item = rows.item)") if a > 0 else ""
        parts.append(f""",
ra{a} AS (SELECT * FROM rows WHERE attempt = {a} {live} {done}),
ff{a} AS (SELECT request, item, min(seq) AS ff_seq FROM ra{a}
          WHERE outcome IN ('ok', 'fatal') GROUP BY request, item),
rb{a} AS (SELECT ra{a}.*, ff{a}.ff_seq FROM ra{a} LEFT JOIN ff{a}
          ON ra{a}.request = ff{a}.request AND ra{a}.item = ff{a}.item)""")
        if a < max_retries:
            parts.append(f""",
trig{a} AS (SELECT request, min(seq) AS trig_seq FROM rb{a}
            WHERE outcome = 'io_error' AND (ff_seq IS NULL OR ff_seq > seq) GROUP BY request),
pr{a} AS (SELECT rb{a}.* FROM rb{a} LEFT JOIN trig{a} ON rb{a}.request = trig{a}.request
          WHERE trig{a}.trig_seq IS NULL OR rb{a}.seq < trig{a}.trig_seq)""")
            fin = "outcome IN ('ok', 'fatal')"
        else:
            parts.append(f""",
pr{a} AS (SELECT * FROM rb{a})""")
            fin = "outcome IN ('ok', 'fatal', 'io_error')"
        prev = f"SELECT * FROM settled{a - 1} UNION ALL " if a > 0 else ""
        parts.append(f""",
st{a} AS (SELECT request, item, arg_min(outcome, seq) AS out, {a} AS attempt_used
          FROM pr{a} WHERE {fin} GROUP BY request, item),
settled{a} AS ({prev}SELECT request, item,
                  CASE out WHEN 'ok' THEN 'ok' WHEN 'fatal' THEN 'failed' ELSE 'failed_io' END AS status,
                  attempt_used FROM st{a})""")
    trig_union = " UNION ALL ".join(f"SELECT request FROM trig{a}" for a in range(max_retries))
    parts.append(f""",
retries AS (SELECT request, CAST(COUNT(*) AS INTEGER) AS retries FROM ({trig_union}) t GROUP BY request),
items AS (SELECT DISTINCT request, item FROM rows)
SELECT items.request, items.item, COALESCE(s.status, 'outstanding') AS status, s.attempt_used,
       COALESCE(r.retries, 0) AS retries
FROM items LEFT JOIN settled{max_retries} s ON items.request = s.request AND items.item = s.item
LEFT JOIN retries r ON items.request = r.request
""")
    return "".join(parts)


@register("wn5_resolve_retries", _retry_sql(3))
def q_resolve_retries(spark, sf):
    from railyard.operators import windows as wn
    return wn.resolve_retries(b.retry_log(spark, sf), max_retries=3)


# ===================================================================== state
REG_EVENTS_SQL = "WITH " + EVENTS_K + """,
re AS (
  SELECT user_id % 20 AS app, user_id AS exec, ts, event_id AS eid,
         CASE WHEN event_type = 'error' THEN 'remove' ELSE 'register' END AS kind,
         CASE WHEN event_type <> 'error' THEN k END AS info,
         CASE WHEN event_type <> 'error' THEN ['/d' || k, '/e' || k] END AS local_dirs,
         CASE WHEN event_type = 'error' THEN k % 2 = 0 END AS cleanup
  FROM e WHERE event_type IN ('signup', 'view', 'error')
)
"""


@register("st1_registry_state", REG_EVENTS_SQL + """,
lr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY app, exec ORDER BY ts DESC, eid DESC) rn
                      FROM re WHERE kind = 'register') t WHERE rn = 1),
rm AS (SELECT app, max(ts) AS rm_ts FROM re WHERE kind = 'remove' GROUP BY app)
SELECT lr.app, lr.exec, lr.info, lr.local_dirs, lr.ts AS reg_ts
FROM lr LEFT JOIN rm ON lr.app = rm.app WHERE rm.rm_ts IS NULL OR lr.ts > rm.rm_ts
""")
def q_registry_state(spark, sf):
    from railyard.operators import state as stt
    return stt.registry_state(b.registry_events(spark, sf))


@register("arr1_removed_dirs", REG_EVENTS_SQL + """,
regs AS (SELECT * FROM re WHERE kind = 'register'),
rms AS (SELECT app, ts AS rm_ts, eid AS rm_id, cleanup FROM re WHERE kind = 'remove'),
nx AS (SELECT regs.*, rms.rm_ts, rms.rm_id, rms.cleanup AS rm_cleanup
       FROM regs ASOF JOIN rms ON regs.app = rms.app AND rms.rm_ts >= regs.ts),
last AS (SELECT app, exec, rm_id, rm_ts, arg_max(local_dirs, ts) AS dirs
         FROM nx WHERE rm_cleanup GROUP BY app, exec, rm_id, rm_ts)
SELECT app, exec, rm_id AS removal_id, rm_ts AS removal_ts, unnest(dirs) AS dir FROM last
""")
def q_removed_dirs(spark, sf):
    from railyard.operators import arrays as ar
    return ar.removed_dirs(b.registry_events(spark, sf))


APP_EVENTS_SQL = "WITH " + EVENTS_K + """,
ae AS (
  SELECT user_id AS app, ts, event_id AS eid,
         CASE WHEN event_type = 'signup' THEN 'SUBMITTED' WHEN event_type = 'view' THEN 'CONNECTED'
              WHEN event_type = 'click' THEN 'RUNNING'
              WHEN event_type = 'error' AND k < 5 THEN 'FAILED'
              WHEN event_type = 'purchase' AND k < 5 THEN 'FINISHED' END AS state
  FROM e
), ae2 AS (SELECT * FROM ae WHERE state IS NOT NULL),
ff AS (SELECT app, min(ts) AS ff_ts FROM ae2 WHERE state IN ('FINISHED', 'FAILED', 'KILLED') GROUP BY app),
tr AS (SELECT ae2.*, CASE WHEN ff.ff_ts IS NOT NULL AND ae2.ts > ff.ff_ts THEN 'ignored'
                          ELSE 'applied' END AS disposition
       FROM ae2 LEFT JOIN ff ON ae2.app = ff.app)
"""


@register("st2_lifecycle_transitions", APP_EVENTS_SQL + "SELECT * FROM tr")
def q_lifecycle_transitions(spark, sf):
    from railyard.operators import state as stt
    return stt.lifecycle_transitions(b.app_state_events(spark, sf))


@register("st2_lifecycle_state", APP_EVENTS_SQL + """
SELECT app, arg_max(state, ts) FILTER (WHERE disposition = 'applied') AS state,
       CAST(SUM(CASE WHEN disposition = 'applied' THEN 1 ELSE 0 END) AS BIGINT) AS n_applied,
       CAST(SUM(CASE WHEN disposition = 'ignored' THEN 1 ELSE 0 END) AS BIGINT) AS n_ignored,
       arg_max(state, ts) FILTER (WHERE disposition = 'applied') IN ('FINISHED', 'FAILED', 'KILLED') AS is_final
FROM tr GROUP BY app
""")
def q_lifecycle_state(spark, sf):
    from railyard.operators import state as stt
    return stt.lifecycle_state(b.app_state_events(spark, sf))


# ====================================================================== text
@register("txt1_chunk_split", """
SELECT doc_id, CAST(i AS INTEGER) AS chunk_idx, CAST(i * 256 AS BIGINT) AS "offset",
       CAST(least(256, length(text) - i * 256) AS BIGINT) AS length,
       substring(text, CAST(i * 256 + 1 AS BIGINT), 256) AS body
FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 256.0) AS BIGINT))) AS i
      FROM documents WHERE length(text) > 0) t
""")
def q_chunk_split(spark, sf):
    from railyard.operators import text as tx
    return tx.chunk_split(b.table(spark, sf, "documents"), "doc_id", "text", 256)


@register("txt2_slice_range", """
SELECT doc_id, doc_id % 50 AS "offset", CAST(100 AS BIGINT) AS length,
       CASE WHEN doc_id % 50 + 100 > length(text) THEN 'eof' END AS reject_reason,
       CASE WHEN doc_id % 50 + 100 <= length(text)
            THEN substring(text, CAST(doc_id % 50 + 1 AS BIGINT), 100) END AS slice
FROM documents
""")
def q_slice_range(spark, sf):
    from railyard.operators import text as tx
    d = b.table(spark, sf, "documents").select(
        "doc_id", "text", (F.col("doc_id") % 50).alias("offset"), F.lit(100).cast("bigint").alias("length"))
    return tx.slice_range(d, "text", "offset", "length").drop("text")


@register("txt3_reassemble_chunks", """
WITH tot AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS txt,
                    CAST(SUM(strlen(text)) AS BIGINT) AS t, COUNT(*) AS n
             FROM conversations GROUP BY conv_id)
SELECT conv_id AS stream_id,
       t + CASE WHEN conv_id % 7 = 0 THEN 1 WHEN conv_id % 7 = 1 THEN -1 ELSE 0 END AS expected_bytes,
       txt AS text, t AS bytes_read, n AS n_chunks,
       CASE WHEN conv_id % 7 = 0 THEN 'incomplete' WHEN conv_id % 7 = 1 THEN 'overrun'
            ELSE 'complete' END AS status
FROM tot
""")
def q_reassemble_chunks(spark, sf):
    from railyard.operators import text as tx
    chunks, ann = b.conversation_streams(spark, sf)
    return tx.reassemble_chunks(chunks, ann)


@register("txt3_reassemble_parts", """
WITH c AS (SELECT conv_id, turn, text, strlen(text) AS n,
                  sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn) - strlen(text) AS before
           FROM conversations)
SELECT conv_id AS stream_id, CAST(before // 300 AS BIGINT) AS part, CAST(min(before) AS BIGINT) AS "offset",
       CAST(sum(n) AS BIGINT) AS n_bytes, count(*) AS n_chunks, string_agg(text, '' ORDER BY turn) AS body
FROM c GROUP BY conv_id, before // 300
""")
def q_reassemble_parts(spark, sf):
    from railyard.operators import text as tx
    return tx.reassemble_parts(b.conversation_streams(spark, sf)[0], part_bytes=300)


# =================================================================== sources
@register("src1_scan_delimited", "SELECT c_name, c_custkey FROM customer")
def q_scan_delimited(spark, sf):
    from railyard import sources as src
    return src.scan_delimited(spark, b.rendered_customer_csv(spark, sf),
                              "c_name STRING, c_custkey BIGINT")


@register("src2_scan_json_lines", """
SELECT c_name, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey END AS c_custkey FROM customer
""")
def q_scan_json_lines(spark, sf):
    from railyard import sources as src
    return src.scan_json_lines(spark, b.rendered_customer_json(spark, sf),
                               "c_name STRING, c_custkey BIGINT")


@register("src3_scan_ctrl_a_kv", "SELECT c_custkey AS key, c_name AS value FROM customer")
def q_scan_ctrl_a_kv(spark, sf):
    from railyard import sources as src
    return src.scan_ctrl_a_kv(spark, b.rendered_customer_kv(spark, sf))


@register("src4_scan_properties", """
SELECT 'defaults' AS layer, 'cust.' || c_custkey AS key, c_name AS value,
       CAST(NULL AS VARCHAR) AS reject_reason FROM customer
UNION ALL
SELECT 'defaults', CAST(NULL AS VARCHAR), 'bad.' || c_custkey || ' = \\u12', 'malformed_escape'
FROM customer WHERE c_custkey % 7 = 0
""")
def q_scan_properties(spark, sf):
    from railyard import sources as src
    return src.scan_properties(spark, b.rendered_customer_properties(spark, sf), "defaults")


@register("src5_scan_segments", """
WITH f AS (SELECT doc_id // 200 AS bucket, encode(string_agg(text || chr(10), '' ORDER BY doc_id)) AS body
           FROM documents GROUP BY 1),
d AS (SELECT doc_id, doc_id // 200 AS bucket,
             CAST(sum(octet_length(encode(text)) + 1) OVER (PARTITION BY doc_id // 200 ORDER BY doc_id)
                  - octet_length(encode(text)) - 1 + doc_id % 50 AS BIGINT) AS start FROM documents),
s AS (SELECT doc_id, start, octet_length(body) AS size, body FROM d JOIN f USING (bucket))
SELECT doc_id, start AS "offset", CAST(100 AS BIGINT) AS length, size AS file_size,
       CASE WHEN start + 100 <= size THEN substr(hex(body), 2 * start + 1, 200) END AS data_hex,
       CASE WHEN start + 100 > size THEN 'eof' END AS reject_reason
FROM s
""")
def q_scan_segments(spark, sf):
    from railyard import sources as src
    path, segs = b.rendered_document_files(spark, sf)
    return src.scan_segments(spark, path, segs).select(
        "doc_id", "offset", "length", "file_size", F.hex("data").alias("data_hex"), "reject_reason")


@register("snk1_write_hashed_layout", """
WITH f AS (SELECT l_orderkey, l_linenumber, 'shuffle_' || l_orderkey || '_0_0.data' AS key
           FROM lineitem),
u AS (SELECT *, """ + JAVA_HASH_SQL.format(c="key") + """ AS u FROM f),
h AS (SELECT l_orderkey, l_linenumber, key,
             abs(CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END) AS h FROM u)
SELECT *, CAST(h % 3 AS INTEGER) AS dir_id, CAST((h // 3) % 5 AS INTEGER) AS sub_id,
       printf('%02x', (h // 3) % 5) AS sub_dir
FROM h
""")
def q_write_hashed_layout(spark, sf):
    from railyard import sources as src
    path = b._scratch(spark, "hashed-layout")
    src.write_hashed_layout(b.shuffle_file_names(spark, sf), "key", 3, 5, path)
    return src.read_hashed_layout(
        spark, path, "l_orderkey BIGINT, l_linenumber INT, key STRING, "
        + src.sinks.HASHED_SCHEMA_EXTRA)


@register("snk2_write_sorted_blocks", "WITH " + OFFSET_SQL + """
SELECT l_orderkey, idx, "offset", next_offset FROM oi
""")
def q_write_sorted_blocks(spark, sf):
    from railyard import sources as src
    from railyard.operators.scan import time_block
    path = b._scratch(spark, "sorted-blocks")
    return src.write_sorted_blocks(b.lineitem_blocks(spark, sf), "l_orderkey",
                                   ["l_shipdate", "l_partkey", "l_suppkey"], "size", path,
                                   block=time_block("l_shipdate", "month"))


# ================================================================= streaming
# Streams read 12 files or more, the rows of a quarter of the time in no order in
# a quarter of them, in three micro-batches; the delay covers such a quarter.
DELAY = "8 days"
DELAY_MS = 8 * 86_400_000


def _staged(spark, df, ts, name):
    from railyard import streaming as sm
    path = sm.stage_files(df, ts, 4, name, n_files=3)
    return sm.read_stream(spark, path, df.schema, max_files=sm.share_of_files(spark, path, 3))


def _finite(spark, df, name, wait_ms=0, ts="ts", delay_ms=DELAY_MS):
    """A staged stream and what stages its end row: past it the watermark has
    passed every event, and every time-out of ``wait_ms`` after one."""
    from railyard import streaming as sm
    df = sm.with_end(df, ts)
    path = sm.stage_files(df, ts, 4, name, n_files=3)
    return (sm.read_stream(spark, path, df.schema, max_files=sm.share_of_files(spark, path, 3)),
            lambda: sm.stage_end(spark.read.schema(df.schema).parquet(path), path, delay_ms + wait_ms + 1000, ts))


@register("st1_stream_registry_state", REG_EVENTS_SQL + """,
lr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY app, exec ORDER BY ts DESC, eid DESC) rn
                      FROM re WHERE kind = 'register') t WHERE rn = 1),
rm AS (SELECT app, max(ts) AS rm_ts FROM re WHERE kind = 'remove' GROUP BY app)
SELECT lr.app, lr.exec, lr.info, lr.local_dirs, lr.ts AS reg_ts
FROM lr LEFT JOIN rm ON lr.app = rm.app WHERE rm.rm_ts IS NULL OR lr.ts > rm.rm_ts
""")
def q_stream_registry_state(spark, sf):
    from railyard import streaming as sm
    s = _staged(spark, b.registry_events(spark, sf), "ts", "registry-events")
    changes = sm.run_available(sm.stream_registry_state(s), "registry")
    return sm.registry_from_changes(changes).withColumn("reg_ts", F.col("reg_ts").cast("timestamp_ntz"))


@register("st2_stream_lifecycle_state", APP_EVENTS_SQL + """
SELECT app, arg_max(state, ts) FILTER (WHERE disposition = 'applied') AS state,
       CAST(SUM(CASE WHEN disposition = 'applied' THEN 1 ELSE 0 END) AS BIGINT) AS n_applied,
       CAST(SUM(CASE WHEN disposition = 'ignored' THEN 1 ELSE 0 END) AS BIGINT) AS n_ignored,
       arg_max(state, ts) FILTER (WHERE disposition = 'applied') IN ('FINISHED', 'FAILED', 'KILLED') AS is_final
FROM tr GROUP BY app
""")
def q_stream_lifecycle_state(spark, sf):
    from railyard import streaming as sm
    s, end = _finite(spark, b.app_state_events(spark, sf), "app-events")
    return sm.lifecycle_from_changes(sm.run_available(sm.stream_lifecycle_state(s, DELAY), "lifecycle", end=end))


def _timed_sql(channel: str, shown: str) -> str:
    """Matches with a one-day give-up time; once the input is flushed, no
    request waits any more."""
    rows = f"""
  SELECT {channel} AS channel, ts, event_id AS eid, CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS is_req
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) e
  WHERE event_type IN ('signup', 'purchase')"""
    return queue_walk_sql(rows, 86_400_000_000) + f"""
SELECT {shown}, req_id, req_ts, resp_id, resp_ts, status FROM done
UNION ALL
SELECT {shown}, req_id, make_timestamp(us), NULL, NULL, 'timed_out' FROM waiting
"""


def _timed_matches(spark, sf, keys):
    from railyard import streaming as sm
    s, end = _finite(spark, b.signup_purchase_events(spark, sf), "rpc-events", 86_400_000)
    out = sm.run_available(sm.stream_match_responses(s, 86400, DELAY, keys), "rpc-match", end=end)
    return (out.withColumn("req_ts", F.col("req_ts").cast("timestamp_ntz"))
            .withColumn("resp_ts", F.col("resp_ts").cast("timestamp_ntz")))


@register("st3_stream_match_responses", _timed_sql("user_id", "channel"))
def q_stream_match_responses(spark, sf):
    return _timed_matches(spark, sf, ("channel",))


@register("st3_stream_match_by_id", _timed_sql("{'c': user_id, 'k': k % 4}", "channel.c AS channel, channel.k AS corr"))
def q_stream_match_by_id(spark, sf):
    return _timed_matches(spark, sf, ("channel", "corr"))


@register("st3_stream_timed_join", """
WITH q AS (SELECT o_orderkey AS id, o_orderdate::TIMESTAMP + to_seconds(o_orderkey % 86400) AS req_ts FROM orders),
p AS (SELECT CASE WHEN l_orderkey % 11 = 0 THEN -l_orderkey ELSE l_orderkey END AS id,
             min(l_shipdate)::TIMESTAMP + to_seconds(l_orderkey * 7 % 86400) AS resp_ts
      FROM lineitem GROUP BY l_orderkey)
SELECT coalesce(q.id, p.id) AS id, req_ts, resp_ts,
       CASE WHEN resp_ts IS NULL THEN 'timed_out' WHEN req_ts IS NULL THEN 'orphan' ELSE 'matched' END AS status
FROM q FULL JOIN p ON q.id = p.id AND resp_ts >= req_ts AND resp_ts <= req_ts + INTERVAL 365 DAY
""")
def q_stream_timed_join(spark, sf):
    from railyard import streaming as sm
    day = 86_400_000
    req, resp = b.orders_and_shipments(spark, sf)
    (req, end_req), (resp, end_resp) = (_finite(spark, df, name, 800 * day, ts, 700 * day) for df, name, ts in
                                        ((req, "orders", "req_ts"), (resp, "shipments", "resp_ts")))

    def end():
        end_req()
        end_resp()

    out = sm.run_available(sm.stream_timed_join(req, resp, ("id",), "365 days", "700 days"), "timed-join", end=end)
    return out.select("id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("req_ts", "resp_ts")], "status")


@register("st4_stream_idle_verdicts", IDLE_SQL.format(close="true").replace(
    "1800000000", str(FOUR_DAYS * 1_000_000)).replace("(SELECT max(ts) FROM events)", "TIMESTAMP '2100-01-01'")
    + "WHERE fa.verdict IS NOT NULL")
def q_stream_idle_verdicts(spark, sf):
    from railyard import streaming as sm
    s, end = _finite(spark, b.view_click_events(spark, sf), "traffic-v", 2000 * FOUR_DAYS)
    out = sm.run_available(sm.stream_idle_verdicts(s, FOUR_DAYS, DELAY, close_idle=True), "verdicts", end=end)
    return out.withColumn("closed_at", F.col("closed_at").cast("timestamp_ntz"))


@register("st4_stream_idle_sessions", """
WITH t AS (SELECT user_id AS channel, ts FROM events WHERE event_type IN ('view', 'click')),
g AS (SELECT *, CASE WHEN LAG(ts) OVER (PARTITION BY channel ORDER BY ts) IS NULL
                      OR ts - LAG(ts) OVER (PARTITION BY channel ORDER BY ts) >= INTERVAL 30 MINUTE
                     THEN 1 ELSE 0 END AS brk FROM t),
s AS (SELECT *, SUM(brk) OVER (PARTITION BY channel ORDER BY ts) AS sid FROM g),
ss AS (SELECT channel, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end,
              COUNT(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts
       FROM s GROUP BY channel, sid)
SELECT * FROM ss
""")
def q_stream_idle_sessions(spark, sf):
    from railyard import streaming as sm
    e = b.table(spark, sf, "events").filter("event_type IN ('view', 'click')").select(
        F.col("user_id").alias("channel"), "ts")
    s, end = _finite(spark, e, "traffic", 1_800_000)
    out = sm.run_available(sm.stream_idle_sessions(s, "channel", "ts", "30 minutes", DELAY),
                           "sessions", end=end)
    return out.select("channel", *[F.col(c).cast("timestamp_ntz").alias(c) for c in
                                   ("session_start", "session_end")],
                      "n_events", *[F.col(c).cast("timestamp_ntz").alias(c)
                                    for c in ("first_ts", "last_ts")])


# Of the log in a micro-batch: what its shuffle and the sessions it opens take
# on disk goes by this, not by the log.
SLICE_ROWS = 25_000_000


@register("st5_stream_first_answer", """
WITH a AS (SELECT DISTINCT l_orderkey AS request, l_linenumber AS item FROM lineitem),
t AS (SELECT request, item, CAST(n.n AS INTEGER) AS attempt, item AS seq,
             make_timestamp((1704067200 + request * 60 + n.n * 3600 + item) * 1000000) AS ts,
             (request * 31 + item * 7 + n.n * 13) % 5 AS code
      FROM a CROSS JOIN (SELECT unnest(range(0, 4)) AS n) n),
o AS (SELECT request, item, attempt, seq, ts,
             CASE WHEN code <= 1 THEN 'io_error' WHEN code = 2 THEN 'fatal' ELSE 'ok' END AS outcome,
             row_number() OVER (PARTITION BY request, item ORDER BY ts, attempt) AS rn,
             count(*) OVER (PARTITION BY request, item) AS n_answers
      FROM t)
SELECT request, item, ts, attempt, seq, outcome, n_answers FROM o
WHERE rn = 1
""")
def q_stream_first_answer(spark, sf):
    from railyard import streaming as sm
    hour = 3_600_000
    log = sm.with_end(b.timed_answers(spark, sf))
    path = sm.stage_files(log, "ts", 4, "answers", n_files=3, slice_rows=SLICE_ROWS)
    s = sm.read_stream(spark, path, log.schema, max_files=sm.files_of_a_slice(spark, path))
    out = sm.run_available(sm.stream_first_answer(s, ("request", "item"), "ts", "3 hours", "2 hours", ("attempt",)),
                           "first-answer", end=lambda: sm.stage_end(spark.read.schema(log.schema).parquet(path), path,
                                                                    5 * hour + 1000, instead=True))
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@register("st5_stream_report_once", "SELECT DISTINCT l_orderkey AS request, l_linenumber AS item FROM lineitem")
def q_stream_report_once(spark, sf):
    """Which answer comes first depends on the files, that each is told once
    does not."""
    from railyard import streaming as sm
    s = _staged(spark, b.timed_answers(spark, sf), "ts", "answers-o")
    return sm.run_available(sm.stream_report_once(s, ("request", "item"), "ts", "3650 days"),
                            "report-once").select("request", "item")


@register("st6_stream_reassemble", """
WITH c AS (SELECT conv_id, turn, strlen(text) AS nb FROM conversations),
r AS (SELECT conv_id, turn,
             CAST(SUM(nb) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS run
      FROM c),
ex AS (SELECT conv_id, CAST(SUM(nb) AS BIGINT)
              + CASE WHEN conv_id % 7 = 0 THEN 1 WHEN conv_id % 7 = 1 THEN -1 ELSE 0 END AS exp
       FROM c GROUP BY conv_id),
j AS (SELECT r.*, ex.exp FROM r JOIN ex ON r.conv_id = ex.conv_id),
ov AS (SELECT conv_id, min(turn) AS t FROM j WHERE run > exp GROUP BY conv_id)
SELECT conv_id AS stream_id, turn AS chunk_idx, run AS bytes_read, 'data' AS event FROM j
UNION ALL
SELECT conv_id, NULL, run, 'complete' FROM j WHERE run = exp
UNION ALL
SELECT j.conv_id, NULL, j.run, 'overrun' FROM j JOIN ov ON j.conv_id = ov.conv_id AND j.turn = ov.t
UNION ALL
SELECT conv_id, NULL, max(run), 'incomplete' FROM j GROUP BY conv_id HAVING max(run) < any_value(exp)
""")
def q_stream_reassemble(spark, sf):
    from railyard import streaming as sm
    chunks, ann = b.timed_conversation_streams(spark, sf)
    s, end = _finite(spark, chunks, "conv-chunks", 3_600_000)
    joined = s.join(ann, "stream_id", "left")         # the end row has no announcement
    return sm.run_available(sm.stream_reassemble(joined, "1 hour", DELAY), "reassembly", end=end)


@register("st7_listener_sink", APP_EVENTS_SQL.replace(
    "ae2 AS (SELECT * FROM ae WHERE state IS NOT NULL)", """
ai AS (SELECT user_id AS app, ts, event_id AS eid, NULL AS state FROM e
       WHERE event_type = 'purchase' AND k >= 5),
aa AS (SELECT * FROM ae WHERE state IS NOT NULL UNION ALL SELECT * FROM ai),
ae2 AS (SELECT * FROM aa WHERE state IS NOT NULL),
info AS (SELECT app, ts, eid FROM aa WHERE state IS NULL)""") + """,
ok AS (SELECT app, ts, eid, state FROM tr WHERE disposition = 'applied')
SELECT app, ts, eid, state, 'state_changed' AS change FROM ok
UNION ALL
SELECT i.app, i.ts, i.eid, coalesce(ok.state, 'UNKNOWN'), 'info_changed'
FROM info i ASOF LEFT JOIN ok ON i.app = ok.app AND i.ts >= ok.ts
""")
def q_listener_sink(spark, sf):
    from railyard import streaming as sm
    from railyard.session import scratch_path
    s, end = _finite(spark, b.app_events_with_info(spark, sf), "app-events-l")
    target = scratch_path(spark, "listener-out")

    def listener(batch, batch_id):
        batch.write.mode("append").parquet(target)

    changes = sm.stream_state_changes(s, DELAY)
    checkpoint = scratch_path(spark, "listener-ckpt")
    sm.listener_sink(changes, listener, checkpoint).awaitTermination()
    end()
    sm.listener_sink(changes, listener, checkpoint).awaitTermination()
    return (spark.read.schema(changes.schema).parquet(target)
            .withColumn("ts", F.col("ts").cast("timestamp_ntz")))


# ============================================================ text (walks)
LINES_SQL = """
WITH l AS (SELECT o_orderkey, o_orderstatus AS st, o_orderkey % 10 AS m FROM orders)
"""


@register("txt4_parse_command_lines", LINES_SQL + """
SELECT o_orderkey,
       CASE WHEN m IN (1, 3) THEN NULL ELSE 'app.jar' END AS resource,
       CASE WHEN m IN (1, 3) THEN NULL
            ELSE '--name=o' || o_orderkey || ' --conf=p=' || st || ' --verbose=' END AS option_list,
       CASE WHEN m IN (1, 3) THEN NULL WHEN m = 0 THEN 1 ELSE 0 END AS n_extras,
       CASE m WHEN 1 THEN 'missing_value' WHEN 3 THEN 'bad_quoting' END AS reject_reason
FROM l
""")
def q_parse_command_lines(spark, sf):
    from railyard.operators import text as tx
    p = tx.parse_command_lines(b.submit_command_lines(spark, sf), "line")
    return p.select("o_orderkey", "resource",
                    F.array_join(F.transform("options", lambda o: F.concat(
                        o["name"], F.lit("="), F.coalesce(o["value"], F.lit("")))), " ")
                    .alias("option_list"),
                    F.when(F.col("extras").isNotNull(), F.size("extras")).alias("n_extras"),
                    "reject_reason")


@register("txt4_option_usage", LINES_SQL + """
SELECT '--name' AS option, COUNT(*) AS uses, COUNT(DISTINCT o_orderkey) AS distinct_values
FROM l WHERE m NOT IN (1, 3)
UNION ALL
SELECT '--conf', COUNT(*), COUNT(DISTINCT st) FROM l WHERE m NOT IN (1, 3)
UNION ALL
SELECT '--verbose', COUNT(*), 0 FROM l WHERE m NOT IN (1, 3)
UNION ALL
SELECT '<rejected>', COUNT(*), 0 FROM l WHERE m IN (1, 3)
""")
def q_option_usage(spark, sf):
    from railyard.operators import text as tx
    return tx.option_usage(tx.parse_command_lines(b.submit_command_lines(spark, sf), "line"))


@register("txt5_reassemble_frames", """
WITH d AS (SELECT doc_id % 8 AS conn, doc_id, text FROM documents),
f AS (SELECT conn, CAST(row_number() OVER (PARTITION BY conn ORDER BY doc_id) - 1 AS INTEGER) AS frame_idx,
             CAST(strlen(text) AS BIGINT) AS length, text AS payload, 'frame' AS status FROM d)
SELECT * FROM f
UNION ALL
SELECT 6, CAST((SELECT COUNT(*) FROM d WHERE conn = 6) AS INTEGER), 0, NULL, 'bad_length'
UNION ALL
SELECT 7, CAST((SELECT COUNT(*) FROM d WHERE conn = 7) AS INTEGER), 4, NULL, 'incomplete_tail'
""")
def q_reassemble_frames(spark, sf):
    from railyard.operators import text as tx
    out = tx.reassemble_frames(b.framed_packets(spark, sf), "conn", "seq", "payload")
    return out.withColumn("payload", F.decode("payload", "UTF-8"))


@register("wn4_activity_sessions", """
WITH t AS (SELECT user_id AS channel, ts, event_id FROM events WHERE event_type IN ('view', 'click')),
g AS (SELECT *, CASE WHEN LAG(ts) OVER w IS NULL OR ts - LAG(ts) OVER w >= INTERVAL 30 MINUTE
                     THEN 1 ELSE 0 END AS brk
      FROM t WINDOW w AS (PARTITION BY channel ORDER BY ts, event_id)),
s AS (SELECT *, SUM(brk) OVER (PARTITION BY channel ORDER BY ts, event_id) AS sid FROM g)
SELECT channel, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end,
       COUNT(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts
FROM s GROUP BY channel, sid
""")
def q_activity_sessions(spark, sf):
    from railyard.operators import windows as wn
    e = b.table(spark, sf, "events").filter("event_type IN ('view', 'click')").select(
        F.col("user_id").alias("channel"), "ts", F.col("event_id").alias("eid"))
    return wn.activity_sessions(e, "channel", "ts", "eid", 1800)
