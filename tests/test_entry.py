import duckdb

from conftest import SF_TINY

import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert {"peer", "n", "avg_us", "p50_us"} <= set(df.columns)


def test_every_oracle_has_a_query():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 45


def test_oracles_agree_on_tiny_scale(spark):
    import sys, os
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(__file__)), "tools"))
    from oracle_check import TABLES, rows_of
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_TINY}/{t}.parquet')")
    q, o = entry.queries(), entry.oracle_sql()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")      # state stores are opened per partition
    streams = sorted(n for n in o if n.startswith("st") and ("_stream_" in n or "listener" in n))
    assert len(streams) >= 10
    for name in [*streams, "jn2_fifo_match", "ag2_latency_summary", "jn5_resolve_blocks",
                 "wn3_in_order_prefix", "wn5_resolve_retries", "txt4_option_usage",
                 "arr1_removed_dirs", "wn4_idle_channels_close", "flt1_tenant_isolation",
                 "ag3_message_census", "prj4_decode_message_type", "ag1_all_or_nothing"]:
        df = q[name](spark, SF_TINY)
        res = con.sql(o[name])
        assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == \
            rows_of(res.columns, res.fetchall()), name
    spark.conf.set("spark.sql.shuffle.partitions", old)
