"""Running streams over staged files.

Streaming inputs are files: ``stage_files`` writes a DataFrame as a sequence
of time-ordered slices (one write per slice, so the file source sees them in
order), ``read_stream`` opens them with an explicit schema, and
``run_available`` drains a streaming DataFrame with ``availableNow`` into a
parquet sink, returning the sink as a batch DataFrame.  Every location is
under the shared checkpoint folder, so a restarted query resumes from its
checkpoint instead of starting over.

A finite input is flushed by an end row (``with_end``, ``stage_end``): it
carries the watermark past the last event, and is dropped right behind it
(``watermarked``), so it is in no result.
"""

from __future__ import annotations

import contextlib
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railyard.session import removed, scratch_path, stored

# Null in events; in the end row of a finite input, its event time.
END = "__end_of_input"


def rows_dropped(query) -> int:
    """Rows that Spark's own stateful operators (session windows, joins,
    duplicates) have dropped as late, of the batches the query remembers."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def with_end(df: DataFrame, ts: str = "ts") -> DataFrame:
    """``df`` with the column that tells an end row from events."""
    return df.withColumn(END, F.lit(None).cast(df.schema[ts].dataType))


def stage_end(df: DataFrame, path: str, after_ms: int, ts: str = "ts", instead: bool = False) -> None:
    """Add the end row of ``df`` (``with_end``) to the staged folder, dated
    ``after_ms`` past its last event; none if there is no event.  Stage it
    once the events are drained: a file source goes by modification times,
    which need not tell the last file of events from this one.  ``instead``
    of them, which no query reads any more, if it is to save the room."""
    at = F.col("top") + F.expr(f"make_dt_interval(0, 0, 0, {after_ms / 1000:.3f})")
    top = df.agg(F.max(ts).alias("top")).filter("top IS NOT NULL")
    row = top.select(*[(at if f.name in (ts, END) else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in df.schema.fields])
    if not instead:
        return row.write.mode("append").parquet(path)
    row = stored(row, "end-row")                      # it may have been read from there
    row.write.mode("overwrite").parquet(path)
    removed(row)


def watermarked(events: DataFrame, ts: str, delay: str) -> DataFrame:
    """``events`` with a watermark and, behind it, without an end row.  The
    condition mentions ``ts``, so that it is not pushed below the watermark."""
    out = events.withWatermark(ts, delay)
    if END not in out.columns:
        return out
    return out.filter(F.coalesce(F.col(ts) != F.col(END), F.lit(True))).drop(END)


FILE_ROWS = 1_000_000     # of a staged file, beyond which a slice has more files


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """The shuffle files of what is run, or of a stream that is started inside
    go when its job, or micro-batch, has ended; otherwise they stay until the
    driver's garbage collector finds them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stage_files(df: DataFrame, ts: str | None = None, n_slices: int = 4,
                name: str = "stream-in", n_files: int | None = None, slice_rows: int | None = None) -> str:
    """Write ``df`` as ``n_slices`` time-ordered slices (slice i holds the
    i-th range of ``ts``, one write each so the file source lists them in
    order); without ``ts`` a single slice.  ``n_files`` deals the rows of a
    slice out over that many files in no order, or over more if a file would
    hold more than ``FILE_ROWS`` rows.  With ``slice_rows`` there are more
    slices if one would hold more rows than that, were they of equal size.
    ``df`` is computed once and kept while it is dealt out, as every slice and
    the range of ``ts`` read it.  Returns the folder."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_dropped(spark):
        df = stored(df, name + "-all")
        _deal(df, path, ts, n_slices, n_files, slice_rows)
    removed(df)
    return path


def _deal(df: DataFrame, path: str, ts: str | None, n_slices: int, n_files: int | None,
          slice_rows: int | None) -> None:
    sliced = ts is not None and n_slices > 1
    if sliced and slice_rows:
        n_slices = max(n_slices, -(-df.count() // slice_rows))
    if n_files:
        n_files = max(n_files, -(-df.count() // (FILE_ROWS * (n_slices if sliced else 1))))

    def deal(part: DataFrame, mode: str = "error") -> None:
        part = part.repartition(n_files) if n_files else part
        part.write.mode(mode).option("compression", "zstd").parquet(path)

    if not sliced:
        return deal(df)
    sec = F.unix_seconds(F.col(ts).cast("timestamp"))
    bounds = df.select(F.min(sec).alias("lo"), F.max(sec).alias("hi")).first()
    lo, hi = bounds["lo"], bounds["hi"]
    if lo is None:
        return deal(df)
    step = max(1, (hi - lo) // n_slices + 1)
    for i in range(n_slices):
        deal(df.filter((sec >= lo + i * step) & (sec < lo + (i + 1) * step)), "append")


def files_of_a_slice(spark: SparkSession, path: str) -> int:
    """The most files that one slice of a staged folder has.  As ``max_files``
    (``read_stream``) it puts every slice in two micro-batches at most, the
    later of which still goes by a watermark from before the slice, so none of
    its rows is late."""
    writes = Counter(re.sub(r".*/part-\d+-|-c\d+\..*", "", f) for f in spark.read.parquet(path).inputFiles())
    return max(writes.values(), default=1)


def share_of_files(spark: SparkSession, path: str, share: int) -> int:
    """The ``max_files`` (``read_stream``) with which a staged folder is drained
    in ``share`` micro-batches, however many files it has."""
    return max(1, -(-len(spark.read.parquet(path).inputFiles()) // share))


def read_stream(spark: SparkSession, path: str, schema, max_files: int | None = None,
                ts_cols: tuple[str, ...] = ("ts", "req_ts", "resp_ts", END)) -> DataFrame:
    """Open staged files as a stream; ``TIMESTAMP_NTZ`` event-time columns
    become ``TIMESTAMP`` (watermarks need it; the session zone is UTC).
    ``max_files`` bounds the files of a micro-batch; no result depends on it."""
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    s = r.parquet(path)
    for c in ts_cols:
        if c in s.columns:
            s = s.withColumn(c, F.col(c).cast("timestamp"))
    return s


ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb_state(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB (off-heap, spills to local disk and is
    snapshotted to the checkpoint) unless the session already chose a state
    store; per-key state for millions of keys does not fit executor heaps."""
    key = "spark.sql.streaming.stateStore.providerClass"
    current = spark.conf.get(key, None)
    if not current or current.endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(key, ROCKSDB_PROVIDER)
        # both sides of a stream-stream join in one store, not four
        spark.conf.set("spark.sql.streaming.join.stateFormatVersion", "3")
        # a count of keys costs a read before every write
        spark.conf.set("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "false")
        # a commit writes what has changed, not the files of the whole store
        spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
        spark.conf.set("spark.sql.streaming.stateStore.compression.codec", "zstd")


def run_available(stream: DataFrame, name: str, output_mode: str = "append",
                  end: Callable[[], None] | None = None, ended: Callable | None = None) -> DataFrame:
    """Drain ``stream`` (``availableNow``) into a parquet sink under the
    checkpoint folder and return what it wrote.  ``end`` stages the end row
    of a finite input once all else is drained; the query then resumes.
    ``ended`` is called with each query once it has ended (``rows_dropped``)."""
    spark = stream.sparkSession
    use_rocksdb_state(spark)
    out = scratch_path(spark, name + "-out")
    ckpt = scratch_path(spark, name + "-ckpt")

    def drain():
        with shuffles_dropped(spark):
            q = (stream.writeStream.format("parquet").outputMode(output_mode)
                 .option("checkpointLocation", ckpt).option("path", out).option("compression", "zstd")
                 .trigger(availableNow=True).start())
        q.awaitTermination()
        if ended:
            ended(q)

    drain()
    if end:
        end()
        drain()
    return spark.read.schema(stream.schema).parquet(out)


def run_foreach_batch(stream: DataFrame, fn, name: str, output_mode: str = "append") -> None:
    """Drain ``stream`` (``availableNow``) through ``foreachBatch(fn)``."""
    spark = stream.sparkSession
    use_rocksdb_state(spark)
    ckpt = scratch_path(spark, name + "-ckpt")
    q = (stream.writeStream.outputMode(output_mode).foreachBatch(fn)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
