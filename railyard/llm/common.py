"""Helpers the operators share: row tags, written tables, size-checked joins."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from railyard.session import scratch_path, ship_package

# A side of at most this many rows may be broadcast; larger sides are shuffled.
BROADCAST_ROWS = 50_000
# A tag has a file's number over so many bits of a row's place in it.
_ROW_BITS = 40
_FILE, _BASE = "__tag_file", "__tag_base"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions that hold about ``per_task`` rows each, and no fewer than
    the session's: what a task holds in memory does not grow with the input."""
    return max(partitions(spark), -(-rows // per_task))


def text_of(col: str) -> Column:
    """Null counts as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def untagged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, text)``, for operators that need not tell repeated rows apart."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))


def tagged(docs: DataFrame, id_col: str, text_col: str, tag: str = "tag") -> DataFrame:
    """``(doc_id, tag, text)`` with a tag that tells repeated rows apart.

    The tag is that of ``numbered``.  Only these columns are kept, so extra
    columns can carry any name.
    """
    return numbered(docs, tag, F.col(id_col).cast("bigint").alias("doc_id"),
                    text_of(text_col).alias("text")).select("doc_id", tag, "text")


def by_position(df: DataFrame, prefix: str = "c") -> tuple[DataFrame, list[str]]:
    """``df`` with its columns renamed by position, and the new names: any
    name (with dots, blanks, or one that an operator adds) can be carried and
    is given back by ``toDF``."""
    names = [f"{prefix}{i}" for i in range(len(df.columns))]
    return df.toDF(*names), names


def free_name(name: str, taken) -> str:
    """``name``, longer if a column of that name (in any case) is there."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name += "_"
    return name


def quoted(name: str) -> Column:
    """The column of that very name."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(docs: DataFrame, tag: str, *columns: Column) -> DataFrame:
    """``columns`` and a bigint ``tag`` that tells the rows apart: the number
    of the row's file among the frame's files and its place in that file.  It
    is the same in every use of the frame if that is ``stable``, however the
    scan is split (by cores at hand, for one).  The files' numbers are
    broadcast if they are ``BROADCAST_ROWS`` at most, else shuffled."""
    docs = stable(docs)
    meta = docs.metadataColumn("_metadata")
    path = F.regexp_replace(meta["file_path"], ":/+", ":/")
    plain = docs.select(*columns)
    files = sorted({re.sub(":/+", ":/", f) for f in docs.inputFiles()})     # file:/// there, file:/ here
    file, base = free_name(_FILE, plain.columns), free_name(_BASE, plain.columns)
    rows = docs.select(*columns, meta["row_index"].alias(tag), path.alias(file))
    if len(files) <= 1:
        return rows.drop(file)
    known = docs.sparkSession.createDataFrame([(f, i << _ROW_BITS) for i, f in enumerate(files)],
                                              f"{file} string, {base} bigint")
    if len(files) <= BROADCAST_ROWS:
        known = F.broadcast(known)
    at = F.coalesce(base, F.raise_error(F.concat(F.lit("not among the files: "), file)).cast("bigint"))
    return rows.join(known, file, "left").withColumn(tag, at + F.col(tag)).drop(file, base)


def written(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back.  ``options``
    are those of the writer."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").options(**options or {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stable(docs: DataFrame) -> DataFrame:
    """The same rows with the same file and place in it at every use: a plain
    scan of files that knows them as it is, anything else (a shuffle, local
    rows) written first."""
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    nodes = re.findall(r"^[\s:+|!'-]*(\w+)", plan, re.M)
    if not set(nodes) <= {"Project", "Filter", "Relation"}:
        return written(docs, "stable")
    try:
        meta = docs.metadataColumn("_metadata")
        docs.select(meta["row_index"], meta["file_path"]).schema
    except AnalysisException:                         # no row_index in this format
        return written(docs, "stable")
    return docs


def small_join(big: DataFrame, small: DataFrame, cond, how: str = "left") -> DataFrame:
    """Join a table that is usually small.  Its rows are counted first: it is
    broadcast up to ``BROADCAST_ROWS``, shuffled beyond."""
    small = written(small, "small")
    if small.count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    return big.join(small, cond, how)


def python_ready(spark: SparkSession) -> None:
    ship_package(spark)


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, one more than rows) and bytes of a string or binary
    array without nulls, as numpy views."""
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    kind = np.int64 if wide else np.int32
    _, off, data = arr.buffers()
    if len(arr) == 0 or off is None:
        return np.zeros(len(arr) + 1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(off, kind)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets, body


def column(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    c = batch.column(batch.schema.get_field_index(name))
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over a 64-bit word."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
