"""Readers for the sample formats: delimited text, JSON lines, ^A-separated
key/value files, properties files, and byte segments of files.

All are ``spark.read`` sources with explicit schemas (no inference pass), so
column pruning and filters reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from railyard.session import stored


# --------------------------------------------------------------------------- SRC1
def _with_reject(schema: StructType | str, reject_col: str | None) -> StructType | str:
    if reject_col is None:
        return schema
    if isinstance(schema, str):
        return f"{schema}, {reject_col} STRING"
    return StructType(schema.fields + [StructField(reject_col, StringType())])


def scan_delimited(spark: SparkSession, path: str, schema: StructType | str,
                   sep: str = ",", reject_col: str | None = None) -> DataFrame:
    """Delimited text rows (``name, age``): the blank after a separator is
    not data.  Malformed numeric fields become null (PERMISSIVE); name a
    ``reject_col`` to get the whole line of every row with a malformed field
    or a wrong number of fields (null on good rows)."""
    return spark.read.csv(path, schema=_with_reject(schema, reject_col), sep=sep,
                          ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True,
                          mode="PERMISSIVE", columnNameOfCorruptRecord=reject_col)


# --------------------------------------------------------------------------- SRC2
def scan_json_lines(spark: SparkSession, path: str,
                    schema: StructType | str | None = None) -> DataFrame:
    """JSON lines; a missing field is null.  Without a schema the column set
    is the union over all records (costs an inference pass — give a schema
    at scale)."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


# --------------------------------------------------------------------------- SRC3
def scan_ctrl_a_kv(spark: SparkSession, path: str, reject_col: str | None = None) -> DataFrame:
    """``key^Avalue`` rows as ``key BIGINT, value STRING``; duplicate keys are
    legal and kept.  ``reject_col`` as in ``scan_delimited``."""
    return spark.read.csv(path, schema=_with_reject("key BIGINT, value STRING", reject_col), sep="\x01",
                          quote="", escape="", mode="PERMISSIVE", columnNameOfCorruptRecord=reject_col)


# --------------------------------------------------------------------------- SRC4
_KEY_VALUE = r"^([^\\=: \t\f]*+(?:\\[\s\S][^\\=: \t\f]*+)*+)[ \t\f]*+[=:]?[ \t\f]*+([\s\S]*+)\z"
_PIECE = r"(?:\\u[0-9a-fA-F]{4})+|\\[\s\S]|[^\\]++"
_ESCAPES_OK = (r"^[^\\]*+(?:\\(?:[^u]|u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}"
               r"|u(?![dD][89a-fA-F])[0-9a-fA-F]{4})[^\\]*+)*+\z")
_CONTROL = {"t": "\t", "n": "\n", "r": "\r", "f": "\f"}


def _unescape(c: Column) -> Column:
    def piece(p: Column) -> Column:
        letter = F.substring(p, 2, 1)
        plain = F.when(p.rlike(r"^\\u"), F.decode(F.unhex(F.replace(p, F.lit("\\u"), F.lit(""))), "UTF-16BE"))
        for name, char in _CONTROL.items():
            plain = plain.when(p == "\\" + name, F.lit(char))
        return plain.when(p.startswith("\\"), letter).otherwise(p)
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(_PIECE), F.lit(0)), piece), "")


def _natural_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as they lie in the files: ``file, block`` (where the split they
    were read by starts), ``row`` (their order in a split) and ``line``,
    stored, as both scans below go by the splits and rows."""
    return stored(spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), F.col("value").alias("line")), "lines")


def _logical_lines(lines: DataFrame) -> DataFrame:
    """``file, at, line``: natural lines joined where a backslash continues
    them.  Whether a line goes on from the one before it depends on that
    line's end, unless it looks like a comment: then it goes on (and is none)
    only if it is itself a continuation.  So the last line that does not look
    like a comment with such an end decides, wherever its split is; a running
    maximum finds it, and a running count numbers the logical lines."""
    from railyard.operators.scan import segmented_scan
    order = ["block", "row"]
    odd = F.length(F.regexp_extract("line", r"(\\*)\z", 1)) % 2 == 1
    comment = F.col("line").rlike(r"^[ \t\f]*[#!]")
    lines = lines.withColumn("goes_on", odd)
    decides = F.when(~(F.col("goes_on") & comment), F.struct(*order, "goes_on"))
    lines = segmented_scan(lines, ["file"], order, {"last": ("max", decides)}, block="block", inclusive=False)
    lines = stored(lines.withColumn("starts", ~F.coalesce(F.col("last.goes_on"), F.lit(False))).drop("last"), "starts")
    lines = segmented_scan(lines, ["file"], order, {"at": ("sum", F.col("starts").cast("bigint"))},
                           block="block")
    body = F.when(F.col("starts"), F.col("line")).otherwise(F.regexp_replace("line", r"^[ \t\f]+", ""))
    # a comment is not continued; all other lines of odd ends lose the last backslash
    ends = F.col("goes_on") & ~(F.col("starts") & comment)
    part = F.struct(*order, F.when(ends, F.expr("left(body, length(body) - 1)")).otherwise(F.col("body")).alias("text"),
                    (F.col("starts") & comment).alias("comment"))
    return (lines.withColumn("body", body).groupBy("file", "at").agg(F.array_sort(F.collect_list(part)).alias("parts"))
            .filter(~F.col("parts")[0]["comment"])
            .select("file", "at", F.regexp_replace(F.array_join(F.transform("parts", lambda p: p["text"]), ""),
                                                   r"^[ \t\f]+", "").alias("line")))


def scan_properties(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """Properties files as ``(layer, key, value, reject_reason)`` rows, in
    the format's whole grammar: ``=``, ``:`` or white space between key and
    value, comments with ``#`` or ``!``, lines continued by a backslash,
    ``\\t \\n \\r \\f \\uXXXX`` and other escapes; values are trimmed.  A line
    whose unicode escape is malformed (or half a surrogate pair) is kept:
    null key, the line as value, ``malformed_escape`` as reason.  Of a key
    that a file sets twice the last value counts.  Files are read in splits
    of any size; a cell holds a logical line, never a file."""
    lines = _logical_lines(_natural_lines(spark, path)).filter("line <> ''")
    ok = F.col("line").rlike(_ESCAPES_OK)
    value = F.regexp_replace(_unescape(F.regexp_extract("line", _KEY_VALUE, 2)),
                             r"^[\x00-\x20]+|[\x00-\x20]+\z", "")
    # a rejected line is a group of its own, any key is one per file
    return (lines.withColumn("key", F.when(ok, _unescape(F.regexp_extract("line", _KEY_VALUE, 1))))
            .withColumn("value", F.when(ok, value).otherwise(F.col("line")))
            .groupBy("file", "key", F.when(~ok, F.col("at")).alias("rejected"))
            .agg(F.max_by("value", "at").alias("value"))
            .select(F.lit(layer).alias("layer"), "key", "value",
                    F.when(F.col("rejected").isNotNull(), "malformed_escape").alias("reject_reason")))


# --------------------------------------------------------------------------- SRC5
READ_BLOCK = 64 << 20     # segments that start in one such range are read by one task


def _read_ranges(batches):
    """Adds ``data``: each segment's bytes, read at its place.  Rows come
    sorted by file, so a file is opened once per run of rows."""
    import pyarrow as pa
    from pyarrow import fs

    name = handle = None
    try:
        for batch in batches:
            out = []
            paths, offsets, lengths, reasons = (batch.column(c).to_pylist() for c in
                                                ("__path", "__offset", "__length", "reject_reason"))
            for path, offset, length, reason in zip(paths, offsets, lengths, reasons, strict=True):
                if reason is not None:
                    out.append(None)
                    continue
                if path != name:
                    if handle is not None:
                        handle.close()
                    uri = "file://" + path[len("file:"):] if path.startswith("file:/") and path[6:7] != "/" else path
                    system, inner = fs.FileSystem.from_uri(uri)
                    name, handle = path, system.open_input_file(inner)
                data = handle.read_at(length, offset)
                if len(data) != length:
                    raise EOFError(f"{path}: {len(data)} of {length} bytes at {offset}")
                out.append(data)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())],
                                             names=[*batch.schema.names, "data"])
    finally:
        if handle is not None:
            handle.close()


def scan_segments(spark: SparkSession, path_glob: str, segments: DataFrame) -> DataFrame:
    """Read exactly ``length`` bytes at ``offset`` of each named file.

    ``segments``: ``path, offset, length`` (+ any columns, kept); ``path`` as
    the ``binaryFile`` source reports it.  Adds ``file_size``, ``data``
    (BINARY) and ``reject_reason``: ``eof`` when the file is shorter than
    ``offset + length`` (an error, never a short read), ``missing_file`` when
    no such file exists (or it is empty: Spark lists none of these),
    ``bad_range`` for a negative or null range.

    Only the listing comes from the ``binaryFile`` source, without contents.
    Segments are dealt to tasks by file and ``READ_BLOCK`` and read at their
    places in ascending order, so files of any size are never loaded; a task
    holds an Arrow batch of segments.  Files are opened by Arrow's file
    systems (local, HDFS, S3, GCS, ABFS) under the URI that Spark lists."""
    from pyspark.sql import types as T

    from railyard.session import ship_package
    ship_package(spark)
    files = spark.read.format("binaryFile").load(path_glob).select(F.col("path").alias("__path"),
                                                                   F.col("length").alias("file_size"))
    j = segments.select(F.struct(*[segments[c] for c in segments.columns]).alias("__row"),
                        segments["path"].alias("__wanted"), segments["offset"].cast("bigint").alias("__offset"),
                        segments["length"].cast("bigint").alias("__length"))
    j = j.join(files, j["__wanted"] == files["__path"], "left")
    reason = (F.when(F.col("__path").isNull(), "missing_file")
              .when(F.col("__offset").isNull() | F.col("__length").isNull() | (F.col("__offset") < 0)
                    | (F.col("__length") < 0), "bad_range")
              .when(F.col("__offset") + F.col("__length") > F.col("file_size"), "eof"))
    j = j.withColumn("reject_reason", reason).drop("__wanted")
    dealt = j.repartition("__path", F.floor(F.col("__offset") / READ_BLOCK)).sortWithinPartitions("__path", "__offset")
    out = dealt.mapInArrow(_read_ranges, T.StructType(dealt.schema.fields + [T.StructField("data", T.BinaryType())]))
    return out.select("__row.*", "file_size", "data", "reject_reason")
