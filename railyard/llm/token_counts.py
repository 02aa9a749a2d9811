"""Operator 3, token counts by a separator scan.

Input is flat token files without an index, cut into blocks of bytes:
``(file, block, body)`` with fixed-width little-endian ids and an
end-of-document id between documents.  Blocks are cut anywhere, so documents
straddle them.  Each block is searched by itself (one vectorised comparison);
the block totals go through a prefix scan per file, which gives every block
the tokens, separators and last separator before it; that stitches the
documents that cross boundaries.

Defined results.  A block of null or empty bytes holds no token.  Tokens after
the last separator of a file are a document with ``ended`` false.  Two
separators in a row enclose a document of zero tokens.  An empty table gives
no rows.  Rows with a null file are one file.  A torn id at the end of a block
is not counted.  Documents of any length are
counted whole, over as many blocks as they take; repeated rows each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from railyard.operators.scan import segmented_scan
from railyard.sources import scan_segments

from .common import column, python_ready, untagged, written
from .tokens import encoder

BLOCK_BYTES = 1 << 18
MANIFEST_ROWS = 4096
BLOCK_GROUP = 4096        # blocks of a file that one task scans

FLAT = "file int, block bigint, body binary, first_doc bigint, doc_ids array<bigint>"
FOUND = "file int, block bigint, n_tokens bigint, ends array<bigint>"


def _flat(ranks_path: str, pattern: str, end_id: int, width: str):
    end = np.array([end_id], width).tobytes()

    def run(batches):
        enc = encoder(ranks_path, pattern)
        file = TaskContext.get().partitionId()
        schema = pa.schema([("file", pa.int32()), ("block", pa.int64()), ("body", pa.binary()),
                            ("first_doc", pa.int64()), ("doc_ids", pa.list_(pa.int64()))])
        held, ids, block, first = bytearray(), [], 0, 0

        def row(**values):
            return pa.RecordBatch.from_pylist([{"file": file} | values], schema=schema)
        for batch in batches:
            docs, texts = column(batch, "doc_id"), column(batch, "text")
            for i in range(len(texts)):
                held += np.array(enc.encode(texts[i].as_py()), width).tobytes() + end
                ids.append(docs[i].as_py())
                at = 0
                while len(held) - at >= BLOCK_BYTES:
                    yield row(block=block, body=bytes(held[at:at + BLOCK_BYTES]))
                    at, block = at + BLOCK_BYTES, block + 1
                if at:
                    del held[:at]
                if len(ids) == MANIFEST_ROWS:
                    yield row(first_doc=first, doc_ids=ids)
                    first, ids = first + len(ids), []
        if held:
            yield row(block=block, body=bytes(held))
        if ids:
            yield row(first_doc=first, doc_ids=ids)
    return run


def flat_files(docs: DataFrame, ranks_path: str, pattern: str, end_id: int, width: str = "<u2",
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise into flat files, one per task: block rows (``body``), and
    manifest rows (``doc_ids`` in file order) that only the query uses."""
    python_ready(docs.sparkSession)
    return untagged(docs, id_col, text_col).mapInArrow(
        _flat(ranks_path, pattern, end_id, width), FLAT)


def _search(end_id: int, width: str):
    def run(batches):
        for batch in batches:
            bodies = column(batch, "body")
            ends, sizes = [], []
            for i in range(len(bodies)):
                raw = bodies[i].as_py() or b""
                ids = np.frombuffer(raw, width, len(raw) // np.dtype(width).itemsize)
                ends.append(np.flatnonzero(ids == end_id))
                sizes.append(len(ids))
            flat = np.concatenate(ends) if ends else np.zeros(0, np.int64)
            cuts = np.cumsum([0, *map(len, ends)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "file"), column(batch, "block"), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat, pa.int64()))],
                names=["file", "block", "n_tokens", "ends"])
    return run


def file_blocks(spark: SparkSession, path_glob: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``file, path, block, body`` of raw flat token files, files numbered by
    path (Spark lists no empty ones).  Blocks are ranges of ``block_bytes`` (a multiple of an id's width),
    read at their places, so no file is loaded whole."""
    listed = spark.read.format("binaryFile").load(path_glob).select("path", F.col("length").alias("size"))
    files = listed.withColumn("file", F.row_number().over(Window.orderBy("path")) - 1)     # a row per file
    last = F.greatest(F.floor((F.col("size") - 1) / block_bytes), F.lit(0)).cast("bigint")
    ranges = files.select("file", "path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("block"))
    offset = F.col("block") * block_bytes
    ranges = ranges.select("file", "path", "block", offset.alias("offset"),
                           F.least(F.lit(block_bytes).cast("bigint"), F.col("size") - offset).alias("length"))
    return scan_segments(spark, path_glob, ranges).select("file", "path", "block", F.col("data").alias("body"))


def separator_scan(blocks: DataFrame, end_id: int, width: str = "<u2") -> DataFrame:
    """``file, ordinal, start, n_tokens, ended`` of every document in the
    blocks ``(file, block, body)``; start counts the file's tokens."""
    python_ready(blocks.sparkSession)
    found = written(blocks.select(F.coalesce(F.col("file"), F.lit(-1)).cast("int").alias("file"),
                                  F.col("block").cast("bigint").alias("block"), "body")
                    .mapInArrow(_search(end_id, width), FOUND), "separators")
    totals = found.select("file", "block", "n_tokens", F.size("ends").cast("bigint").alias("n_ends"),
                          F.try_element_at("ends", F.lit(-1)).alias("last_end"),
                          F.floor(F.col("block") / BLOCK_GROUP).alias("part"))
    sums = segmented_scan(totals, ["file"], ["block"], {
        "tokens_before": ("sum", F.col("n_tokens")), "ends_before": ("sum", F.col("n_ends"))},
        block="part", inclusive=False).fillna(0, ["tokens_before", "ends_before"])
    stitched = segmented_scan(sums.withColumn("last", F.col("tokens_before") + F.col("last_end")),
                              ["file"], ["block"], {"last_before": ("max", F.col("last"))},
                              block="part", inclusive=False)
    base = (found.select("file", "block", "ends")
            .join(stitched.select("file", "block", "n_tokens", "n_ends", "last", "tokens_before",
                                  "ends_before", "last_before"), ["file", "block"])
            .withColumn("at", F.transform("ends", lambda e: e + F.col("tokens_before"))))
    docs = base.select("file", "block", "tokens_before", "ends_before", "last_before", "at",
                       F.posexplode("at").alias("k", "end"))
    start = F.coalesce(F.get("at", F.col("k") - 1), F.col("last_before"), F.lit(-1)) + 1
    whole = docs.select("file", (F.col("ends_before") + F.col("k")).alias("ordinal"),
                        start.cast("bigint").alias("start"), (F.col("end") - start).cast("bigint").alias("n_tokens"),
                        F.lit(True).alias("ended"))
    tail = (stitched.groupBy("file").agg(F.max(F.col("tokens_before") + F.col("n_tokens")).alias("size"),
                                     F.max(F.col("ends_before") + F.col("n_ends")).alias("ordinal"),
                                     F.coalesce(F.max("last") + 1, F.lit(0)).alias("start"))
            .filter("size > start")
            .select("file", "ordinal", F.col("start").cast("bigint").alias("start"),
                    (F.col("size") - F.col("start")).cast("bigint").alias("n_tokens"),
                    F.lit(False).alias("ended")))
    return whole.unionByName(tail)


def token_counts(docs: DataFrame, ranks_path: str, pattern: str, end_id: int, width: str = "<u2",
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, file, ordinal, start, n_tokens`` by writing flat files,
    scanning them and naming the documents found by their place in the file."""
    flat = written(flat_files(docs, ranks_path, pattern, end_id, width, id_col, text_col), "flat")
    found = separator_scan(flat.filter("body IS NOT NULL").select("file", "block", "body"), end_id, width)
    names = (flat.filter("body IS NULL").select("file", "first_doc", F.posexplode("doc_ids").alias("k", "doc_id"))
             .select("file", (F.col("first_doc") + F.col("k")).alias("ordinal"), "doc_id"))
    return names.join(found, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
