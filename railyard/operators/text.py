"""Text and binary rules: chunking, bounded slicing, reassembly, option
usage over command lines, and frame reassembly over captured packets.

STRING columns are measured in characters, BINARY columns in bytes (Spark's
``length``/``substring`` do exactly that), so the same operator serves both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railyard.operators.scan import segmented_scan


def _c(c):
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------------------- TXT1
def chunk_split(df: DataFrame, id_col: str, body: str, max_len: int) -> DataFrame:
    """Cut each body into pieces of at most ``max_len`` units (last one
    short); an empty or null body yields no piece.  Output: ``id_col,
    chunk_idx, offset, length, body``.  A generator (``posexplode``) inside
    the scan stage — no shuffle."""
    n = F.length(_c(body))
    k = F.when(n > 0, F.sequence(F.lit(0), ((n + (max_len - 1)) / max_len).cast("int") - 1))
    exploded = df.select(id_col, F.col(body).alias("__b"), n.alias("__n"),
                         F.explode(F.coalesce(k, F.array().cast("array<int>"))).alias("chunk_idx"))
    off = F.col("chunk_idx").cast("bigint") * max_len
    return exploded.select(
        id_col, "chunk_idx", off.alias("offset"),
        F.least(F.lit(max_len).cast("bigint"), F.col("__n") - off).alias("length"),
        F.substring(F.col("__b"), (off + 1).cast("int"), max_len).alias("body"))


# --------------------------------------------------------------------------- TXT2
def slice_range(df: DataFrame, body: str, offset: Column | str, length: Column | str) -> DataFrame:
    """Bounded read of ``length`` units at ``offset``: adds ``slice`` and
    ``reject_reason`` = ``eof`` when the source is shorter than
    ``offset + length`` (a short source is an error, never a short read) or
    ``bad_range`` for a negative offset/length."""
    o, ln = _c(offset), _c(length)
    reason = (F.when((o < 0) | (ln < 0), "bad_range")
              .when(o + ln > F.length(_c(body)), "eof"))
    piece = F.substring(_c(body), (o + 1).cast("int"), ln.cast("int"))
    return df.withColumn("reject_reason", reason) \
             .withColumn("slice", F.when(reason.isNull(), piece))


# --------------------------------------------------------------------------- TXT3
PART_BYTES = 1 << 20
CELL_BYTES = 1 << 30


def reassemble_parts(chunks: DataFrame, stream: str = "stream_id", idx: str = "chunk_idx", body: str = "body",
                     part_bytes: int = PART_BYTES, block_chunks: int = 4096) -> DataFrame:
    """A stream's bytes in order, in parts that fit a cell: ``stream, part,
    offset, n_bytes, n_chunks, body``.

    Pieces are put in order of ``(idx, body)``; a running sum of their sizes
    gives each its offset, and pieces that start within the same
    ``part_bytes`` make a part.  So no task and no cell holds a stream: a part
    is smaller than ``part_bytes`` and one piece together.  ``body`` has the
    type of the pieces (STRING or BINARY); null pieces count as empty."""
    rows = chunks.select(F.col(stream), F.col(idx), F.col(body), F.octet_length(_c(body)).cast("bigint").alias("__n"))
    rows = rows.withColumn("__n", F.coalesce("__n", F.lit(0).cast("bigint")))
    placed = segmented_scan(rows, [stream], [F.col(idx), F.col(body)], {"__before": ("sum", F.col("__n"))},
                            block=F.coalesce(F.floor(F.col(idx) / block_chunks), F.lit(-(1 << 62))), inclusive=False)
    placed = placed.withColumn("__at", F.coalesce("__before", F.lit(0).cast("bigint")))
    whole = F.expr(f"listagg(`{body}`) WITHIN GROUP (ORDER BY __order)")
    return (placed.withColumn("__order", F.struct("__at", "__n", idx, body))
            .groupBy(stream, F.floor(F.col("__at") / part_bytes).alias("part"))
            .agg(F.min("__at").alias("offset"), F.sum("__n").alias("n_bytes"), F.count(F.lit(1)).alias("n_chunks"),
                 F.coalesce(whole, F.lit("").cast(chunks.schema[body].dataType)).alias("body")))


def reassemble_chunks(chunks: DataFrame, announced: DataFrame, stream: str = "stream_id",
                      idx: str = "chunk_idx", body: str = "body",
                      expected: str = "expected_bytes", cell_bytes: int = CELL_BYTES) -> DataFrame:
    """Put pieces back together in index order and check the byte count;
    the result has the type of the pieces, STRING or BINARY.

    ``chunks``: ``stream, idx, body``; ``announced``: ``stream,
    expected_bytes`` (one row per stream).  Output per announced stream:
    ``text`` (concatenation by index), ``bytes_read`` (UTF-8 bytes, or bytes
    of BINARY), ``n_chunks`` and ``status``: ``complete`` (count equals the
    announcement; a 0-byte stream completes at once), ``incomplete`` (fewer:
    the channel ended first) or ``overrun`` (more).

    The text is joined from the parts of ``reassemble_parts``, for streams of
    at most ``cell_bytes``; a longer stream has a null ``text`` here and its
    bytes in its parts.  Counts are partial sums, so no stream is collected.
    """
    sizes = chunks.groupBy(stream).agg(F.coalesce(F.sum(F.octet_length(_c(body))), F.lit(0)).cast("bigint").alias("__bytes"),
                                       F.count("*").alias("n_chunks"))
    j = announced.select(stream, expected).join(sizes, stream, "left")
    read = F.coalesce(F.col("__bytes"), F.lit(0).cast("bigint"))
    status = (F.when(read == F.col(expected), "complete")
              .when(read < F.col(expected), "incomplete").otherwise("overrun"))
    fits = sizes.filter(F.col("__bytes") <= cell_bytes).select(F.col(stream).alias("__fits"))
    parts = reassemble_parts(chunks.join(fits, F.col(stream) == F.col("__fits"), "left_semi"), stream, idx, body)
    whole = (parts.groupBy(F.col(stream).alias("__of"))
             .agg(F.expr("listagg(body) WITHIN GROUP (ORDER BY part)").alias("__whole")))
    empty = F.lit("").cast(chunks.schema[body].dataType)
    return (j.join(whole, F.col(stream) == F.col("__of"), "left")
            .select(stream, expected, F.when(read <= cell_bytes, F.coalesce(F.col("__whole"), empty)).alias("text"),
                    read.alias("bytes_read"), F.coalesce(F.col("n_chunks"), F.lit(0)).alias("n_chunks"),
                    status.alias("status")))


# --------------------------------------------------------------------------- TXT4
# Shell-like splitting.  A piece is a backslash-escaped character, a
# single-quoted run (taken literally), a double-quoted run (backslash escapes
# inside) or one plain character; a token is a run of pieces; tokens are
# separated by white space.  A line is valid only if pieces and blanks cover
# it completely (so an open quote or a dangling backslash rejects it).
_PIECE = r"""\\[\s\S]|'[^']*'|"(?:[^"\\]|\\[\s\S])*"|[^\s'"\\]"""
_TOKEN = "(?:" + _PIECE + ")+"
_LINE_OK = r"^\s*(?:(?:" + _PIECE + r")++(?:\s+|$))*$"


def shell_split(line: Column | str) -> Column:
    """Array of unquoted tokens, or null when the line is not well formed."""
    def unquote(p):
        return (F.when(p.startswith("'"), F.substring(p, F.lit(2), F.length(p) - 2))
                .when(p.startswith('"'), F.regexp_replace(
                    F.substring(p, F.lit(2), F.length(p) - 2), r"\\([\s\S])", "$1"))
                .when(p.startswith("\\"), F.substring(p, 2, 1))
                .otherwise(p))

    toks = F.regexp_extract_all(_c(line), F.lit(_TOKEN), 0)
    words = F.transform(toks, lambda t: F.array_join(
        F.transform(F.regexp_extract_all(t, F.lit(_PIECE), 0), unquote), ""))
    # Fast path: without quotes or backslashes a line is just blank-separated
    # words (always well formed).
    stripped = F.regexp_replace(_c(line), r"^\s+|\s+$", "")
    plain = F.when(stripped == "", F.array().cast("array<string>")) \
             .otherwise(F.split(stripped, r"\s+"))
    return (F.when(_c(line).isNull(), F.lit(None).cast("array<string>"))
            .when(~_c(line).rlike(r"['\"\\\\]"), plain)
            .when(_c(line).rlike(_LINE_OK), words))


# Submit options.  Options taking a value (with aliases), then
# switches (with aliases); the first name is the canonical one.
VALUED_OPTIONS = [
    ["--archives"], ["--class"], ["--conf", "-c"], ["--deploy-mode"], ["--driver-class-path"],
    ["--driver-cores"], ["--driver-java-options"], ["--driver-library-path"],
    ["--driver-memory"], ["--executor-cores"], ["--executor-memory"], ["--files"], ["--jars"],
    ["--keytab"], ["--kill"], ["--master"], ["--name"], ["--num-executors"], ["--packages"],
    ["--exclude-packages"], ["--principal"], ["--properties-file"], ["--proxy-user"],
    ["--py-files"], ["--queue"], ["--repositories"], ["--status"], ["--total-executor-cores"],
]
SWITCHES = [["--help", "-h"], ["--supervise"], ["--usage-error"], ["--verbose", "-v"],
            ["--version"]]

_OPT_T = "array<struct<name:string,value:string>>"


def _option_map() -> Column:
    kv = []
    for names, valued in [(n, True) for n in VALUED_OPTIONS] + [(n, False) for n in SWITCHES]:
        for alias in names:
            kv += [F.lit(alias), F.struct(F.lit(names[0]).alias("long"),
                                          F.lit(valued).alias("valued"))]
    return F.create_map(*kv)


def parse_submit_args(tokens: Column) -> Column:
    """Walk a token list the way the submit option parser does: ``--k=v``
    splits at the first ``=``; aliases map to the canonical name; a valued
    option without ``=v`` takes the next token (none left: ``missing_value``);
    a switch takes nothing; the first unknown token is the application
    resource and everything after it is passed through as extras.

    Returns ``struct<options, resource, extras, error>``.  Each token is
    classified once (regex split, dictionary lookup) in ``transform`` passes
    — lambdas get no common-subexpression elimination, so the fold must not
    repeat that work — and the walk is a fold (``aggregate``) over the small
    per-token structs.  All JVM-side, per row.
    """
    omap = _option_map()
    eq_re = r"^(--[^=]+)=(.+)$"
    t1 = F.transform(tokens, lambda t: F.struct(t.alias("tok"), t.rlike(eq_re).alias("eq")))
    t2 = F.transform(t1, lambda x: F.struct(
        x["tok"].alias("tok"),
        F.when(x["eq"], F.regexp_extract(x["tok"], eq_re, 1)).otherwise(x["tok"]).alias("arg"),
        F.when(x["eq"], F.regexp_extract(x["tok"], eq_re, 2)).alias("val")))
    t3 = F.transform(t2, lambda x: F.struct(
        x["tok"].alias("tok"), x["val"].alias("val"),
        F.element_at(omap, x["arg"]).alias("spec")))
    init = F.struct(F.lit("opt").alias("mode"), F.lit(None).cast("string").alias("pending"),
                    F.array().cast(_OPT_T).alias("options"),
                    F.lit(None).cast("string").alias("resource"),
                    F.array().cast("array<string>").alias("extras"))

    def one(n, v):
        return F.array(F.struct(n.alias("name"), v.cast("string").alias("value")))

    def step(acc, x):
        mode, spec, tok, val = acc["mode"], x["spec"], x["tok"], x["val"]
        known = spec.isNotNull()
        wants_next = known & spec["valued"] & val.isNull()
        scan_opts = (F.when(~known | wants_next, acc["options"])
                     .when(spec["valued"], F.concat(acc["options"], one(spec["long"], val)))
                     .otherwise(F.concat(acc["options"], one(spec["long"], F.lit(None)))))
        return F.struct(
            F.when(mode == "opt", F.when(~known, "extra").when(wants_next, "val").otherwise("opt"))
            .when(mode == "val", "opt").otherwise("extra").alias("mode"),
            F.when((mode == "opt") & wants_next, spec["long"]).alias("pending"),
            F.when(mode == "opt", scan_opts)
            .when(mode == "val", F.concat(acc["options"], one(acc["pending"], tok)))
            .otherwise(acc["options"]).alias("options"),
            F.when((mode == "opt") & ~known, tok).otherwise(acc["resource"]).alias("resource"),
            F.when(mode == "extra", F.concat(acc["extras"], F.array(tok)))
            .otherwise(acc["extras"]).alias("extras"))

    def finish(acc):
        return F.struct(acc["options"].alias("options"), acc["resource"].alias("resource"),
                        acc["extras"].alias("extras"),
                        F.when(acc["mode"] == "val", "missing_value").alias("error"))

    return F.aggregate(t3, init, step, finish)


def parse_command_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """Per command line: ``tokens``, parsed ``options`` (canonical name,
    value), ``resource``, ``extras`` and ``reject_reason`` (``bad_quoting``
    or ``missing_value``).  Row-local, no shuffle."""
    out = df.withColumn("tokens", shell_split(line))
    out = out.withColumn("__p", parse_submit_args(
        F.coalesce(F.col("tokens"), F.array().cast("array<string>"))))
    reason = F.when(F.col("tokens").isNull(), "bad_quoting").otherwise(F.col("__p.error"))
    ok = reason.isNull()
    return out.select(*df.columns, "tokens",
                      F.when(ok, F.col("__p.options")).alias("options"),
                      F.when(ok, F.col("__p.resource")).alias("resource"),
                      F.when(ok, F.col("__p.extras")).alias("extras"),
                      reason.alias("reject_reason"))


def option_usage(parsed: DataFrame) -> DataFrame:
    """Per canonical option over the accepted lines: ``uses`` and
    ``distinct_values``; rejected lines are counted under the option name
    ``<rejected>``.  One pass: ``explode`` + partial aggregation (the
    distinct count is exact)."""
    rejected = F.array(F.struct(F.lit("<rejected>").alias("name"),
                                F.lit(None).cast("string").alias("value")))
    opts = F.when(F.col("reject_reason").isNotNull(), rejected).otherwise(F.col("options"))
    return (parsed.select(F.explode(opts).alias("o"))
            .groupBy(F.col("o.name").alias("option"))
            .agg(F.count("*").alias("uses"),
                 F.count_distinct(F.col("o.value")).alias("distinct_values")))


# --------------------------------------------------------------------------- TXT5
FRAME_HEADER_BYTES = 8
MAX_FRAME_PAYLOAD = 2**31 - 1


def reassemble_frames(packets: DataFrame, conn: str = "conn", seq: str = "seq",
                      payload: str = "payload", num_partitions: int | None = None) -> DataFrame:
    """Cut each connection's byte stream into frames.

    A frame is an 8-byte big-endian length (counting itself) followed by the
    payload; frames, and even the length field, may straddle packets.  Output
    rows: ``conn, frame_idx, length, payload, status`` with status ``frame``,
    ``bad_length`` (non-positive or too-large payload; the connection stops
    there) or ``incomplete_tail`` (bytes held back at the end; ``length`` is
    the number held).

    Packets are shuffled by connection and sorted by ``seq`` inside each
    partition; ``mapInPandas`` then streams through them keeping only the
    current unfinished frame, so memory is bounded by one frame, not by a
    connection's traffic.
    """
    import pandas as pd

    from railyard.session import ship_package
    ship_package(packets.sparkSession)
    parts = num_partitions or int(packets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    conn_type = packets.schema[conn].dataType.simpleString()
    ordered = (packets.select(conn, seq, payload).repartition(parts, conn)
               .sortWithinPartitions(conn, seq))
    cols = ["conn", "frame_idx", "length", "payload", "status"]

    def cut(batches):
        cur, buf, pos, need, idx, dead = object(), bytearray(), 0, None, 0, False
        out = []

        def flush_conn():
            held = len(buf) - pos + (0 if need is None else FRAME_HEADER_BYTES)
            if cur is not None and not dead and (held > 0 or need is not None):
                out.append((cur, idx, held, None, "incomplete_tail"))

        started = False
        for pdf in batches:
            for c, data in zip(pdf[conn].to_numpy(), pdf[payload]):
                if not started or c != cur:
                    if started:
                        flush_conn()
                    cur, buf, pos, need, idx, dead, started = c, bytearray(), 0, None, 0, False, True
                if dead:
                    continue
                buf += bytes(data)
                while True:
                    if need is None:
                        if len(buf) - pos < FRAME_HEADER_BYTES:
                            break
                        declared = int.from_bytes(buf[pos:pos + 8], "big", signed=True)
                        body = declared - FRAME_HEADER_BYTES
                        if body <= 0 or body >= MAX_FRAME_PAYLOAD:
                            out.append((cur, idx, body, None, "bad_length"))
                            dead = True
                            break
                        pos += FRAME_HEADER_BYTES
                        need = body
                    if len(buf) - pos < need:
                        break
                    out.append((cur, idx, need, bytes(buf[pos:pos + need]), "frame"))
                    pos += need
                    idx += 1
                    need = None
                if pos > 1 << 20:
                    del buf[:pos]
                    pos = 0
            if out:
                yield pd.DataFrame(out, columns=cols)
                out = []
        if started:
            flush_conn()
        if out:
            yield pd.DataFrame(out, columns=cols)

    return ordered.mapInPandas(
        cut, f"conn {conn_type}, frame_idx int, length bigint, payload binary, status string")
