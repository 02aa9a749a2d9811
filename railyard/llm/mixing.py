"""Operator 4, mixing sources to target weights by Poisson replication.

A source's repetition rate is its target share of the output divided by its
share of the input.  Each document draws its number of copies from a Poisson
distribution of that mean by inverting the distribution function at a number
hashed from its id, so a rerun or a retried task draws the same.  Copies are
exploded and dealt out by a hash of (id, copy): partitions are a random split
of the copies, and each is in random order.  All of it is DataFrame functions.

A rate beyond ``STEP`` is drawn as a sum of independent draws of at most
``STEP`` each, so no rate is too large for the inversion.

Defined results.  Null text counts no characters; a null source is a source of
its own.  A source of empty texts only, or of weight zero, has rate 1 or 0.
Rows without an id, and repeated rows, draw by the hash of what they hold, so
equal rows get equal counts.  Texts of any length are carried whole.  An empty table gives no rows.  The documents'
columns stay as they are; an added column whose name they have is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_position, small_join, tasks, text_of, written

STEP = 30.0               # largest mean inverted at once
TERMS = 128               # P(X >= 128) at mean 30 is below 2**-53, the step of the hash
TASK_CHARS = 128 << 20    # text of the copies of a task


def unit(*parts) -> Column:
    """A number in [0, 1) hashed from the parts: 52 bits of MD5."""
    key = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def rates(docs: DataFrame, temperature: float = 0.5, weights: dict | None = None,
          epochs: float = 1.0, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``src, size, mix_rate`` per source.  Target shares are ``weights`` (by
    source name; missing ones zero) or else size ** temperature, normalised."""
    sizes = written(docs.groupBy(F.col(source_col).cast("string").alias("src")).agg(
        F.sum(F.length(text_of(text_col))).cast("double").alias("size")), "sizes")
    if weights is None:
        want = F.pow("size", F.lit(float(temperature)))
    else:
        want = F.coalesce(*[F.when(F.col("src").eqNullSafe(F.lit(k)), F.lit(float(v)))
                            for k, v in weights.items()], F.lit(0.0))
    sizes = sizes.withColumn("want", want)
    total = sizes.agg(F.sum("size").alias("all_size"), F.sum("want").alias("all_want"))
    all_size, all_want = total.first() or (0.0, 0.0)
    rate = (F.col("want") / F.lit(all_want or 1.0) * F.lit((all_size or 0.0) * epochs) / F.col("size"))
    return sizes.select("src", "size", F.when(F.col("size") > 0, F.round(rate, 9)).otherwise(1.0).alias("mix_rate"))


def _distribution(rate: Column) -> Column:
    """P(X <= k) for k = 0 .. TERMS - 1 at the mean ``rate``."""
    first = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("cdf"))

    def more(acc, k):
        p = acc["p"] * rate / k
        c = acc["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(acc["cdf"], F.array(c)).alias("cdf"))
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(TERMS - 1)), lambda k: k.cast("double")),
                       first, more, lambda acc: acc["cdf"])


def copies(draws: Column, cdf: Column, key: Column, seed: int) -> Column:
    """Sum of ``draws`` inverted draws for the row hashed by ``key``."""
    def one(i):
        u = unit(seed, key, i.cast("string"))
        return F.size(F.filter(cdf, lambda c: c <= u))
    return F.aggregate(F.transform(F.sequence(F.lit(1), draws), one), F.lit(0), lambda a, n: a + n)


def poisson_mix(docs: DataFrame, temperature: float = 0.5, weights: dict | None = None,
                epochs: float = 1.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source") -> DataFrame:
    """All columns of ``docs`` for each copy, with ``mix_rate, mix_copies,
    mix_copy`` (from 0) and ``mix_order`` (sorted within partitions).  Columns
    of ``docs`` of any name stay as they are; of the added ones those are left
    out whose names ``docs`` has."""
    spark = docs.sparkSession
    given = {c.lower() for c in docs.columns}
    added = {"mix_rate": "rate", "mix_copies": "copies", "mix_copy": "copy", "mix_order": "place"}
    kept = {name: c for name, c in added.items() if name not in given}
    per_source = rates(docs, temperature, weights, epochs, source_col, text_col)
    chars = per_source.agg(F.sum(F.col("size") * F.col("mix_rate"))).first()[0] or 0
    per_source = per_source.select("src", F.col("mix_rate").alias("rate"),
                                   F.greatest(F.lit(1), F.ceil(F.col("mix_rate") / STEP)).cast("int").alias("draws"))
    per_source = per_source.withColumn("cdf", _distribution(F.col("rate") / F.col("draws")))
    plain, names = by_position(docs)
    at = {c: F.col(name) for c, name in zip(docs.columns, names, strict=True)}
    key = F.coalesce(at[id_col].cast("string"), F.sha2(F.coalesce(at[text_col].cast("string"), F.lit("")), 256))
    rows = small_join(plain, per_source, at[source_col].cast("string").eqNullSafe(F.col("src")))
    n = F.when(F.col("rate") > 0, copies(F.col("draws"), F.col("cdf"), key, seed)).otherwise(0)
    out = (rows.withColumn("copies", n).filter("copies > 0")
           .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
           .withColumn("place", F.substring(F.md5(F.concat_ws(
               ":", F.lit(f"order{seed}"), key, F.col("copy").cast("string"))), 1, 16)))
    out = out.select(*names, *added.values())
    out = out.repartition(tasks(spark, int(chars), TASK_CHARS), "place").sortWithinPartitions("place")
    return out.select(*names, *kept.values()).toDF(*docs.columns, *kept)
