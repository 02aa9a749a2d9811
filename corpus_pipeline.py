"""Corpus pipeline: five operators of ``railyard.llm`` over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its
predecessor kept; all but the last return the columns of ``documents``.  Rows
of a stage are written as Parquet and read again as the next one's ``docs``.

Nulls, empty and very long texts, ties, repeated rows, empty tables and extra
columns have the results that the operators' docstrings define.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railyard.llm import exact_dedup, mixing, packing, quality, simhash_dedup
from railyard.llm.common import documents, free_name, numbered, quoted, stable, written
from railyard.llm.queries import ADDED, CAPACITY, END_ID, MAX_BITS, MIX, SHINGLE, VOCABULARY
from railyard.llm.tokens import added_tokens

_TAG = "__pipeline_tag"


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose tag is not among ``dropped``."""
    tag, columns = free_name(_TAG, docs.columns), [quoted(c) for c in docs.columns]
    rows = numbered(docs, tag, *columns)
    return rows.join(dropped.select(F.col("tag").alias(tag)), tag, "left_anti").select(*columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents scored under one half go."""
    docs = stable(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = quality.classify(docs, labels)
    return _without(docs, written(found.filter("score < 0.5").select("tag"), "rejected"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of equal texts the row with the largest id stays."""
    docs = stable(docs)
    found = exact_dedup.exact_dedup(docs, exact_dedup.older_half(docs))
    return _without(docs, written(found.filter("NOT kept").select("tag"), "copies"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of each component the row with the smallest id stays."""
    docs = stable(docs)
    found = simhash_dedup.near_dedup(docs, SHINGLE, MAX_BITS)
    return _without(docs, written(found.filter("NOT kept").select("tag"), "near-copies"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: each document as often as its source's rate draws it."""
    mixed = mixing.poisson_mix(docs, **MIX)
    return mixed.select(*[quoted(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: pieces of all documents with their place in a sequence."""
    return packing.best_fit_packing(docs, VOCABULARY, public_tokenizers.PATTERN, END_ID, CAPACITY,
                                    added=added_tokens(ADDED)).drop("tag")


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# The classifier is trained and packing searches: SQL can't say the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
