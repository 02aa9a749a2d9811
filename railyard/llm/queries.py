"""One query per operator over the whole ``documents`` table, and oracle SQL
where SQL can say what the operator returns."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (exact_dedup, fingerprint, language_id, lexical_search, license_scan, mixing, packing, quality,
               simhash_dedup, spelling, suffix_dedup, token_counts, window_packing)
from .common import documents
from .tokens import added_tokens

VOCABULARY = os.environ.get("LLM_VOCABULARY") or public_tokenizers.path("byte_bpe_50k.tiktoken")
ADDED = os.environ.get("LLM_ADDED_TOKENS") or public_tokenizers.path("byte_bpe_50k.json")
END_OF_TEXT = 50_256      # free id of that vocabulary

# Production parameters, also the pipeline's.
MIX = {"temperature": 0.5, "epochs": 1.0, "seed": 7}
SHINGLE, MAX_BITS = 4, 4
END_ID, CAPACITY = 2, 1024
WINDOW_END_ID, WINDOW = 1, 2048
TOP = 20


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = exact_dedup.exact_dedup(docs, exact_dedup.older_half(docs))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    model = language_id.train(docs.filter(~held_out))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    return language_id.identify(docs, model, held)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), VOCABULARY, public_tokenizers.PATTERN, END_OF_TEXT)


def op4_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(documents(spark, sf_dir), **MIX)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = quality.classify(documents(spark, sf_dir), labels)
    return got.select("doc_id", "score", "text_score", "page_score", (F.col("score") >= 0.5).alias("kept"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(documents(spark, sf_dir)).drop("tag")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(documents(spark, sf_dir), VOCABULARY, public_tokenizers.PATTERN,
                                    END_ID, CAPACITY, added=added_tokens(ADDED)).drop("tag")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(documents(spark, sf_dir), 200).drop("tag")


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_dedup(documents(spark, sf_dir), SHINGLE, MAX_BITS)
    return found.select("doc_id", "fingerprint", "component_id")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(documents(spark, sf_dir))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir))


def op12_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = window_packing.pack_windows(documents(spark, sf_dir), VOCABULARY, public_tokenizers.PATTERN,
                                         WINDOW_END_ID, WINDOW, added_tokens(ADDED))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.build_index(documents(spark, sf_dir))
    return lexical_search.search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), TOP)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_exact_dedup, op2_language_id, op3_token_counts, op4_poisson_mix, op5_quality,
                            op6_license_scan, op7_packing, op8_suffix_dedup, op9_simhash_dedup,
                            op10_fingerprints, op11_spelling_variants, op12_window_packing,
                            op13_lexical_search)}

_TERMS = (r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
_UNIT = "('0x' || substr(md5({}), 1, 13))::BIGINT / 4503599627370496.0"

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op4_poisson_mix": f"""
WITH sizes AS (
  SELECT source AS src, sum(length(coalesce(text, '')))::DOUBLE AS size FROM documents GROUP BY source),
rates AS (
  SELECT src, CASE WHEN size > 0 THEN round(sqrt(size) / (SELECT sum(sqrt(size)) FROM sizes)
                 * (SELECT sum(size) FROM sizes) / size, 9) ELSE 1.0 END AS rate FROM sizes),
steps AS (SELECT src, rate, greatest(1, ceil(rate / 30.0))::INT AS draws FROM rates),
terms AS (
  SELECT src, k.k AS k, exp(-(rate / draws) + k.k * ln(rate / draws) - lgamma(k.k + 1)) AS p
  FROM steps CROSS JOIN (SELECT unnest(range(0, 128)) AS k) k WHERE rate > 0),
cdf AS (SELECT src, k, sum(p) OVER (PARTITION BY src ORDER BY k) AS c FROM terms),
draws AS (
  SELECT d.doc_id, d.source, s.rate,
         {_UNIT.format("concat_ws(':', '7', coalesce(d.doc_id::VARCHAR, sha256(coalesce(d.text, ''))), i.i::VARCHAR)")} AS u
  FROM documents d JOIN steps s ON d.source IS NOT DISTINCT FROM s.src, unnest(range(1, s.draws + 1)) i(i)),
counted AS (
  SELECT doc_id, sum(coalesce(n, 0))::INT AS n, any_value(rate) AS rate FROM (
    SELECT doc_id, rate, (SELECT count(*) FROM cdf WHERE cdf.src IS NOT DISTINCT FROM draws.source
                          AND cdf.c <= draws.u) AS n FROM draws) GROUP BY doc_id)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, c.rate AS mix_rate, c.n AS mix_copies,
       j.j::INT AS mix_copy,
       substr(md5(concat_ws(':', 'order7', coalesce(d.doc_id::VARCHAR, sha256(coalesce(d.text, ''))),
                            j.j::VARCHAR)), 1, 16) AS mix_order
FROM documents d JOIN counted c USING (doc_id), unnest(range(0, c.n)) j(j)""",
    "op13_lexical_search": f"""
WITH d AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
post AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM post GROUP BY doc_id),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sizes),
norm AS (SELECT doc_id, 75 + (25 * n * docs) // terms AS m FROM sizes, whole),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
            FROM post, whole GROUP BY term),
asked AS (SELECT item_id, term, count(*) AS times
          FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
           FROM asked JOIN weights USING (term) JOIN post USING (term) JOIN norm USING (doc_id) GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank,
                  doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20""",
}
