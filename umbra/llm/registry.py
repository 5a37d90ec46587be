"""The queries of this subpackage, with the parameters that they run with in production, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.sources.tables import read_table

from . import ann, bpe, likelihood, ngrams, packing, pieces, quality, secrets, surrogates, urls

#: (verdict, host/path)
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
TOKEN_LIMIT, SEQUENCE, QUERY_STEP = 4096, 2048, 100
#: A deployment passes its own key to ``surrogates.replace``.
SURROGATE_KEY = "umbra"


#: Word ranks for guess costs: a public vocabulary of many languages.
WORDS = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.cluster(_table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = bpe.encode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, with_decoded=True)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.filter(F.col("vec_id") % QUERY_STEP == 0), k=10)


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = surrogates.replace(_table(spark, sf_dir, "documents"), SURROGATE_KEY)
    return done.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["kind"], e["start"].cast("string"), e["end"].cast("string"))), ",").alias("spans"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"), words_path=public_tokenizers.path(WORDS))
    return found.select("doc_id", *secrets.digest(F.col("secrets")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents")).drop("lost_lines")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), TOKEN_LIMIT)


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op9_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return likelihood.score(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenized = packing.tokenize(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, SEQUENCE)
    return packing.pack(tokenized, SEQUENCE)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard, op2_byte_bpe, op3_nearest, op4_surrogates, op5_secrets, op6_quality, op7_token_counts, op8_url_rules, op9_pseudo_likelihood, op10_packing)}


def oracle_sql() -> dict[str, str]:
    return {}
