"""A corpus pipeline: quality rules, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. :func:`run` applies them to ``documents``, each result written as
Parquet in the shared folder and read again; what a stage has read is then deleted.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from umbra.llm import ngrams, packing, quality, secrets
from umbra.llm.registry import SEQUENCE, WORDS
from umbra.llm.shared import shared_folder
from umbra.session import bounded
from umbra.sources.tables import read_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _bounded(stage: Stage) -> Stage:
    """The stage in a session whose Arrow batches are bounded in bytes."""
    return wraps(stage)(lambda spark, docs, sf_dir: stage(bounded(spark), docs, sf_dir))


@_bounded
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their boilerplate lines."""
    return quality.clean(docs)


@_bounded
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of least id, of each group of near duplicates."""
    return ngrams.keep_one(docs)


@_bounded
def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets masked."""
    return secrets.mask(docs, words_path=public_tokenizers.path(WORDS))


@_bounded
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    tokenized = packing.tokenize(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, SEQUENCE)
    return packing.pack(tokenized, SEQUENCE)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("secret_scans", secret_scans), ("best_fit_packing", best_fit_packing)]

#: Tokenisers, guess costs and a genetic algorithm are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the ``documents`` in ``sf_dir``."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _delete(spark, before)
        before = path
    return docs


def _delete(spark: SparkSession, path: str) -> None:
    """Remove a folder from whatever store it is in."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
