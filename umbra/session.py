"""Lets Python workers import this package where it has not been installed on them."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch to a Python worker, unless the session has a limit of its own: rows may be long, and both sides hold a batch whole.
BATCH_BYTES, _LIMIT = 6 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> SparkSession:
    """Put the repository on the path of the session's Python workers, and bound what they are sent at a time.

    Enough for local sessions and for clusters that see the repository under the same path;
    elsewhere submit the package with ``--py-files``.
    """
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return bounded(spark)


def bounded(spark: SparkSession) -> SparkSession:
    """The session, its Arrow batches bounded in bytes."""
    if not any(key == _LIMIT for key in spark.conf.getAll):
        spark.conf.set(_LIMIT, str(BATCH_BYTES))
    return spark
