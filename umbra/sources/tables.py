"""Parquet tables as rows, dealt out to all cores where they are small."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if it has fewer; a table with more is left as it is.

    A file of one row group is one task's work however Spark splits it. Only a table too small
    to occupy the cluster is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The table ``name`` in ``folder``, with only ``columns`` if any are named."""
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(rows.select(*columns) if columns else rows)
