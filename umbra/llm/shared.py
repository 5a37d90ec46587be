"""Cutting lineage in the cluster's shared folder, and joins whose small side is measured before it is broadcast."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from umbra.functions.text import fresh

__all__ = ["cut", "fresh", "join_small", "shared_folder", "small_enough"]

#: Bounds of a join's small side, in rows and in bytes of its values, up to which it is broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 8 << 20
#: With this setting Spark deletes a query's shuffle files when the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, set as the context's checkpoint folder.

    Where neither is set, a session of this machine alone gets a temporary folder; on a cluster that is an error.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="umbra-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again from there; the shuffle files that it took are deleted."""
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan of its own, made under the setting
    finally:
        spark.conf.set(_CLEANUP, before)


def _bytes(kind: T.DataType, value: Column) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.octet_length(value).cast("long")
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StringType | T.BinaryType | T.ArrayType | T.StructType):
            return F.aggregate(value, F.lit(0).cast("long"), lambda total, x: total + F.coalesce(_bytes(kind.elementType, x), F.lit(0).cast("long")) + 16)
        return F.size(value).cast("long") * 8
    if isinstance(kind, T.StructType):
        return sum((F.coalesce(_bytes(f.dataType, value[f.name]), F.lit(0).cast("long")) for f in kind.fields), F.lit(0).cast("long"))
    return F.lit(8).cast("long")


def small_enough(small: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a table (cheap to read: it has been cut) is within both bounds."""
    each = sum((F.coalesce(_bytes(f.dataType, F.col(f"`{f.name}`")), F.lit(0).cast("long")) + 8 for f in small.schema.fields), F.lit(0).cast("long"))
    n, total = small.agg(F.count("*"), F.coalesce(F.sum(each), F.lit(0))).first()
    return n <= rows and total <= size


def join_small(large: DataFrame, small: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join with ``small``, which is broadcast only if it is :func:`small_enough`."""
    return large.join(F.broadcast(small) if small_enough(small) else small.hint("shuffle_hash") if how == "inner" else small, on, how)
