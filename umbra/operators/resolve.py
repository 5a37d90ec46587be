"""Overlap resolution: overlapping matches become one over their union.

The merged match keeps everything else, its value too, of the one of highest confidence;
then the longest, then the first by start, end and registry order. Matches that only touch
stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.operators.detect import MATCH, MATCHES


def resolve(matches: Column) -> Column:
    """Row by row: one sort and one fold, no shuffle."""
    none = F.lit(None)
    start = F.struct(F.array().cast(MATCHES).alias("done"), none.cast("int").alias("lo"), none.cast("int").alias("hi"), none.cast(MATCH).alias("rep"))

    def merged(acc: Column) -> Column:
        rep = acc["rep"]
        return F.struct(
            acc["lo"].alias("start"), acc["hi"].alias("end"), rep["ord"].alias("ord"), rep["kind"].alias("kind"), rep["label"].alias("label"),
            rep["value"].alias("value"), rep["confidence"].alias("confidence"), rep["detector"].alias("detector"),
        ).cast(MATCH)

    def closed(acc: Column) -> Column:
        return F.when(acc["rep"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(merged(acc))))

    def step(acc: Column, m: Column) -> Column:
        rep = acc["rep"]
        better = (m["confidence"] > rep["confidence"]) | ((m["confidence"] == rep["confidence"]) & (m["end"] - m["start"] > rep["end"] - rep["start"]))
        joined = F.struct(acc["done"].alias("done"), acc["lo"].alias("lo"), F.greatest(acc["hi"], m["end"]).alias("hi"), F.when(better, m).otherwise(rep).alias("rep"))
        opened = F.struct(closed(acc).alias("done"), m["start"].alias("lo"), m["end"].alias("hi"), m.alias("rep"))
        return F.when(m["start"] < acc["hi"], joined).otherwise(opened)

    return F.aggregate(F.array_sort(matches), start, step, closed)


def resolve_relational(exploded: DataFrame, key: str) -> DataFrame:
    """The same over rows (``key``, ``m``): islands by a running maximum, then an aggregate."""
    order = Window.partitionBy(key).orderBy("m.start", "m.end", "m.ord", "m.value")
    before = F.max("m.end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = exploded.withColumn("opens", F.when(before.isNull() | (F.col("m.start") >= before), 1).otherwise(0))
    islands = flagged.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.struct(F.col("m.confidence"), (F.col("m.end") - F.col("m.start")), -F.col("m.start"), -F.col("m.end"), -F.col("m.ord"))
    grouped = islands.groupBy(key, "island").agg(F.min("m.start").alias("start"), F.max("m.end").alias("end"), F.max_by(F.col("m"), best).alias("m"))
    return grouped.select(key, "start", "end", "m.kind", "m.label", "m.value", "m.confidence", "m.detector")
