"""The sanitising plan over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from umbra.plans.sanitize import Sanitizer


def sanitize_stream(stream: DataFrame, sanitizer: Sanitizer, text: str = "text") -> DataFrame:
    """A stateless map, so the batch plan as it is; raw matches and the raw text stay out of the sink."""
    return sanitizer.sanitize(stream, text).drop("matches", text)


def findings_by_window(stream: DataFrame, sanitizer: Sanitizer, time: str, text: str = "text", window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Findings by label and window of event time; windows close once the watermark has passed."""
    found = sanitizer.scan(stream.withWatermark(time, late), text)
    labels = found.select(time, F.explode(F.col("matches")["label"]).alias("label"))
    counts = labels.groupBy(F.window(time, window), "label").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "label", "n")


def write_stream(stream: DataFrame, sanitizer: Sanitizer, path: str, checkpoint: str, text: str = "text") -> StreamingQuery:
    """Sanitised rows to Parquet, exactly once, for what is there now."""
    return sanitize_stream(stream, sanitizer, text).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
