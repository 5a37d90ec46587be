"""One text at a time, for callers without a table: the same plan over a table of one row."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import SparkSession

from umbra.plans.sanitize import Sanitizer


class Match(NamedTuple):
    """One finding; code points, ``end`` exclusive. ``value`` is secret: keep it in memory."""

    start: int
    end: int
    kind: str
    label: str
    value: str
    confidence: float
    detector: str


class SanitizedText(NamedTuple):
    """A text without its secrets, and what was found."""

    text: str | None
    matches: tuple[Match, ...]

    @property
    def redaction_count(self) -> int:
        return len(self.matches)


def sanitize_text(spark: SparkSession, text: str | None, sanitizer: Sanitizer | None = None) -> SanitizedText:
    """``text`` sanitised; null stays null."""
    rows = spark.createDataFrame([(text,)], "text string")
    done = (sanitizer or Sanitizer()).sanitize(rows).first()
    return SanitizedText(done["sanitized"], tuple(Match(*(m[f] for f in Match._fields)) for m in done["matches"]))
