"""Reports over sanitised rows: summaries, previews, scan reports and audit records. No report has a raw value."""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions.text import fingerprint, line_number

PREVIEW_WIDTH, LABEL_WIDTH = 72, 28


def findings(df: DataFrame, *keys: str, matches: str = "matches") -> DataFrame:
    """A row for each match, without its value."""
    m = F.explode_outer(matches).alias("m")  # explode() would have Catalyst compute the matches once more to drop empty arrays early
    return df.select(*keys, m).filter("m IS NOT NULL").select(*keys, "m.start", "m.end", "m.kind", "m.label", "m.confidence", "m.detector")


def summary(df: DataFrame, *keys: str, matches: str = "matches") -> DataFrame:
    """Matches by label (and ``keys``), sorted."""
    return df.select(*keys, F.explode_outer(F.col(matches)["label"]).alias("label")).filter("label IS NOT NULL").groupBy(*keys, "label").agg(F.count("*").alias("n")).orderBy(*keys, "label")


def summary_text(counts: list[tuple[str, int]]) -> str:
    """A printed summary of (label, count) pairs."""
    if not counts:
        return "No sensitive data detected."
    total = sum(n for _, n in counts)
    return "\n".join([f"Redacted {total} item(s):", *(f"  - {label}: {n}" for label, n in sorted(counts))])


def scan_report(df: DataFrame, key: str, matches: str = "matches") -> DataFrame:
    """Rows with findings: their number, and their labels sorted and joined."""
    labels = F.array_join(F.array_sort(F.array_distinct(F.col(matches)["label"])), ", ")
    return df.filter(F.size(matches) > 0).select(key, F.size(matches).cast("long").alias("findings"), labels.alias("labels"))


def scan_totals(report: DataFrame) -> DataFrame:
    """The number of rows with findings, and of findings."""
    return report.agg(F.count("*").alias("rows_with_findings"), F.coalesce(F.sum("findings"), F.lit(0)).cast("long").alias("findings"))


def preview(df: DataFrame, key: str, text: str = "text", matches: str = "matches", width: int = PREVIEW_WIDTH) -> DataFrame:
    """A row for each match: its line's number, and the line with the match masked, cut to ``width`` around it."""
    t, longest = F.col(text), F.array_max(F.transform(F.col(matches)["label"], F.length))
    rows = df.filter(F.size(matches) > 0).select(key, t.alias("t"), F.least(longest, F.lit(LABEL_WIDTH)).alias("w"), F.posexplode(matches).alias("position", "m"))
    before = F.substr("t", F.lit(1), F.col("m.start"))
    start = F.length(before) - F.length(F.substring_index(before, "\n", -1))
    newline = F.locate("\n", F.substr(F.col("t"), F.col("m.end") + 1, F.length("t")))
    end = F.when(newline > 0, F.col("m.end") + newline - 1).otherwise(F.length("t"))
    lines = rows.select(key, "position", "w", "m.label", line_number(F.col("t"), F.col("m.start")).alias("line"), (F.col("m.start") - start).alias("at"),
                        F.concat(F.substr("t", start + 1, F.col("m.start") - start), F.lit("["), F.col("m.label"), F.lit("]"), F.substr(F.col("t"), F.col("m.end") + 1, end - F.col("m.end"))).alias("masked"))
    n = F.length("masked")
    upto = F.least(n, F.greatest(F.lit(0), F.col("at") - width // 2) + width)
    first = F.greatest(F.lit(0), upto - width)
    dots = lambda some: F.when(some, F.lit("…")).otherwise(F.lit(""))
    window = F.when(n <= width, F.col("masked")).otherwise(F.concat(dots(first > 0), F.substr(F.col("masked"), first + 1, upto - first), dots(upto < n)))
    padded = F.when(F.length("label") >= F.col("w"), F.col("label")).otherwise(F.rpad("label", F.col("w"), F.lit(" ")))
    number = F.col("line").cast("string")
    number = F.when(F.length(number) >= 4, number).otherwise(F.rpad(number, F.lit(4), F.lit(" ")))
    return lines.select(key, "position", F.col("line").cast("long").alias("line"), "label", F.concat(F.lit("  Ln "), number, F.lit(" "), padded, F.lit("  "), window).alias("shown"))


def audit_records(matches: Column, salt: Column) -> Column:
    """What was found where, with salted fingerprints in place of values."""
    return F.transform(
        matches,
        lambda m: F.struct(m["kind"].alias("kind"), m["label"].alias("label"), m["detector"].alias("detector"), m["start"].alias("start"), m["end"].alias("end"), (m["end"] - m["start"]).alias("length"), fingerprint(m["value"], salt).alias("fingerprint")),
    )


def audit(df: DataFrame, key: str, matches: str = "matches", salt: str | None = None) -> DataFrame:
    """``key`` and ``audit``, a JSON document; one salt, drawn on the driver, for the whole run unless given."""
    word = F.lit(salt or secrets.token_hex(16))
    body = F.struct(F.lit(1).alias("version"), word.alias("salt"), F.size(matches).alias("redaction_count"), audit_records(F.col(matches), word).alias("records"))
    return df.select(key, F.to_json(body, {"pretty": "true"}).alias("audit"))
