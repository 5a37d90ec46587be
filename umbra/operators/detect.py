"""Detection: a text column to an array of matches."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from umbra.functions.text import spans
from umbra.operators.specs import CHECKS, DetectorSpec, assignment_label

MATCH = "struct<start:int,end:int,ord:int,kind:string,label:string,value:string,confidence:double,detector:string>"
MATCHES = f"array<{MATCH}>"


def match(start: Column, end: Column, ord_: int, name: str, label: Column, value: Column, confidence: float) -> Column:
    """One match; it sorts by start, end, then the detector's place in the registry."""
    return F.struct(
        start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(ord_).alias("ord"), F.lit(name).alias("kind"), label.alias("label"),
        value.alias("value"), F.lit(float(confidence)).alias("confidence"), F.lit(name).alias("detector"),
    )


def detect_one(text: Column, spec: DetectorSpec, ord_: int) -> Column:
    """Matches of one detector; its gate keeps the regex away from most texts."""

    def secret(span: Column) -> Column:
        if not spec.secret:
            return F.struct(span["start"].alias("start"), span["end"].alias("end"), span["value"].alias("value"), span["value"].alias("whole"))
        value = F.regexp_extract(span["value"], spec.java, spec.secret)
        start = span["start"] + F.length(F.regexp_extract(span["value"], spec.java, spec.prefix))
        return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), span["value"].alias("whole"))

    def shaped(s: Column) -> Column:
        label = assignment_label(F.regexp_extract(s["whole"], spec.java, 2)) if spec.check == "assignment" else F.lit(spec.label)
        return match(s["start"], s["end"], ord_, spec.name, label, s["value"], spec.confidence)

    found = F.transform(spans(text, spec.java), secret)
    if spec.check:
        found = F.filter(found, lambda s: CHECKS[spec.check](s["value"]))
    found = F.transform(found, shaped).cast(MATCHES)
    gate = spec.may_match(text)
    return found if gate is None else F.when(gate, found).otherwise(F.array().cast(MATCHES))


def detect(text: Column, specs: Sequence[DetectorSpec], more: Iterable[Column] = ()) -> Column:
    """Matches of all detectors, not resolved; ``more`` are further arrays of matches. A null text has none."""
    arrays = [detect_one(text, s, i) for i, s in enumerate(specs)]
    arrays += [c.cast(MATCHES) for c in more]
    if not arrays:
        return F.array().cast(MATCHES)
    return F.when(text.isNull(), F.array().cast(MATCHES)).otherwise(F.concat(*arrays))


def allow(matches: Column, patterns: Sequence[str]) -> Column:
    """``matches`` without those whose value any of the (Java) patterns finds something in."""
    if not patterns:
        return matches

    def kept(m: Column) -> Column:
        hit = F.lit(False)
        for p in patterns:
            hit = hit | m["value"].rlike("(?U)" + p)
        return ~hit

    return F.filter(matches, kept)
