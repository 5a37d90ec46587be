"""Redaction: resolved matches replaced by placeholders with stable numbers."""

from __future__ import annotations

import string

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the default placeholder.
TEMPLATE = "[REDACTED: {label}{suffix}]"


def placeholder(template: str, label: Column, suffix: Column) -> Column:
    """``template`` with its fields filled; other fields than label and suffix are a KeyError."""
    parts, plain = [], True
    for literal, field, spec, conversion in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is None:
            continue
        if field not in ("label", "suffix"):
            raise KeyError(field)
        plain = plain and not spec and not conversion
        parts.append(label if field == "label" else suffix)
    if plain:
        return F.concat(F.lit(""), *parts)
    raise ValueError("format specifications need formatted_splice()")


def has_format_spec(template: str) -> bool:
    """Whether a field of ``template`` has a format specification or conversion."""
    return any(field is not None and (spec or conversion) for _, field, spec, conversion in string.Formatter().parse(template))


def formatted_splice(template: str, numbering: bool = True):
    """Arrow function for templates with format specifications: text, starts, ends, labels and values to the redacted text."""
    template.format(label="", suffix="")

    def one(text: str | None, starts: list[int], ends: list[int], labels: list[str], values: list[str]) -> str | None:
        if text is None:
            return None
        seen: dict[str, dict[str, int]] = {}
        for label, value in zip(labels, values, strict=True):
            seen.setdefault(label, {}).setdefault(value, len(seen[label]) + 1)
        parts, at = [], 0
        for start, end, label, value in zip(starts, ends, labels, values, strict=True):
            suffix = f" #{seen[label][value]}" if numbering and len(seen[label]) > 1 else ""
            parts += [text[at:start], template.format(label=label, suffix=suffix)]
            at = end
        return "".join([*parts, text[at:]])

    @F.pandas_udf(T.StringType())
    def fill(texts: pd.Series, starts: pd.Series, ends: pd.Series, labels: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([one(*row) for row in zip(texts, starts, ends, labels, values, strict=True)], dtype=object)

    return fill


def numbered(matches: Column) -> Column:
    """The different (label, value) pairs in order of first appearance."""
    return F.array_distinct(F.transform(matches, lambda m: F.struct(m["label"].alias("label"), m["value"].alias("value"))))


def suffixes(matches: Column, pairs: Column, numbering: bool = True) -> Column:
    """`` #n`` for each match: its value's place among the values of its label, if the label has several.

    ``pairs``: a column of :func:`numbered`, so that it is not computed anew for each match.
    """
    if not numbering:
        return F.transform(matches, lambda m: F.lit(""))

    def suffix(m: Column) -> Column:
        same = F.filter(pairs, lambda p: p["label"] == m["label"])
        own = F.struct(m["label"].alias("label"), m["value"].alias("value"))
        return F.when(F.size(same) > 1, F.concat(F.lit(" #"), F.array_position(same, own).cast("string"))).otherwise(F.lit(""))

    return F.transform(matches, suffix)


def splice(text: Column, matches: Column, placeholders: Column) -> Column:
    """``text`` with each match (sorted, not overlapping) replaced by the placeholder of the same place."""

    def piece(x: Column, i: Column) -> Column:
        before = F.coalesce(F.get(matches, i - 1)["end"], F.lit(0))
        return F.concat(F.substr(text, before + 1, x["m"]["start"] - before), x["p"])

    pairs = F.arrays_zip(matches.alias("m"), placeholders.alias("p"))  # an argument: within the function it could be computed for each match
    tail = F.expr("int(2147483647)")
    end = F.get(matches, F.size(matches) - 1)["end"]
    return F.when(F.size(matches) == 0, text).otherwise(F.concat(F.array_join(F.transform(pairs, piece), ""), F.substr(text, end + 1, tail)))
