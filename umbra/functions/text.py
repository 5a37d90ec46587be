"""Column functions over text: regex spans, entropy, checksums, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string>>"


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one, that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """``df`` with the column ``name``, computed once for each row whatever later filters and columns ask for it.

    Catalyst moves filters below a projection and copies the projection's expressions into
    them; it moves none below a generator.
    """
    generated = F.explode(F.array(column)).alias(name)
    kept = [generated if c == name else F.col(f"`{c}`") for c in df.columns]
    return df.select(*kept) if name in df.columns else df.select(*kept, generated)


def quoted(text: Column) -> Column:
    """A Java regex that matches ``text`` letter for letter."""
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def spans(text: Column, pattern: str | Column) -> Column:
    """All matches of a Java regex in ``text`` as array of struct(start, end, value).

    Offsets count code points, ``end`` is exclusive. The pattern must not match the empty
    string. ``split`` gives what lies between the matches and ``regexp_extract_all`` the
    matches; one fold over both adds up the lengths.
    """
    rx = F.lit(pattern) if isinstance(pattern, str) else pattern
    pairs = F.arrays_zip(F.split(text, rx, -1).alias("gap"), F.regexp_extract_all(text, rx, F.lit(0)).alias("hit"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("value"))
        return F.when(pair["hit"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["found"], F.array(span)).alias("found")))

    return F.aggregate(pairs, empty, step, lambda acc: acc["found"])


def entropy(value: Column) -> Column:
    """Shannon entropy of the characters of ``value`` in bits; 0 for the empty string."""
    n = F.length(value)

    def part(acc: Column, char: Column) -> Column:
        p = (n - F.length(F.replace(value, char, F.lit("")))) / n
        return acc - p * F.log2(p)

    chars = F.array_distinct(F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0)))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(chars, F.lit(0.0), part))


def luhn(value: Column) -> Column:
    """Whether ``value`` without blanks and hyphens has 13 to 19 digits that pass the Luhn check."""
    digits = F.regexp_replace(value, "[ -]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def fingerprint(value: Column, salt: Column) -> Column:
    """The first 12 hex digits of SHA-256 over the salt and the value."""
    return F.substring(F.sha2(F.concat(salt, value), 256), 1, 12)


def line_number(text: Column, offset: Column) -> Column:
    """The 1-based line that holds the character at ``offset``."""
    before = F.substr(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def newlines(text: Column) -> Column:
    """``text`` with CRLF and CR as LF."""
    return F.regexp_replace(text, "\r\n?", "\n")
