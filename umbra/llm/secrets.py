"""Secret scanning: credential patterns, and a guess-cost estimate of values in credential contexts.

Base patterns give spans of the kinds assign, access and hex. A dynamic programme estimates
how many guesses a value takes: the cheapest segmentation into words, dates, repeats,
keyboard walks and brute-force spans. Words and their ranks are a short list of passwords'
words, followed by those of a public tokeniser's rank file, if one is named. The value of every base assignment gets its cost; a
value in a wider credential context that costs ``min_log10_guesses`` or more and reaches past
the base spans is added whole as a span of the kind guess.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import sub_batches

KINDS = ("assign", "access", "hex", "guess")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: A value that takes fewer guesses is made of words or patterns rather than generated. Of the labelled values in
#: the tests, which the limit was measured on, those people choose cost 1.7 to 10.4 and generated ones 11.8 or more.
MIN_LOG10_GUESSES = 10.0

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{%d,}" % MIN_HEX)
_CONTEXT = re.compile(r"""(?<![A-Za-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|api[_-]?key|(?:access|private|auth|client|signing)[_-]?(?:key|token|secret)|bearer)["']?\x20*(?:[:=]|\bis\b)\x20*["']?([!#-&(-~]{8,})""", re.I | re.A)
#: The same contexts for a first look by RE2, which needs no captures.
_ANY = r"""(?i)(pass|pwd|secret|token|credential|api[_-]?key|_key|-key|bearer)[a-z_-]*["']?\x20*([:=]|is\b)|AKIA[A-Z0-9]|[0-9a-f]{24}"""

# Common words in passwords, most common first.
COMMON_WORDS = (
    "password admin welcome login master dragon monkey letmein shadow sunshine princess football baseball superman "
    "batman michael jordan hunter ranger secret summer winter spring autumn love hello test user root guest default "
    "changeme example access server database system public private token key pass qwerty azerty abc cheese orange "
    "banana coffee chocolate flower family forever freedom angel soccer hockey tiger purple silver golden diamond "
    "charlie thomas robert daniel george andrew joshua matthew jessica ashley jennifer computer internet company "
    "office service account backup temp demo staging production dev prod"
).split()
# Rows of keys, in order.
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "azertyuiop", "qwertzuiop", "abcdefghijklmnopqrstuvwxyz")
# Characters for letters in common words.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

_WALKS = {a + b for row in KEY_ROWS for r in (row, row[::-1]) for a, b in zip(r, r[1:], strict=False)}
_DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)?\d\d|(?:19|20)\d\d")


@lru_cache(maxsize=4)
def word_costs(path: str | None = None) -> dict[str, float]:
    """Log10 of each word's place: the list above, then the words of three letters or more in the rank file at ``path``, by rank."""
    words = dict.fromkeys(COMMON_WORDS)
    if path:
        with open(path, "rb") as lines:
            tokens = (base64.b64decode(x.split()[0]).decode(errors="replace") for x in lines if x.strip())
            words |= dict.fromkeys(w for t in tokens if len(w := t.removeprefix(" ").lower()) > 2 and w.isalpha())
    return {w: math.log10(i + 2) for i, w in enumerate(words)}


@lru_cache(maxsize=4)
def _longest(path: str | None) -> int:
    return max(map(len, word_costs(path)))


def _char_cost(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() else 33)


def log10_guesses(value: str, words_path: str | None = None) -> float:
    """Log10 of the guesses that the cheapest segmentation of ``value`` takes (0.0 for no characters).

    Costs: a word its place in the list, capitals and digits for letters double it; a
    date a day within two centuries; a repeat its unit times its count; a walk its start, its
    length and two directions; other characters the size of their class.
    """
    n = len(value)
    if not n:
        return 0.0
    lower = value.lower()
    if len(lower) != n:
        lower = value
    plain = "".join(LEET.get(c, c) for c in lower)
    brute = [_char_cost(c) for c in value]
    edges: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for m in re.finditer(r"(?=\d)", value):
        if d := _DATE.match(value, m.start()):
            edges[d.start()].append((d.end(), math.log10(365 * 200) if d.end() - d.start() > 4 else math.log10(200)))
    costs, longest = word_costs(words_path), _longest(words_path)
    for i in range(n):
        for j in range(i + 3, min(n, i + longest) + 1):
            for word in {lower[i:j], plain[i:j]}:
                if word in costs:
                    edges[i].append((j, costs[word] + (value[i:j] != word) * math.log10(2)))
    best = np.full(n + 1, math.inf)
    best[0] = 0.0
    walks, repeats = _walk_ends(lower), _repeats(value)
    sums = np.concatenate([[0.0], np.cumsum(brute)])
    for i in range(n):
        here = best[i]
        best[i + 1] = min(best[i + 1], here + brute[i])
        for j, cost in edges[i]:
            best[j] = min(best[j], here + cost)
        if (j := walks[i]) >= i + 3:
            ends = best[i + 3 : j + 1]
            np.minimum(ends, here + np.log10(47 * 2 * np.arange(3, j - i + 1)), out=ends)
        for unit, times in repeats.get(i, ()):
            least = max(2, -(-3 // unit))
            if times >= least:
                ends = best[i + least * unit : i + times * unit + 1 : unit]
                np.minimum(ends, here + sums[i + unit] - sums[i] + np.log10(np.arange(least, times + 1)), out=ends)
    return float(best[n])


def _walk_ends(lower: str) -> list[int]:
    """Where the longest walk from each character ends."""
    ends = list(range(1, len(lower) + 1))
    for i in range(len(lower) - 2, -1, -1):
        if lower[i] + lower[i + 1] in _WALKS:
            ends[i] = ends[i + 1]
    return ends


def _runs(codes: np.ndarray, unit: int) -> np.ndarray:
    """For each place, how many characters on are equal to the one ``unit`` later."""
    n = len(codes) - unit
    at = np.where(codes[:n] != codes[unit:], np.arange(n), n)
    return np.minimum.accumulate(at[::-1])[::-1] - np.arange(n)


def _repeats(value: str) -> dict[int, list[tuple[int, int]]]:
    """By place, the units that follow one another there, and how often at most; a unit that is itself a repeat costs more than its own unit and is left out."""
    codes, out = np.array([ord(c) for c in value], np.int32), {}
    for unit in range(1, len(value) // 2 + 1):
        runs = _runs(codes, unit)
        at = np.flatnonzero(runs >= unit)
        for part in range(1, unit // 2 + 1) if len(at) else ():
            if unit % part == 0 and len(at):
                at = at[_runs(codes, part)[at] < unit - part]
        for i in at.tolist():
            out.setdefault(i, []).append((unit, int(runs[i]) // unit + 1))
    return out


def find_spans(text: str, min_log10_guesses: float = MIN_LOG10_GUESSES, words_path: str | None = None) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, log10 guesses or None) by start, then kind; code points, end exclusive."""
    out: list[tuple[str, int, int, float | None]] = []
    for m in _ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= MIN_ASSIGN:
            out.append(("assign", m.start(), m.end(), log10_guesses(m[2], words_path)))
    out += [("access", m.start(), m.end(), None) for m in _ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [("hex", m.start(), m.end(), None) for m in _HEX.finditer(text)]
    taken = sorted((a, b) for _, a, b, _ in out)
    for m in _CONTEXT.finditer(text):
        value = m[1].rstrip("\"').,;")
        a, b = m.start(1), m.start(1) + len(value)
        held = a
        for x, y in taken:
            held = max(held, y) if x <= held else held
        if len(value) < 8 or held >= b:
            continue
        if (cost := log10_guesses(value, words_path)) >= min_log10_guesses:
            out.append(("guess", a, b, cost))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


@lru_cache(maxsize=1)
def _span_type() -> pa.DataType:
    return pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("log10_guesses", pa.float64())]))


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("log10_guesses", T.DoubleType())]))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_log10_guesses: float = MIN_LOG10_GUESSES, words_path: str | None = None) -> DataFrame:
    """``id_col`` and ``secrets``: array of struct(kind, start, end, log10_guesses) of every whole text.

    A null or empty text has no spans. Repeated rows give repeated rows; other columns are
    left out; an empty table gives an empty table.
    """
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("secrets", SPANS)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, found in _scan_batch(batch, 1, min_log10_guesses, words_path):
                yield pa.RecordBatch.from_arrays([rows.column(0), found], schema.names)

    return df.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def _scan_batch(batch: pa.RecordBatch, column: int, least: float, words_path: str | None) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    for rows, texts in sub_batches(batch, column):
        hit = pc.match_substring_regex(texts, _ANY).to_numpy(zero_copy_only=False)
        found: list = [[]] * len(texts)
        for i in np.flatnonzero(hit):
            found[i] = [dict(zip(("kind", "start", "end", "log10_guesses"), s, strict=True)) for s in find_spans(texts[int(i)].as_py(), least, words_path)]
        yield rows, pa.array(found, _span_type())


def mask(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", min_log10_guesses: float = MIN_LOG10_GUESSES, words_path: str | None = None) -> DataFrame:
    """``df`` with every span of ``text_col`` (overlapping ones as one) replaced by ``[kind]``, of the first of them.

    ``length_col``, if the table has it, is set to the new length where a text changed. Null texts stay null.
    """
    names, schema = df.columns, df.schema
    at = names.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, found in _scan_batch(batch, at, min_log10_guesses, words_path):
                columns = list(rows.columns)
                hit = np.flatnonzero(pc.list_value_length(found).to_numpy(zero_copy_only=False))
                if len(hit):
                    texts = columns[at].to_pylist()
                    sizes = columns[names.index(length_col)].to_pylist() if length_col in names else None
                    for i in hit:
                        texts[i] = replace_spans(texts[i], found[int(i)].as_py())
                        if sizes:
                            sizes[i] = len(texts[i])
                    columns[at] = pa.array(texts, columns[at].type)
                    if sizes:
                        columns[names.index(length_col)] = pa.array(sizes, columns[names.index(length_col)].type)
                yield pa.RecordBatch.from_arrays(columns, names)

    return df.mapInArrow(run, schema)


def replace_spans(text: str, spans: list[dict]) -> str:
    """``text`` with each run of overlapping spans replaced by the first one's kind in brackets."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], KINDS.index(s["kind"]))):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind']}]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def digest(spans: Column) -> list[Column]:
    """Columns n_assign, n_access, n_hex, base_sha256 and spans of an array as :func:`scan` makes it."""
    def said(array: Column) -> Column:
        return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter(spans, lambda s: s["kind"] != "guess")
    return [*(count(k) for k in KINDS[:3]), F.sha2(said(base), 256).alias("base_sha256"), said(spans).alias("spans")]
