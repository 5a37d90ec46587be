"""What needs Python: rules in Python's regex dialect, model-proposed spans, and diffs. All run on Arrow batches."""

from __future__ import annotations

import difflib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from http.client import HTTPConnection, HTTPException, HTTPSConnection
from typing import Protocol
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from umbra.functions.text import SPAN, quoted, spans
from umbra.operators.detect import match


def regex_rule(text: Column, ord_: int, name: str, label: str, pattern: str, confidence: float = 0.9, group: int | str = 0) -> Column:
    """Matches of a rule in Python's dialect; a match in which ``group`` took no part is skipped.

    A confidence outside 0 to 1 or a pattern that does not compile is an error when the plan is built.
    """
    if not 0 <= confidence <= 1:
        raise ValueError("confidence must lie between 0 and 1")
    compiled = re.compile(pattern)

    @F.pandas_udf(SPAN)
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([[(m.start(group), m.end(group), m[group]) for m in compiled.finditer(t) if m[group] is not None] if t else [] for t in texts])

    return F.transform(find(text), lambda s: match(s["start"], s["end"], ord_, name, F.lit(label), s["value"], confidence))


class BackendUnavailable(RuntimeError):
    """A model backend cannot answer; its proposals are then left out."""


class Backend(Protocol):
    """Anything that completes a prompt. It is sent to the executors, so it must pickle."""

    def complete(self, prompt: str) -> str: ...


class HttpBackend:
    """A model behind ``/api/generate`` on this machine; each worker keeps one connection open."""

    def __init__(self, model: str = "qwen2.5:3b", host: str = "http://127.0.0.1:11434", timeout: float = 30.0):
        self.model, self.host, self.timeout, self._open = model, host, timeout, None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_open": None}

    def complete(self, prompt: str) -> str:
        """The model's reply, at temperature 0."""
        fixed = {"model": self.model, "stream": False, "options": {"temperature": 0}}
        for last in (False, True):  # a connection that the other side has closed is opened anew, once
            try:
                answer = self._post(json.dumps({**fixed, "prompt": prompt}))
                return str(answer["response"]) if "response" in answer else ""
            except (OSError, HTTPException, ValueError, TypeError, AttributeError) as why:
                self._open, stale = None, isinstance(why, HTTPException | ConnectionError)
                if last or not stale:
                    raise BackendUnavailable(f"{self.host}: {why}") from why
        raise AssertionError

    def _post(self, body: str) -> dict:
        place = urlsplit(self.host)
        if self._open is None:
            kind = HTTPSConnection if place.scheme == "https" else HTTPConnection
            self._open = kind(place.netloc, timeout=self.timeout)
        self._open.request("POST", place.path.rstrip("/") + "/api/generate", body.encode(), {"Content-Type": "application/json"})
        reply = self._open.getresponse()
        raw = reply.read()
        if reply.status >= 400:
            raise OSError(f"status {reply.status}")
        return json.loads(raw)


class LexiconBackend:
    """No model: proposes the terms of a list that the text holds, each with its type."""

    def __init__(self, terms: dict[str, str]):
        self.terms = terms

    def complete(self, prompt: str) -> str:
        return json.dumps([{"text": term, "type": kind} for term, kind in self.terms.items() if term in prompt])


PROMPT = (
    "List every sensitive part of the text below: keys, tokens, passwords, connection strings, personal data. "
    'Reply with a JSON array only; each element is {{"text": the part, letter for letter, "type": a short label}}. '
    "Reply [] if there is none.\n\n{text}\n"
)
OTHER_LABEL = "Sensitive Value"


def parse_reply(reply: str) -> list[dict]:
    """The objects of the JSON array from the reply's first ``[`` to its last ``]``; none if that is no array."""
    begin, last = reply.find("["), reply.rfind("]")
    try:
        items, end = json.JSONDecoder().raw_decode(reply, max(begin, 0))
    except ValueError:
        return []
    return [x for x in items if isinstance(x, dict)] if isinstance(items, list) and end == last + 1 else []


def named_parts(reply: str, min_length: int) -> list[dict[str, str]]:
    """The parts that a reply names, without blanks at either end, that are long enough; their labels."""
    parts = ((str(item.get("text", "")).strip(), str(item.get("type") or "").strip()) for item in parse_reply(reply))
    return [{"value": value, "label": label or OTHER_LABEL} for value, label in parts if len(value) >= min_length]


class Counted:
    """An ``on_error`` for executors: adds up on the driver how many texts a backend had no answer for."""

    def __init__(self, spark: SparkSession):
        self.total: Accumulator[int] = spark.sparkContext.accumulator(0)

    def __call__(self, why: Exception) -> None:
        self.total += 1


def propose(df: DataFrame, text: str, out: str, backend: Backend, min_length: int = 4, on_error: Callable[[Exception], None] | None = None) -> DataFrame:
    """``df`` with ``out``: what a model names in each text that is not blank, array of struct(value, label).

    Where the backend is unavailable there is nothing, and ``on_error`` is told. One copy of the
    backend serves a task, so its connection stays open from text to text.
    """
    names = df.columns
    kind = pa.list_(pa.struct([("value", pa.string()), ("label", pa.string())]))

    def ask(texts: list[str | None]) -> Iterator[list[dict[str, str]]]:
        for t in texts:
            try:
                yield named_parts(backend.complete(PROMPT.format(text=t)), min_length) if t and not t.isspace() else []
            except BackendUnavailable as why:
                if on_error:
                    on_error(why)
                yield []

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(list(ask(batch.column(names.index(text)).to_pylist())), kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*names, out])

    part = T.StructType([T.StructField("value", T.StringType()), T.StructField("label", T.StringType())])
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(part))]))


def placed(text: Column, proposed: Column, ord_: int, confidence: float = 0.7) -> Column:
    """Matches at all places, without overlap, of each proposed part that the text really holds."""

    def places(part: Column) -> Column:
        return F.transform(spans(text, quoted(part["value"])), lambda s: match(s["start"], s["end"], ord_, "llm_secret", part["label"], s["value"], confidence))

    return F.flatten(F.transform(F.filter(proposed, lambda part: F.contains(text, part["value"])), places))


def unified_diffs(df: DataFrame, key: str, before: str = "text", after: str = "sanitized", name: Column | None = None) -> DataFrame:
    """``key`` and ``diff``: unified, with three lines around, from the original to the sanitised text. Null texts count as empty."""
    rows = df.select(F.col(key).alias("key"), before, after, (F.col(key) if name is None else name).cast("string").alias("name"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [[(t or "").splitlines(keepends=True) for t in batch.column(i).to_pylist()] for i in (1, 2)]
            said = ["".join(difflib.unified_diff(a, b, f"{n} (original)", f"{n} (sanitized)")) for a, b, n in zip(*lines, batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string())], [key, "diff"])

    return rows.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, diff string")
