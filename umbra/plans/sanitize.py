"""The sanitising plan: detect, allow, resolve, redact."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.config import Config
from umbra.functions.text import fresh, once
from umbra.operators.detect import allow, detect
from umbra.operators.python_rules import Backend, HttpBackend, placed, propose, regex_rule
from umbra.operators.redact import TEMPLATE, formatted_splice, has_format_spec, numbered, placeholder, splice, suffixes
from umbra.operators.resolve import resolve
from umbra.operators.specs import DetectorSpec, active_specs

#: A further detector: takes the text column and its place in the registry, gives an array of matches.
Detector = Callable[[Column, int], Column]


class Sanitizer:
    """Builds the plan for a configuration. Each method adds columns and keeps the others; nothing shuffles."""

    def __init__(
        self, specs: Sequence[DetectorSpec] | None = None, detectors: Sequence[Detector] = (), allowlist: Sequence[str] = (), template: str = TEMPLATE,
        numbering: bool = True, backend: Backend | None = None, on_error: Callable[[Exception], None] | None = None,
    ):
        self.specs = list(active_specs() if specs is None else specs)
        self.detectors, self.allowlist, self.template, self.numbering = list(detectors), list(allowlist), template, numbering
        self.backend, self.on_error = backend, on_error

    @classmethod
    def from_config(cls, config: Config, backend: Backend | None = None, on_error: Callable[[Exception], None] | None = None) -> Sanitizer:
        """Custom rules are always on; a model proposes spans if configured or if a backend is given.

        ``on_error`` is called on the executors for each text that the backend had no answer for
        (``python_rules.Counted`` adds them up on the driver).
        """
        specs = active_specs(config.enabled_detectors, config.disabled_detectors, config.redact_pii)
        rules: list[Detector] = [lambda t, n, r=r: regex_rule(t, n, r.name, r.label, r.pattern, r.confidence, r.group) for r in config.custom_rules]
        if backend is None and config.llm.enabled:
            backend = HttpBackend(config.llm.model, config.llm.host, config.llm.timeout)
        return cls(specs, rules, config.allowlist_patterns, config.placeholder_template, config.stable_numbering, backend, on_error)

    def detect(self, df: DataFrame, text: str = "text", out: str = "matches") -> DataFrame:
        """All matches that the allowlist leaves, overlapping ones too."""
        t, found, inner = F.col(text), df, []
        for i, rule in enumerate(self.detectors):  # Python runs before, on the whole batch, not within the fold
            inner.append(fresh(found, "__rule"))
            found = found.withColumn(inner[-1], rule(t, len(self.specs) + i))
        more = [F.col(c) for c in inner]
        if self.backend is not None:
            inner.append(fresh(found, "__proposed"))
            found = propose(found, text, inner[-1], self.backend, on_error=self.on_error)
            more.append(placed(t, F.col(inner[-1]), len(self.specs) + len(self.detectors)))
        return once(found, out, allow(detect(t, self.specs, more), self.allowlist)).drop(*inner)

    def scan(self, df: DataFrame, text: str = "text", out: str = "matches") -> DataFrame:
        """Resolved matches: sorted, not overlapping."""
        found = self.detect(df, text, out)
        return once(found, out, resolve(F.col(out)))

    def sanitize(self, df: DataFrame, text: str = "text", out: str = "sanitized") -> DataFrame:
        """Resolved ``matches``, ``redaction_count`` and the sanitised text; a null text stays null."""
        found = self.scan(df, text).withColumn("redaction_count", F.size("matches"))
        m = F.col("matches")
        if has_format_spec(self.template):
            return found.withColumn(out, formatted_splice(self.template, self.numbering)(F.col(text), m["start"], m["end"], m["label"], m["value"]))
        pairs, filled = fresh(found, "__pairs"), fresh(found, "__filled")
        found = found.withColumn(pairs, numbered(m))
        marks = suffixes(m, F.col(pairs), self.numbering)
        found = found.withColumn(filled, F.zip_with(m, marks, lambda x, s: placeholder(self.template, x["label"], s)))
        return found.withColumn(out, splice(F.col(text), m, F.col(filled))).drop(pairs, filled)
