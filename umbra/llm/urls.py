"""URL filters: fixed host and path rules, and association rules mined from what those label.

The fixed rules label the urls that they fit. Spark's FP-growth finds the combinations of url
tokens that come with a label often enough (``min_support``); those that almost always do
(``min_confidence``) are rules, of which the most general stay. An inverted index from a rule's
rarest part to the rule matches them against the urls that no fixed rule fits; the rule of
most confidence (then support, then tokens in order) decides, and ``allow`` is the verdict
where none fits.

Urls are not cut. Tokens that the same labelled urls hold are one item to FP-growth, so that
the several names of a host or segment do not multiply the combinations; in a rule any of them
will do. What is mined is bounded by the support, however many urls there are.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from math import ceil

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut

MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.9
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Mark of the items that are verdicts; tokens start with their kind.
VERDICT = "="

Rule = tuple[str, str]  # verdict, host/path
#: Classes of tokens (one of each must be there), verdict, confidence, support.
Mined = tuple[frozenset[frozenset[str]], str, float, float]


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty where it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits (of equally long ones the first), and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: len(r[1])):  # the last when() put around is the first tried
        of, _, start = rule.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith("/" + start)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Different tokens: scheme, host, its last two labels, last, first and all labels, first, second and all path segments, extension, whether there is a query, its names, and the words in labels and segments."""
    labels, segments = F.split(host, r"\."), F.filter(F.split(path, "/"), lambda s: s != "")
    n = F.size(labels)

    def word(kind: str, value: Column, when: Column) -> Column:
        return F.when(when & (value != ""), F.concat(F.lit(kind + ":"), value))

    def named(s: Column) -> Column:
        return F.when(s.rlike(r"^\d+(\.\w+)?$"), F.lit("<number>")).otherwise(s)

    def segment(k: int) -> Column:
        return named(F.get(segments, F.lit(k)))

    def each(kind: str, values: Column) -> Column:
        return F.transform(F.filter(values, lambda v: v != ""), lambda v: F.concat(F.lit(kind + ":"), v))

    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    names = F.transform(F.split(query, "[&;]"), lambda q: F.substring_index(q, "=", 1))
    words = F.filter(F.split(F.concat_ws("/", host, path), r"[^\p{L}\p{N}]+"), lambda w: ~w.rlike(r"^\d+$"))

    found = [
        word("scheme", F.substring_index(url, "://", 1), F.instr(url, "://") > 0),
        word("host", host, host != ""),
        word("domain", F.concat_ws(".", F.get(labels, n - 2), F.get(labels, n - 1)), n >= 2),
        word("top", F.get(labels, n - 1), n >= 1),
        word("sub", F.get(labels, F.lit(0)), n >= 3),
        word("first", segment(0), F.size(segments) >= 1),
        word("second", segment(1), F.size(segments) >= 2),
        word("extension", F.lower(F.regexp_extract(path, r"[^/]\.(\w+)$", 1)), path != ""),
        word("query", F.lit("yes"), F.instr(url, "?") > 0),
    ]
    all_ = F.concat(F.array(*found), each("label", labels), each("segment", F.transform(segments, named)), each("name", names), each("word", words))
    return F.coalesce(F.filter(F.array_distinct(all_), lambda t: t.isNotNull()), F.array().cast("array<string>"))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> list[Mined]:
    """Rules of ``labelled`` (tokens, verdict); no rule has another of its verdict and no less confidence within it.

    A rule is a set of classes of tokens that the same urls hold; it fits where one token of each class is.
    """
    baskets = cut(labelled.select(F.monotonically_increasing_id().alias("row"), F.array_distinct("tokens").alias("tokens"), "verdict"))
    total = baskets.count()
    if not total:
        return []
    each = baskets.select("row", F.explode("tokens").alias("t")).groupBy("t")
    held = each.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(row))").alias("x"), F.expr("bit_xor(xxhash64(row, 1))").alias("y")).filter(F.col("n") >= ceil(min_support * total))
    classes = {min(r["ts"]): frozenset(r["ts"]) for r in held.groupBy("n", "x", "y").agg(F.collect_list("t").alias("ts")).collect()}  # at most tokens of a url / support
    if not classes:
        return []
    items = F.concat(F.array_intersect("tokens", F.array(*map(F.lit, classes))), F.array(F.concat(F.lit(VERDICT), F.col("verdict"))))
    grown = FPGrowth(itemsCol="items", minSupport=min_support).fit(baskets.select(items.alias("items")))
    said = lambda x: F.startswith(x, F.lit(VERDICT))
    sets = cut(grown.freqItemsets.select(F.array_sort(F.filter("items", lambda x: ~said(x))).alias("set"), F.get(F.filter("items", said), 0).alias("verdict"), "freq"))
    some = sets.filter(F.col("verdict").isNotNull() & (F.size("set") > 0))
    whole = sets.filter(F.col("verdict").isNull()).select("set", F.col("freq").alias("all"))
    rules = some.join(whole, "set").filter(F.col("freq") >= min_confidence * F.col("all"))
    kept: list[Mined] = []
    found = [(frozenset(r["set"]), r["verdict"].removeprefix(VERDICT), r["freq"] / r["all"], r["freq"] / total) for r in rules.collect()]
    general: dict[str, list[tuple[frozenset[str], float]]] = defaultdict(list)
    for names, verdict, confidence, support in sorted(found, key=lambda r: (len(r[0]), -r[2], sorted(r[0]))):
        if not any(c >= confidence and other < names for other, c in general[verdict]):
            general[verdict].append((names, confidence))
            kept.append((frozenset(classes[n] for n in names), verdict, confidence, support))
    return kept


class RuleIndex:
    """Rules by the tokens of their rarest class."""

    def __init__(self, rules: list[Mined]):
        often = Counter(c for r in rules for c in r[0])
        self.by_token: dict[str, list] = defaultdict(list)
        for rule in rules:
            for token in min(rule[0], key=lambda c: (often[c], min(c))):
                self.by_token[token].append(rule)

    def match(self, found: Iterable[str]) -> tuple[Mined, tuple[str, ...]] | None:
        """The rule that decides for a url's tokens, and those of them that it rests on."""
        have = frozenset(found)
        fit = [(r, tuple(sorted(min(c & have) for c in r[0]))) for t in have for r in self.by_token.get(t, ()) if all(c & have for c in r[0])]
        return min(fit, key=lambda f: (-f[0][2], -f[0][3], f[1])) if fit else None


def judge(df: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, default: str = "allow") -> DataFrame:
    """``id_col``, ``host``, ``path``, ``rule``, ``verdict`` and ``mined_rule`` (the tokens that decided, or null) of every url.

    Null urls and urls without ``://`` have empty parts and the default verdict, unless a mined
    rule fits. Repeated rows give repeated rows; other columns are left out; an empty table
    gives an empty table.
    """
    url = F.col(url_col).cast("string")
    host, path = parts(url)
    named = df.select(F.col(id_col).alias(id_col), url.alias("__url"), host.alias("host"), path.alias("path"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    told = named.select(id_col, "host", "path", rule.alias("rule"), verdict.alias("verdict"), tokens(F.col("host"), F.col("path"), F.col("__url")).alias("tokens"))
    mined = mine(told.filter("rule IS NOT NULL").select("tokens", "verdict"), min_support, min_confidence)
    schema = T.StructType([*told.drop("tokens").schema.fields, T.StructField("mined_rule", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = RuleIndex(mined), {}
        for batch in batches:
            said, why = batch.column(4).to_pylist(), [None] * batch.num_rows
            for i, (verdict, found) in enumerate(zip(said, batch.column(5).to_pylist(), strict=True)):
                if verdict is None:
                    key = tuple(found or ())
                    if key not in known:
                        if len(known) > 100_000:
                            known.clear()
                        known[key] = index.match(key)
                    if fit := known[key]:
                        said[i], why[i] = fit[0][1], " ".join(fit[1])
                    else:
                        said[i] = default
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(said, pa.string()), pa.array(why, pa.string())], schema.names)

    return told.mapInArrow(run, schema)
