"""Quality rules: statistics of a text by itself, and lines that recur across a host's documents.

A line is hashed in lower case with runs of white space as one blank. A first pass counts, for
each host and line, the documents that hold it. A line that more documents of a host hold than
the limit allows is boilerplate: all of them lose it, and a document that loses more than
``max_lost`` of its words is depleted. A second pass judges each document by itself against
the boilerplate lines, which are counted before: a bounded number goes to every worker, and
more are joined by shuffle. Verdicts belong to rows, so rows of one id are judged apart.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import sub_batches
from .shared import cut, fresh

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: A line is boilerplate where more than this many of a host's documents hold it, however many the host has.
MIN_DOCUMENTS = 20
MAX_LOST = 0.5
#: Boilerplate lines that every worker may hold, at 8 bytes each.
MOST_HELD = 1_000_000

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit integers whose bits look random."""
    with np.errstate(over="ignore"):
        x = (x.astype(np.uint64) + np.uint64(1)) * _GOLD
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def words_of(texts: pa.Array) -> tuple[np.ndarray, list, np.ndarray]:
    """Word numbers end to end, the different words, and the number of words of each text. Words: runs of other than ASCII white space."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    full = pc.binary_length(flat).to_numpy() > 0
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    coded = flat.filter(pa.array(full)).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, np.bincount(owner[full], minlength=len(texts)).astype(np.int64)


def repeated_words(numbers: np.ndarray, sizes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each text, its words that lie in windows of ``window`` words found twice or more in it."""
    ends = np.cumsum(sizes)
    out = np.zeros(len(sizes), np.int64)
    n = len(numbers) - window + 1
    if n <= 0:
        return out
    owner = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.flatnonzero(owner[:n] == owner[window - 1 :])
    if not len(starts):
        return out
    codes = mix(numbers)
    with np.errstate(over="ignore"):
        h = mix(owner[starts])
        for k in range(window):
            h = h * _GOLD + codes[starts + k]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    found = np.zeros(len(h), bool)
    found[order[1:][same]] = found[order[:-1][same]] = True
    delta = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(delta, starts[found], 1)
    np.add.at(delta, starts[found] + window, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(delta[:-1]) > 0)])
    return inside[ends] - inside[ends - sizes]


def _lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Repeated lines of each text; then, for each text and each different line, end to end: the text's number, the line's hash, its words there."""
    lists = pc.split_pattern(texts, "\n")
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    coded = lists.flatten().dictionary_encode()
    number, lines = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    n_words = words_of(lines)[2]
    keep = n_words[number] > 0
    owner, number = owner[keep], number[keep]
    if not len(owner):
        return np.zeros(len(texts), np.int64), owner, np.zeros(0, np.int64), np.zeros(0, np.int64)
    exact = np.unique(owner * len(lines) + number) // len(lines)
    hashes = line_hashes(normal_lines(lines))[number]
    order = np.lexsort((hashes, owner))
    own, sorted_ = owner[order], hashes[order]
    heads = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (sorted_[1:] != sorted_[:-1])))
    repeated = np.bincount(owner, minlength=len(texts)) - np.bincount(exact, minlength=len(texts))
    return repeated, own[heads], sorted_[heads].view(np.int64), np.add.reduceat(n_words[number][order], heads)


def normal_lines(lines: pa.Array) -> pa.Array:
    """Lines in lower case, runs of white space as one blank, none at either end."""
    return pc.replace_substring_regex(pc.utf8_lower(pc.ascii_trim_whitespace(lines)), r"[\t-\r ]+", " ")


def line_hashes(lines: pa.Array) -> np.ndarray:
    """64-bit hashes of strings."""
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(x) for x in lines.cast(pa.large_binary()).to_pylist()], np.uint64)


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(texts: pa.Array) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The statistics of each text, and (text, line hash, words) of their different lines."""
    numbers, _, n_words = words_of(texts)
    count = lambda chars: sum(pc.count_substring(texts, c).to_numpy().astype(np.int64) for c in chars)
    dup, *lines = _lines(texts)
    columns = (n_words, pc.utf8_length(texts).to_numpy().astype(np.int64) - count(BLANKS), count(SYMBOLS), dup, repeated_words(numbers, n_words))
    return dict(zip(STATS, (np.asarray(c, np.int64) for c in columns), strict=True)), tuple(lines)


def base_failed(stats: dict[str, np.ndarray]) -> np.ndarray:
    return (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * stats["n_words"])


def _hosts(column: pa.Array) -> np.ndarray:
    """A 64-bit hash of each host."""
    coded = pc.fill_null(column.cast(pa.large_string()), "").dictionary_encode()
    return line_hashes(coded.dictionary)[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.uint64)


def _in_host(hosts: np.ndarray, owner: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """One hash of each line and the host of the text that holds it."""
    return mix(lines.view(np.uint64) ^ mix(hosts)[owner]).view(np.int64)


def common_lines(df: DataFrame, text_col: str, host_col: str, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``__line``: hashes of host and line of the lines that more than ``min_documents`` rows of a host hold; cut."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in sub_batches(batch, 1):
                _, owner, lines, _ = _lines(texts)
                yield pa.RecordBatch.from_arrays([pa.array(_in_host(_hosts(rows.column(0)), owner, lines))], ["__line"])

    rows = df.select(F.col(host_col).cast("string").alias("__host"), F.col(text_col).cast("string").alias("__text"))
    counted = rows.mapInArrow(run, "__line long").groupBy("__line").agg(F.count("*").alias("__n"))
    return cut(counted.filter(F.col("__n") > min_documents).select("__line"))


def _verdicts(texts: pa.Array, hosts: np.ndarray, common: np.ndarray, max_lost: float) -> tuple[dict[str, np.ndarray], np.ndarray, list[np.ndarray], np.ndarray]:
    """Statistics, lost words, lost line hashes and whether each text is kept; ``common`` is sorted."""
    stats, (owner, lines, words) = measure(texts)
    keys = _in_host(hosts, owner, lines)
    lost = common[np.minimum(np.searchsorted(common, keys), max(0, len(common) - 1))] == keys if len(common) else np.zeros(len(keys), bool)
    n_lost = np.bincount(owner[lost], words[lost], len(texts)).astype(np.int64)
    ends = np.searchsorted(owner[lost], np.arange(len(texts) + 1))
    gone = [lines[lost][a:b] for a, b in zip(ends, ends[1:], strict=False)]
    return stats, n_lost, gone, ~base_failed(stats) & (n_lost <= max_lost * stats["n_words"])


def _held_by_row(df: DataFrame, common: DataFrame, text_col: str, host_col: str) -> tuple[DataFrame, str]:
    """``df`` (cut) with an array of those ``common`` lines that each row holds, and that column's name: for too many lines to hold in a worker."""
    row, mine = fresh(df, "__row"), fresh(df, "__mine")
    rows = cut(df.withColumn(row, F.monotonically_increasing_id()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in sub_batches(batch, 2):
                _, owner, lines, _ = _lines(texts)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), pa.array(_in_host(_hosts(part.column(1)), owner, lines))], ["__row", "__line"])

    each = rows.select(F.col(row).alias("__row"), F.col(host_col).cast("string").alias("__host"), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, "__row long, __line long")
    held = each.join(common, "__line").groupBy("__row").agg(F.collect_list("__line").alias(mine))  # at most the lines of one text
    return rows.join(held.withColumnRenamed("__row", row), row, "left").drop(row), mine


def _judged(df: DataFrame, text_col: str, host_col: str, min_documents: int, max_lost: float, most_held: int):
    """A table whose last column is null or the boilerplate lines of the row, and a function from batches of it to (rows, texts, verdicts)."""
    common = common_lines(df, text_col, host_col, min_documents)
    few = common.limit(most_held + 1).count() <= most_held
    if few:
        held = np.sort(common.toArrow().column(0).to_numpy())
        shared = df.sparkSession.sparkContext.broadcast(held)
        table, mine = df.withColumn(extra := fresh(df, "__mine"), F.lit(None).cast("array<bigint>")), extra
    else:
        shared = None
        table, mine = _held_by_row(df, common, text_col, host_col)
        table = table.select(*(F.col(f"`{c}`") for c in df.columns), F.col(mine))
    text, host = df.columns.index(text_col), df.columns.index(host_col)

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for rows, texts in sub_batches(batch, text):
                own = shared.value if shared else np.unique(rows.column(rows.num_columns - 1).flatten().to_numpy())
                yield rows, texts, _verdicts(texts, _hosts(rows.column(host)), own, max_lost)

    return table, run


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*values, np.zeros(0, np.int64)])))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_documents: int = MIN_DOCUMENTS, max_lost: float = MAX_LOST, most_held: int = MOST_HELD) -> DataFrame:
    """``id_col``, the five statistics, ``base_failed``, ``n_lost_words``, ``lost_lines`` array<long> and ``kept``.

    Every row is a document, repeated rows and rows of one id too. A null text has no words and
    fails. Null hosts are one host, that of the empty name. Other columns are left out; an empty
    table gives an empty table.
    """
    rows = df.select(F.col(id_col).alias("__id"), F.col(host_col).cast("string").alias("__host"), F.col(text_col).cast("string").alias("__text"))
    table, verdicts = _judged(rows, "__text", "__host", min_documents, max_lost, most_held)
    kinds = [df.schema[id_col].dataType, *[T.LongType()] * 5, T.BooleanType(), T.LongType(), T.ArrayType(T.LongType()), T.BooleanType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip([id_col, *STATS, "base_failed", "n_lost_words", "lost_lines", "kept"], kinds, strict=True)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, (stats, n_lost, gone, kept) in verdicts(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, stats.values()), pa.array(base_failed(stats)), pa.array(n_lost), _lists(gone), pa.array(kept)], schema.names)

    return table.mapInArrow(run, schema)


def remove_lines(texts: Iterable[str], lost: Iterable[set[int]]) -> list[str]:
    """Each text without its lines whose hash is in its set."""
    out = []
    for text, hashes in zip(texts, lost, strict=True):
        lines = text.split("\n")
        codes = line_hashes(normal_lines(pa.array(lines, pa.large_string()))).view(np.int64).tolist()
        out.append("\n".join(x for x, h in zip(lines, codes, strict=True) if h not in hashes or not x.strip(BLANKS)))
    return out


def clean(df: DataFrame, text_col: str = "text", host_col: str = "source", length_col: str | None = "n_chars", min_documents: int = MIN_DOCUMENTS, max_lost: float = MAX_LOST, most_held: int = MOST_HELD) -> DataFrame:
    """The rows of ``df`` that :func:`judge` keeps, without their boilerplate lines; all columns, of whatever names.

    Each row has its own verdict, whatever its id. ``length_col``, if the table has it, is set to
    the new length where a text changed.
    """
    names, schema = df.columns, df.schema
    table, verdicts = _judged(df, text_col, host_col, min_documents, max_lost, most_held)
    at = names.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts, (_, _, gone, kept) in verdicts(batches):
            columns = list(part.columns[:-1])
            hit = [i for i in np.flatnonzero(kept) if len(gone[i])]
            if hit:
                said = columns[at].to_pylist()
                for i in hit:
                    said[i] = remove_lines([texts[int(i)].as_py()], [set(gone[i].tolist())])[0]
                columns[at] = pa.array(said, columns[at].type)
                if length_col in names:
                    sizes = columns[names.index(length_col)].to_pylist()
                    for i in hit:
                        sizes[i] = len(said[i])
                    columns[names.index(length_col)] = pa.array(sizes, columns[names.index(length_col)].type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(kept))

    return table.mapInArrow(run, schema)
