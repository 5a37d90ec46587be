"""Token counts under a sentencepiece BPE model with byte fallback.

Rank-synchronous merging: the distinct pre-tokens of a batch lie end to end in one ragged
numpy array of symbols. Each round takes the leftmost pair of least rank of every sequence,
merges all of them at once and closes the gaps; sequences without a pair leave the array.
The count is that of the surviving symbols, a character outside the vocabulary counting
as many as it has bytes.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import ChunkCache, chunked, sub_batches

NEVER = np.int64(2**31 - 1)
#: Characters in one ragged array; longer pre-tokens merge by a heap instead.
RAGGED, LONG = 400_000, 400
_RUNS = re.compile(" *[^ ]+| +$")


class PieceTable:
    """Symbols and merges of a model whose normaliser is the identity with a blank put first."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i).replace("▁", " "): model.get_score(i) for i in plain}
        if any(re.search("[^ ] ", p) for p in pieces):
            raise ValueError("pieces that go on after a blank are not supported")
        order = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        symbols = dict.fromkeys([*pieces, *{c for p in pieces for c in p}])
        self.ids = {s: i for i, s in enumerate(symbols)}
        self.unknown = len(self.ids)  # and three more, for two to four bytes
        self.cost = np.array([1 if s in pieces else len(s.encode()) for s in symbols] + [1, 2, 3, 4], np.int64)
        self.pairs = {}
        for piece, score in pieces.items():
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    self.pairs[left, right] = (order[score], self.ids[piece])
        keys = np.array([a << 20 | b for a, b in self.pairs], np.int64)
        by = np.argsort(keys)
        self.keys = keys[by]
        self.values = np.array(list(self.pairs.values()), np.int64).reshape(-1, 2)[by]
        bits = int(len(keys) * 8).bit_length()
        self.mask = (1 << bits) - 1
        self.filled = np.zeros(1 << bits, bool)  # most pairs never merge: this tells without a search
        self.filled[self._slot(self.keys)] = True
        chars = {s: i for s, i in self.ids.items() if len(s) == 1}
        self.char_ids = np.full(0x110000, -1, np.int32)
        code = np.arange(0x110000)
        self.char_ids[:] = self.unknown + (code >= 0x80) + (code >= 0x800).astype(int) + (code >= 0x10000)
        for c, i in chars.items():
            self.char_ids[ord(c)] = i

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys * np.int64(0x2545F4914F6CDD1D)
        return (mixed ^ (mixed >> 31)) & self.mask

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (``NEVER``: no such pair) and merged symbols."""
        keys = left.astype(np.int64) << 20 | right
        ranks, new = np.full(len(keys), NEVER), np.zeros(len(keys), np.int32)
        maybe = np.flatnonzero(self.filled[self._slot(keys)])
        at = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == keys[maybe]
        ranks[maybe[hit]], new[maybe[hit]] = self.values[at[hit], 0], self.values[at[hit], 1]
        return ranks, new

    def count(self, words: list[str]) -> list[int]:
        """The number of tokens of each pre-token (blanks, then other characters)."""
        out = np.zeros(len(words), np.int64)
        begin = 0
        while begin < len(words):
            end, n = begin, 0
            while end < len(words) and (n < RAGGED or end == begin):
                n += len(words[end])
                end += 1
            out[begin:end] = self._count_ragged(words[begin:end])
            begin = end
        return out.tolist()

    def _count_ragged(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        which = np.array([i for i, w in enumerate(words) if 0 < len(w) <= LONG], np.int64)
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self._count_long(w)
        text = "".join(words[i] for i in which)
        symbols = self.char_ids[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        size = np.array([len(words[i]) for i in which], np.int64)
        last = np.zeros(len(symbols), bool)
        last[np.cumsum(size) - 1] = True
        ranks, new = np.full(len(symbols), NEVER), np.zeros(len(symbols), np.int32)
        inner = np.flatnonzero(~last)
        ranks[inner], new[inner] = self.find(symbols[inner], symbols[inner + 1])
        while len(which):
            starts = np.cumsum(size) - size
            best = np.minimum.reduceat(ranks << 32 | np.arange(len(ranks)), starts)
            going = best >> 32 != NEVER
            if not going.all():
                done = ~going
                costs = np.add.reduceat(self.cost[symbols], starts)
                out[which[done]] = costs[done]
                keep = np.repeat(going, size)
                symbols, ranks, new = symbols[keep], ranks[keep], new[keep]
                moved = (np.cumsum(keep) - 1)[(best & 0xFFFFFFFF)[going]]
                which, size = which[going], size[going]
                if not len(which):
                    break
            else:
                moved = best & 0xFFFFFFFF
            symbols[moved] = new[moved]
            keep = np.ones(len(symbols), bool)
            keep[moved + 1] = False
            symbols, ranks, new = symbols[keep], ranks[keep], new[keep]
            at = moved - np.arange(len(moved))  # one symbol went in every sequence before
            size = size - 1
            ends = np.cumsum(size) - 1
            starts = ends - size + 1
            ranks[at] = NEVER
            for x in (at[at < ends], (at - 1)[at > starts]):
                ranks[x], new[x] = self.find(symbols[x], symbols[x + 1])
        return out

    def _count_long(self, word: str) -> int:
        symbols = self.char_ids[np.frombuffer(word.encode("utf-32-le"), np.uint32)].tolist()
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.pairs[p][0], i, p) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in self.pairs]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if symbols[i] is not None else n
            if j >= n or (symbols[i], symbols[j]) != pair:
                continue
            symbols[i], symbols[j] = self.pairs[pair][1], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (p := (symbols[a], symbols[b])) in self.pairs:
                    heapq.heappush(heap, (self.pairs[p][0], a, p))
        return int(sum(self.cost[s] for s in symbols if s is not None))


def pre_tokens(text: str) -> list[str]:
    """Runs of blanks with the other characters after them; a text that is not empty gets one blank first.

    A pre-token without a blank in front stands for one blank and itself.
    """
    return _RUNS.findall(" " + text) if text else []


class Counter:
    """Counts tokens through a bounded cache of pre-tokens."""

    def __init__(self, path: str):
        self.table = PieceTable(path)
        self.cache = ChunkCache(lambda keys: self.table.count([k if k[0] == " " else " " + k for k in keys]))

    def count(self, texts: pa.Array) -> np.ndarray:
        c = chunked(pc.replace_substring(texts, "▁", " "), pre_tokens, "^$|^ | $|  ")
        keys = [k[0] if isinstance(k, tuple) else k for k in c.keys]
        total = np.concatenate([[0], np.cumsum(np.array(self.cache.values(keys), np.int64)[c.numbers])])
        return total[c.starts + c.sizes] - total[c.starts]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter for each file and worker process."""
    return Counter(path)


def count_tokens(df: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (``n_tokens > limit``) of every whole text.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows give repeated rows; other
    columns are left out; an empty table gives an empty table.
    """
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(path)
        for batch in batches:
            for rows, texts in sub_batches(batch, 1):
                n = pa.array(tool.count(texts), pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), n], schema.names)

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    counted = df.select(F.col(id_col).alias(id_col), text.alias("__text"), F.octet_length(text).cast("long").alias("n_bytes")).mapInArrow(run, schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
