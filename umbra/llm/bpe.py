"""Byte-level BPE: encoding by rounds over padded numpy matrices, and decoding.

Every distinct pre-token of a batch becomes a row of a matrix of rows of like length.
In each round every row merges its leftmost pair of least rank; ranks come from an
open-addressing hash table held in numpy arrays; rows without a mergeable pair leave the
matrix, and the others lose the column that the merge freed. Pre-tokens longer than
``MATRIX_BYTES`` merge by a heap, to the same result, so that one very long run of
letters costs n log n.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import ChunkCache, chunk_text, chunked, gather, sub_batches

#: Unicode White_Space, as the tokeniser libraries' ``\s`` has it.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
MATRIX_BYTES = 256
MATRIX_ROWS = 1 << 15
_MARKS = (".", ",", ";", ":", "!", "?")


def compile_pattern(pattern: str) -> regex.Pattern:
    r"""``pattern`` with ``\s`` and ``\S`` spelt out as Unicode White_Space."""
    inner = pattern.replace("[^\\s", "[^" + WHITE)
    return regex.compile(inner.replace("\\s", f"[{WHITE}]").replace("\\S", f"[^{WHITE}]"))


class BpeTable:
    """Vocabulary and merges of a byte-level BPE.

    ``pairs``: (left id, right id) to (rank, merged id). ``whole``: pre-tokens that are
    taken as one token without merging, where the tokeniser does so.
    """

    def __init__(self, vocab: dict[bytes, int], pairs: dict[tuple[int, int], tuple[int, int]], whole: dict[bytes, int], pattern: str, special: dict[str, int] | None = None):
        self.vocab, self.whole, self.special = vocab, whole, special or {}
        self.pattern = compile_pattern(pattern)
        self.plain_words = r"| ?\p{L}+|" in pattern
        self.bytes_to_id = np.array([vocab[bytes([b])] for b in range(256)], np.int32)
        self.merges = pairs
        self._build_hash(pairs)
        named = {i: b for b, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.lengths = np.array([len(named.get(i, b"")) for i in range(max(named) + 1)], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(named.get(i, b"") for i in range(max(named) + 1)), np.uint8)

    @classmethod
    def from_ranks(cls, path: str, pattern: str) -> BpeTable:
        """Of a rank file: lines of a base64 token and its rank."""
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = (rank, rank)
        return cls(ranks, pairs, ranks, pattern)

    @classmethod
    def from_json(cls, path: str, pattern: str) -> BpeTable:
        """Of a ``tokenizers`` file with a byte-level pre-tokeniser; its special tokens' strings stand for their ids."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: b for b, c in enumerate(_printable_bytes())}
        named = spec["model"]["vocab"]
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        vocab = {bytes(byte[c] for c in t): i for t, i in named.items() if t not in special}
        pairs = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pairs[named[left], named[right]] = (rank, named[left + right])
        return cls(vocab, pairs, {}, pattern, special)

    def _build_hash(self, pairs: dict) -> None:
        bits = max(4, int(len(pairs) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        ranks = np.array([r for r, _ in pairs.values()], np.int32)
        self.type = np.uint16 if max(self.vocab.values()) < 65_000 and ranks.max(initial=0) < 65_000 else np.int32
        self.none = np.iinfo(self.type).max
        self.rank_id = np.zeros(ranks.max(initial=0) + 1, self.type)
        self.rank_id[ranks] = [i for _, i in pairs.values()]
        self.hash_keys = np.full((1 << bits) + 64, -1, np.int64)
        self.hash_ranks = np.full((1 << bits) + 64, self.none, self.type)
        at, todo, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(todo):
            if self.probes >= 64:
                raise ValueError("the pair table is too full")
            free = self.hash_keys[at[todo]] < 0
            _, first = np.unique(at[todo][free], return_index=True)
            won = todo[free][first]
            self.hash_keys[at[won]], self.hash_ranks[at[won]] = keys[won], ranks[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            at[todo] += 1
            self.probes += 1
        both = np.arange(65536)
        self.byte_pairs = self.find(self.bytes_to_id[both >> 8], self.bytes_to_id[both & 255])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; ``none`` where there is none."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = self._slot(keys)
        seen = self.hash_keys[at]
        out = np.where(seen == keys, self.hash_ranks[at], self.none).astype(self.type)
        todo = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(todo):
            at[todo] += 1
            seen = self.hash_keys[at[todo]]
            hit = seen == keys[todo]
            out[todo[hit]] = self.hash_ranks[at[todo[hit]]]
            todo = todo[~hit & (seen >= 0)]
        return out

    def merge_rows(self, rows: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(rows)
        sizes = np.array([len(r) for r in rows], np.int64)
        for i in np.flatnonzero(sizes > MATRIX_BYTES):
            out[i] = self._merge_long(rows[i])
        widths = np.where(sizes <= 24, sizes, (sizes + 15) // 16 * 16)
        widths[sizes > MATRIX_BYTES] = 0
        order = np.argsort(widths, kind="stable")
        ordered = widths[order]
        begin = int(np.searchsorted(ordered, 1))
        while begin < len(order):
            width = int(ordered[begin])
            end = min(begin + MATRIX_ROWS, int(np.searchsorted(ordered, width, "right")))
            self._merge_matrix([rows[i] for i in order[begin:end]], order[begin:end], width, out)
            begin = end
        return out

    def _merge_matrix(self, rows: list[bytes], which: np.ndarray, width: int, out: list[bytes]) -> None:
        length = np.array([len(r) for r in rows])
        padded = rows if (length == width).all() else [r.ljust(width, b"\0") for r in rows]
        flat = np.frombuffer(b"".join(padded), np.uint8).reshape(-1, width)
        symbols = self.bytes_to_id[flat].astype(self.type)
        ranks = np.full((len(which), width), self.none, self.type)
        if width > 1:
            ranks[:, :-1] = self.byte_pairs[flat[:, :-1].astype(np.int32) << 8 | flat[:, 1:]]
        if padded is not rows:
            beyond = np.arange(width) >= length[:, None]
            symbols[beyond] = self.none
            ranks[np.arange(width) >= length[:, None] - 1] = self.none
        while len(which):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(which)), at]
            going = best != self.none
            if not going.all():
                done = ~going
                raw, step = symbols[done].astype("<u4").tobytes(), symbols.shape[1] * 4
                for k, (i, n) in enumerate(zip(which[done].tolist(), (length[done] * 4).tolist(), strict=True)):
                    out[i] = raw[k * step : k * step + n]
                which, symbols, ranks, at, best, length = (x[going] for x in (which, symbols, ranks, at, best, length))
                if not len(which):
                    return
            line, column = np.arange(len(which)), np.arange(symbols.shape[1] - 1)
            keep = column <= at[:, None]
            symbols = np.where(keep, symbols[:, :-1], symbols[:, 1:])
            ranks = np.where(keep, ranks[:, :-1], ranks[:, 1:])
            symbols[line, at] = new = self.rank_id[best]
            length = length - 1
            ranks[line, at] = self.none
            r = np.flatnonzero(at + 1 < length)  # the pair that the new symbol begins, and the one that it ends
            ranks[r, at[r]] = self.find(new[r], symbols[r, at[r] + 1])
            r = np.flatnonzero(at > 0)
            ranks[r, at[r] - 1] = self.find(symbols[r, at[r] - 1], new[r])

    def _merge_long(self, row: bytes) -> bytes:
        symbols = self.bytes_to_id[np.frombuffer(row, np.uint8)].tolist()
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.merges[p][0], i, p) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in self.merges]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if symbols[i] is not None else n
            if j >= n or (symbols[i], symbols[j]) != pair:
                continue
            symbols[i], symbols[j] = self.merges[pair][1], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (p := (symbols[a], symbols[b])) in self.merges:
                    heapq.heappush(heap, (self.merges[p][0], a, p))
        return np.array([s for s in symbols if s is not None], "<u4").tobytes()

    def encode_chunks(self, keys: list) -> list[bytes]:
        """The ids of chunks (see :mod:`.chunks`), each different pre-token merged once."""
        whole, known = self.whole, {}
        # a chunk of letters is a pre-token with the blank before it; the others are taken apart
        words = [k for k in keys if type(k) is str and k.isalpha()] if self.plain_words else []
        single = set(words)
        pieces = {k: self._pre_tokens(chunk_text(k)) for k in keys if k not in single}
        names = list(set().union([" " + w for w in words], *pieces.values()))
        rows = [n.encode() for n in names]
        for name, row in zip(names, rows, strict=True) if whole else ():
            if row in whole:
                known[name] = whole[row].to_bytes(4, "little")
        left = [i for i, n in enumerate(names) if n not in known] if known else range(len(names))
        known.update(zip([names[i] for i in left], self.merge_rows([rows[i] for i in left]), strict=True))
        get = known.__getitem__
        taken = {k: get(p[0]) if len(p) == 1 else b"".join(map(get, p)) for k, p in pieces.items()}
        return [taken[k] if k in taken else get(" " + k) for k in keys]

    def _pre_tokens(self, text: str) -> list[str]:
        """What the pattern finds; words, and words before a mark, without asking it."""
        if self.plain_words and (text[:1] == " " or text[:1].isalpha()):
            if text[1:].isalpha():
                return [text]
            line, newline, rest = text.partition("\n")
            if line[-1:] in _MARKS and line[1:-1].isalpha() and (not newline or rest.isalpha()):
                return [line[:-1], line[-1], newline, rest] if newline else [line[:-1], line[-1]]
        return self.pattern.findall(text)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ``ids``."""
        sizes = self.lengths[ids]
        total = int(sizes.sum())
        if not total:
            return b""
        shift = np.repeat(self.starts[ids] - (np.cumsum(sizes) - sizes), sizes)
        return self.bytes[np.arange(total) + shift].tobytes()


def _printable_bytes() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one from U+0100 on."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class Encoder:
    """Encodes texts by a :class:`BpeTable` through a bounded cache of chunks."""

    def __init__(self, table: BpeTable):
        self.table, self.cache = table, ChunkCache(table.encode_chunks)
        self.special = regex.compile("|".join(map(regex.escape, sorted(table.special, key=len, reverse=True)))) if table.special else None

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers."""
        out = self._plain(texts)
        if self.special:
            hit = np.zeros(len(texts), bool)
            for name in self.table.special:
                hit |= pc.match_substring(texts, name).to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(hit):
                out[i] = self._with_special(texts[int(i)].as_py())
        return out

    def _with_special(self, text: str) -> np.ndarray:
        at, ids = 0, []
        for m in self.special.finditer(text):
            ids += [*self._plain(pa.array([text[at : m.start()]], pa.large_string())), np.array([self.table.special[m[0]]], "<u4")]
            at = m.end()
        return np.concatenate([*ids, *self._plain(pa.array([text[at:]], pa.large_string()))])

    def _plain(self, texts: pa.Array) -> list[np.ndarray]:
        c = chunked(texts)
        flat, begins = gather(self.cache.values(c.keys), c.numbers)
        return [flat[a:b] for a, b in zip(begins[c.starts].tolist(), begins[c.starts + c.sizes].tolist(), strict=True)]


@lru_cache(maxsize=2)
def encoder(kind: str, path: str, pattern: str) -> Encoder:
    """One encoder for each file and worker process. kind: "ranks" or "json"."""
    return Encoder({"ranks": BpeTable.from_ranks, "json": BpeTable.from_json}[kind](path, pattern))


def ids_array(encoded: list[np.ndarray]) -> pa.ListArray:
    """Encoded texts as an Arrow array of lists of int."""
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in encoded])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*encoded, np.zeros(0, "<u4")]).view("<i4")))


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", kind: str = "ranks", with_decoded: bool = False) -> DataFrame:
    """Tokenise every whole text: ``id_col``, ``ids`` array<int>, and if asked for ``decoded``, the bytes that :func:`decode` would give, in the same pass.

    A null or empty text has no ids. Repeated rows give repeated rows; other columns,
    whatever their names, are left out; an empty table gives an empty table.
    """
    fields = [T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    schema = T.StructType(fields + [T.StructField("decoded", T.BinaryType())] * with_decoded)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(kind, path, pattern)
        for batch in batches:
            for rows, texts in sub_batches(batch, 1):
                ids = tool.encode(texts)
                raw = [pa.array([tool.table.decode(x) for x in ids], pa.binary())] if with_decoded else []
                yield pa.RecordBatch.from_arrays([rows.column(0), ids_array(ids), *raw], schema.names)

    return df.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", kind: str = "ranks") -> DataFrame:
    """Add ``decoded`` binary: the bytes of the tokens in ``ids_col`` (null: no bytes)."""
    schema = T.StructType([*df.schema.fields, T.StructField("decoded", T.BinaryType())])
    at = df.columns.index(ids_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = encoder(kind, path, pattern).table
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                rows = batch.slice(begin, 512)
                raw = [table.decode(v.values.to_numpy()) if v.is_valid else b"" for v in rows.column(at)]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(raw, pa.binary())], [*rows.schema.names, "decoded"])

    return df.mapInArrow(run, schema)
