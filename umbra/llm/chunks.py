"""Whitespace chunks of texts, and a bounded cache of what a tokeniser makes of them.

A single blank between two characters that are not white space always starts a new
pre-token, so the pieces between such blanks can be tokenised apart, and each different
piece only once. Everything else (runs of blanks, a blank beside a newline, blanks at
either end) stays inside its chunk. Arrow splits and numbers the chunks; Python sees
only the different ones.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time within an Arrow batch, and bytes that a cache may hold.
SUB_BATCH_BYTES = 3_000_000
CACHE_BYTES = 80_000_000
#: What an entry takes besides its characters and its value: two objects' heads and a place in the table.
_ENTRY_BYTES = 200
#: Longer chunks are tokenised each time and never cached.
CACHED_CHARS = 120

_SPACE = r"[\t-\r \x1c-\x1f\x{85}\p{Z}]"
_UNSAFE = f"^ | $|{_SPACE} | {_SPACE}"


def split_chunks(text: str) -> list:
    """Cut ``text`` at every blank that stands between two other non-space characters.

    A chunk that follows a blank is its string; the chunk that starts the text is a 1-tuple.
    """
    out: list = []
    parts = text.split(" ")
    open_ = [parts[0]]
    for part in parts[1:]:
        left = open_[-1]
        if left and part and not left[-1].isspace() and not part[0].isspace():
            chunk = " ".join(open_)
            out.append(chunk if out else (chunk,))
            open_ = [part]
        else:
            open_.append(part)
    chunk = " ".join(open_)
    out.append(chunk if out else (chunk,))
    return out


def chunk_text(key) -> str:
    """The text of a chunk, with the blank that goes before it."""
    return key[0] if isinstance(key, tuple) else " " + key


@dataclass
class Chunked:
    """Texts as numbered chunks: those of text i are ``keys[numbers[starts[i]:starts[i] + sizes[i]]]``."""

    keys: list
    numbers: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray


def chunked(texts: pa.Array, slowly: Callable[[str], list] = split_chunks, unsafe: str = _UNSAFE) -> Chunked:
    """Number the chunks of ``texts`` (no nulls). Texts in which ``unsafe`` matches are cut by ``slowly``."""
    odd = pc.match_substring_regex(texts, unsafe).to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    offsets = offsets - (offsets[0] if len(offsets) else 0)
    coded = flat.dictionary_encode()
    keys, numbers = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    if len(offsets) > 1:
        first = flat.take(pa.array(offsets[:-1])).dictionary_encode()
        numbers[offsets[:-1]] = len(keys) + first.indices.to_numpy()
        keys += [(k,) for k in first.dictionary.to_pylist()]
    starts, sizes = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    starts[~odd], sizes[~odd] = offsets[:-1], np.diff(offsets)
    if odd.any():
        place = {k: i for i, k in enumerate(keys)}
        more: list[int] = []
        for i in np.flatnonzero(odd):
            own = [place.setdefault(k, len(place)) for k in slowly(texts[int(i)].as_py())]
            starts[i], sizes[i] = len(numbers) + len(more), len(own)
            more += own
        keys, numbers = list(place), np.concatenate([numbers, np.array(more, np.int64)])
    return Chunked(keys, numbers, starts, sizes)


class ChunkCache:
    """Values (bytes, or numbers) of short chunks, in about ``most`` bytes; starts anew beyond."""

    def __init__(self, encode: Callable[[list], Iterable], most: int = CACHE_BYTES):
        self.encode, self.most, self.known, self.held = encode, most, {}, 0

    def values(self, keys: list) -> list:
        """The value of each key."""
        if self.held > self.most:
            self.known, self.held = {}, 0
        known = self.known
        missing = list(dict.fromkeys(k for k in keys if k not in known))
        made = list(self.encode(missing))
        known.update(zip(missing, made, strict=True))
        out = list(map(known.__getitem__, keys))
        sizes = [len(k) if isinstance(k, str) else len(k[0]) for k in missing]
        self.held += sum(sizes) + _ENTRY_BYTES * len(missing) + (sum(map(len, made)) if made and isinstance(made[0], bytes) else 0)
        if max(sizes, default=0) > CACHED_CHARS:
            for key, size in zip(missing, sizes, strict=True):
                if size > CACHED_CHARS:
                    del known[key]
        return out


def _trimmer() -> Callable[[int], int]:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return lambda pad: 0


_trim = _trimmer()


def give_back() -> None:
    """Return to the system what Arrow's pool and the C library hold free; a worker lives on from stage to stage."""
    pa.default_memory_pool().release_unused()
    _trim(0)


def sub_batches(batch: pa.RecordBatch, column: int, most: int = SUB_BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of ``batch`` with their texts (null: empty), each of about ``most`` bytes."""
    texts = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy())
    begin = 0
    while begin < batch.num_rows:
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(begin, end - begin), texts.slice(begin, end - begin)
        begin = end
    del texts
    give_back()


def gather(values: list[bytes], numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit integers of ``values[n]`` for each number, end to end, and where each begins (with the total last)."""
    size = np.array([len(v) >> 2 for v in values], np.int64)
    start = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(values), "<u4")
    sizes = size[numbers]
    ends = np.cumsum(sizes)
    begins = np.concatenate([[0], ends])
    if not len(ends) or not ends[-1]:
        return np.zeros(0, "<u4"), begins
    return flat[np.arange(ends[-1]) + np.repeat(start[numbers] - begins[:-1], sizes)], begins
