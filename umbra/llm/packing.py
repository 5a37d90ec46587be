"""Best-fit packing of tokenised documents into sequences by a grouping genetic algorithm.

Documents longer than a sequence are cut into whole sequences with the shorter piece first;
only those first pieces need packing. Documents are dealt to islands of about
``ISLAND`` each. An island breeds solutions of its own documents: crossover injects the
donor's well-filled bins whole, the receiver's bins that shared a document go, and the
documents that this displaces are best-fitted, longest first. Then its elite bins, as lists
of lengths, migrate to the next island, which rebuilds them from its own documents of these
lengths and breeds on. At last the emptiest bins of ``POOL`` islands at a time, a bounded number of
documents, make an island of their own, and again, until one is left: so part-filled
sequences do not add up over the islands.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import encoder
from .chunks import sub_batches
from .shared import cut

ISLAND = 2000
POPULATION, GENERATIONS, ELITES = 4, 6, 64
WELL_FILLED = 0.98
#: Islands whose emptiest bins are packed together, and documents that each gives.
POOL = 64
GIVEN = ISLAND // POOL


def tokenize(df: DataFrame, path: str, pattern: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``id_col``, ``__n`` (tokens with ``end_id``), ``__crcs`` (CRC-32 of each piece's little-endian ids), and ``__ids`` if asked for.

    A null or empty text is ``end_id`` alone.
    """
    fields = [T.StructField(id_col, df.schema[id_col].dataType), T.StructField("__n", T.LongType()), T.StructField("__crcs", T.ArrayType(T.LongType()))]
    schema = T.StructType(fields + [T.StructField("__ids", T.ArrayType(T.IntegerType()))] * with_ids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder("json", path, pattern)
        for batch in batches:
            for rows, texts in sub_batches(batch, 1):
                sizes, crcs, all_ids = [], [], []
                for ids in tool.encode(texts):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    sizes.append(len(ids))
                    crcs.append([zlib.crc32(ids[a:b].tobytes()) for a, b in piece_bounds(len(ids), capacity)])
                    all_ids.append(ids.view("<i4"))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sizes, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))] + [pa.array(all_ids, pa.list_(pa.int32()))] * with_ids, schema.names)

    return df.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """Where the pieces of ``n`` tokens begin and end; the first is the shorter one."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((a, a + capacity) for a in range(first, n, capacity))]


class Bins:
    """Bins of items, open for best fit: an item goes to the bin that it leaves the least room in."""

    def __init__(self, capacity: int):
        self.capacity, self.items, self.room = capacity, {}, {}
        self.by_room: list[tuple[int, int]] = []
        self.next = 0

    def add(self, items: list[int], length: list[int]) -> None:
        room = self.capacity - sum(length[i] for i in items)
        self.items[self.next], self.room[self.next] = list(items), room
        insort(self.by_room, (room, self.next))
        self.next += 1

    def fit(self, item: int, length: list[int]) -> None:
        at = bisect_left(self.by_room, (length[item], -1))
        if at == len(self.by_room):
            self.add([item], length)
            return
        room, bin_ = self.by_room.pop(at)
        self.items[bin_].append(item)
        self.room[bin_] = room - length[item]
        if self.room[bin_]:
            insort(self.by_room, (self.room[bin_], bin_))

    def fit_all(self, items: Iterable[int], length: list[int]) -> Bins:
        for item in sorted(items, key=lambda i: -length[i]):
            self.fit(item, length)
        return self

    def solution(self) -> list[list[int]]:
        return list(self.items.values())


def fitness(bins: list[list[int]], length: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins are better, then fuller ones: the mean square of how full they are."""
    return -len(bins), sum((sum(length[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def cross(donor: list[list[int]], receiver: list[list[int]], length: list[int], capacity: int, share: float) -> list[list[int]]:
    """The donor's fullest ``share`` of bins whole, the receiver's bins without any of their items, the rest best-fitted."""
    full = sorted(donor, key=lambda b: -sum(length[i] for i in b))
    injected = [b for b in full[: max(1, int(share * len(full)))] if sum(length[i] for i in b) >= WELL_FILLED * capacity] or full[:1]
    taken = {i for b in injected for i in b}
    child, displaced = Bins(capacity), []
    for b in injected:
        child.add(b, length)
    for b in receiver:
        if taken.isdisjoint(b):
            child.add(b, length)
        else:
            displaced += [i for i in b if i not in taken]
    return child.fit_all(displaced, length).solution()


def mutate(bins: list[list[int]], length: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """The emptiest bins and a few others taken apart and best-fitted again, the other bins offered first."""
    order = sorted(bins, key=lambda b: sum(length[i] for i in b))
    gone = set(range(max(1, len(order) // 20))) | set(rng.integers(0, len(order), max(1, len(order) // 20)).tolist())
    child = Bins(capacity)
    for k, b in enumerate(order):
        if k not in gone:
            child.add(b, length)
    return child.fit_all((i for k in gone for i in order[k]), length).solution()


def rebuild(patterns: list[tuple[int, ...]], length: list[int]) -> list[list[int]]:
    """Bins of the island's own items with the lengths of each pattern, as far as there are such items."""
    spare: dict[int, list[int]] = defaultdict(list)
    for i, n in enumerate(length):
        spare[n].append(i)
    out = []
    for pattern in patterns:
        if all(len(spare[n]) >= k for n, k in Counter(pattern).items()):
            out.append([spare[n].pop() for n in pattern])
    return out


def evolve(length: list[int], capacity: int, seed: int, start: list[list[int]] | None = None, migrants: list[tuple[int, ...]] = (), population: int = POPULATION, generations: int = GENERATIONS) -> list[list[int]]:
    """The best solution found; stops early at as many bins as the total length needs at least."""
    if not length:
        return []
    rng, items = np.random.default_rng(seed), range(len(length))
    least = math.ceil(sum(length) / capacity)
    people = [start] if start else [Bins(capacity).fit_all(items, length).solution()]
    if migrants:
        own = rebuild(list(migrants), length)
        used, guest = {i for b in own for i in b}, Bins(capacity)
        for b in own:
            guest.add(b, length)
        people.append(guest.fit_all((i for i in items if i not in used), length).solution())
    score = lambda s: fitness(s, length, capacity)
    if max(len(s) for s in people) > least or min(len(s) for s in people) > least:
        while len(people) < population:
            first = Bins(capacity)
            for i in rng.permutation(len(length)).tolist():
                first.fit(i, length)
            people.append(first.solution())
        for _ in range(generations):
            people.sort(key=score, reverse=True)
            if len(people[0]) <= least:
                break
            donor, receiver = (people[k] for k in rng.choice(len(people), 2, replace=False))
            people[-1] = cross(donor, receiver, length, capacity, rng.uniform(0.2, 0.6))
            people[-2] = mutate(people[0], length, capacity, rng)
    return max(people, key=score)


def emptiest(bins: list[list[int]], length: list[int], most: int) -> list[int]:
    """Numbers of the emptiest bins that together hold at most ``most`` items."""
    out, held = [], 0
    for k in sorted(range(len(bins)), key=lambda k: (sum(length[i] for i in bins[k]), k)):
        held += len(bins[k])
        if held > most:
            break
        out.append(k)
    return out


def pack(tokenized: DataFrame, capacity: int, id_col: str = "doc_id", island: int = ISLAND, seed: int = 7) -> DataFrame:
    """Packs what :func:`tokenize` made; a row for each piece.

    ``id_col``, ``piece`` (from 0), ``start``, ``length``, ``ids_crc32``, ``sequence_id``,
    ``offset``, and ``ids`` if there were ids. Every row of the input is a document of its own,
    repeated ids too; an empty table gives an empty table.
    """
    docs = cut(tokenized)
    islands = max(1, math.ceil(docs.count() / island))
    with_ids = "__ids" in docs.columns
    payload = ["__id", "__n", "__crcs"] + ["__ids"] * with_ids
    types = [docs.schema[id_col].dataType, T.LongType(), T.ArrayType(T.LongType())] + [T.ArrayType(T.IntegerType())] * with_ids
    fields = [T.StructField("__island", T.LongType()), *map(T.StructField, payload, types)]
    bred = T.StructType([*fields, T.StructField("__bin", T.LongType()), T.StructField("__pattern", T.ArrayType(T.LongType()))])
    # where an item's first piece lies, the first sequence of its other pieces, and whether its bin may still change
    placed = T.StructType([*fields, *(T.StructField(x, T.LongType()) for x in ("__bin", "__offset", "__rest")), T.StructField("__open", T.BooleanType())])
    dealt = docs.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(islands)).alias("__island"), F.col(id_col).alias("__id"), *payload[1:])

    def lengths(group: pa.Table) -> list[int]:
        return ((group.column("__n").to_numpy() - 1) % capacity + 1).tolist()

    def held(group: pa.Table) -> list[list[int]] | None:
        bins: dict[int, list[int]] = defaultdict(list)
        for i, b in enumerate(group.column("__bin").to_pylist()):
            bins[b].append(i)
        return list(bins.values()) or None

    def first(group: pa.Table) -> pa.Table:
        at, length = group.column("__island")[0].as_py(), lengths(group)
        best = evolve(length, capacity, seed + at)
        where = np.zeros(len(length), np.int64)
        for k, b in enumerate(best):
            where[b] = k
        patterns = pa.list_(pa.int64())
        out = group.append_column("__bin", pa.array(where)).append_column("__pattern", pa.nulls(len(length), patterns))
        if islands == 1:
            return out
        elite = sorted(best, key=lambda b: -sum(length[i] for i in b))[:ELITES]
        columns = {x.name: pa.nulls(len(elite), x.type) for x in out.schema}
        columns["__island"] = pa.array([(at + 1) % islands] * len(elite), pa.int64())
        columns["__pattern"] = pa.array([sorted((length[i] for i in b), reverse=True) for b in elite], patterns)
        return pa.concat_tables([out, pa.table(columns)])

    def settled(group: pa.Table, best: list[list[int]], length: list[int], level: int, last: bool) -> pa.Table:
        """``group`` with each item's place; sequences are numbered by level, island and place."""
        at = group.column("__island")[0].as_py()
        number = level << 60 | at << 30
        bin_, offset, may_change = (np.zeros(len(length), np.int64) for _ in range(3))
        for k, b in enumerate(best):
            bin_[b] = number + k
            offset[b] = np.cumsum([0, *(length[i] for i in b[:-1])])
        for k in [] if last else emptiest(best, length, GIVEN):
            may_change[best[k]] = 1
        if "__rest" in group.column_names:
            rest = group.column("__rest")
        else:
            more = (group.column("__n").to_numpy() - 1) // capacity
            rest = pa.array(number + len(best) + np.cumsum(more) - more)
        return pa.table([group.column(f.name) for f in fields] + [pa.array(bin_), pa.array(offset), rest, pa.array(may_change.astype(bool))], placed.names)

    def second(group: pa.Table) -> pa.Table:
        at = group.column("__island")[0].as_py()
        guests = sorted(tuple(p) for p in group.column("__pattern").drop_null().to_pylist())
        group = group.filter(pc.is_valid(group.column("__bin")))
        length = lengths(group)
        best = evolve(length, capacity, seed + at + islands, held(group), guests)
        return settled(group, best, length, 0, islands == 1)

    def pooled(level: int, last: bool):
        def run(group: pa.Table) -> pa.Table:
            length = lengths(group)
            best = evolve(length, capacity, seed + level + group.column("__island")[0].as_py(), held(group))
            return settled(group, best, length, level, last)

        return run

    table, groups, level, done = cut(dealt.groupBy("__island").applyInArrow(first, bred).groupBy("__island").applyInArrow(second, placed)), islands, 0, []
    while groups > 1:
        groups, level = math.ceil(groups / POOL), level + 1
        done.append(table.filter("NOT __open"))
        again = table.filter("__open").withColumn("__island", F.expr(f"__island div {POOL}"))
        table = cut(again.groupBy("__island").applyInArrow(pooled(level, groups == 1), placed))
    done.append(table)

    names = [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    result = T.StructType([T.StructField(a, b) for a, b in zip(names, [types[0], T.IntegerType(), *[T.LongType()] * 5, *types[3:]], strict=True)])

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, bins, offsets, rests = (batch.column(i).to_numpy() for i in (1, len(payload), len(payload) + 1, len(payload) + 2))
            bounds = [piece_bounds(n, capacity) for n in total.tolist()]
            size = np.array([len(b) for b in bounds], np.int64)
            item = np.repeat(np.arange(len(size)), size)
            piece = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            begin, end = np.array([x for b in bounds for x in b], np.int64).reshape(-1, 2).T
            sequence, offset = np.where(piece == 0, bins[item], rests[item] + piece - 1), np.where(piece == 0, offsets[item], 0)
            out = [batch.column(0).take(pa.array(item)), pa.array(piece.astype(np.int32)), pa.array(begin), pa.array(end - begin), batch.column(2).flatten(), pa.array(sequence), pa.array(offset)]
            if with_ids:
                ids = batch.column(3).to_pylist()
                out.append(pa.array([ids[i][a:b] for i, a, b in zip(item.tolist(), begin.tolist(), end.tolist(), strict=True)], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, names)

    whole = reduce(DataFrame.unionByName, done)
    return whole.select(*payload, "__bin", "__offset", "__rest").mapInArrow(pieces, result)
