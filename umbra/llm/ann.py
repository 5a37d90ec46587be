"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``tables`` hash tables cuts ``k`` Gaussian projections of a vector into bins of
``width``; a query visits the buckets around its own in the order of their estimated chance
to hold a neighbour at the distance that a bounded sample shows, until the chances over
all tables reach ``target``. Candidates never become rows: a partition holds the queries that
probe one bucket while that bucket's vectors stream past, reranks by exact distance, and keeps
each query's nearest. Buckets are counted first: one of many vectors is salted, and one of many
queries is visited by blocks of them, so that no task holds or reads more than a bounded part.
Queries left with too few candidates probe on, to a higher chance; those still left are compared
with all rows, a bounded number of blocks of queries at a time.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quality import mix
from .shared import cut, join_small

#: Rows at most that the width, and the distance of a neighbour, are fitted on; and of them at most as many queries.
SAMPLE, SAMPLE_QUERIES = 4000, 100
TABLES, WIDTH, TARGET = 2, 1.6, 0.97
#: Vectors that a bucket is meant for; those that a task reads of one, and the queries that it holds of one, at most (on average).
BUCKET, SALT_ROWS, HELD_QUERIES = 1500, 6000, 2000
#: Of queries against all rows: queries in a block, blocks at a time, and rows that a task reads.
ALL_QUERIES, ALL_BLOCKS, ALL_ROWS = 1000, 4, 50_000
#: Rows of vectors compared at a time.
BLOCK = 4096
SEED = 11


@lru_cache(maxsize=64)
def projections(dim: int, table: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``k`` Gaussian directions and offsets (in bins) of a table; the same on every executor."""
    rng = np.random.default_rng([SEED, dim, table])
    return rng.standard_normal((k, dim)), rng.random(k)


def _normal(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf)(x / math.sqrt(2)))


def probe_sequence(position: np.ndarray, reach: float, enough: float) -> list[tuple[float, tuple[int, ...]]]:
    """(chance, offsets of bins) from the likeliest on, until the chances reach ``enough``.

    ``position``: the query's projections in bins. A neighbour's lie around them, normally
    distributed with deviation ``reach`` (in bins).
    """
    span = max(1, math.ceil(3 * reach))
    steps = np.arange(-span, span + 1)
    low = np.floor(position)[:, None] + steps
    chance = _normal((low + 1 - position[:, None]) / reach) - _normal((low - position[:, None]) / reach)
    order = np.argsort(-chance, axis=1, kind="stable")
    logs = np.log(np.maximum(np.take_along_axis(chance, order, 1), 1e-300))
    out, total = [], 0.0
    heap, seen = [(-logs[:, 0].sum(), (0,) * len(position))], {(0,) * len(position)}
    while heap and total < enough:
        cost, at = heapq.heappop(heap)
        out.append((math.exp(-cost), tuple(int(steps[order[i, a]]) for i, a in enumerate(at))))
        total += out[-1][0]
        for i, a in enumerate(at):
            if a + 1 < len(steps) and (after := (*at[:i], a + 1, *at[i + 1 :])) not in seen:
                seen.add(after)
                heapq.heappush(heap, (cost + logs[i, a] - logs[i, a + 1], after))
    return out


def _keys(dim: int, table: int, bins: np.ndarray) -> np.ndarray:
    """A 64-bit name for each row of bin numbers."""
    with np.errstate(over="ignore"):
        key = np.full(len(bins), mix(np.array([dim * 1000003 + table]))[0], np.uint64)  # mixed: tables' small bin numbers must not cancel
        for column in bins.astype(np.int64).T:
            key = (key ^ column.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _vectors(column: pa.Array) -> list[np.ndarray]:
    return [v.values.to_numpy(zero_copy_only=False) for v in column]


def _by_dim(batch: pa.RecordBatch, at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors (in double precision) of each dimension."""
    vectors = _vectors(batch.column(at))
    dims = np.array([len(v) for v in vectors])
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        yield rows, np.stack([vectors[i] for i in rows]).astype(np.float64)


class _Nearest:
    """The nearest ``k`` of each query so far."""

    def __init__(self, k: int):
        self.k, self.parts, self.n = k, [], 0

    def add(self, queries: np.ndarray, ids: np.ndarray, distances: np.ndarray) -> None:
        self.parts.append((queries, ids, distances))
        self.n += len(queries)
        if self.n > 500_000:
            self.parts = [self.best()]
            self.n = len(self.parts[0][0])

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        q, v, d = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((v, d, q))
        q, v, d = q[order], v[order], d[order]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1]) | (d[1:] != d[:-1])
        q, v, d = q[new], v[new], d[new]
        start = np.ones(len(q), bool)
        start[1:] = q[1:] != q[:-1]
        rank = np.arange(len(q)) - np.repeat(np.flatnonzero(start), np.diff(np.append(np.flatnonzero(start), len(q))))
        return q[rank < self.k], v[rank < self.k], d[rank < self.k]


def _rerank(k: int):
    """Over rows (key, kind, id, vec) sorted by key and kind: the queries (kind 0) of a key, against its vectors (kind 1)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, key, names, points = _Nearest(k), None, [], None
        held: list[np.ndarray] = []
        for batch in batches:
            keys, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ids = batch.column(2).to_numpy()
            edges = np.flatnonzero((keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, b in zip([0, *edges], [*edges, len(keys)], strict=True):
                if key is None or keys[a] != key:
                    key, names, held, points = keys[a], [], [], None
                if kinds[a] == 0:
                    names += ids[a:b].tolist()
                    held += _vectors(batch.column(3).slice(a, b - a))
                    points = None
                elif names:
                    if points is None:
                        points = np.stack(held).astype(np.float64)
                    for c in range(a, b, BLOCK):
                        e = min(b, c + BLOCK)
                        rows = np.stack(_vectors(batch.column(3).slice(c, e - c))).astype(np.float64)
                        for name, point in zip(names, points, strict=True):
                            gap = rows - point
                            distance = np.sqrt(np.einsum("ij,ij->i", gap, gap))
                            near = np.argpartition(distance, k - 1)[:k] if len(distance) > k else np.arange(len(distance))
                            near = np.flatnonzero(distance <= distance[near].max())
                            near = near[np.lexsort((ids[c:e][near], distance[near]))][:k]
                            best.add(np.full(len(near), name), ids[c:e][near], distance[near])
        q, v, d = best.best()
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(d)], ["__query", "__id", "__distance"])

    return run


def _fit(rows: DataFrame, n: int, k: int) -> float:
    """The distance of a ``k``-th neighbour, from at most ``SAMPLE`` rows (an upper estimate: a sample is sparser)."""
    place = F.pmod(F.xxhash64("__id", "__a"), F.lit(1 << 40))
    some = rows.select(place.alias("p"), "__id", "__vec").filter(F.col("p") < math.ceil(min(1.0, 1.2 * SAMPLE / n) * (1 << 40))).limit(2 * SAMPLE).collect()
    sample = [np.array(r["__vec"], float) for r in sorted(some, key=lambda r: (r["p"], r["__id"]))[:SAMPLE]]  # the same however the rows are partitioned
    dims = [len(v) for v in sample]
    if not dims:
        return 1.0
    points = np.stack([v for v in sample if len(v) == max(set(dims), key=dims.count)])
    at = max(1, min(len(points) - 1, round(k * len(points) / n)))
    if len(points) < 2:
        return 1.0
    kth = [np.sort(np.sqrt(((points - p) ** 2).sum(1)))[at] for p in points[:SAMPLE_QUERIES]]
    return max(float(np.quantile(kth, 0.75)), 1e-9)


def search(df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = TABLES, width: float = WIDTH, target: float = TARGET) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``id_col``, ``score``: the ``k`` nearest found of each query, ties to the smaller id.

    ``queries``: rows like those of ``df`` (ids of type long). Vectors that are null, empty or
    zero, or hold null or non-finite components, take no part on either side, nor do rows
    with a null id; vectors of different sizes are never compared. A row of the query's own
    id is not among its results. Repeated rows count once. Of equal vectors only the ``k + 1``
    of least id can be in any result, and no more are indexed; equal queries are searched once.
    """
    v = F.col("__vec")
    usable = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)

    def clean(rows: DataFrame) -> DataFrame:
        some = rows.select(F.col(id_col).cast("long").alias("__id"), F.col(vec_col).alias("__vec")).filter(F.col("__id").isNotNull() & usable)
        return some.withColumn("__a", F.xxhash64(v)).withColumn("__b", F.xxhash64(F.lit(SEED), F.reverse(v)))

    same = Window.partitionBy("__a", "__b").orderBy("__id")
    rows = clean(df)
    index = cut(rows.dropDuplicates(["__id", "__a", "__b"]).withColumn("__n", F.row_number().over(same)).filter(F.col("__n") <= k + 1).drop("__n"))
    asked = cut(clean(queries).select("__id", "__a", "__b", "__vec").dropDuplicates(["__id", "__a", "__b"]))
    points = cut(asked.groupBy("__a", "__b").agg(F.first("__vec").alias("__vec")).withColumn("__query", F.monotonically_increasing_id()))
    n = index.count()
    if not n:
        return asked.select(F.col("__id").alias("query_id"), F.lit(1).alias("rank"), F.col("__id").alias(id_col), F.lit(0.0).alias("score")).limit(0)
    reach = _fit(index, n, k)
    bits = max(1, round(math.log2(max(2, n / BUCKET)) / 1.25))
    step, enough = width * reach, 1 - (1 - target) ** (1 / tables)
    kind = df.schema[vec_col].dataType.simpleString()

    def places(chance: float | None):
        """Rows (bucket, number of the row, vector or null): of vectors without a chance, else of queries, which visit buckets up to it."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows, points in _by_dim(batch, 1):
                    part = batch.take(pa.array(rows))
                    for table in range(tables):
                        a, shift = projections(points.shape[1], table, bits)
                        position = points @ a.T / step + shift
                        if chance is None:
                            yield _rows(_keys(points.shape[1], table, np.floor(position)), part)
                            continue
                        for i, p in enumerate(position):
                            probes = np.floor(p) + np.array([o for _, o in probe_sequence(p, 1 / width, chance)])
                            yield _rows(_keys(points.shape[1], table, probes), part.take(pa.array(np.full(len(probes), i))))

        return run

    def _rows(keys: np.ndarray, part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), part.column(0), part.column(1)], ["__bucket", "__id", "__vec"])

    schema, found_schema = f"__bucket long, __id long, __vec {kind}", "__query long, __id long, __distance double"

    def compare(probes: DataFrame, vectors: DataFrame) -> DataFrame:
        """Nearest of each query among the vectors with the same ``__key``."""
        both = probes.select("__key", F.lit(0).alias("__kind"), "__id", "__vec").unionByName(vectors.select("__key", F.lit(1).alias("__kind"), "__id", "__vec"))
        return both.repartition("__key").sortWithinPartitions("__key", "__kind").mapInArrow(_rerank(k + 1), found_schema)

    vectors = index.select("__id", "__vec").mapInArrow(places(None), schema)
    filled = cut(vectors.groupBy("__bucket").agg(F.count("*").alias("__m")))

    def search_buckets(some: DataFrame, chance: float) -> DataFrame:
        probes = some.select(F.col("__query").alias("__id"), F.col("__vec").cast(kind).alias("__vec")).mapInArrow(places(chance), schema)
        asked_of = probes.groupBy("__bucket").agg(F.count("*").alias("__q"))
        sizes = asked_of.join(filled, "__bucket").select("__bucket", F.ceil(F.col("__m") / SALT_ROWS).alias("__salts"), F.ceil(F.col("__q") / HELD_QUERIES).alias("__blocks"))
        large = cut(sizes.filter("__salts > 1 OR __blocks > 1"))
        spread = lambda count: F.sequence(F.lit(0).cast("long"), F.coalesce(count, F.lit(1).cast("long")) - 1)
        own = lambda count: F.pmod(F.xxhash64("__id"), F.coalesce(count, F.lit(1)))
        key = F.xxhash64("__bucket", F.col("__salt").cast("long"), F.col("__block").cast("long")).alias("__key")
        left = join_small(probes, large, ["__bucket"], "left").withColumn("__block", own(F.col("__blocks"))).withColumn("__salt", F.explode(spread(F.col("__salts"))))
        right = join_small(vectors, large, ["__bucket"], "left").withColumn("__salt", own(F.col("__salts"))).withColumn("__block", F.explode(spread(F.col("__blocks"))))
        return compare(left.select(key, "__id", "__vec"), right.select(key, "__id", "__vec"))

    near = Window.partitionBy("__query").orderBy("__distance", "__id")
    top = lambda found: found.dropDuplicates(["__query", "__id", "__distance"]).withColumn("__n", F.row_number().over(near)).filter(F.col("__n") <= k + 1)
    found = cut(top(search_buckets(points, enough)))

    def lacking() -> DataFrame:
        return cut(points.join(found.filter(F.col("__n") == min(n, k + 1)).select("__query"), "__query", "left_anti"))

    few = lacking()
    if not few.isEmpty():  # further buckets, to a chance that leaves a tenth of what is left now
        found = cut(top(found.drop("__n").unionByName(search_buckets(few, 1 - (1 - enough) / 10))))
        few = lacking()
    missing = few.count()
    blocks, pieces = math.ceil(missing / ALL_QUERIES), max(1, math.ceil(n / ALL_ROWS))
    for begin in range(0, blocks, ALL_BLOCKS):  # against all rows, in blocks of queries and parts of the rows
        now = range(begin, min(blocks, begin + ALL_BLOCKS))
        placed = lambda b, p: F.xxhash64(F.size("__vec").cast("long"), b.cast("long"), p.cast("long")).alias("__key")
        block, part = F.pmod(F.xxhash64("__query"), F.lit(blocks)), F.pmod(F.xxhash64("__id"), F.lit(pieces))
        some = few.withColumn("b", block).filter(F.col("b").isin(*now)).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
        all_rows = index.withColumn("b", F.explode(F.array(*map(F.lit, now)))).withColumn("p", part)
        more = compare(some.select(placed(F.col("b"), F.col("p")), F.col("__query").alias("__id"), F.col("__vec").cast(kind).alias("__vec")), all_rows.select(placed(F.col("b"), F.col("p")), "__id", "__vec"))
        found = cut(top(found.drop("__n").unionByName(more)))
    each = asked.select(F.col("__id").alias("query_id"), "__a", "__b").join(points.select("__a", "__b", "__query"), ["__a", "__b"]).join(found.drop("__n"), "__query").filter(F.col("__id") != F.col("query_id"))
    last = Window.partitionBy("query_id", "__a", "__b").orderBy("__distance", "__id")
    return each.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("__id").alias(id_col), F.col("__distance").alias("score"))
