"""Near duplicates by the Jaccard similarity of word n-grams: a parity-sketch join.

A document is the set of its shingles, each a 64-bit hash. Sets whose sizes a and b may link
lie in a common size band; linked sets differ in at most D = (a + b) / 9 shingles
(for a similarity of 0.8). Two sketches rest on that. Both XOR shingles together, so that a
shingle in one set only changes at most one place: the Hamming distance of two sketches is a
lower bound of the symmetric difference.

* Words: each shingle goes to one of the band's K places and XORs its hash into the word
  there. A document emits its first D + 1 words that hold anything. Of the words that the
  one of a linked pair emits whose (D + 1)-th comes first, at most D differ, so by the pigeonhole principle one is
  equal, and the other document emits it too. (One that has fewer such words emits the empty
  ones as well, which meets the case that both have fewer.)
* Bits: each shingle flips one bit; pairs whose bit sketches differ in more than D bits need
  no verification.

Equal sets are one node, named by a 64-bit hash; a second hash shows the names that different
sets share (some at 10^10 sets), and those get other names. A set's text is fetched by the
128-bit hash of a document's id and text, so null and repeated ids are like any others.

In a group of nodes with an equal word only the pairs with its hub, the node that shares words
with the most others, are candidates at first. In groups that then still hold several components,
the bit sketches of different components are compared in blocks: each node is verified against the
nearest, and in a last round every pair is that may link and still lies in different components.
Groups of more than ``HOT`` nodes, as a passage in very many texts makes them, are not compared:
their nodes emit words anew, those of such groups last, which other sets they may link with do
too. So groups of copies cost about as many pairs as they have members, and no link is lost.
Nothing is collected to the driver but names that clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import sub_batches
from .components import components
from .quality import line_hashes, mix, words_of
from .shared import cut, fresh, join_small

WORDS, PERCENT = 5, 80
BAND = 1.5
#: Members of a block in which sketches are compared, and pairs that one task verifies against a document.
BLOCK, SALT = 512, 500
SUB_BATCH = 1_500_000
#: Nodes of a group up to which all its pairs may be compared; beyond, its nodes emit rarer words instead.
HOT = 20_000
#: Seed of the second hash of a set.
_CHECK = 0x2545F491
#: Names of sets that a task remembers, so as not to emit copies' words again.
_SEEN = 200_000


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Different shingle hashes, sorted, of each text end to end, and how many each has. A-Z count as a-z."""
    numbers, known, sizes = words_of(pc.ascii_lower(texts))
    codes = line_hashes(known)[numbers] if len(known) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.cumsum(sizes) - sizes
    begins = np.flatnonzero(owner[: max(0, len(codes) - words + 1)] == owner[words - 1 :])
    with np.errstate(over="ignore"):
        full = np.zeros(len(begins), np.uint64)
        for k in range(words):
            full = mix(full + codes[begins + k])
        short = np.flatnonzero((sizes > 0) & (sizes < words))
        single = np.zeros(len(short), np.uint64)
        for k in range(words - 1):
            more = sizes[short] > k
            single[more] = mix(single[more] + codes[starts[short[more]] + k])
        single = mix(single ^ sizes[short].astype(np.uint64))
    own, hashes = np.concatenate([owner[begins], short]), np.concatenate([full, single])
    order = np.lexsort((hashes, own))
    own, hashes = own[order], hashes[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.bincount(own[new], minlength=len(sizes)).astype(np.int64)


def set_names(hashes: np.ndarray, sizes: np.ndarray, seed: int = 0x51ED270B) -> np.ndarray:
    """A 64-bit name of each set (0 for the empty set)."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(seed)))])
    ends = np.cumsum(sizes)
    with np.errstate(over="ignore"):
        names = mix(total[ends] - total[ends - sizes])
    names[sizes == 0] = 0
    return names.view(np.int64)


def told_apart(names: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, clashing: frozenset[int]) -> np.ndarray:
    """``names``, but those in ``clashing``, which different sets share, with the second hash mixed in."""
    if clashing and (which := np.isin(names, np.fromiter(clashing, np.int64))).any():
        names = np.where(which, mix(names.view(np.uint64) ^ set_names(hashes, sizes, _CHECK).view(np.uint64)).view(np.int64), names)
    return names


def most_different(small: np.ndarray, large: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The largest symmetric difference that linked sets of these sizes can have."""
    return (100 - percent) * (small + large) // (100 + percent)


def bands(sizes: np.ndarray, percent: int = PERCENT) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(set, band, words of the band, D) of each band that a set belongs to: its own, and those of larger partners."""
    edges = _edges(int(sizes.max(initial=1)) * 4)
    reach = sizes * 100 // percent
    out = []
    first, last = np.searchsorted(edges, sizes, "right"), np.searchsorted(edges, reach, "right")
    for step in range(int((last - first).max(initial=0)) + 1):
        which = np.flatnonzero((first + step <= last) & (sizes > 0))
        band = first[which] + step
        top = edges[band] - 1
        different = most_different(sizes[which], np.minimum(top, reach[which]), percent)
        places = most_different(top, top, percent) * 13 // 10 + 8
        some = different > 0  # else only equal sets link, which are one node
        out.append((which[some], band[some], places[some], different[some]))
    return out


def _edges(most: int) -> np.ndarray:
    edges = [1]
    while edges[-1] <= most:
        edges.append(max(edges[-1] + 1, int(edges[-1] * BAND)))
    return np.array(edges, np.int64)


def signatures(hashes: np.ndarray, sizes: np.ndarray, names: np.ndarray, percent: int = PERCENT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, names): the words that each set emits."""
    for keys, which, _, order, need in all_words(hashes, sizes, percent):
        # where few words hold anything, the empty ones come after them
        begin = np.searchsorted(which, np.arange(len(sizes)))
        keep = np.arange(len(which)) - begin[which] < need
        yield keys[keep], names[which[keep]]


def all_words(hashes: np.ndarray, sizes: np.ndarray, percent: int = PERCENT) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, sets, bands, order, need) of all words of the sets, a band at a time: by set and ``order``, of which a set emits the first ``need`` words.

    Empty words come last, and only for sets with fewer others than they need.
    """
    starts = np.cumsum(sizes) - sizes
    for which, band, places, different in bands(sizes, percent):
        if not len(which):
            continue
        n = sizes[which]
        at = np.repeat(starts[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        own = np.repeat(np.arange(len(which)), n)
        h = hashes[at]
        place = ((h >> np.uint64(20)) % places[own].astype(np.uint64)).astype(np.int64)
        width = int(places.max()) + 1
        slot = own * width + place
        order = np.argsort(slot, kind="stable")
        slot, value = slot[order], mix(h)[order]
        heads = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        word, slot = np.bitwise_xor.reduceat(value, heads), slot[heads]
        set_, at = slot // width, slot % width
        key = mix(word ^ mix((band[set_] << 32 | at).astype(np.uint64))).view(np.int64)
        filled = np.bincount(set_, minlength=len(which))
        poor = np.flatnonzero(filled <= different)
        empty = [np.setdiff1d(np.arange(places[i]), at[set_ == i]) for i in poor]
        own = np.repeat(poor, [len(e) for e in empty])
        free = np.concatenate([*empty, np.zeros(0, np.int64)]).astype(np.int64)
        set_, at = np.concatenate([set_, own]), np.concatenate([at, free + width])
        key = np.concatenate([key, mix(mix((band[own] << 32 | free).astype(np.uint64))).view(np.int64)])
        if len(own):
            order = np.lexsort((at, set_))
            key, set_, at = key[order], set_[order], at[order]
        need = np.where(filled <= different, places, different + 1)
        yield key, which[set_], band[set_], at, need[set_]


def bit_sketches(hashes: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """A parity sketch of each set: a power of two bits, at least twice its size and 64."""
    out, ends = [], np.cumsum(sizes)
    for end, n in zip(ends.tolist(), sizes.tolist(), strict=True):
        m = 1 << max(6, (2 * n - 1).bit_length())
        flips = np.bincount((hashes[end - n : end] >> np.uint64(7)).astype(np.int64) & (m - 1), minlength=m) & 1
        out.append(np.packbits(flips.astype(np.uint8), bitorder="little").tobytes())
    return out


def fold(sketch: np.ndarray, size: int) -> np.ndarray:
    """A bit sketch (bytes) as it would be with only ``size`` bytes."""
    while len(sketch) > size:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def may_link(a: int, b: int, one: bytes, other: bytes, percent: int = PERCENT) -> bool:
    """Whether the sketches of sets of sizes ``a`` and ``b`` allow the similarity."""
    if 100 * min(a, b) < percent * max(a, b):
        return False
    x, y = np.frombuffer(one, np.uint8), np.frombuffer(other, np.uint8)
    size = min(len(x), len(y))
    return int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum()) <= int(most_different(np.int64(a), np.int64(b), percent))


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, node) sorted by both: the different rows of the keys that several nodes have."""
    key, first, last, told = None, None, None, False
    for batch in batches:
        keys, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(keys):
            continue
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
        fresh[0] = key is None or keys[0] != key or nodes[0] != last
        last = nodes[-1]
        keys, nodes = keys[fresh], nodes[fresh]
        if not len(keys):
            continue
        goes_on = key is not None and keys[0] == key
        heads = np.append(True, keys[1:] != keys[:-1])
        run = np.cumsum(heads) - 1
        firsts = nodes[heads]
        if goes_on:
            firsts[0] = first
        other = nodes != firsts[run]
        several = np.bincount(run[other], minlength=len(firsts)) > 0
        own = several.copy()
        if goes_on and told:
            own[0] = False
        told = bool(several[-1]) or (told and goes_on and len(firsts) == 1)
        key, first = keys[-1], firsts[-1]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([keys[other], keys[heads][own]])), pa.array(np.concatenate([nodes[other], firsts[own]]))], ["key", "node"])


def _across(percent: int, nearest: bool):
    """Of rows (key, lo, hi, block, node, component, size, sketch) sorted by the first three: pairs of different components that may link.

    Rows (key, node, star, gap); with ``nearest``, for each node only the star whose sketch is nearest for its size.
    """

    def compare(rows: list[tuple]) -> list[tuple[int, int, int, float]]:
        key, lo, hi = rows[0][:3]
        rows = sorted({r[3:] for r in rows}, key=lambda r: (r[3], r[1]))
        found = []
        size = np.array([r[3] for r in rows])
        for width in sorted({len(r[4]) for r in rows}):
            near = [i for i, r in enumerate(rows) if width <= len(r[4]) <= 2 * width]
            bits = np.stack([fold(np.frombuffer(rows[i][4], np.uint8), width) for i in near]).view(np.uint64)
            which, part = np.array(near), np.array([rows[i][2] for i in near])
            blocks, exact = np.array([rows[i][0] for i in near]), np.array([len(rows[i][4]) == width for i in near])
            for k, i in enumerate(near):
                if not exact[k]:
                    continue
                ok = (part != part[k]) & (100 * np.minimum(size[which], size[i]) >= percent * np.maximum(size[which], size[i])) & (~exact | (which > i))
                if lo != hi:
                    ok &= blocks != blocks[k]
                c = np.flatnonzero(ok)
                if len(c):
                    gap = np.bitwise_count(bits[c] ^ bits[k]).sum(1, dtype=np.int64)
                    for j, g in zip(which[c].tolist(), gap.tolist(), strict=True):
                        if g <= most_different(size[j], size[i], percent):
                            a, b = rows[i][1], rows[j][1]
                            found.append((key, min(a, b), max(a, b), g / (size[i] + size[j])))
        if nearest:
            best: dict[int, tuple] = {}
            for pair in found:
                for end in pair[1:3]:
                    if end not in best or (pair[3], pair) < (best[end][3], best[end]):
                        best[end] = pair
            found = list(dict.fromkeys(best.values()))
        return found

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:3] != held[0][:3]:
                    out += compare(held)
                    held = []
                held.append(row)
            yield _told(out)
        if held:
            yield _told(compare(held))

    return run


def _told(found: list[tuple[int, int, int, float]]) -> pa.RecordBatch:
    columns = zip(*found, strict=True) if found else ((), (), (), ())
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "node", "star", "gap"])


def _pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["node", "star"])


def _verified(words: int, percent: int):
    """Of rows (star, salt, kind, node, text) sorted by the first three: the (node, star) that link. A star's own text has kind 0."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        star, against = None, None
        for batch in batches:
            out = []
            for rows, texts in sub_batches(batch, 4, SUB_BATCH):
                hashes, sizes = shingles(texts, words)
                ends = np.cumsum(sizes)
                stars, kinds, nodes = (rows.column(i).to_numpy() for i in (0, 2, 3))
                for i in range(len(sizes)):
                    own = hashes[ends[i] - sizes[i] : ends[i]]
                    if kinds[i] == 0:
                        star, against = stars[i], own
                    elif star == stars[i]:
                        at = np.minimum(np.searchsorted(against, own), len(against) - 1)
                        common = int((against[at] == own).sum())
                        if 100 * common >= percent * (len(own) + len(against) - common):
                            out.append((int(nodes[i]), int(star)))
            yield _pairs(out)

    return run


def verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The ``pairs`` (node, star) whose sets link, as edges (a, b).

    ``nodes``: (node, __a, __b, copies), the key of a document with that set and how many rows
    have that key. ``docs``: (__a, __b, __text).
    """
    many = pairs.groupBy("star").agg(F.ceil(F.count("*") / SALT).alias("salts"))
    salted = pairs.join(many, "star").withColumn("salt", F.pmod(F.xxhash64("node"), "salts"))
    stars = many.select("star", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("star").alias("node"))
    wanted = stars.unionByName(salted.select("star", "salt", F.lit(1).alias("kind"), "node"))
    wanted = cut(wanted.join(nodes.select("node", "__a", "__b", "copies"), "node").select("__a", "__b", "star", "salt", "kind", "node", "copies"))
    place = ["star", "salt", "kind", "node"]

    def fetch(some: DataFrame) -> DataFrame:
        return join_small(docs, some.drop("copies"), ["__a", "__b"], "inner").select(*place, "__text")

    rows, repeated = fetch(wanted.filter("copies = 1")), wanted.filter("copies > 1")
    if not repeated.isEmpty():  # rows that stand in the table again as they are: one of them is enough
        rows = rows.unionByName(fetch(repeated).groupBy(*place).agg(F.first("__text").alias("__text")))
    dealt = rows.repartition("star", "salt").sortWithinPartitions("star", "salt", "kind")
    return dealt.mapInArrow(_verified(words, percent), "node long, star long").distinct().select(F.col("node").alias("a"), F.col("star").alias("b"))


def _row_key(id_: Column, text: Column) -> tuple[Column, Column]:
    """128 bits that tell rows of different ids or texts apart."""
    return F.xxhash64(id_, text), F.xxhash64(F.lit(1), text, id_)


def _classes(df: DataFrame, id_col: str, text_col: str, words: int, percent: int, name_bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``known``: (id, __a, __b, n, node, ...), a row for each row; ``nodes``: (node, root, least, ...), one for each set; ``parts``: (node, component) of those with links."""
    id_, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    a, b = _row_key(id_, text)
    docs = df.select(id_.alias("__id"), a.alias("__a"), b.alias("__b"), text.alias("__text"))
    mask = np.uint64(2**name_bits - 1)

    def named(hashes: np.ndarray, sizes: np.ndarray, clashing: frozenset[int]) -> np.ndarray:
        return told_apart((set_names(hashes, sizes).view(np.uint64) & mask).view(np.int64), hashes, sizes, clashing)

    def measure(clashing: frozenset[int]):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows, texts in sub_batches(batch, 3, SUB_BATCH):
                    hashes, sizes = shingles(texts, words)
                    columns = [pa.array(sizes), pa.array(named(hashes, sizes, clashing)), pa.array(set_names(hashes, sizes, _CHECK)), pa.array(bit_sketches(hashes, sizes), pa.binary())]
                    yield pa.RecordBatch.from_arrays([*rows.columns[:3], *columns], ["id", "__a", "__b", "n", "node", "check", "sketch"])

        return run

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies next to each other need no rows of their own
        for batch in batches:
            for _, texts in sub_batches(batch, 0, SUB_BATCH):
                hashes, sizes = shingles(texts, words)
                names = named(hashes, sizes, clashing)
                _, first = np.unique(names, return_index=True)
                new = np.zeros(len(names), bool)
                new[[i for i in first if int(names[i]) not in seen]] = True
                if len(seen) > _SEEN:
                    seen.clear()
                seen.update(names[new].tolist())
                for keys, nodes in signatures(hashes[np.repeat(new, sizes)], sizes[new], names[new], percent):
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(nodes)], ["key", "node"])

    clashing: frozenset[int] = frozenset()
    while True:
        known = cut(docs.mapInArrow(measure(clashing), "id long, __a long, __b long, n long, node long, check long, sketch binary"))
        root = F.struct(F.col("id").isNull().alias("none"), "id", "__a", "__b")
        nodes = known.filter("n > 0").groupBy("node").agg(F.min("id").alias("least"), F.min(root).alias("root"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("check").alias("c"), F.max("check").alias("d"))
        nodes = cut(nodes)
        clash = [r["node"] for r in nodes.filter("c <> d").select("node").collect()]  # for N sets about N * N / 2 ** 65 of them
        if not clash:
            break
        clashing |= frozenset(clash)
    again = known.groupBy("__a", "__b").agg(F.count("*").alias("copies")).filter("copies > 1")
    rooted = nodes.select("node", "root.__a", "root.__b")
    rooted = cut(rooted.join(again, ["__a", "__b"], "left").select("node", "__a", "__b", F.coalesce("copies", F.lit(1)).alias("copies")))
    signed = docs.select("__text").mapInArrow(sign, "key long, node long")
    groups = cut(signed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_groups, "key long, node long"))
    sized, texts = nodes.select("node", "n", "sketch"), docs.select("__a", "__b", "__text")

    def linked(pairs: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """Components by those of ``pairs`` that link, and by the components known before, which are stars already."""
        edges = cut(verify(pairs, rooted, texts, words, percent))
        return cut(components(edges if known is None else edges.union(known.select(F.col("node").alias("a"), F.col("component").alias("b")))))

    # what others were copied from shares words with the most others: it is the hub of its groups
    weights = groups.join(groups.groupBy("key").agg(F.count("*").alias("m")), "key").groupBy("node").agg(F.sum("m").alias("w"))
    weighed = cut(groups.join(weights, "node"))
    hubs = weighed.groupBy("key").agg(F.max_by("node", F.struct("w", "node")).alias("star"))
    often = weighed.join(hubs, "key").filter("node <> star").groupBy("node", "star").agg(F.count("*").alias("hits"))
    best = often.groupBy("node").agg(F.max_by("star", F.struct("hits", "star")).alias("star"))
    both = best.join(sized, "node").join(sized.select(F.col("node").alias("star"), F.col("n").alias("m"), F.col("sketch").alias("other")), "star")

    def sift(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            yield _pairs([(a, b) for a, b, n, m, x, y in zip(*columns, strict=True) if may_link(n, m, x, y, percent)])

    first = both.select("node", "star", "n", "m", "sketch", "other").mapInArrow(sift, "node long, star long")
    tested = cut(first.select(F.least("node", "star").alias("node"), F.greatest("node", "star").alias("star")).distinct())
    parts = linked(tested)

    def across(keys: DataFrame, nearest: bool, most: int | None = None) -> DataFrame:
        """Pairs of different components in the groups ``keys``, those of more than ``most`` nodes left out."""
        placed = cut(keys.join(parts, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")))
        mixed = placed.groupBy("key").agg(F.min("component").alias("c"), F.max("component").alias("d"), F.count("*").alias("m")).filter("c <> d")
        mixed = mixed.filter(F.col("m") <= (most or 1 << 62)).select("key", F.ceil(F.col("m") / BLOCK).alias("blocks"))
        own = join_small(placed, cut(mixed), ["key"], "inner").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
        spread = own.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        spread = spread.join(sized, "node").select("key", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "node", "component", "n", "sketch")
        return cut(spread.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(_across(percent, nearest), "key long, node long, star long, gap double").distinct())

    def rarer(nodes_: DataFrame, hot: DataFrame) -> DataFrame:
        """Groups of ``nodes_`` by other words: those in ``hot`` groups, and others as frequent among these nodes, come last.

        Any order of the words that all sets share serves the pigeonhole principle as well as that of their places.
        """

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows, some in sub_batches(batch, 1, SUB_BATCH):
                    hashes, sizes = shingles(some, words)
                    own = rows.column(0).to_numpy()
                    for key, set_, band, order, need in all_words(hashes, sizes, percent):
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own[set_]), pa.array(band), pa.array(order), pa.array(need)], ["key", "node", "band", "place", "need"])

        wanted = cut(nodes_.join(rooted, "node").select("node", "__a", "__b"))
        held = join_small(texts, wanted, ["__a", "__b"], "inner").select("node", "__text")
        every = cut(held.mapInArrow(run, "key long, node long, band long, place long, need long").distinct())  # rows that repeat are one
        often = every.groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > HOT).select("key")
        late = cut(often.union(hot).distinct().withColumn("late", F.lit(1)))
        rank = F.row_number().over(Window.partitionBy("node", "band").orderBy(F.col("late").asc_nulls_first(), "place"))
        first = join_small(every, late, ["key"], "left").withColumn("rank", rank).filter("rank <= need").select("key", "node")
        return cut(first.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_groups, "key long, node long"))

    found = across(groups, True, HOT)
    if not found.isEmpty():
        ends = found.select("node", "star", "gap").union(found.select(F.col("star"), F.col("node"), "gap")).toDF("node", "star", "gap")
        near = ends.groupBy("node").agg(F.min_by("star", F.struct("gap", "star")).alias("star"))
        near = near.select(F.least("node", "star").alias("node"), F.greatest("node", "star").alias("star")).distinct()
        near = cut(near.join(tested, ["node", "star"], "left_anti"))
        parts, tested = linked(near, parts), tested.union(near)
        rest = across(groups.join(found.select("key").distinct(), "key", "left_semi"), False, HOT)
        rest = cut(rest.select("node", "star").distinct().join(tested, ["node", "star"], "left_anti"))
        if not rest.isEmpty():
            parts, tested = linked(rest, parts), tested.union(rest)
    large = cut(groups.groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > HOT).select("key"))
    if not large.isEmpty():
        within = join_small(groups, large, ["key"], "inner").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = within.groupBy("key").agg(F.min("component").alias("c"), F.max("component").alias("d")).filter("c <> d").select("key")
        hot = cut(mixed)
        if not hot.isEmpty():
            others = rarer(join_small(groups, hot, ["key"], "inner").select("node").distinct(), hot)
            rest = across(others, False).select("node", "star").distinct()
            rest = cut(rest.join(tested, ["node", "star"], "left_anti"))
            if not rest.isEmpty():
                parts = linked(rest, parts)
    return known, nodes, parts


def cluster(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, name_bits: int = 64) -> DataFrame:
    """``id_col``, ``n_shingles`` and ``component_id``, the least id that links (of similarity ``percent`` or more) reach.

    Empty and null texts have no shingles and are linked with nothing, their component is their
    own id. Rows with the same id and different texts are documents of their own; rows with a
    null id link like any others, but a null is a component's name only if all its ids are null.
    Other columns are left out; an empty table gives an empty table.
    """
    known, nodes, parts = _classes(df, id_col, text_col, words, percent, name_bits)
    named = parts.join(nodes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("all"))
    in_parts = parts.join(named, "component").select("node", "all")
    names = nodes.select("node", "least").join(in_parts, "node", "left").select("node", F.coalesce("all", "least").alias("name"))
    answer = known.select("id", "n", "node").join(names, "node", "left")
    return answer.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("id")).alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``df``, but of those that links join only one of the least id (null ids last), all columns.

    Rows are told apart by id and text together; of rows with both alike one stays. Texts without shingles stay.
    """
    known, nodes, parts = _classes(df, id_col, text_col, words, percent, 64)
    rooted = nodes.select("node", "root").join(parts, "node", "left").select("node", "root", F.coalesce("component", "node").alias("component"))
    first = rooted.groupBy("component").agg(F.min("root").alias("stays"))
    stays = cut(rooted.join(first, "component").select("node", "stays.__a", "stays.__b").withColumnsRenamed({"__a": "x", "__b": "y"}))
    rows = known.filter("n > 0").select("node", "__a", "__b").join(stays, "node")
    gone = cut(rows.filter("__a <> x OR __b <> y").select("__a", "__b").distinct())
    again = cut(known.groupBy("__a", "__b").agg(F.count("*").alias("copies")).filter("copies > 1").select("__a", "__b").join(gone, ["__a", "__b"], "left_anti"))
    inner = {c: fresh(df, c) for c in ("__a", "__b")}
    a, b = _row_key(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    keyed, on = df.withColumns({inner["__a"]: a, inner["__b"]: b}), list(inner.values())
    left = join_small(keyed, gone.withColumnsRenamed(inner), on, "left_anti")
    again = again.withColumnsRenamed(inner)
    if not again.isEmpty():
        left = join_small(left, again, on, "left_anti").unionByName(join_small(left, again, on, "left_semi").dropDuplicates(on))
    return left.drop(*on)
